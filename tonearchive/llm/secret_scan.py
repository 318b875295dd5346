"""Secret scan by built-in functions alone: strong patterns, and weak parts linked into multipart credentials.

A weak part (a short access identifier or assigned id, a short assigned secret, an endpoint)
means little alone. It is reported only where complementary parts stand within ``SCOPE``
characters: an id needs a secret, a secret an id, an endpoint both. Strong findings count as
parts too. Parts are joined by overlapping intervals, dealt by document and stretch of text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCOPE = 256
_JOIN = r"""["']?\x20*[:=]\x20*["']?"""
# Strong patterns (fixed values of the contract).
ASSIGN = rf"(?i:password|passwd|secret|token|api_?key){_JOIN}([A-Za-z0-9+/_.=-]+)"
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{16,})"
# Weak parts.
SHORT_ID = rf"(?:\b(?:AKIA|ASIA)[A-Z0-9]+|\b(?i:access_?key_?id|client_?id|account_?id|user_?name|user|login){_JOIN}[A-Za-z0-9+/_.@-]+)"
SHORT_SECRET = rf"\b(?i:password|passwd|pwd|secret_?access_?key|client_?secret|secret|token|api_?key|private_?key){_JOIN}[A-Za-z0-9+/_.=-]+"
ENDPOINT = rf"(?:\bhttps?://[A-Za-z0-9.-]+[^\s\"'<>]*|\b(?i:endpoint|host|server|base_?url){_JOIN}[A-Za-z0-9._:/-]+)"
#: Kinds by rank: strong ones as the contract lists them, then this scan's own.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
_SPANS = "array<struct<start:long,rank:int,end:long>>"


#: Elements of an array that are summed up together.
STRIDE = 32


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of longs what ``join`` makes of 0 and all before it; strides are joined first, so long arrays take no quadratic time."""
    fold = lambda part: F.aggregate(part, F.lit(0).cast("long"), join)

    def over(all_: Column) -> Column:
        strides = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(all_) - 1) / STRIDE).cast("int"))
        totals = F.transform(strides, lambda k: fold(F.slice(all_, k * STRIDE + 1, STRIDE)))
        heads = F.aggregate(totals, F.array(F.lit(0).cast("long")), lambda done, t: F.concat(done, F.array(join(F.element_at(done, -1), t))))
        each = lambda h: F.transform(all_, lambda _, i: join(F.element_at(h, (i / STRIDE).cast("int") + 1), fold(F.slice(all_, (i - i % STRIDE) + 1, i % STRIDE))))
        return _let(heads, each)

    return _let(values, over)


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Places of the leftmost non-overlapping matches whose ``group`` has ``least`` characters or more.

    The text between matches and the matches themselves give the places by their lengths.
    Texts without a match are told apart first, by one pass.
    """
    regex, rank = F.lit(pattern), KINDS.index(kind)
    matches = F.arrays_zip(F.regexp_extract_all(text, regex, 0).alias("all"), F.regexp_extract_all(text, regex, group).alias("part"))
    sized = F.zip_with(
        matches,
        F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap).cast("long")),
        lambda m, gap: F.struct(gap.alias("gap"), F.length(m["all"]).cast("long").alias("size"), (F.length(m["part"]) >= least).alias("ok")),
    )

    def placed(all_: Column) -> Column:  # the last gap has no match after it
        before = _running(F.transform(all_, lambda m: m["gap"] + F.coalesce(m["size"], F.lit(0))), lambda a, b: a + b)
        each = F.zip_with(all_, before, lambda m, at: F.struct((at + m["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + m["gap"] + m["size"]).alias("end"), m["ok"].alias("ok")))
        return F.transform(F.filter(each, lambda s: F.coalesce(s["ok"], F.lit(False))), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))

    found = _let(sized, placed).cast(_SPANS)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def _texts(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def _stretches(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / SCOPE), F.floor(end / SCOPE)))


def _parts(found: DataFrame) -> DataFrame:
    """row, start, rank, end of the strong and weak matches of each row, without weak ones that overlap a strong one: these are the same thing."""
    part = found.where(F.size("weak") > 0).select("row", F.explode(F.concat("strong", "weak")).alias("s")).select("row", "s.*")
    strong, weak = part.where(F.col("rank") <= KINDS.index("hex")), part.where(F.col("rank") > KINDS.index("hex"))
    spread = lambda rows: rows.select("*", _stretches(F.col("start"), F.col("end")).alias("stretch"))
    over = (F.col("w.row") == F.col("s.row")) & (F.col("w.stretch") == F.col("s.stretch")) & (F.col("w.start") < F.col("s.end")) & (F.col("s.start") < F.col("w.end"))
    covered = spread(weak).alias("w").join(spread(strong).alias("s"), over, "left_semi").select("row", "start", "rank", "end").distinct()
    return strong.unionByName(weak.join(covered, ["row", "start", "rank", "end"], "left_anti"))


def _linked(found: DataFrame) -> DataFrame:
    """row, linked: the weak parts of each row that have their complements within the scope."""
    rank = {k: i for i, k in enumerate(KINDS)}
    part = _parts(found)
    role = F.when(F.col("rank").isin(rank["access"], rank["id"]), "id").when(F.col("rank") == rank["endpoint"], "endpoint").otherwise("secret")
    part = part.withColumn("role", role)
    # a part can be met from anywhere within its interval widened by the scope
    reach = F.sequence(F.floor((F.col("start") - SCOPE) / SCOPE), F.floor((F.col("end") + SCOPE) / SCOPE))
    near = part.where("role <> 'endpoint'").select("row", "role", F.col("start").alias("a"), F.col("end").alias("b"), F.explode(reach).alias("stretch"))
    weak = part.where(F.col("rank") > rank["hex"])
    own = _stretches(F.col("start"), F.col("end"))

    def meets(which: DataFrame, wanted: str) -> DataFrame:
        which = which.select("row", "start", "rank", "end", own.alias("stretch"))
        other = near.where(F.col("role") == wanted).select("row", "stretch", "a", "b")
        close = (F.col("w.row") == F.col("o.row")) & (F.col("w.stretch") == F.col("o.stretch")) & (F.col("o.a") - F.col("w.end") <= SCOPE) & (F.col("w.start") - F.col("o.b") <= SCOPE)
        # a part can meet in several stretches, and its complements in different ones
        return which.alias("w").join(other.alias("o"), close, "left_semi").select("row", "start", "rank", "end").distinct()

    ids, secrets = meets(weak.where("role = 'id'"), "secret"), meets(weak.where("role = 'secret'"), "id")
    ends = meets(meets(weak.where("role = 'endpoint'"), "id"), "secret")
    return ids.unionByName(secrets).unionByName(ends).groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked"))


def find_secrets(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, strong and linked (arrays of start, rank of kind, end), and the columns of ``carry`` in ``carried``.

    Places are code points, ends exclusive. Null and empty texts have no spans. Repeated rows
    and rows without doc_id stay, each judged by its own text; an empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    strong = F.concat(_spans(text, ASSIGN, "assign", 1, 12), _spans(text, ACCESS, "access", 1, 18), _spans(text, HEX, "hex", 1, 16))
    # without any id no part can be linked
    weak = F.concat(_spans(text, SHORT_ID, "id"), _spans(text, SHORT_SECRET, "secret"), _spans(text, ENDPOINT, "endpoint"))
    weak = F.when(text.rlike(f"{ACCESS}|{SHORT_ID}"), weak).otherwise(F.array().cast(_SPANS))
    found = docs.select("doc_id", F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carried"), strong.alias("strong"), weak.alias("weak"))
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "spans")
    linked = _linked(found.select("row", "strong", "weak"))
    # only rows with weak parts meet their links; the others, nearly all, are not dealt anew
    some = found.where(F.size("weak") > 0).join(linked, "row", "left").select("doc_id", "strong", F.coalesce("linked", F.array().cast(_SPANS)).alias("linked"), "carried")
    return some.unionByName(found.where(F.size("weak") == 0).select("doc_id", "strong", F.array().cast(_SPANS).alias("linked"), "carried"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("strong", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return find_secrets(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_texts(F.col("strong")), 256).alias("base_sha256"), _texts(F.concat("strong", "linked")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same columns, every strong or linked span of ``text`` replaced by a mark; null texts stay null."""
    found = find_secrets(docs, tuple(docs.columns))
    text = F.col("carried.text")
    # four bytes a character: a piece is cut out without counting from the start
    part = lambda wide, a, b: F.decode(F.substring(wide, (4 * a + 1).cast("int"), (4 * (b - a)).cast("int")), "UTF-32")

    def marked(given: Column) -> Column:
        before = _running(F.transform(given["spans"], lambda s: s["end"]), lambda a, b: F.greatest(a, b))  # how far earlier spans reach
        pieces = F.zip_with(given["spans"], before, lambda s, at: F.when(s["start"] >= at, F.concat(part(given["wide"], at, s["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), part(given["wide"], F.array_max(F.transform(given["spans"], lambda s: s["end"])), given["n"]))

    given = F.struct(F.array_sort(F.concat("strong", "linked")).alias("spans"), F.encode(text, "UTF-32").alias("wide"), F.length(text).cast("long").alias("n"))
    clean = F.when((F.size(F.concat("strong", "linked")) == 0) | text.isNull(), text).otherwise(_let(given, marked))
    return found.select(*[clean.alias("text") if c == "text" else F.col("carried")[c].alias(c) for c in docs.columns])
