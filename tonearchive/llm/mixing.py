"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``most`` copies, as close as possible (in relative
entropy to one copy, bounded above) to being taken once, such that each source's words add
up to its target. The dual problem has one multiplier per source; rates are the source's
exponential tilt of the document's size. Newton steps on the dual run over the histogram of
sizes, as Spark aggregates. Rates are then rounded to copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, materialize, numbered

#: Bins of the rounding thresholds of one source.
BINS = 4096
STEPS = 60
#: Sources up to which a table of one row per source is broadcast; with more it is joined by key.
FEW = 20_000
#: Multiples of it spread evenly over [0, 1).
GOLDEN = 0.6180339887498949


def _level(sources: DataFrame, most: float) -> float:
    """The words per unit of weight at which sources below their limit together take what the limits leave.

    Sources found above their limit stay there; the rest is shared anew until none is above.
    """
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("source_size") * most
        row = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("source_size") * most)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.count_if(above).alias("capped")
        ).first()
        if row["capped"] == capped or not row["weight"]:
            return level
        capped, level = row["capped"], ((row["all"] or 0) - (row["held"] or 0)) / row["weight"]


def _rate(size: Column, most: float) -> Column:
    """Copies per document at the source's multiplier: 1 at multiplier 0, and all or nothing at the ends."""
    tilt = F.exp(F.least(F.lit(700.0), F.greatest(F.lit(-700.0), -F.col("multiplier") * size / F.col("mean"))))
    return F.when(F.col("target") >= F.col("source_size") * most, F.lit(float(most))).when(F.col("target") <= 0, F.lit(0.0)).otherwise(most / (1 + (most - 1) * tilt))


def _apart(rows: DataFrame) -> DataFrame:
    """Rows that repeat (``h``) get thresholds ``u`` spread evenly from their common one, as they are interchangeable; the others keep theirs.

    Repeats are numbered within the partitions that they were written from, whose counts are
    then summed up: one row with many repeats does not meet in one task.
    """
    repeats = materialize(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeats")
    if not repeats.head(1):
        return rows
    small = F.broadcast if repeats.count() <= FEW else lambda table: table.hint("merge")
    again = rows.join(small(repeats), "h", "left_semi")
    counts = again.groupBy("h", "part").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("h", "part").orderBy("size")) - 1
    numbered = again.withColumn("nth", nth).join(counts.select("h", "part", base.alias("base")), ["h", "part"])
    spread = F.pmod(F.col("u") + (F.col("nth") + F.col("base")) * GOLDEN, F.lit(1.0))
    return rows.join(small(repeats), "h", "left_anti").unionByName(numbered.withColumn("u", spread).select(*rows.columns))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, rate, copies, taken (copies x size), and the columns of ``carry`` in ``carried``.

    Size is the number of words. Sources rank by code point, the null source last, and take
    ``weights`` in turn; together they share ``share`` of all words, but none more than
    ``most`` times its own, what is over being shared anew by weight. No document is copied
    more than ``most`` times. Rounding depends on doc_id, text, source and what is carried, so reruns agree;
    of rows that repeat in all of these, as many are rounded up as their rate asks. Null texts have size 0 and a copy or none like any
    other. An empty table gives an empty result.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD_RE)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    carried = F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carried")
    rows = materialize(docs.select("doc_id", "source", carried, key.alias("key"), size.alias("size"), F.xxhash64("doc_id", "text", key, *[F.col(c) for c in carry]).alias("h"), F.spark_partition_id().alias("part")), "sizes")
    rows = _apart(rows.withColumn("u", F.pmod("h", F.lit(1 << 32)) / float(1 << 32)))
    counts = materialize(rows.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "histogram")

    sources = counts.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    sources = numbered(sources, [F.col("source").asc_nulls_last()], "rank", "ranks")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", weight).drop("rank").withColumn("source_size", F.col("source_size").cast("double") * share), "sources")
    small = F.broadcast if sources.count() <= FEW else lambda table: table
    level = _level(sources, most / share)
    sources = sources.withColumn("target", F.least(F.col("weight") * level, F.col("source_size") / share * most)).withColumn("source_size", F.col("source_size") / share)
    mean = F.greatest(F.col("source_size") / F.col("documents"), F.lit(1e-9))
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    state = sources.select("key", "source_size", "target", mean.alias("mean"), F.lit(0.0).alias("multiplier"), low.alias("low"), high.alias("high"))
    state = materialize(state.withColumn("off", F.lit(1.0)), "state")

    for _ in range(STEPS):
        x, r = F.col("size") / F.col("mean"), _rate(F.col("size"), most)
        sums = counts.join(small(state.select("key", "source_size", "target", "mean", "multiplier")), "key").groupBy("key").agg(
            F.sum(F.col("n") * x * r).alias("words"), F.sum(F.col("n") * x * x * r * (1 - r / most)).alias("slope")
        )
        gap = F.col("words") - F.col("target") / F.col("mean")
        state = state.join(sums, "key").withColumn("gap", gap)
        state = state.withColumn("low", F.when(F.col("gap") < 0, F.col("multiplier")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("gap") > 0, F.col("multiplier")).otherwise(F.col("high")))
        newton = F.col("multiplier") - F.col("gap") / F.greatest("slope", F.lit(1e-300))
        reach = 2 * F.abs("multiplier") + 1  # a step is bounded, and kept between the signs seen
        newton = F.least(F.greatest(newton, F.col("multiplier") - reach), F.col("multiplier") + reach)
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        off = F.abs("gap") * F.col("mean") / F.greatest("target", F.lit(1.0))
        ends = (F.col("target") >= F.col("source_size") * most) | (F.col("target") <= 0)
        state = state.withColumn("off", F.when(ends, F.lit(0.0)).otherwise(off)).withColumn("multiplier", F.when(ends | (F.col("off") < 1e-9), F.col("multiplier")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2))
        state = materialize(state.drop("words", "slope", "gap"), "state")
        if (state.agg(F.max("off")).first()[0] or 0.0) < 1e-6:
            break

    rated = rows.join(small(state.select("key", "source_size", "target", "mean", "multiplier")), "key").withColumn("rate", _rate(F.col("size"), most))
    rated = rated.withColumn("aim", F.col("rate") + F.col("u")).withColumn("copies", F.least(F.floor("aim"), F.lit(most)))
    spare = materialize(rated.groupBy("key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("spare")), "spare")
    # what rounding missed is made up by the documents nearest to being rounded the other way
    rated = rated.join(small(spare), "key").withColumn("part", F.col("aim") - F.floor("aim"))
    able = (F.col("size") > 0) & F.when(F.col("spare") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    near = F.when(F.col("spare") > 0, 1 - F.col("part")).otherwise(F.col("part"))
    rated = rated.withColumn("bin", F.when(able, F.least(F.floor(near * BINS), F.lit(BINS - 1))))
    bins = rated.where("bin is not null").groupBy("key", "bin").agg(F.sum("size").alias("mass"), F.max(F.abs("spare")).alias("spare"))
    upto = F.sum("mass").over(Window.partitionBy("key").orderBy("bin"))
    cut = bins.withColumn("over", upto - F.col("mass") / 2 <= F.col("spare")).where("over").groupBy("key").agg(F.max("bin").alias("cut"))
    rated = rated.join(small(cut), "key", "left")
    moved = F.coalesce(F.col("bin") <= F.col("cut"), F.lit(False))
    copies = (F.col("copies") + F.when(moved, F.signum("spare")).otherwise(F.lit(0))).cast("long")
    return rated.select("doc_id", "size", "source", F.col("source_size").cast("long").alias("source_size"), "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "carried")
