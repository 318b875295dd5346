"""Divergence of the sources of a language, by count-level bitmaps.

Each (lang, source) group has a smoothed share p for every kept term of its language, which depends
on the group and the term's count there alone. Terms get ids in the order of their frequency; for each
group, count and stretch of 64 ids a bitmap holds the terms with that count. AND and popcount of two
groups' bitmaps give the number of terms in each joint cell of counts, which is multiplied by the cell's f.

A count of zero has no bitmap: cells with a zero are the complement. With z for the zero level,
n(a, b) the popcounts and n(a), n(b) the sizes of levels, the sum over all V kept terms is

    sum n(a,b) (f(a,b) - f(a,z) - f(z,b) + f(z,z)) + sum n(a) (f(a,z) - f(z,z)) + sum n(b) (f(z,b) - f(z,z)) + V f(z,z)

so that only levels which occur meet, and all is exact in whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize, prepare, runs

#: Bytes that terms consist of: letters (A-Z become a-z) and all that is not ASCII; the rest separates.
TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
UNIT = 1_000_000_000
#: Bytes of text that are split at a time, and counts that a task holds before it hands them on.
STRETCH, HELD = 1 << 20, 400_000
#: Groups of one tile; a language with more has pairs of tiles, each a unit of work.
TILE = 256


def _stretches(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text whose separators are blanks, some at a time; cuts fall on blanks."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut if cut > at else text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end + 1 if end < len(text) else end


def _counted(counts: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (words, docs) in counts.items():
        terms = list(words)
        for low in range(0, len(terms), 1 << 15):
            some = terms[low : low + (1 << 15)]
            columns = [[lang] * len(some), [source] * len(some), pa.array(some, pa.binary()).cast(pa.string()), [words[t] for t in some], [docs[t] for t in some]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), columns[2], pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, summed up as far as memory is meant to hold them."""
    counts: dict = {}
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words, docs = counts.get((lang, source)) or counts.setdefault((lang, source), (Counter(), Counter()))
            seen: set = set()
            for some in _stretches(text.as_buffer().to_pybytes().translate(TERMS)):
                words.update(some)
                seen.update(some)
            docs.update(seen)
        if sum(len(words) for words, _ in counts.values()) > HELD:
            yield from _counted(counts)
            counts = {}
    yield from _counted(counts)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(n: Column, words: Column, terms: Column) -> Column:
    """p of a count n: 1 + floor(10^9 (n + 2) / (words + 2 terms)), by decimals, which no count overflows; 1 without terms."""
    exact = _div((n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (words + 2 * terms).cast("decimal(20,0)"))
    return F.when(terms > 0, exact + 1).otherwise(F.lit(1).cast("long"))


def _gap(p: Column, q: Column) -> Column:
    """f of two shares: floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so longs hold the square."""
    return _div((p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _cells(table: pa.Table, sums: dict) -> None:
    """Adds one stretch's joint cells of every two groups (of the two tiles): AND, popcount, times the cell's f less what its zeros count."""
    lang, low, high = (table.column(k)[0].as_py() for k in ("lang", "low", "high"))
    names, group = np.unique(table.column("source").to_numpy(zero_copy_only=False), return_inverse=True)
    order = np.argsort(group, kind="stable")
    group = group[order]
    bits, p, zero, tile = (table.column(k).to_numpy()[order] for k in ("bits", "p", "zero", "tile"))
    bits = bits.view(np.uint64)
    found = np.zeros((len(names), len(names)), np.int64)
    for at in range(0, len(bits), step := max(1, (1 << 20) // len(bits))):
        rows = slice(at, at + step)
        common = np.bitwise_count(bits[rows, None] & bits[None])
        common[group[rows, None] >= group[None]] = 0  # each two groups once, in the order of their names
        if low != high:
            common[tile[rows, None] == tile[None]] = 0
        i, j = np.nonzero(common)
        n, i = common[i, j].astype(np.int64), i + at
        value = _f(p[i], p[j]) - _f(p[i], zero[j]) - _f(zero[i], p[j]) + _f(zero[i], zero[j])
        np.add.at(found, (group[i], group[j]), n * value)
    for i, j in zip(*np.nonzero(found)):
        key = (lang, names[i], names[j])
        sums[key] = sums.get(key, 0) + int(found[i, j])


def _summed(sums: dict) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in sums], pa.string()) for i in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "item", "value"])


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict = {}
    for table in runs(batches, ["lang", "word", "low", "high"]):
        _cells(table, sums)
        if len(sums) > HELD:
            yield _summed(sums)
            sums = {}
    yield _summed(sums)


def _dealt(df: DataFrame, tiles: int) -> DataFrame:
    """Each row with every pair (low, high) of tiles that its own ``tile`` is in."""
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))) if tiles > 1 else F.lit(0)
    return df.withColumn("other", other).withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("other")


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each (lang, source) group is from the others of its language, and in which terms.

    Null lang, source and text are empty. Terms are runs of letters and signs beyond ASCII, A-Z
    lower-cased; each language keeps those in at least ``least_docs`` of its rows. With n a term's count and N the
    sum of counts over the V kept terms, p = 1 + floor(10^9 (n + 2) / (N + 2V)), and f = floor((p - q)^2 / (p + q)).
    Part ``pair`` has for each other source of the language the sum of f over all kept terms (0 without any), part ``term`` the
    ``top`` terms whose share in the group is above the language's. Groups without terms count as zeros all over;
    a language of one source has no pairs; repeated rows count as documents each; an empty table gives an empty result.

    Sources meet in tiles of 256, so rows are sent once per tile; the result itself has a row for every two sources of a language.
    """
    prepare(docs.sparkSession)
    lang, source = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))
    rows = docs.select(lang, source, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counts = rows.mapInArrow(lean(_count), "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("of"))
    terms = terms.where(F.col("docs") >= least_docs).drop("docs")
    # alike frequencies lie in one stretch of ids, where few counts occur
    terms = terms.repartitionByRange("lang", F.desc("n"), "term").sortWithinPartitions("lang", F.desc("n"), "term")
    terms = materialize(terms.withColumn("id", F.monotonically_increasing_id()), "terms")

    each = terms.select("lang", "term", "id", F.col("n").alias("lang_n"), F.explode("of").alias("x")).select("lang", "term", "id", "lang_n", "x.*")
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_words"))
    groups = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(each.groupBy("lang", "source").agg(F.sum("n").alias("words")), ["lang", "source"], "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("terms", "lang_words", "words")])
    groups = materialize(groups.withColumn("zero", _share(F.lit(0), F.col("words"), F.col("terms"))), "groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    tiles = max(1, math.ceil(most / TILE))
    groups = groups.withColumn("tile", F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int"))

    word, bit = F.shiftright("id", 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(63).cast("int"))
    levels = each.groupBy("lang", "source", word.alias("word"), "n").agg(F.bit_or(bit).alias("bits"))
    levels = levels.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("words"), F.col("terms")))
    levels = materialize(levels.select("lang", "source", "word", "bits", "p", "zero", "tile"), "bitmaps")
    keys = ["lang", "word", "low", "high"]
    joint = _dealt(levels, tiles).repartition(*keys).sortWithinPartitions(*keys).select("source", "bits", "p", "zero", "tile", *keys)
    joint = joint.mapInArrow(lean(_joint), "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("joint"))

    own = [F.col(c) for c in ("lang", "source", "terms", "zero", "tile")]
    other = _dealt(groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), "tile"), tiles).withColumnRenamed("tile", "item_tile")
    pairs = _dealt(groups.select(*own), tiles).join(other, ["lang", "low", "high"]).where("source <> item")
    if tiles > 1:  # two groups of one tile meet under their own tile alone
        pairs = pairs.where("low = high or tile <> item_tile")
    pairs = materialize(pairs.select("lang", "source", "item", "terms", "zero", "item_zero"), "pairs")
    sizes = levels.groupBy("lang", "source", "p").agg(F.sum(F.bit_count("bits")).alias("n"))
    alone = sizes.join(pairs, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (_gap(F.col("p"), F.col("item_zero")) - _gap(F.col("zero"), F.col("item_zero")))).alias("alone"))
    half = pairs.join(alone, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("alone", F.lit(0)).alias("alone"), (F.col("terms") * _gap(F.col("zero"), F.col("item_zero"))).alias("none"))
    first = half.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), "alone", "none")
    whole = first.groupBy("lang", "source", "item").agg(F.sum("alone").alias("alone"), F.min("none").alias("none")).join(joint, ["lang", "source", "item"], "left")
    whole = whole.select("lang", "source", "item", (F.col("alone") + F.col("none") + F.coalesce("joint", F.lit(0))).alias("value"))
    whole = whole.unionByName(whole.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    part = lambda name: F.lit(name).alias("part")
    pair = whole.select("lang", "source", part("pair"), "item", "value", place.alias("rank"))

    p, q = _share(F.col("n"), F.col("words"), F.col("terms")), _share(F.col("lang_n"), F.col("lang_words"), F.col("terms"))
    term = each.join(groups.drop("tile"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    term = term.select("lang", "source", "item", _gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", place).where(F.col("rank") <= top)
    return pair.unionByName(term.select("lang", "source", part("term"), "item", "value", "rank"))
