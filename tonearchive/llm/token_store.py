"""Token ids of a corpus in files that give any token without decoding a block.

A store is an uncompressed Parquet table with one row per document: ``part`` (range of
doc_id), ``first`` and ``last`` (the document's places in the part), ``doc_id``, and
``codes``, its ids as directly addressable codes (see ``dac``). Documents lie in ascending
doc_id order over parts and within one, and pages are small, so that the place of a token
leads to the pages of one document, and there to the few bytes that hold the token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dac
from .common import documents, partitions, prepare
from .tokens import encoder, gathered

#: Characters of a part's texts, bytes of a page.
PART_TEXT, PAGE = 16 << 20, 64 << 10
#: Parts that are summed up together, and up to which a table of one row per part is broadcast (24 bytes each).
GROUP, FEW = 1024, 200_000
#: Folder beside the rows with a row per part; readers of the rows pass over its name.
TOTALS = "_totals"
_ROWS = "part int, first long, last long, doc_id long, codes binary"


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in gathered(batches):
            ids, ends = encoder(path).encode(batch.column("text"))
            starts = np.append(0, ends[:-1])
            codes = [dac.encode(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            columns = [pa.array(np.full(len(ends), part, np.int32)), pa.array(before + starts), pa.array(before + ends - 1), batch.column("doc_id"), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "first", "last", "doc_id", "codes"])
            before += len(ids)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, to: str) -> None:
    """Encode every whole text (null: empty), end it with id 1, and write the store ``to``.

    Rows without doc_id come last; rows that share a doc_id lie together, in an order set
    by their texts. An empty table gives a store without rows.
    """
    prepare(docs.sparkSession)
    docs = documents(docs)
    characters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    dealt = docs.repartitionByRange(max(partitions(docs.sparkSession), characters // PART_TEXT), *order).sortWithinPartitions(*order)
    # small uncompressed pages: a page is what a reader fetches at least
    pages = {"compression": "none", "parquet.page.size": str(PAGE), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16", "parquet.enable.dictionary": "false"}
    dealt.mapInArrow(_write(tokenizer), _ROWS).write.options(**pages).parquet(to)
    _bases(_rows(docs.sparkSession, to).select("part", "last")).coalesce(1).write.parquet(f"{to}/{TOTALS}")


def _read(ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = []
            for codes in batch.column("codes").to_pylist():
                sequence = dac.Sequence(codes)
                pieces.append(sequence.slice(0, len(sequence)).astype("<u4").tobytes())
            columns = [batch.column("doc_id"), batch.column("start"), pa.array([len(p) // 4 for p in pieces], pa.int64()), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(pieces, pa.binary())] * ids_too, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids_too])

    return run


def _bases(rows: DataFrame) -> DataFrame:
    """part, base (ids of all parts before it), n: summed within groups of parts, then over the groups' totals."""
    sizes = rows.groupBy("part").agg((F.max("last") + 1).alias("n")).withColumn("group", F.floor(F.col("part") / GROUP))
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each GROUP parts: a 16 GB text each
    groups = sizes.groupBy("group").agg(F.sum("n").alias("n"), F.min("part").alias("part"))
    groups = groups.select("group", before().alias("base"))
    return sizes.withColumn("own", before("group")).join(groups, "group").select("part", (F.col("base") + F.col("own")).alias("base"), "n")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROWS).parquet(path)


def _totals(spark: SparkSession, path: str) -> DataFrame:
    """part, base, n as they were summed up when the store was written."""
    return spark.read.schema("part int, base long, n long").parquet(f"{path}/{TOTALS}")


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Per document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids (unsigned 32 bits each, little endian).

    Repeated rows and rows without doc_id are documents like any other; an empty store gives none.
    """
    prepare(spark)
    rows, totals = _rows(spark, path), _totals(spark, path)
    bases, few = totals.select("part", "base"), totals.limit(FEW + 1).count() <= FEW
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    placed = rows.join(F.broadcast(bases) if few else bases.hint("merge"), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "codes")
    return placed.mapInArrow(_read(ids), kind)


def token_row(spark: SparkSession, path: str, place: int) -> DataFrame | None:
    """The stored row that holds one place of the whole store, and ``at``, the place in it.

    The totals written beside the store tell the part; ``first`` and ``last`` are then compared within the files' statistics,
    by file part and page, so that of ``codes`` the pages of one document are fetched.
    """
    rows = _rows(spark, path)
    part = _totals(spark, path).where((F.col("base") <= place) & (F.col("base") + F.col("n") > place)).first()
    if part is None:
        return None
    within = place - part["base"]
    return rows.where((F.col("part") == part["part"]) & (F.col("first") <= within) & (F.col("last") >= within)).select("codes", (F.lit(within) - F.col("first")).alias("at"))


def read_token(spark: SparkSession, path: str, place: int) -> int | None:
    """The id at one place of the whole store, or None beyond its end: its row is found, and in the row the token's own bytes by rank."""
    row = token_row(spark, path, place)
    row = row.first() if row is not None else None
    return dac.Sequence(bytes(row["codes"]))[row["at"]] if row else None
