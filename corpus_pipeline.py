"""The corpus pipeline: classify quality, drop near copies, redact secrets, mix sources, pack sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearchive.llm import mixing, packing, quality, secret_scan
from tonearchive.llm.common import discard, noting_tables, release, work_dir
from tonearchive.llm.near_copies import near_copies

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that are likelier junk than not are rejected.
LEAST_SCORE = 0.5


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


class _Run(threading.local):
    """Each thread's own run: work tables of the stage that ran last."""

    def __init__(self) -> None:
        self.left: list[str] = []


_run = _Run()


def _after_the_one_before(stage: Stage) -> Stage:
    """A stage whose input was written by the one before: that one's work tables and shuffle files can go."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _run.left)
        release(spark)
        with noting_tables(_run.left):
            return stage(spark, docs, sf_dir)

    return run


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score reaches ``LEAST_SCORE``."""
    _run.left.clear()  # a run of its own: what an earlier run left may still be read
    with noting_tables(_run.left):
        return _keep_good(spark, docs, sf_dir)


def _keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.classify(_columns(docs), labels, carry=COLUMNS)
    return scored.where(F.col("score") >= LEAST_SCORE).select("carried.*")


@_after_the_one_before
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return near_copies(_columns(docs), shingle=5, similarity=0.8)


@_after_the_one_before
def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows the text."""
    return secret_scan.redact(_columns(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_after_the_one_before
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their weights; a document comes as often as the mix takes it."""
    mixed = mixing.mix(_columns(docs), carry=COLUMNS)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("carried.*")


@_after_the_one_before
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids, with their places in sequences."""
    import public_tokenizers

    return packing.pack(_columns(docs), public_tokenizers.path("byte_bpe_50k.json"), length=2048)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("secret scan", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the packing; the stages are tested against plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{work_dir(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
