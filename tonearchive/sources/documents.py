"""JSON documents and tables: read with a size cap and a schema, write, and keep work tables in the shared folder."""

from __future__ import annotations

import json
import math
import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; only a local session may do without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, key: str, buckets: int = 8) -> None:
    """Parquet in folders by a bucket of the key, rows of a key together."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    df.select("*", bucket).repartition("bucket", key).sortWithinPartitions(key).write.partitionBy("bucket").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def parse_documents(texts: DataFrame, schema: str, max_bytes: int) -> DataFrame:
    """``document`` by the schema, and ``reject``: too-large or broken, else null."""
    parsed = F.from_json("text", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    small = texts.withColumn("large", F.octet_length("text") > max_bytes).withColumn("document", F.when(~F.col("large"), parsed))
    reject = F.when(F.col("large"), "too-large").when(F.col("document._corrupt").isNotNull() | F.col("document").isNull(), "broken")
    return small.withColumn("reject", reject).drop("large")


def read_documents(spark: SparkSession, path: str, schema: str, max_bytes: int) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse_documents(texts, schema, max_bytes)


def document_json(columns: list[str]) -> Column:
    """The columns as one JSON object, in their order, nulls left out."""
    return F.to_json(F.struct(*columns))


def write_documents(df: DataFrame, columns: list[str], path: str) -> None:
    df.select(document_json(columns).alias("value")).write.text(path)


def tree_violations(documents: DataFrame, depth: int = 8, text: int = 2000, items: int = 720) -> DataFrame:
    """What each JSON text (column json) breaks: depth, text, array, non-finite, json; empty if nothing."""

    def walk(value, level: int, found: set[str]) -> None:
        if level > depth:
            found.add("depth")
        elif isinstance(value, str):
            found |= {"text"} if len(value) > text else set()
        elif isinstance(value, float):
            found |= set() if math.isfinite(value) else {"non-finite"}
        elif isinstance(value, list | dict):
            if isinstance(value, list) and len(value) > items:
                found.add("array")
            for child in value if isinstance(value, list) else value.values():
                walk(child, level + 1, found)

    @F.pandas_udf("string")
    def check(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str:
            found: set[str] = set()
            try:
                walk(json.loads(t or ""), 0, found)
            except ValueError:
                found.add("json")
            return ",".join(sorted(found))

        return texts.map(one)

    return documents.withColumn("violations", check("json"))
