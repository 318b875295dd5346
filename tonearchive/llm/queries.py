"""The numbered queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, embedding, extraction, licenses, mixing, mpeg, packing, quality, secret_scan, simhash, substring, token_store, whitening
from .common import work_dir
from .oracle import ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    found = licenses.find_licenses(_table(spark, sf_dir, "documents"), base)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.concat_ws("; ", "expressions").alias("expressions"), "open")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(_table(spark, sf_dir, "documents"))


def op5_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.digests(_table(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_tokens(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), path)
    return token_store.read_tokens(spark, path, ids=False)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), length=2048)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, most=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(_table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=16)


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding": op1_embedding,
    "op2_licenses": op2_licenses,
    "op3_secrets": op3_secrets,
    "op4_token_store": op4_token_store,
    "op5_mpeg": op5_mpeg,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_substring": op10_substring,
    "op11_divergence": op11_divergence,
    "op12_whitening": op12_whitening,
    "op13_html": op13_html,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
