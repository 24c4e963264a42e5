"""The registered queries of the ten operators, each over its whole table, and the SQL that
says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import htmltext, langid, licenses, mixing, neardup, pieces, quality, secrets, toxicity, transport

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings_of(spark, _read(spark, sf_dir, "documents"))


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, _read(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(spark, _read(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access")
    return transport.media_columns(spark, _read(spark, sf_dir, "documents"), fields)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(spark, _read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(spark, _read(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _read(spark, sf_dir, "documents")).drop("copies")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, _read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, _read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_secret_scans, op3_simhash_neardup, op4_license_scans, op5_media_columns, op6_sentencepiece, op7_html_extraction, op8_mixing,
        op9_language_id, op10_quality_rules,
    )
}

ORACLES: dict[str, str] = {"op4_license_scans": licenses.oracle(), "op8_mixing": mixing.ORACLE}
