"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

1. language ID: drops texts without a language and those whose score is below LEAST_SCORE;
2. SimHash near-duplicates: one document of each component stays;
3. secret scans: secrets are replaced in the text, no document goes;
4. mixing: each row as often as the mix of sources takes it;
5. SentencePiece: token ids are added, and checked to decode to the text.

Defined results: each stage takes null columns, empty texts, repeated rows, empty tables and
extra columns as its operator's docstring says; the columns of documents are returned by all
stages but the last, which adds to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import langid, mixing, neardup, pieces, secrets
from quarrymill.llm.common import Scratch

#: Below this a language is a guess: with five languages or fewer, little over chance.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(spark, docs)
    found = docs.select(F.struct(*docs.columns).alias("row"), langid.predict(spark, docs, model).alias("found"))
    return found.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(spark, docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(spark, docs)


STAGES = [
    ("language_id", language),
    ("simhash_neardup", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixing", mix),
    ("sentencepiece", tokens),
]

#: A trained classifier, XXH64 and a Viterbi are beyond SQL; tests hold each stage against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is a Parquet table that the next one reads."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
