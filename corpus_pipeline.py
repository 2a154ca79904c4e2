"""Corpus pipeline over ``documents``: quality rules, near-dedup, secret scans, packing.

Each stage works on all that the stage before it kept, and its decisions take
effect: documents that the rules reject go, one document of each group of near
copies stays, live-looking secrets are masked in the texts, and what is left
is packed into sequences of power-of-two lengths.  All stages but the last
return the columns of ``documents``.  Every stage's result is written as
Parquet to the shared folder and read again, so a lost executor costs at most
the stage at hand.

Stages take null texts, empty tables, repeated rows and extra columns as their
operators define them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilloom.llm import nearcopies, packing, quality, secrets
from skilloom.llm.common import DOCUMENT_COLUMNS, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judged(docs, table(spark, sf_dir, "labels"), list(DOCUMENT_COLUMNS))
    return judged.filter("kept").select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs, F.col("source"), F.concat_ws("/", "source", "lang"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pieces(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("pack", pack)]

#: A learned list, 64-bit hashing and a tokenizer have no SQL form; tests hold the pipeline against a row-at-a-time version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
