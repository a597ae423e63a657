"""From raw documents to token ids: five stages, each a Parquet table.

Every stage but the last returns the columns of documents. A stage reads what
its predecessor kept; run() writes each result below spark.checkpoint.dir.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bpe import bpe_encode
from sparkloom.llm.decontaminate import benchmark_overlaps
from sparkloom.llm.neardup import near_duplicates
from sparkloom.llm.scratch import Scratch
from sparkloom.llm.secrets import find_secrets
from sparkloom.llm.toxicity import fit, labelled_sample, toxicity_scores

TOXIC_FROM = 0.3
#: Jaccard similarity of five-word shingles that links two documents, and bands that lose such a pair once in 150,000.
SIMILARITY, BANDS, BAND_ROWS = (80, 100), 30, 5


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is TOXIC_FROM or more go. Rows with a null text or
    id are judged like others, repeated rows alike; empty tables and names beside
    those of documents make no difference."""
    model = fit(*labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity_scores(docs, model).where(F.col("toxicity") < TOXIC_FROM).select(_own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest doc_id stays; rows without an id stay."""
    lost = near_duplicates(docs, similarity=SIMILARITY, bands=BANDS, band_rows=BAND_ROWS).where(~F.col("kept")).select("doc_id")
    return docs.join(lost, "doc_id", "left_anti").select(_own(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    return benchmark_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0").select(_own(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; spans of secrets in their texts are masked, n_chars follows."""
    found = find_secrets(docs, mask="[secret]")
    return found.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(_own(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    coded = bpe_encode(docs, path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, with_decoded=True)
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]

#: SQL can't express the stages; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
