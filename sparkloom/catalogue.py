"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_dialogues, queries_records, queries_relational, queries_samples, queries_scenarios, queries_scoring, queries_search, queries_sources, queries_text  # noqa: F401 - they register
from .registry import ORACLE, QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: keyword and vector results of the benchmark's items, fused."""
    return QUERIES["ir_rrf_fusion"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
