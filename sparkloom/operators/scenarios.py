"""Scenario scores, stage comparisons, reasons, and parsing of recommendation lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _c


def scenario_scores(metrics: DataFrame, weights: DataFrame) -> DataFrame:
    """(case_id, stage, overall, hard_fail) from metrics(case_id, stage, scenario,
    metric, value) and weights(scenario, metric, weight, least, cap).

    The weighted mean of the metrics that a scenario weighs; a value under least is
    a hard fail, which holds the score at the smallest cap of the failed metrics.
    One table of weights stands for one scorer per scenario.
    """
    both = metrics.join(F.broadcast(weights), ["scenario", "metric"]) if weights.count() <= 10_000 else metrics.join(weights, ["scenario", "metric"])
    failed = F.col("least").isNotNull() & (F.coalesce("value", F.lit(0.0)) < F.col("least"))
    one = both.groupBy("case_id", "stage").agg(
        (F.sum(F.coalesce("value", F.lit(0.0)) * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-6))).alias("mean"),
        F.min(F.when(failed, F.coalesce("cap", F.lit(0.0)))).alias("cap"),
    )
    return one.select("case_id", "stage", F.round(F.least("mean", F.coalesce("cap", F.lit(1.0))), 4).alias("overall"), F.col("cap").isNotNull().alias("hard_fail"))


def stage_pairs(scores: DataFrame) -> DataFrame:
    """(case_id, stage_a, stage_b, winner): each pair of a case's stages once, a before b."""
    a = scores.select("case_id", F.col("stage").alias("stage_a"), F.col("overall").alias("score_a"))
    b = scores.select("case_id", F.col("stage").alias("stage_b"), F.col("overall").alias("score_b"))
    winner = F.when(F.abs(F.col("score_a") - F.col("score_b")) < 1e-9, "tie").when(F.col("score_a") > F.col("score_b"), F.col("stage_a")).otherwise(F.col("stage_b"))
    return a.join(b, "case_id").where("stage_a < stage_b").select("case_id", "stage_a", "stage_b", winner.alias("winner"))


def stage_summary(scores: DataFrame, routing: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """(stage, cases, mean, won): every stage once, also without cases."""
    spark = scores.sparkSession
    known = spark.createDataFrame([(s,) for s in stages], "stage string")
    mean = scores.groupBy("stage").agg(F.count("*").alias("cases"), F.round(F.avg("overall"), 4).alias("mean"))
    won = routing.groupBy(F.col("recommended_stage").alias("stage")).agg(F.count("*").alias("won"))
    return known.join(mean, "stage", "left").join(won, "stage", "left").select("stage", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cases", "mean", "won")])


def route_reason(stage: str | Column, best: str | Column, threshold: str | Column) -> Column:
    s = _c(stage)
    return F.when(s == "manual_review", F.concat(F.lit("best score "), F.format_string("%.2f", _c(best)), F.lit(" is under "), F.format_string("%.2f", _c(threshold)))).otherwise(F.concat(s, F.lit(" is the lightest stage near the best")))


def diagnosis_owner(reasons: str | Column) -> Column:
    """Who answers for a failure, by the first reason that names an owner."""
    r = _c(reasons)
    return F.when(F.exists(r, lambda x: x.rlike("inventory|medical|discount")), "safety").when(F.exists(r, lambda x: x.rlike("budget|grounding")), "rag_or_prompt").when(F.size(r) > 0, "dpo").otherwise("none")


def recommendation_items(text: str | Column) -> Column:
    """array<struct<place,title,price,rating,reason>> of a numbered list of
    recommendations: ``1. **title**``, then ``价格：¥n``, ``评分：n`` and ``理由：...``."""
    parts = F.filter(F.split(_c(text), r"(?m)^(?=\d+\. \*\*)"), lambda p: p.rlike(r"^\d+\. \*\*"))
    field = lambda p, pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit(""))
    return F.transform(
        parts,
        lambda p: F.struct(
            field(p, r"^(\d+)\.").try_cast("int").alias("place"),
            field(p, r"\*\*([^*]+)\*\*").alias("title"),
            field(p, r"价格[：:]\s*[¥￥]?\s*(\d+(?:\.\d+)?)").try_cast("double").alias("price"),
            field(p, r"评分[：:]\s*(\d+(?:\.\d+)?)").try_cast("double").alias("rating"),
            field(p, r"理由[：:]\s*([^\n]+)").alias("reason"),
        ),
    )


def drop_reasons(records: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """records with reasons array<string>: the names of the checks that a record fails."""
    return records.withColumn("reasons", F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]), lambda x: x.isNotNull()))


def reason_histogram(records: DataFrame) -> DataFrame:
    return records.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("records"))
