"""Data plans: how urgent a case is and how many samples to write for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _c

#: Scores to reach, by who owns a failure, and weights by risk.
TARGETS = {"sft": 0.82, "dpo": 0.78}
RISK_WEIGHTS = {"low": 0.8, "medium": 1.0, "high": 1.2}


def _by(column: Column, values: dict[str, float], default: Column) -> Column:
    out = default
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def priority_score(owner: str | Column, score: str | Column, risk: str | Column, best: str | Column | None = None) -> Column:
    o, r = _c(owner), _c(risk)
    fallback = _c(best) if best is not None else _c(score)
    raw = F.greatest(F.lit(0.0), _by(o, TARGETS, fallback) - _c(score)) * _by(r, RISK_WEIGHTS, F.lit(1.0))
    return F.round(F.when((o == "manual_review") & (r == "high"), F.greatest(raw, F.lit(0.45))).otherwise(raw), 4)


def priority_label(score: str | Column) -> Column:
    return F.when(_c(score) >= 0.4, "P0").when(_c(score) >= 0.2, "P1").otherwise("P2")


def failure_label(base_score: str | Column) -> Column:
    return F.when(_c(base_score) < 0.25, "P0").when(_c(base_score) < 0.4, "P1").otherwise("P2")


def sample_count(owner: str | Column, base: str | Column, score: str | Column, risk: str | Column) -> Column:
    """To the next ten, by the gap to the target; a maintenance share where there is none."""
    o = _c(owner)
    gap = F.greatest(F.lit(0.0), _by(o, TARGETS, F.lit(0.0)) - _c(score))
    scaled = _c(base) * (0.55 + gap * 1.6) * _by(_c(risk), RISK_WEIGHTS, F.lit(1.0))
    return F.when(~o.isin(*TARGETS), 0).when(gap == 0, F.greatest(F.lit(64), F.floor(_c(base) * 0.3))).otherwise(F.ceil(scaled / 10.0) * 10).cast("bigint")


def plan(cases: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Entries of cases(case_id, scenario_type, risk_level, score) that the taxonomy
    (scenario_type, owner, sample_target) knows, most urgent first."""
    joined = cases.join(F.broadcast(taxonomy), "scenario_type") if taxonomy.count() <= 10_000 else cases.join(taxonomy, "scenario_type")
    made = joined.withColumns({"priority_score": priority_score("owner", "score", "risk_level"), "suggested_samples": sample_count("owner", "sample_target", "score", "risk_level")})
    made = made.withColumn("priority_label", priority_label("priority_score"))
    return made.select("case_id", "scenario_type", "owner", "risk_level", "priority_score", "priority_label", "suggested_samples").orderBy("priority_label", F.desc("priority_score"), "risk_level", "case_id")


def plan_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("owner").agg(F.count("*").alias("cases"), F.count_if(F.col("priority_label") == "P0").alias("urgent"), F.sum("suggested_samples").alias("samples"))
