"""Training-sample filters, answer metrics, score merging, routing and failure reports."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import _c, budget_limit, clamp_score, prices, strip

# Fixed patterns: what counts as structure, and as a reference to data.
STRUCTURE = (r"(?m)^\s*[-*]\s+", r"(?m)^\s*\d+[.)]\s+", r"\*\*[^*]+\*\*", r"\|.*\|.*\|", r"(?m)^#{1,4}\s+", "\n\n")
DATA = (r"[$¥]\s*\d+", r"\d+(\.\d+)?\s*元", r"\d+(\.\d+)?\s*/\s*5", r"\d+\s*条评[价价]", r"评分[：:]\s*\d", r"价格[：:]\s*[$¥]", r"价格[：:]\s*\d+(\.\d+)?\s*元", "订单编号", r"ORD\d+")
#: Dimensions whose good answers may hold no data.
RELAXED = ("safety_honesty", "service_boundary")


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def respects_budget(prompt: Column, answer: Column) -> Column:
    """No budget, no price, or one price within 1.12 of it."""
    limit, found = budget_limit(prompt), prices(answer)
    return limit.isNull() | (F.size(found) == 0) | F.exists(found, lambda p: p <= limit * 1.12)


def sft_reason(prompt: str | Column, answer: str | Column, shortest: int = 50, longest: int = 2000) -> Column:
    """The first reason to reject a sample, or null."""
    p, a = F.coalesce(_c(prompt), F.lit("")), F.coalesce(_c(answer), F.lit(""))
    size = F.length(strip(a))
    return (
        F.when(size < shortest, "too_short").when(size > longest, "too_long").when(~any_match(a, STRUCTURE), "no_structure")
        .when(~any_match(a, DATA), "no_data").when(~respects_budget(p, a), "budget_mismatch")
    )


def dpo_reason(prompt: str | Column, chosen: str | Column, rejected: str | Column, dimension: str | Column, shortest: int = 50, longest: int = 2000) -> Column:
    p, a, d = F.coalesce(_c(prompt), F.lit("")), F.coalesce(_c(chosen), F.lit("")), F.coalesce(_c(dimension), F.lit(""))
    size = F.length(strip(a))
    return (
        F.when(size < shortest, "too_short").when(size > longest, "too_long").when(~any_match(a, STRUCTURE), "no_structure")
        .when(~d.isin(*RELAXED) & ~any_match(a, DATA), "no_data").when((d == "information_quality") & ~respects_budget(p, a), "budget_mismatch")
        .when(F.length(strip(F.coalesce(_c(rejected), F.lit("")))) < 5, "too_short")
    )


def last_assistant(messages: str | Column = "messages") -> Column:
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))["content"], F.lit(""))


def first_user(messages: str | Column = "messages") -> Column:
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))["content"], F.lit(""))


def rejection_report(reasons: DataFrame) -> DataFrame:
    """(reason, samples, share) with passed for null reasons."""
    counted = reasons.groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("samples"))
    return counted.withColumn("share", F.round(F.col("samples") / F.sum("samples").over(Window.partitionBy(F.lit(1))), 6))


def answer_quality(answer: str | Column) -> Column:
    """struct(structure, completeness, specificity, overall)."""
    a = _c(answer)
    flag = lambda pattern, weight: F.when(a.rlike(pattern), weight).otherwise(0.0)
    structure = flag(r"(?m)^[\s]*[-\d*●•]", 0.4) + flag(r"(?m)^#+\s|^\*\*.*\*\*", 0.3) + F.when(F.length(a) - F.length(F.replace(a, F.lit("\n"), F.lit(""))) >= 2, 0.3).otherwise(0.0)
    n = F.length(a)
    complete = F.when(n < 50, 0.2).when(n < 100, 0.5).when(n < 300, 0.8).otherwise(1.0)
    numbers = F.size(F.regexp_extract_all(a, F.lit(r"(\d+)"), F.lit(1)))
    specific = flag(r"[¥￥$]\s?\d+|[\d,]+\s?元", 0.3) + flag(r"\d\.?\d?\s?[星分/]|评[分级]", 0.25) + flag(r"[一-鿿]{2,}牌|[A-Z][a-zA-Z]+", 0.25) + F.when(numbers >= 3, 0.2).otherwise(0.0)
    return F.struct(structure.alias("structure"), complete.alias("completeness"), specific.alias("specificity"), (structure * 0.3 + complete * 0.3 + specific * 0.4).alias("overall"))


def fact_consistency(answer: str | Column, facts: Column, numbers_in: Column) -> Column:
    """struct(fact_coverage, hallucination_ratio): facts and the texts whose
    numbers are supported are arrays; both 0 without facts."""
    a = _c(answer)
    known = F.array_distinct(F.filter(F.transform(facts, lambda f: F.lower(strip(f.cast("string")))), lambda f: f.isNotNull() & (f != "")))
    number = F.lit(r"(\d+\.?\d*)")
    said = F.array_distinct(F.regexp_extract_all(a, number, F.lit(1)))
    given = F.flatten(F.transform(F.filter(numbers_in, lambda x: x.isNotNull()), lambda x: F.regexp_extract_all(x.cast("string"), number, F.lit(1))))
    covered = F.size(F.filter(known, lambda f: F.contains(F.lower(a), f))) / F.greatest(F.lit(1), F.size(known))
    loose = F.when(F.size(said) > 0, F.size(F.array_except(said, given)) / F.size(said)).otherwise(0.0)
    empty = F.size(known) == 0
    return F.struct(F.when(empty, 0.0).otherwise(covered).alias("fact_coverage"), F.when(empty, 0.0).otherwise(loose).alias("hallucination_ratio"))


@F.pandas_udf(T.DoubleType())
def rouge_l(said: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of two token arrays."""

    def one(x, y):
        x, y = list(x if x is not None else []), list(y if y is not None else [])
        if not x or not y:
            return 0.0
        row = [0] * (len(y) + 1)
        for a in x:
            above = 0
            for j, b in enumerate(y, 1):
                here, row[j] = row[j], above + 1 if a == b else max(row[j], row[j - 1])
                above = here
        common = row[-1]
        return 2 * common / (len(x) + len(y)) if common else 0.0

    return pd.Series([one(x, y) for x, y in zip(said, reference, strict=True)])


def weighted_overall(metrics: str | Column, weights: str | Column, reasons: str | Column, cap: str | Column) -> Column:
    """Weighted mean of a map of metrics; at most the cap where a reason to fail stands."""
    entries = F.map_entries(weights)
    total = F.aggregate(entries, F.lit(0.0), lambda s, e: s + e["value"])
    value = F.aggregate(entries, F.lit(0.0), lambda s, e: s + F.coalesce(F.try_element_at(_c(metrics), e["key"]), F.lit(0.0)) * e["value"]) / F.greatest(total, F.lit(1e-6))
    return F.round(F.when((F.size(reasons) > 0) & _c(cap).isNotNull(), F.least(value, _c(cap))).otherwise(value), 4)


def judge_weight(risk: str | Column, realistic: str | Column, base: float = 0.55) -> Column:
    r = _c(risk)
    service = F.greatest(F.lit(base), F.lit(0.8))
    return F.when(_c(realistic), F.when(r == "high", F.greatest(service, F.lit(0.85))).when(r == "low", F.greatest(service, F.lit(0.75))).otherwise(service)).otherwise(
        F.when(r == "high", F.greatest(F.lit(base), F.lit(0.65))).when(r == "low", F.least(F.lit(base), F.lit(0.5))).otherwise(F.lit(base))
    )


def merged_score(heuristic: str | Column, judge: str | Column, weight: Column, failed: str | Column, cap: str | Column) -> Column:
    both = _c(heuristic) * (1 - weight) + clamp_score(judge) * weight
    both = F.when(_c(failed), F.least(both, F.coalesce(_c(cap), F.lit(0.0)))).otherwise(both)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), both)), 4)


def parse_judge(raw: str | Column) -> Column:
    """struct(overall, primary_failure, tags) of a judge's reply: JSON, JSON in a
    code fence, JSON without braces, or fields found by pattern."""
    t = F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    schema = "overall string, primary_failure string, failure_tags array<string>"
    candidates = [t, F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.concat(F.lit("{"), F.regexp_replace(t, r",\s*$", ""), F.lit("}"))]
    parsed = [F.from_json(c, schema) for c in candidates]
    good = [F.when(p["overall"].isNotNull(), p) for p in parsed]
    by_field = F.struct(
        F.nullif(F.regexp_extract(t, r'"overall"\s*:\s*"?([0-9.]+)', 1), F.lit("")).alias("overall"),
        F.nullif(F.regexp_extract(t, r'"primary_failure"\s*:\s*"([^"]*)"', 1), F.lit("")).alias("primary_failure"),
        F.array().cast("array<string>").alias("failure_tags"),
    )
    one = F.coalesce(*good, by_field)
    return F.struct(clamp_score(one["overall"]).alias("overall"), F.coalesce(one["primary_failure"], F.lit("none")).alias("primary_failure"), F.coalesce(one["failure_tags"], F.array().cast("array<string>")).alias("tags"))


def stage_threshold(risk: str | Column, realistic: str | Column) -> Column:
    r = _c(risk)
    return F.when(_c(realistic), F.when(r == "low", 0.64).when(r == "high", 0.72).otherwise(0.68)).otherwise(F.when(r == "low", 0.72).when(r == "high", 0.78).otherwise(0.75))


def pairwise_winner(comparisons: DataFrame) -> DataFrame:
    """(case_id, winner): most weight of 1 plus a bonus for confidence; none for a tie."""
    bonus = F.when(F.col("confidence") == "high", 0.1).when(F.col("confidence") == "medium", 0.05).otherwise(0.0)
    won = comparisons.where(F.col("winner_stage").isin("base", "sft", "dpo")).groupBy("case_id", "winner_stage").agg(F.sum(1 + bonus).alias("weight"))
    order = Window.partitionBy("case_id").orderBy(F.desc("weight"), "winner_stage")
    placed = won.withColumns({"place": F.row_number().over(order), "next": F.lead("weight").over(order)})
    return placed.where((F.col("place") == 1) & (F.col("next").isNull() | (F.col("weight") - F.col("next") >= 1e-6))).select("case_id", F.col("winner_stage").alias("winner"))


def routes(scores: DataFrame, comparisons: DataFrame | None = None, margin: float = 0.03) -> DataFrame:
    """(case_id, recommended_stage) from scores(case_id, stage, overall, risk_level, realistic).

    Stages within the margin of the best and over the threshold are eligible; a
    winner of comparisons among them is taken, else the lightest stage. Below
    the threshold a person decides.
    """
    best = Window.partitionBy("case_id")
    weight = F.when(F.col("stage") == "base", 0).when(F.col("stage") == "sft", 1).when(F.col("stage") == "dpo", 2).otherwise(99)
    marked = scores.withColumns({"best": F.max("overall").over(best), "threshold": stage_threshold("risk_level", "realistic")})
    marked = marked.withColumn("eligible", (F.col("overall") >= F.col("threshold")) & (F.col("overall") >= F.col("best") - margin))
    light = marked.groupBy("case_id").agg(F.min(F.when(F.col("eligible"), F.struct(weight.alias("w"), (-F.col("overall")).alias("s"), F.col("stage").alias("stage")))).alias("pick"))
    out = light.select("case_id", F.col("pick.stage").alias("stage"))
    if comparisons is not None:
        able = marked.where("eligible").select("case_id", "stage")
        pairs = comparisons.join(able.withColumnRenamed("stage", "stage_a"), ["case_id", "stage_a"]).join(able.withColumnRenamed("stage", "stage_b"), ["case_id", "stage_b"])
        out = out.join(pairwise_winner(pairs), "case_id", "left").select("case_id", F.when(F.col("stage").isNotNull(), F.coalesce("winner", "stage")).alias("stage"))
    return out.select("case_id", F.coalesce("stage", F.lit("manual_review")).alias("recommended_stage"))


def failure_analysis(results: DataFrame, routing: DataFrame, top: int = 5) -> DataFrame:
    """(stage, failures, failure_rate, top_tags) from results(stage, case_id,
    overall, risk_level, realistic, tags)."""
    joined = results.join(routing, "case_id", "left")
    away = F.col("recommended_stage").isNotNull() & (F.col("recommended_stage") != F.col("stage"))
    marked = joined.withColumn("failed", away | (F.col("overall") < stage_threshold("risk_level", "realistic")))
    counted = marked.groupBy("stage").agg(F.count_if("failed").alias("failures"), F.round(F.count_if("failed") / F.count("*"), 4).alias("failure_rate"))
    tags = marked.where("failed").select("stage", F.explode("tags").alias("tag")).groupBy("stage", "tag").agg(F.count("*").alias("n"))
    order = Window.partitionBy("stage").orderBy(F.desc("n"), "tag")
    best = tags.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    listed = best.groupBy("stage").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "tag", "n"))), lambda t: F.concat_ws(":", t["tag"], t["n"].cast("string"))), ",").alias("top_tags"))
    return counted.join(listed, "stage", "left").withColumn("top_tags", F.coalesce("top_tags", F.lit("")))
