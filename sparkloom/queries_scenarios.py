"""Registered queries of scenario scores, stage comparisons and record checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import evaluation as E
from .operators import scenarios as N
from .queries_text import _SCORES_SQL, _scores, forms, forms_sql
from .registry import query
from .sources.tables import table

WEIGHTS = [("R", "discount", 3.0, 0.02, 0.01), ("R", "tax", 1.5, None, None), ("N", "discount", 1.0, None, None), ("N", "tax", 1.0, 0.01, 0.0), ("A", "discount", 1.0, None, None)]


@query(
    "ben_scenario_scores",
    """WITH w(scenario, metric, weight, least_, cap) AS (VALUES ('R', 'discount', 3.0, 0.02, 0.01), ('R', 'tax', 1.5, NULL, NULL), ('N', 'discount', 1.0, NULL, NULL), ('N', 'tax', 1.0, 0.01, 0.0), ('A', 'discount', 1.0, NULL, NULL)),
    m AS (SELECT l_orderkey AS case_id, l_linenumber AS stage, l_returnflag AS scenario, 'discount' AS metric, l_discount * 1.00013::DOUBLE AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, 'tax', l_tax * 1.00013::DOUBLE FROM lineitem),
    o AS (SELECT case_id, stage, sum(value * weight::DOUBLE) / sum(weight::DOUBLE) AS mean, min(CASE WHEN least_ IS NOT NULL AND value < least_::DOUBLE THEN coalesce(cap::DOUBLE, 0.0) END) AS cap FROM m JOIN w USING (scenario, metric) GROUP BY 1, 2)
    SELECT case_id, stage, round(least(mean, coalesce(cap, 1.0)), 4)::DOUBLE AS overall, cap IS NOT NULL AS hard_fail FROM o""",
)
def scenario_scores(spark, d):
    # The factor keeps means off the halves that engines round differently.
    weights = spark.createDataFrame(WEIGHTS, "scenario string, metric string, weight double, least double, cap double")
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("stage"), F.col("l_returnflag").alias("scenario"), F.explode(F.create_map(F.lit("discount"), F.col("l_discount") * 1.00013, F.lit("tax"), F.col("l_tax") * 1.00013)).alias("metric", "value")
    )
    return N.scenario_scores(lines, weights)


@query(
    "join_stage_pairs",
    f"""WITH {_SCORES_SQL} SELECT a.case_id, a.stage AS stage_a, b.stage AS stage_b, CASE WHEN abs(a.overall - b.overall) < 1e-9 THEN 'tie' WHEN a.overall > b.overall THEN a.stage ELSE b.stage END AS winner FROM sc a JOIN sc b ON a.case_id = b.case_id AND a.stage < b.stage""",
)
def stage_pairs(spark, d):
    return N.stage_pairs(_scores(spark, d))


@query("agg_pairwise_wins", f"""WITH {_SCORES_SQL}, p AS (SELECT CASE WHEN abs(a.overall - b.overall) < 1e-9 THEN 'tie' WHEN a.overall > b.overall THEN a.stage ELSE b.stage END AS winner FROM sc a JOIN sc b ON a.case_id = b.case_id AND a.stage < b.stage) SELECT winner, count(*) AS wins FROM p WHERE winner <> 'tie' GROUP BY winner""")
def pairwise_wins(spark, d):
    return N.stage_pairs(_scores(spark, d)).where("winner <> 'tie'").groupBy("winner").agg(F.count("*").alias("wins"))


@query(
    "agg_stage_summary",
    f"""WITH {_SCORES_SQL}, k(stage) AS (VALUES ('base'), ('sft'), ('dpo'), ('manual_review')), s AS (SELECT stage, count(*) AS cases, round(avg(overall), 4) AS mean FROM sc GROUP BY stage), w AS (SELECT recommended_stage AS stage, count(*) AS won FROM rt GROUP BY 1)
    SELECT stage, coalesce(cases, 0) AS cases, coalesce(mean, 0)::DOUBLE AS mean, coalesce(won, 0) AS won FROM k LEFT JOIN s USING (stage) LEFT JOIN w USING (stage)""",
)
def stage_summary(spark, d):
    scores = _scores(spark, d)
    return N.stage_summary(scores, E.routes(scores), ("base", "sft", "dpo", "manual_review"))


@query("rte_base_only", f"WITH {_SCORES_SQL} SELECT case_id, CASE WHEN risk_level = 'high' AND overall < 0.6 THEN 'manual_review' WHEN overall >= threshold THEN 'base' ELSE 'sft' END AS stage FROM th WHERE stage = 'base'")
def base_only(spark, d):
    s = _scores(spark, d).where("stage = 'base'")
    return s.select("case_id", F.when((F.col("risk_level") == "high") & (F.col("overall") < 0.6), "manual_review").when(F.col("overall") >= E.stage_threshold("risk_level", "realistic"), "base").otherwise("sft").alias("stage"))


REASONS = ["budget_miss", "inventory_claim", "tone", ""]


@query("rte_diagnosis_owner", f"WITH {forms_sql(REASONS)} SELECT id, CASE WHEN text = '' THEN 'none' WHEN regexp_matches(text, 'inventory|medical|discount') THEN 'safety' WHEN regexp_matches(text, 'budget|grounding') THEN 'rag_or_prompt' ELSE 'dpo' END AS owner FROM t")
def diagnosis_owner(spark, d):
    return forms(spark, d, REASONS).select("id", N.diagnosis_owner(F.filter(F.array("text"), lambda x: x != "")).alias("owner"))


@query("par_recommendation_items")
def recommendation_items(spark, d):
    text = "开头\n\n1. **耳机 A**\n价格：¥{n}\n评分：4.8\n理由：降噪好\n\n2. **耳机 B**\n价格：399元\n评分：4.5"
    return forms(spark, d, [text]).select("id", F.explode(N.recommendation_items("text")).alias("i")).select("id", "i.*")


@query(
    "agg_drop_reasons",
    "SELECT reason, count(*) AS records FROM (SELECT 'too_short' AS reason FROM documents WHERE length(text) < 200 UNION ALL SELECT 'not_english' FROM documents WHERE lang <> 'en' UNION ALL SELECT 'no_sentence' FROM documents WHERE NOT contains(text, '. ')) GROUP BY reason",
)
def drop_reasons(spark, d):
    docs = table(spark, d, "documents")
    return N.reason_histogram(N.drop_reasons(docs, {"too_short": F.length("text") >= 200, "not_english": F.col("lang") == "en", "no_sentence": F.contains("text", F.lit(". "))}))
