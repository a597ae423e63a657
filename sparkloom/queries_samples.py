"""Registered queries of synthesis, answers and scenario scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import answers as A
from .operators import evaluation as E
from .operators import relational as R
from .plans import data_plan as P
from .plans import samples as S
from .registry import query
from .sources.synthetic import synthetic_orders, synthetic_products
from .sources.tables import CATALOGUE_SQL, catalogue, table


@query("src_synthetic_products")
def products(spark, d):
    return synthetic_products(spark)


@query("src_synthetic_orders")
def orders(spark, d):
    return synthetic_orders(synthetic_products(spark), "2026-01-01 00:00:00")


@query(
    "rag_match_reason",
    f"""WITH {CATALOGUE_SQL}, m AS (SELECT median(Price) AS med FROM cat) SELECT Product_ID,
    CASE WHEN Rating >= 4.7 AND Price <= med THEN '口碑表现稳定；价格带更友好' WHEN Rating >= 4.7 THEN '口碑表现稳定' WHEN Price <= med THEN '价格带更友好' ELSE '综合语义匹配、评分和价格推荐' END AS reason FROM cat, m""",
)
def match_reason(spark, d):
    cat = catalogue(spark, d)
    return cat.crossJoin(F.broadcast(cat.agg(F.median("Price").alias("med")))).select("Product_ID", A.match_reason(F.lit("没有这样的词"), "Product_Title", "Rating", "Price", "med").alias("reason"))  # one row


@query(
    "rag_template_answer",
    f"""WITH {CATALOGUE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY Category ORDER BY Rating DESC, Rating_Count DESC, Product_ID) AS rank FROM cat QUALIFY rank <= 5)
    SELECT Category, string_agg(rank || '. ' || Product_Title || ' — ' || Rating_Count, chr(10) ORDER BY rank) AS answer FROM r GROUP BY Category""",
)
def template_answer(spark, d):
    line = F.concat("Product_Title", F.lit(" — "), F.col("Rating_Count").cast("string"))
    return A.listed(catalogue(spark, d), "Category", [F.desc("Rating"), F.desc("Rating_Count"), F.col("Product_ID")], line, 5, "answer")


@query(
    "rag_prompt",
    """WITH l AS (SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'), q AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
    SELECT q.conv_id, 'system:sys|' || coalesce(string_agg(l.role || ':' || l.text, '|' ORDER BY l.turn) || '|', '') || 'user:' || any_value(q.text) AS prompt FROM q LEFT JOIN l ON l.conv_id = q.conv_id AND l.turn < q.turn GROUP BY q.conv_id""",
)
def prompt(spark, d):
    said = table(spark, d, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    before = F.transform(F.slice("m", F.lit(1), F.size("m") - 1), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    made = said.select("conv_id", A.prompt("sys", F.lit(None).cast("string"), before, F.element_at("m", -1)["text"]).alias("p"))
    return made.select("conv_id", F.array_join(F.transform("p", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("prompt"))


@query("gen_recommendation")
def recommendation(spark, d):
    return S.random_split(S.recommendation_samples(synthetic_products(spark), 6), "sample_id", 0.15)


@query("gen_comparison")
def comparison(spark, d):
    return S.comparison_samples(synthetic_products(spark))


@query("gen_manifest")
def manifest(spark, d):
    return S.manifest(S.random_split(S.recommendation_samples(synthetic_products(spark), 6), "sample_id", 0.15), "category")


@query("qf_generated")
def generated(spark, d):
    return E.rejection_report(S.recommendation_samples(synthetic_products(spark), 6).select(E.sft_reason("prompt", "answer").alias("reason")))


@query(
    "pln_data_plan",
    """WITH t(status, scenario, owner, target) AS (VALUES ('F', 'returned', 'sft', 600), ('O', 'open', 'dpo', 400), ('P', 'partial', 'manual_review', 0)),
    c AS (SELECT o_orderkey AS case_id, scenario AS scenario_type, owner, CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk_level, (o_custkey % 97) / 100.0 AS score FROM orders JOIN t ON status = o_orderstatus),
    p AS (SELECT *, round(CASE WHEN owner = 'manual_review' AND risk_level = 'high' THEN 0.45 ELSE greatest(0, CASE owner WHEN 'sft' THEN 0.82 WHEN 'dpo' THEN 0.78 ELSE score END - score) * CASE risk_level WHEN 'low' THEN 0.8 WHEN 'high' THEN 1.2 ELSE 1.0 END END, 4)::DOUBLE AS priority FROM c)
    SELECT owner, risk_level, count(*) AS cases, count(*) FILTER (WHERE priority >= 0.4) AS urgent FROM p GROUP BY owner, risk_level""",
)
def data_plan(spark, d):
    taxonomy = spark.createDataFrame([("returned", "sft", 600), ("open", "dpo", 400), ("partial", "manual_review", 0)], "scenario_type string, owner string, sample_target int")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    cases = table(spark, d, "orders").select(
        key.alias("case_id"), F.when(status == "F", "returned").when(status == "O", "open").when(status == "P", "partial").alias("scenario_type"),
        F.when(key % 3 == 0, "low").when(key % 3 == 1, "medium").otherwise("high").alias("risk_level"), ((F.col("o_custkey") % 97) / 100.0).alias("score"),
    )
    entries = P.plan(cases, taxonomy)
    return entries.groupBy("owner", "risk_level").agg(F.count("*").alias("cases"), F.count_if(F.col("priority_score") >= 0.4).alias("urgent"))


@query("ded_crawled_products", "SELECT p_name, p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_name, p_brand")
def crawled(spark, d):
    return R.keep_first(table(spark, d, "part"), ["p_name", "p_brand"], ["p_partkey"]).select("p_name", "p_brand", "p_partkey")
