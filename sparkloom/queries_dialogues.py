"""Registered queries of training dialogues, preference pairs and their exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.text import rounded
from .operators import records as D
from .plans import dialogues as G
from .registry import query
from .sources.tables import CATALOGUE_SQL, catalogue, table

_HALF = "format('{:.1f}', floor(Rating * 2) / 2)"
#: What the holes of templates stand for, in SQL and in Spark.
PRODUCT_SQL = {"title": "Product_Title", "brand": "Brand", "category": "Category", "price": "'¥' || format('{:,.2f}', CAST(Price AS DOUBLE))", "rating": _HALF, "other": "other"}
ORDER_SQL = {"order": "CAST(o_orderkey AS VARCHAR)", "customer": "CAST(o_custkey AS VARCHAR)", "status": "o_orderstatus", "amount": "'¥' || format('{:,.2f}', CAST(o_totalprice AS DOUBLE))"}


def _product():
    c = F.col
    return {"title": c("Product_Title"), "brand": c("Brand"), "category": c("Category"), "price": D.price_text("Price"), "rating": F.format_string("%.1f", F.floor(c("Rating") * 2) / 2), "other": c("other")}


def _order():
    c = F.col
    return {"order": c("o_orderkey").cast("string"), "customer": c("o_custkey").cast("string"), "status": c("o_orderstatus"), "amount": D.price_text("o_totalprice")}


def filled(template, holes):
    quoted = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(holes[p] if i % 2 else quoted(p) for i, p in enumerate(G._HOLE.split(template)) if i % 2 or p)


def dialogues_sql(source, id_, tasks, holes):
    one = lambda turns: " || chr(10) || ".join(f"'{role}: ' || {filled(t, holes)}" for role, t in turns)
    return " UNION ALL ".join(f"SELECT '{task}-' || {id_} AS sample_id, '{task}' AS task, {len(turns)} AS turns, {one(turns)} AS text FROM {source}" for task, turns in tasks.items())


def pairs_sql(source, id_, kinds, holes):
    return " UNION ALL ".join(f"SELECT '{k}-' || {id_} AS pair_id, '{k}' AS kind, {filled(p, holes)} AS prompt, {filled(c, holes)} AS chosen, {filled(r, holes)} AS rejected FROM {source}" for k, (p, c, r) in kinds.items())


def _told(df):
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return df.select("sample_id", "task", F.size("messages").alias("turns"), F.array_join(lines, "\n").alias("text"))


@query("gen_product_dialogues", f"WITH {CATALOGUE_SQL} {dialogues_sql('cat', 'Product_ID', G.PRODUCT_TASKS, PRODUCT_SQL)}")
def product_dialogues(spark, d):
    return _told(G.dialogues(catalogue(spark, d).withColumn("other", F.lit("")), G.PRODUCT_TASKS, _product(), "Product_ID"))


@query("gen_order_dialogues", dialogues_sql("orders", "o_orderkey", G.ORDER_TASKS, ORDER_SQL))
def order_dialogues(spark, d):
    return _told(G.dialogues(table(spark, d, "orders"), G.ORDER_TASKS, _order(), "o_orderkey"))


@query("gen_dimension_pairs", f"WITH {CATALOGUE_SQL} {pairs_sql('cat', 'Product_ID', G.DIMENSIONS, PRODUCT_SQL)}")
def dimension_pairs(spark, d):
    return G.pairs(catalogue(spark, d).withColumn("other", F.lit("")), G.DIMENSIONS, _product(), "Product_ID")


_LED = f"{CATALOGUE_SQL}, ld AS (SELECT Category, Product_Title AS other FROM cat QUALIFY row_number() OVER (PARTITION BY Category ORDER BY Rating DESC, Price, Product_ID) = 1), led AS (SELECT * FROM cat JOIN ld USING (Category))"


def _service(spark, d):
    cat = catalogue(spark, d)
    lead = D.lead_items(cat, "Category").withColumnRenamed("lead", "Product_ID").join(cat.select("Product_ID", F.col("Product_Title").alias("other")), "Product_ID").select("Category", "other")
    return G.pairs(cat.join(lead, "Category"), G.SERVICE, _product(), "Product_ID")


@query("gen_service_pairs", f"WITH {_LED} {pairs_sql('led', 'Product_ID', G.SERVICE, PRODUCT_SQL)}")
def service_pairs(spark, d):
    return _service(spark, d)


_MD5 = "list_reduce(list_prepend(0, list_transform(string_split(md5(pair_id), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT))), lambda a, b: (a * 16 + b) % 100)"


@query(
    "exp_service_pairs",
    f"""WITH {_LED}, p AS ({pairs_sql('led', 'Product_ID', G.SERVICE, PRODUCT_SQL)}), o AS (SELECT min(pair_id) AS pair_id, kind FROM p GROUP BY prompt, chosen, rejected, kind),
    s AS (SELECT pair_id, kind, CASE WHEN {_MD5} < 10 THEN 'val' ELSE 'train' END AS split FROM o)
    SELECT pair_id, kind, split, row_number() OVER (PARTITION BY kind, split ORDER BY pair_id) AS place FROM s QUALIFY place <= CASE WHEN split = 'val' THEN 8 ELSE 72 END""",
)
def service_export(spark, d):
    return G.export_pairs(_service(spark, d), 80, 0.10)


_FAIL = "f AS (SELECT o_orderkey AS case_id, o_orderpriority AS scenario, round(o_totalprice / 1000000, 6) AS overall FROM orders WHERE o_totalprice < 2000)"


@query(
    "pln_failure_first",
    f"""WITH {_FAIL}, b(bundle, scenario) AS (VALUES ('hot', '1-URGENT'), ('hot', '2-HIGH'), ('cold', '5-LOW'), ('none', 'x'))
    SELECT bundle, count(case_id) AS failures, string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY overall, case_id) AS cases, min(overall) AS least FROM b LEFT JOIN f USING (scenario) GROUP BY bundle""",
)
def failure_first(spark, d):
    low = table(spark, d, "orders").where("o_totalprice < 2000").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("scenario"), rounded(F.col("o_totalprice") / 1000000, 6).alias("overall"))
    bundles = spark.createDataFrame([("hot", ["1-URGENT", "2-HIGH"]), ("cold", ["5-LOW"]), ("none", ["x"])], "bundle string, scenarios array<string>")
    return G.failure_plan(bundles, low)
