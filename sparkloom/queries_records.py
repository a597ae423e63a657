"""Registered queries of product, order and case records, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as X
from .operators import records as D
from .registry import query
from .sources.tables import CATALOGUE_SQL, catalogue, table


@query("prj_preprocess_products", f"WITH {CATALOGUE_SQL} SELECT Product_ID, Price, Rating, trim(Product_Title) || ' ' || trim(Brand) || ' ' || trim(Category) AS combined_text FROM cat WHERE Price > 0 AND Rating BETWEEN 0 AND 5")
def preprocess_products(spark, d):
    return D.preprocess_products(catalogue(spark, d)).select("Product_ID", "Price", "Rating", "combined_text")


@query(
    "prj_preprocess_orders",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_quantity, 2) AS Total_Amount, round(l_extendedprice * l_discount - l_tax, 4) AS Net_Profit,
    array_to_string(list_transform(string_split(lower(trim(o_orderpriority)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS Order_Priority FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_extendedprice > 0""",
)
def preprocess_orders(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    raw = joined.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("Sales"), F.col("l_quantity").alias("Quantity"), (F.col("l_extendedprice") * F.col("l_discount")).alias("Profit"), F.col("l_tax").alias("Shipping_Cost"), F.col("o_orderpriority").alias("Order_Priority"))
    return D.preprocess_orders(raw).select("l_orderkey", "l_linenumber", F.round("Total_Amount", 2).alias("Total_Amount"), F.round("Net_Profit", 4).alias("Net_Profit"), "Order_Priority")


@query("prj_complete_columns", "SELECT p_name AS title, CAST(NULL AS VARCHAR) AS image, p_brand AS brand FROM part")
def complete_columns(spark, d):
    return D.complete_columns(table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("title")), ["title", "image", "brand"])


@query("prj_product_texts", f"WITH {CATALOGUE_SQL} SELECT Product_ID, Product_Title || ' | ' || CASE WHEN Product_ID % 7 = 0 THEN '价格未知' ELSE '¥' || format('{{:,.2f}}', CAST(Price AS DOUBLE)) END || ' | ' || format('{{:.1f}}', floor(Rating * 2) / 2) || '/5' AS card FROM cat")
def product_texts(spark, d):
    price = F.when(F.col("Product_ID") % 7 != 0, F.col("Price"))
    return catalogue(spark, d).select("Product_ID", D.product_text("Product_Title", price, F.floor(F.col("Rating") * 2) / 2).alias("card"))


@query("flt_valid_records", "SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ' ' || left(p_name, 1) || ' ' ELSE p_name END AS title, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN -1.0 ELSE p_retailprice END AS price FROM part) WHERE length(trim(title)) >= 2 AND (price IS NULL OR price > 0)")
def valid_records(spark, d):
    key = F.col("p_partkey")
    raw = table(spark, d, "part").select("p_partkey", F.when(key % 5 == 0, F.concat(F.lit(" "), F.left("p_name", F.lit(1)), F.lit(" "))).otherwise(F.col("p_name")).alias("title"), F.when(key % 4 == 0, None).when(key % 4 == 1, -1.0).otherwise(F.col("p_retailprice").cast("double")).alias("price"))
    return D.valid_records(raw).select("p_partkey")


_RAW = "'[''' || replace(p_type, ' ', ''', ''') || ''', ''x'', ''' || p_brand || ''']'"


@query("str_feature_bullets", f"""SELECT p_partkey, array_to_string(list_transform(list_filter(list_transform(string_split(trim({_RAW}, '[]'), ','), lambda x: trim(trim(x), '''"')), lambda x: length(x) > 2)[1:4], lambda x: '- ' || x), chr(10)) AS bullets FROM part""")
def feature_bullets(spark, d):
    raw = F.concat(F.lit("['"), F.replace("p_type", F.lit(" "), F.lit("', '")), F.lit("', 'x', '"), F.col("p_brand"), F.lit("']"))
    return table(spark, d, "part").select("p_partkey", D.feature_bullets(raw).alias("bullets"))


@query("str_scene_and_brand", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '日常使用' ELSE p_type END AS scene, CASE WHEN contains(lower(p_brand), 'brand#1') THEN 'BRAND#1' WHEN contains(lower(p_brand), 'brand#2') THEN 'Brand#2' ELSE '' END AS brand FROM part")
def scene_and_brand(spark, d):
    told = F.when(F.col("p_size") % 3 == 0, "没有场景").otherwise(F.concat(F.lit("面向"), F.col("p_type"), F.lit("场景设计，也面向其他场景设计")))
    return table(spark, d, "part").select("p_partkey", D.scene(told).alias("scene"), D.known_brand("p_brand", ["BRAND#1", "Brand#2"]).alias("brand"))


@query("str_serialised", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE '[\"' || p_brand || '\",\"' || p_type || '\"]' END AS json FROM part")
def serialised(spark, d):
    return table(spark, d, "part").select("p_partkey", D.serialised(F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type"))).alias("json"))


@query("hsh_code_points", "SELECT p_partkey, CAST(list_sum(list_transform(string_split('键' || p_name, ''), lambda c: unicode(c))) % 3 AS INTEGER) AS variant FROM part")
def code_points(spark, d):
    return table(spark, d, "part").select("p_partkey", D.variant(F.concat(F.lit("键"), F.col("p_name"))).alias("variant"))


# Orders as training records: task by status, scenario by priority, categories by the types of their parts.
_RECORDS_SQL = """rec AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'sft' WHEN 'O' THEN 'dpo' ELSE 'hold' END AS task, o_orderpriority AS scenario, any_value(o_totalprice) AS amount,
  list_distinct(list(p_brand)) AS categories FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


def _records(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("categories"))
    task = F.when(F.col("o_orderstatus") == "F", "sft").when(F.col("o_orderstatus") == "O", "dpo").otherwise("hold")
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), task.alias("task"), F.col("o_orderpriority").alias("scenario"), F.col("o_totalprice").alias("amount"), "categories")


_SCEN, _CATS = ["1-URGENT", "2-HIGH"], ["Brand#11", "Brand#22", "Brand#33"]


@query("flt_bundle_records", f"WITH {_RECORDS_SQL} SELECT id FROM rec WHERE task = 'sft' AND scenario IN ('1-URGENT', '2-HIGH') AND list_has_any(categories, {_CATS})")
def bundle_records(spark, d):
    return _records(spark, d).where(D.in_bundle("sft", _SCEN, _CATS)).select("id")


@query("agg_category_counts", f"WITH {_RECORDS_SQL} SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM rec) WHERE category IN ('Brand#11', 'Brand#22', 'Brand#33') GROUP BY category")
def category_counts(spark, d):
    return D.category_counts(_records(spark, d), _CATS)


@query("flt_plan_partition", f"WITH {_RECORDS_SQL} SELECT included, scenario, count(*) AS n FROM (SELECT scenario, task IN ('sft', 'dpo') AND scenario IN ('1-URGENT', '2-HIGH') AS included FROM rec) GROUP BY ALL")
def plan_partition(spark, d):
    cases = _records(spark, d).withColumnRenamed("task", "action")
    return D.partition_cases(cases, ["sft", "dpo"], _SCEN).groupBy("included", "scenario").agg(F.count("*").alias("n"))


@query(
    "flt_followup_reasons",
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN contains(o_orderpriority, 'LOW') OR contains(o_orderpriority, 'SPEC') THEN 'blocked' END, CASE WHEN NOT (contains(o_orderpriority, 'H') OR contains(o_orderpriority, 'M')) THEN 'missing' END,
    CASE WHEN NOT (contains(o_orderstatus || o_orderpriority, 'H') OR contains(o_orderstatus || o_orderpriority, 'M')) THEN 'unaligned' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders""",
)
def followup_reasons(spark, d):
    reasons = D.drop_reasons(F.concat("o_orderstatus", "o_orderpriority"), "o_orderpriority", blocked=["LOW", "SPEC"], required=["H", "M"])
    return table(spark, d, "orders").select("o_orderkey", F.array_join(reasons, ",").alias("reasons"))


@query("agg_case_categories", "SELECT l_orderkey, array_to_string(list(p_brand ORDER BY l_linenumber, p_brand), ',') AS cats FROM (SELECT l_orderkey, p_brand, min(l_linenumber) AS l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) GROUP BY l_orderkey")
def case_categories(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return D.first_seen(lines, "l_orderkey", "l_linenumber", "p_brand").select("l_orderkey", F.array_join("values", ",").alias("cats"))


_STAGE_SQL = "s AS (SELECT l_orderkey AS case_id, CASE l_linenumber % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'sft' ELSE 'dpo' END AS stage, max(l_discount * 5 + l_tax * 3) AS overall FROM lineitem GROUP BY ALL)"


def _stages(spark, d):
    line = F.col("l_linenumber") % 3
    stage = F.when(line == 0, "base").when(line == 1, "sft").otherwise("dpo")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("case_id"), stage.alias("stage")).agg(F.max(F.col("l_discount") * 5 + F.col("l_tax") * 3).alias("overall"))


@query(
    "srt_showcase_cases",
    f"""WITH {_STAGE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY overall DESC, stage DESC) AS k, lead(overall) OVER (PARTITION BY case_id ORDER BY overall DESC, stage DESC) AS next FROM s)
    SELECT stage, case_id, round(overall - next, 6) AS margin FROM r WHERE k = 1 AND next IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stage ORDER BY round(overall - next, 6) DESC, case_id) = 1""",
)
def showcase_cases(spark, d):
    return D.showcase(_stages(spark, d))


@query("srt_failures", f"WITH {_STAGE_SQL} SELECT case_id, stage, round(overall, 6) AS overall, row_number() OVER (PARTITION BY stage ORDER BY round(overall, 6), case_id % 3, case_id) AS place FROM s WHERE overall < 0.3 QUALIFY place <= 20")
def failures(spark, d):
    from pyspark.sql import Window

    low = _stages(spark, d).withColumn("overall", F.round("overall", 6)).where("overall < 0.3")
    order = Window.partitionBy("stage").orderBy("overall", F.col("case_id") % 3, "case_id")
    return low.withColumn("place", F.row_number().over(order)).where("place <= 20")


@query("agg_min_base_score", f"WITH {_STAGE_SQL} SELECT o_orderpriority AS bundle, round(min(overall), 6) AS least FROM s JOIN orders ON o_orderkey = case_id WHERE stage = 'base' GROUP BY o_orderpriority")
def min_base_score(spark, d):
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("bundle"))
    return _stages(spark, d).where("stage = 'base'").join(cases, "case_id").groupBy("bundle").agg(F.round(F.min("overall"), 6).alias("least"))


@query("agg_macro_metrics", f"WITH {_STAGE_SQL} SELECT stage, round(avg(CASE WHEN case_id % 3 <> 0 THEN overall END), 6) AS some, round(avg(overall), 6) AS every, count(CASE WHEN case_id % 3 <> 0 THEN overall END) AS n FROM s GROUP BY stage")
def macro_metrics(spark, d):
    some = F.when(F.col("case_id") % 3 != 0, F.col("overall"))
    return _stages(spark, d).groupBy("stage").agg(F.round(F.avg(some), 6).alias("some"), F.round(F.avg("overall"), 6).alias("every"), F.count(some).alias("n"))


@query("srt_lead_items", f"WITH {CATALOGUE_SQL} SELECT Category, Product_ID AS lead FROM cat QUALIFY row_number() OVER (PARTITION BY Category ORDER BY Rating DESC, Price, Product_ID) = 1")
def lead_items(spark, d):
    return D.lead_items(catalogue(spark, d), "Category")


@query("agg_catalog_showcase", f"WITH {CATALOGUE_SQL}, t AS (SELECT Product_ID FROM cat ORDER BY Rating DESC, Rating_Count DESC, Product_ID LIMIT 4) SELECT c.n, c.categories, t.Product_ID FROM t, (SELECT count(*) AS n, count(DISTINCT Category) AS categories FROM cat) c")
def catalog_showcase(spark, d):
    cat = catalogue(spark, d)
    top = cat.orderBy(F.desc("Rating"), F.desc("Rating_Count"), "Product_ID").limit(4).select("Product_ID")
    return top.crossJoin(F.broadcast(cat.agg(F.count("*").alias("n"), F.countDistinct("Category").alias("categories"))))  # one row


@query("agg_order_breakdown", "SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority), (o_orderstatus))")
def order_breakdown(spark, d):
    return D.order_breakdown(table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount")))


@query("agg_crawl_stats", "SELECT count(*) AS n, count(*) FILTER (WHERE html IS NOT NULL AND length(html) > 0) AS ok, round(count(*) FILTER (WHERE html IS NOT NULL AND length(html) > 0) / nullif(count(*), 0), 6) AS rate FROM pages")
def crawl_stats(spark, d):
    ok = F.count_if(F.coalesce(F.length("html") > 0, F.lit(False)))
    return table(spark, d, "pages").agg(F.count("*").alias("n"), ok.alias("ok"), F.round(F.try_divide(ok, F.count("*")), 6).alias("rate"))


@query(
    "rag_order_answers",
    """WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders QUALIFY place <= 5)
    SELECT o_custkey, '最近 ' || count(*) || ' 笔订单：' || chr(10) || string_agg(place || '. 订单 ' || o_orderkey || '，金额 ¥' || format('{:,.2f}', CAST(o_totalprice AS DOUBLE)), chr(10) ORDER BY place) AS answer FROM p GROUP BY o_custkey""",
)
def order_answers(spark, d):
    newest = D.newest_orders(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return D.order_answer(newest.select("o_custkey", "place", F.col("o_orderkey").alias("order"), F.col("o_totalprice").alias("amount")), "o_custkey")


@query("join_ranked_products", f"WITH {CATALOGUE_SQL}, r AS (SELECT l_orderkey, l_linenumber AS rank, CASE WHEN l_linenumber = 3 THEN -1 ELSE l_partkey END AS Product_ID FROM lineitem) SELECT l_orderkey, rank, Product_ID, Product_Title FROM r JOIN cat USING (Product_ID)")
def ranked_products(spark, d):
    ranked = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("rank"), F.when(F.col("l_linenumber") == 3, -1).otherwise(F.col("l_partkey")).alias("Product_ID"))
    return ranked.join(catalogue(spark, d).select("Product_ID", "Product_Title"), "Product_ID").select("l_orderkey", "rank", "Product_ID", "Product_Title")


@query("join_case_routing", f"WITH {_STAGE_SQL}, r AS (SELECT case_id, stage AS route FROM s WHERE overall >= 0.4 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY overall DESC, stage) = 1) SELECT o_orderkey, coalesce(route, 'manual_review') AS route FROM orders LEFT JOIN r ON case_id = o_orderkey")
def case_routing(spark, d):
    best = _stages(spark, d).where("overall >= 0.4").groupBy("case_id").agg(F.min_by("stage", F.struct((-F.col("overall")).alias("o"), F.col("stage"))).alias("route"))
    return table(spark, d, "orders").join(best, F.col("o_orderkey") == F.col("case_id"), "left").select("o_orderkey", F.coalesce("route", F.lit("manual_review")).alias("route"))


@query("join_category_hints", "SELECT n_nationkey, coalesce(CASE n_name WHEN 'CHINA' THEN '中国' WHEN 'JAPAN' THEN '日本' END, n_name) AS name, r_name AS parent FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def category_hints(spark, d):
    hints = F.create_map(*[F.lit(x) for x in ("CHINA", "中国", "JAPAN", "日本")])
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("parent"))
    return table(spark, d, "nation").join(region, "n_regionkey", "left").select("n_nationkey", F.coalesce(F.try_element_at(hints, F.col("n_name")), F.col("n_name")).alias("name"), "parent")


@query("par_product_ids", "SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]id=(\\d+)', 1), ''), nullif(regexp_extract(url, '/item/(\\d+)', 1), ''), nullif(regexp_extract(url, '/(\\d+)\\.html', 1), ''), nullif(regexp_extract(url, '/(\\d+)$', 1), ''), url) AS product_id FROM pages")
def product_ids(spark, d):
    return table(spark, d, "pages").select("page_id", D.product_id("url").alias("product_id"))


@query("par_specs", "SELECT p_partkey, 'brand=' || p_brand || ';size=' || p_size || ': cm;' || 'type=' || p_type AS specs FROM part")
def spec_pairs(spark, d):
    lines = F.array(F.concat(F.lit("brand： "), F.col("p_brand")), F.concat(F.lit("size:"), F.col("p_size").cast("string"), F.lit(": cm")), F.lit("no mark"), F.lit("empty:"), F.concat(F.lit("type :"), F.col("p_type")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(D.specs(lines), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";").alias("specs"))


@query(
    "str_query_texts",
    r"""SELECT p_partkey, trim(regexp_replace('  键盘 ' || p_name || chr(10) || ' ', '\s+', ' ', 'g')) AS zh, lower(trim(regexp_replace('  ' || p_name || chr(10) || ' X ', '\s+', ' ', 'g'))) AS latin,
    regexp_replace(p_name || ' a' || chr(9) || 'b', '\s+', '', 'g') AS dense FROM part""",
)
def query_texts(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", X.preprocess_text(F.concat(F.lit("  键盘 "), F.col("p_name"), F.lit("\n "))).alias("zh"), X.preprocess_text(F.concat(F.lit("  "), F.col("p_name"), F.lit("\n X "))).alias("latin"), X.without_spaces(F.concat("p_name", F.lit(" a\tb"))).alias("dense")
    )


@query("par_all_prices", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.0,9.5,' || CAST(l_linenumber AS VARCHAR) || '.0' AS prices FROM lineitem")
def all_prices(spark, d):
    said = F.concat(F.lit("¥"), F.col("l_quantity").cast("int").cast("string"), F.lit(" 或 "), F.col("l_linenumber").cast("string"), F.lit("元，另有 $ 9.5"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(X.prices(said), lambda p: p.cast("string")), ",").alias("prices"))
