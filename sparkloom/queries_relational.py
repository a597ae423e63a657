"""Registered relational queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions.text import hash_bucket
from .operators import relational as R
from .registry import query
from .sources.tables import CATALOGUE_SQL, SALES_SQL, catalogue, sales, table

CARD = ["Product_ID", "Product_Title", "Category", "Brand", "Price", "Rating", "Rating_Count"]
CARD_SQL = ", ".join(CARD)


@query("flt_product_search", f"WITH {CATALOGUE_SQL} SELECT {CARD_SQL} FROM cat WHERE regexp_matches(Product_Title, 'a', 'i') AND Rating >= 4.0 AND Price <= 1500 ORDER BY Rating DESC, Rating_Count DESC, Product_ID LIMIT 50")
def product_search(spark, d):
    return R.best_rated(R.search_products(catalogue(spark, d), text="a", min_rating=4.0, max_price=1500.0), 50)


@query("flt_category", f"WITH {CATALOGUE_SQL} SELECT {CARD_SQL} FROM cat WHERE contains(lower(Category), 'e') AND Rating >= 4.2")
def category_listing(spark, d):
    return R.search_products(catalogue(spark, d), category="E", min_rating=4.2)


@query("flt_top_rated", f"WITH {CATALOGUE_SQL} SELECT {CARD_SQL} FROM cat WHERE Rating >= 4.0 ORDER BY Rating DESC, Rating_Count DESC, Product_ID LIMIT 10")
def top_rated(spark, d):
    return R.best_rated(R.search_products(catalogue(spark, d), min_rating=4.0), 10)


@query("flt_orders_by_customer", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) QUALIFY rank <= 20")
def orders_by_customer(spark, d):
    orders = table(spark, d, "orders")
    first = orders.agg(F.min("o_custkey").alias("o_custkey"))
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return orders.join(F.broadcast(first), "o_custkey").withColumn("rank", F.row_number().over(order)).where("rank <= 20").select("o_orderkey", "o_totalprice", "rank")


@query("flt_orders_by_priority", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE lower(o_orderpriority) = '1-urgent' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def orders_by_priority(spark, d):
    return table(spark, d, "orders").where(F.lower("o_orderpriority") == "1-urgent").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("flt_date_range", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-06-30'")
def date_range(spark, d):
    return R.in_date_range(table(spark, d, "orders"), "o_orderdate", "1995-01-01", "1996-06-30").select("o_orderkey", "o_orderpriority")


@query(
    "prj_product_normalize",
    f"""WITH {CATALOGUE_SQL} SELECT CAST(Product_ID AS VARCHAR) AS Product_ID, trim(Product_Title) AS Product_Title, Category, Brand, Price, least(5.0, greatest(0.0, Rating)) AS Rating, Rating_Count,
    Brand || ' ' || Category || '，适合日常选购场景。' AS Description, 'synthetic-demo' AS source,
    trim(Product_Title) || ' ' || Brand || ' ' || Category || '，适合日常选购场景。 ' || Category || ' ' || Brand AS combined_text FROM cat WHERE Price > 0""",
)
def product_normalise(spark, d):
    raw = catalogue(spark, d).withColumnsRenamed({"Product_ID": "parent_asin", "Product_Title": "title", "Category": "main_category", "Brand": "brand", "Price": "price", "Rating": "average_rating", "Rating_Count": "rating_number"})
    return R.normalise_products(raw).select(*CARD, "Description", "source", "combined_text")


@query(
    "prj_order_normalize",
    f"""WITH {CATALOGUE_SQL}, {SALES_SQL} SELECT l_orderkey || '-' || l_linenumber AS Order_ID, Customer_Id, CAST(o.Product_ID AS VARCHAR) AS Product_ID, Product_Title AS Product, Category AS Product_Category,
    Quantity, round(Sales, 4) AS Sales, strftime(Order_DateTime, '%Y-%m-%d %H:%M:%S') AS Order_DateTime, strftime(Order_DateTime, '%Y-%m-%d') AS Order_Date FROM ord o JOIN cat c ON c.Product_ID = o.Product_ID""",
)
def order_normalise(spark, d):
    raw = sales(spark, d).withColumns({"Order_ID": F.concat_ws("-", "l_orderkey", "l_linenumber"), "Order_DateTime": F.date_format("Order_DateTime", "yyyy-MM-dd HH:mm:ss")})
    out = R.normalise_orders(raw, catalogue(spark, d).withColumn("Product_ID", F.col("Product_ID").cast("string")), "2026-01-01 00:00:00")
    return out.select("Order_ID", "Customer_Id", "Product_ID", "Product", "Product_Category", "Quantity", F.round("Sales", 4).alias("Sales"), "Order_DateTime", "Order_Date")


@query("prj_product_card", f"WITH {CATALOGUE_SQL} SELECT Product_ID, left(Product_Title, 12) AS title, round(Price, 1) AS price, CASE WHEN Rating >= 4.7 THEN 'high' WHEN Rating >= 4.4 THEN 'good' ELSE 'plain' END AS verdict FROM cat")
def product_card(spark, d):
    verdict = F.when(F.col("Rating") >= 4.7, "high").when(F.col("Rating") >= 4.4, "good").otherwise("plain")
    return catalogue(spark, d).select("Product_ID", F.left("Product_Title", F.lit(12)).alias("title"), F.round("Price", 1).alias("price"), verdict.alias("verdict"))


@query("join_order_product_fill", f"WITH {CATALOGUE_SQL}, {SALES_SQL} SELECT l_orderkey, l_linenumber, coalesce(Product_Title, '') AS Product, coalesce(Category, '') AS Product_Category FROM ord LEFT JOIN cat USING (Product_ID)")
def order_product_fill(spark, d):
    filled = sales(spark, d).join(catalogue(spark, d), "Product_ID", "left")
    return filled.select("l_orderkey", "l_linenumber", F.coalesce("Product_Title", F.lit("")).alias("Product"), F.coalesce("Category", F.lit("")).alias("Product_Category"))


@query(
    "join_same_category_peers",
    f"""WITH {CATALOGUE_SQL} SELECT a.Product_ID AS target_id, b.Product_ID, round(abs(b.Price - a.Price), 4) AS gap, row_number() OVER (PARTITION BY a.Product_ID ORDER BY b.Rating DESC, abs(b.Price - a.Price), b.Product_ID) AS rank
    FROM cat a JOIN cat b ON a.Category = b.Category AND a.Product_ID <> b.Product_ID QUALIFY rank <= 4""",
)
def same_category_peers(spark, d):
    return R.peers(catalogue(spark, d), 4).select("target_id", "Product_ID", F.round("gap", 4).alias("gap"), "rank")


@query(
    "join_full_outer_stages",
    """WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT s_suppkey AS k, s_acctbal FROM supplier WHERE s_acctbal > 0)
    SELECT coalesce(a.k, b.k) AS k, coalesce(n, 0) AS n, coalesce(s_acctbal, 0.0) AS s_acctbal FROM a FULL JOIN b ON a.k = b.k""",
)
def full_outer_stages(spark, d):
    a = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    return a.join(b, "k", "full").select("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s_acctbal", F.lit(0.0)).alias("s_acctbal"))


@query("join_customer_orders", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def customer_orders(spark, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query(
    "agg_catalog_summary",
    f"""WITH {CATALOGUE_SQL} SELECT count(*) AS product_count, count(DISTINCT Category) AS category_count, count(DISTINCT nullif(Brand, '')) AS brand_count, round(avg(Rating), 2) AS avg_rating, round(avg(Price), 2) AS avg_price,
    round(min(Price), 2) AS min_price, round(max(Price), 2) AS max_price, (SELECT count(*) FROM orders) AS order_count, (SELECT count(*) FROM orders WHERE lower(o_orderpriority) = '2-high') AS high_priority_orders FROM cat""",
)
def catalogue_summary(spark, d):
    one = catalogue(spark, d).agg(
        F.count("*").alias("product_count"), F.countDistinct("Category").alias("category_count"), F.countDistinct(F.nullif("Brand", F.lit(""))).alias("brand_count"),
        F.round(F.avg("Rating"), 2).alias("avg_rating"), F.round(F.avg("Price"), 2).alias("avg_price"), F.round(F.min("Price"), 2).alias("min_price"), F.round(F.max("Price"), 2).alias("max_price"),
    )
    two = table(spark, d, "orders").agg(F.count("*").alias("order_count"), F.count_if(F.lower("o_orderpriority") == "2-high").alias("high_priority_orders"))
    return one.crossJoin(F.broadcast(two))  # one row each


@query("agg_top_categories", f"WITH {CATALOGUE_SQL} SELECT Category AS name, count(*) AS count FROM cat GROUP BY Category ORDER BY count(*) DESC, Category LIMIT 6")
def top_categories(spark, d):
    return catalogue(spark, d).groupBy(F.col("Category").alias("name")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name").limit(6)


@query("agg_order_statistics", f"WITH {SALES_SQL} SELECT Order_Priority, count(*) AS orders, round(sum(Sales), 2) AS total, round(avg(Sales), 4) AS mean FROM ord GROUP BY Order_Priority")
def order_statistics(spark, d):
    return sales(spark, d).groupBy("Order_Priority").agg(F.count("*").alias("orders"), F.round(F.sum("Sales"), 2).alias("total"), F.round(F.avg("Sales"), 4).alias("mean"))


@query("agg_median_price", f"WITH {CATALOGUE_SQL} SELECT Category, round(median(Price), 4) AS median_price FROM cat GROUP BY Category")
def median_price(spark, d):
    return catalogue(spark, d).groupBy("Category").agg(F.round(F.median("Price"), 4).alias("median_price"))


@query("agg_price_quantiles", f"WITH {CATALOGUE_SQL}, q AS (SELECT Category, unnest(quantile_cont(Price, [0.35, 0.55, 0.8])) AS q FROM cat GROUP BY Category) SELECT DISTINCT Category, CAST(greatest(1, floor(q / 10) * 10) AS BIGINT) AS budget FROM q")
def price_quantiles(spark, d):
    q = catalogue(spark, d).groupBy("Category").agg(F.percentile("Price", F.array(F.lit(0.35), F.lit(0.55), F.lit(0.8))).alias("q"))
    return q.select("Category", F.explode("q").alias("q")).select("Category", F.greatest(F.lit(1), F.floor(F.col("q") / 10) * 10).cast("bigint").alias("budget")).distinct()


@query("agg_rows_by_category", f"WITH {CATALOGUE_SQL} SELECT Category, string_agg(CAST(Product_ID AS VARCHAR), ',' ORDER BY Rating DESC, Product_ID) AS ids FROM cat WHERE Rating >= 4.5 GROUP BY Category")
def rows_by_category(spark, d):
    listed = catalogue(spark, d).where("Rating >= 4.5").groupBy("Category").agg(F.array_sort(F.collect_list(F.struct((-F.col("Rating")).alias("r"), "Product_ID"))).alias("rows"))
    return listed.select("Category", F.array_join(F.transform("rows", lambda x: x["Product_ID"].cast("string")), ",").alias("ids"))


@query(
    "srt_top_per_category_budget",
    f"""WITH {CATALOGUE_SQL}, p AS (SELECT *, count(*) FILTER (WHERE Price <= 1000 * 1.08) OVER (PARTITION BY Category) AS n FROM cat)
    SELECT Category, Product_ID, row_number() OVER (PARTITION BY Category ORDER BY Rating DESC, Rating_Count DESC, Price, Product_ID) AS rank FROM p WHERE n < 3 OR Price <= 1000 * 1.08 QUALIFY rank <= 3""",
)
def top_per_category_budget(spark, d):
    return R.top_per_category(catalogue(spark, d), 1000.0, 3).select("Category", "Product_ID", "rank")


@query("srt_latest_per_category", f"WITH {CATALOGUE_SQL}, {SALES_SQL} SELECT Category, l_orderkey, l_linenumber FROM ord JOIN cat USING (Product_ID) QUALIFY row_number() OVER (PARTITION BY Category ORDER BY Order_DateTime DESC, l_orderkey DESC, l_linenumber DESC) = 1")
def latest_per_category(spark, d):
    joined = sales(spark, d).join(catalogue(spark, d).select("Product_ID", "Category"), "Product_ID")
    best = joined.groupBy("Category").agg(F.max(F.struct("Order_DateTime", "l_orderkey", "l_linenumber")).alias("x"))
    return best.select("Category", "x.l_orderkey", "x.l_linenumber")


_ALT = """, b AS (SELECT t.Product_ID AS target_id, c.Product_ID, c.Product_Title, abs(c.Price - t.Price) AS pg, abs(c.Rating - t.Rating) AS rg FROM cat t JOIN cat c ON c.Category = t.Category AND c.Product_ID <> t.Product_ID),
r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY target_id, Product_Title ORDER BY pg, rg, Product_Title, Product_ID) > 1 THEN 1 ELSE 0 END AS rep FROM b)
SELECT target_id, Product_ID, row_number() OVER (PARTITION BY target_id ORDER BY rep, pg, rg, Product_Title, Product_ID) AS rank FROM r QUALIFY rank <= 3
"""


@query("srt_nearest_alternatives", f"WITH {CATALOGUE_SQL} {_ALT}")
def nearest_alternatives(spark, d):
    cat = catalogue(spark, d)
    return R.nearest_alternatives(cat, 3, cat).select("target_id", "Product_ID", "rank")


@query(
    "win_history_window",
    """SELECT conv_id, turn, coalesce(string_agg(role || ':' || length(text), ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations""",
)
def history_window(spark, d):
    told = R.history(table(spark, d, "conversations"), 2)
    return told.select("conv_id", "turn", F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["role"], F.length(h["text"]).cast("string"))), ",").alias("history"))


@query(
    "win_rate_limit_60s",
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS recent,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) > 1 AS limited FROM events""",
)
def rate_limit(spark, d):
    return R.rate_limited(table(spark, d, "events"), "user_id", "ts", 60, 1).select("event_id", "recent", "limited")


@query("ded_exact_keep_first", "SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, text")
def exact_keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.xxhash64("text").alias("h1"), F.md5("text").alias("h2"))
    return docs.groupBy("source", "h1", "h2").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query("ded_record_fingerprint", """SELECT sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def record_fingerprint(spark, d):
    return table(spark, d, "documents").groupBy(R.fingerprint("source", "lang", "n_chars").alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "ded_title_pairs",
    """WITH t AS (SELECT min(p_partkey) AS id, p_name AS title FROM part GROUP BY p_name), c AS (SELECT id, list_distinct(list_filter(string_split(lower(title), ''), lambda x: x <> '' AND x <> ' ')) AS s FROM t)
    SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS similarity
    FROM c a JOIN c b ON a.id < b.id WHERE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.7""",
)
def title_pairs(spark, d):
    titles = table(spark, d, "part").groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("id"))
    return R.character_set_pairs(titles.select("id", "title"), 0.7).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("ded_title_greedy")
def title_greedy(spark, d):
    titles = table(spark, d, "part").groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("id"))
    return R.greedy_keep(titles.select("id", "title"), 0.7)


@query("set_union_slices", "SELECT 0 AS slice, doc_id FROM labels WHERE quality = 1 UNION ALL SELECT 1 AS slice, doc_id FROM labels WHERE toxic = 0")
def union_slices(spark, d):
    labels = table(spark, d, "labels")
    part = lambda n, where: labels.where(where).select(F.lit(n).alias("slice"), "doc_id")
    return part(0, "quality = 1").unionByName(part(1, "toxic = 0"))


@query(
    "hsh_md5_bucket",
    """SELECT p_partkey, CAST(list_reduce(list_transform(string_split(md5(CAST(p_partkey AS VARCHAR)), ''), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS BIGINT)), lambda a, b: (a * 16 + b) % 100) AS INTEGER) AS bucket FROM part""",
)
def md5_bucket(spark, d):
    return table(spark, d, "part").select("p_partkey", hash_bucket(F.col("p_partkey").cast("string")).alias("bucket"))


@query(
    "exp_stable_quota_split",
    """WITH b AS (SELECT p_partkey, p_type, CASE WHEN list_reduce(list_transform(string_split(md5(CAST(p_partkey AS VARCHAR)), ''), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS BIGINT)), lambda a, b: (a * 16 + b) % 100) < 15 THEN 'val' ELSE 'train' END AS split FROM part)
    SELECT p_type, split, p_partkey FROM b QUALIFY row_number() OVER (PARTITION BY p_type, split ORDER BY p_partkey) <= CASE WHEN split = 'val' THEN 6 ELSE 34 END""",
)
def stable_quota_split(spark, d):
    return R.quota_split(table(spark, d, "part"), "p_partkey", "p_type", ["p_partkey"], 40, 0.15).select("p_type", "split", "p_partkey")


@query(
    "exp_focus_slices",
    """WITH s(slice_id, quality, toxic) AS (VALUES ('clean_good', 1, 0), ('clean_poor', 0, 0), ('toxic', 1, 1)) SELECT slice_id, count(*) AS records FROM labels JOIN s USING (quality, toxic) GROUP BY slice_id""",
)
def focus_slices(spark, d):
    slices = spark.createDataFrame([("clean_good", 1, 0), ("clean_poor", 0, 0), ("toxic", 1, 1)], "slice_id string, quality int, toxic int")
    return table(spark, d, "labels").join(F.broadcast(slices), ["quality", "toxic"]).groupBy("slice_id").agg(F.count("*").alias("records"))


@query("exp_summary_counts", "SELECT source, count(*) FILTER (WHERE doc_id % 10 = 0) AS val, count(*) FILTER (WHERE doc_id % 10 <> 0) AS train, count(*) AS total FROM documents GROUP BY source")
def summary_counts(spark, d):
    val = F.col("doc_id") % 10 == 0
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(val).alias("val"), F.count_if(~val).alias("train"), F.count("*").alias("total"))


@query(
    "gen_preference_pairs",
    """WITH g AS (SELECT doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY doc_id) AS n FROM documents JOIN labels USING (doc_id))
    SELECT a.lang, a.doc_id AS chosen, b.doc_id AS rejected FROM g a JOIN g b ON a.lang = b.lang AND a.n = b.n AND a.quality = 1 AND b.quality = 0""",
)
def preference_pairs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    placed = docs.withColumn("n", F.row_number().over(Window.partitionBy("lang", "quality").orderBy("doc_id")))
    good, bad = (placed.where(F.col("quality") == q).select("lang", "n", F.col("doc_id").alias(name)) for q, name in ((1, "chosen"), (0, "rejected")))
    return good.join(bad, ["lang", "n"]).select("lang", "chosen", "rejected")


@query(
    "trn_chatml",
    """SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""",
)
def chatml(spark, d):
    listed = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return listed.select("conv_id", F.array_join(F.transform("m", lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>"))), "\n").alias("text"))
