"""Registered queries of whole searches, prompts, evidence and remaining sources, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import prompts as P
from .operators import records as N
from .operators import retrieval as I
from .queries_text import _BM25, _FUSED, _QUESTIONS, _dense, _sparse
from .registry import query
from .sources.tables import CATALOGUE_SQL, catalogue, read_raw_products, table, working_dir, write_vectors


@query(
    "ir_search_end_to_end",
    f"""WITH {CATALOGUE_SQL}, {_BM25}, {_QUESTIONS}, {_FUSED},
    best AS (SELECT qid, doc_id, score, Rating, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS n FROM fu JOIN cat ON Product_ID = doc_id QUALIFY n <= 5)
    SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM best WHERE Rating >= 3.5""",
)
def search_end_to_end(spark, d):
    mixed = I.fused([_sparse(spark, d), _dense(spark, d)], 20)
    found = I.search(mixed, catalogue(spark, d), 5, min_rating=3.5, id_col="Product_ID")
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "prj_retrieval_payload",
    f"""WITH {_BM25}, {_QUESTIONS}, un AS (SELECT qid, 'bm25_results' AS list, rank, doc_id, score FROM bm UNION ALL SELECT qid, 'dense_results', rank, doc_id, score FROM dn)
    SELECT qid, list, rank, un.doc_id AS id, round(CAST(score AS DECIMAL(18, 6)), 4)::DOUBLE AS score, left(text, 60) AS title FROM un LEFT JOIN documents d ON d.doc_id = un.doc_id WHERE rank <= 10""",
)
def retrieval_payload(spark, d):
    titles = table(spark, d, "documents").select("doc_id", F.col("text").alias("title"))
    lists = {"bm25_results": _sparse(spark, d), "dense_results": _dense(spark, d)}
    made = I.retrieval_payload(lists, titles)
    named = lambda n: lambda x: F.struct(F.lit(n).alias("list"), *[x[c].alias(c) for c in ("rank", "id", "score", "title")])
    shown = F.concat(*[F.transform(F.coalesce(F.col(n), F.array().cast(made.schema[n].dataType)), named(n)) for n in lists])
    return made.select("qid", F.explode(shown).alias("x")).select("qid", "x.*")


# Every product as a prompt: one in four in another form.
_PROMPT_SQL = "CASE WHEN Product_ID % 4 = 3 THEN '想买' || Product_Title ELSE '预算' || CASE WHEN Product_ID % 4 = 1 THEN '控制在' ELSE '' END || Product_ID || '元以内，主要用于 ' || Category || '，更看重' || Brand || '。谢谢。' END"


@query(
    "par_structured_prompt",
    f"WITH {CATALOGUE_SQL} SELECT Product_ID, CASE WHEN Product_ID % 4 = 3 THEN '' ELSE CAST(Product_ID AS VARCHAR) END AS budget, CASE WHEN Product_ID % 4 = 3 THEN '' ELSE Category END AS scene, CASE WHEN Product_ID % 4 = 3 THEN '' ELSE Brand END AS feature FROM cat",
)
def structured_prompt(spark, d):
    return catalogue(spark, d).select("Product_ID", P.structured_prompt(F.expr(_PROMPT_SQL)).alias("p")).select("Product_ID", "p.*")


@query(
    "str_short_reason",
    f"""WITH {CATALOGUE_SQL} SELECT Product_ID, CASE WHEN Product_ID % 5 = 0 THEN '更偏' || Brand || '取向，当前评分也比较稳。' WHEN Product_ID % 5 = 1 THEN '偏' || Category || '。'
    WHEN Product_ID % 5 = 2 THEN '更适合' || Category || '。' WHEN Product_ID % 5 = 3 THEN '偏' || Category || '取向，当前评分也比较稳。' ELSE Product_Title || '。' END AS reason FROM cat""",
)
def short_reason(spark, d):
    k = F.col("Product_ID") % 5
    said = F.when(k == 0, F.concat(F.lit("价格不高，"), "Brand")).when(k == 1, F.concat(F.lit("价格在预算内，更适合"), "Category")).when(k == 2, F.concat(F.lit("结合用途与当前评分表现，适合"), "Category", F.lit("。"))).when(k == 3, F.lit(" 。 ")).otherwise(F.col("Product_Title"))
    return catalogue(spark, d).select("Product_ID", P.short_reason(said, "Brand", F.col("Category")).alias("reason"))


@query("cln_leaked_turns", "SELECT conv_id, turn, trim(CASE WHEN role = 'assistant' THEN regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\n{3,}', chr(10) || chr(10), 'g') ELSE text END, ' ' || chr(9) || chr(10) || chr(13)) AS cleaned FROM conversations")
def leaked_turns(spark, d):
    told = F.when(F.col("role") == "assistant", F.concat("text", F.lit("🖇\r\n\r\nUSER\nagain"))).otherwise(F.concat("text", F.lit("\n\n玭\n> assistant\nx")))
    return table(spark, d, "conversations").select("conv_id", "turn", P.without_leaks(told).alias("cleaned"))


@query(
    "par_detail_numbers",
    """SELECT p_partkey, p_retailprice AS price, round_even((p_partkey % 50) * 2 / 100.0 * 5, 1)::DOUBLE AS rating FROM part""",
)
def detail_numbers(spark, d):
    price = F.concat(F.lit("¥ "), F.format_string("%.2f", F.col("p_retailprice").cast("double")))
    texts = [F.when(F.col("p_partkey") % 2 == 0, F.lit("1.2.3")).otherwise(price), F.when(F.col("p_partkey") % 3 > 0, F.lit("暂无")), price]
    rate = F.concat((F.col("p_partkey") % 50 * 2).cast("string"), F.lit("%好评"))
    return table(spark, d, "part").select("p_partkey", P.first_price(*texts).alias("price"), P.percent_rating(rate).alias("rating"))


@query(
    "prj_optional_fields",
    """SELECT event_id, 'type=' || event_type || CASE WHEN event_id % 3 = 0 THEN ',user=' || user_id ELSE '' END AS fields FROM events""",
)
def optional_fields(spark, d):
    events = table(spark, d, "events")
    made = P.with_extras(F.create_map(F.lit("type"), "event_type"), user=F.when(F.col("event_id") % 3 == 0, F.col("user_id")), note=F.when(F.col("event_id") % 2 == 0, F.lit("")))
    pairs = F.transform(F.array_sort(F.map_keys(made)), lambda k: F.concat(k, F.lit("="), made[k]))
    return events.select("event_id", F.array_join(pairs, ",").alias("fields"))


@query(
    "rag_system_message",
    f"""WITH {CATALOGUE_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY Category ORDER BY Rating DESC, Product_ID) AS n FROM cat QUALIFY n <= 5)
    SELECT Category, 'S' || chr(10) || chr(10) || '{P.EVIDENCE.strip()}' || chr(10) || chr(10) || string_agg('[' || n || '] ' || Product_Title || chr(10) || '价格：¥' || printf('%.2f', Price) || chr(10) || '评分：' || CAST(Rating AS VARCHAR) || '/5' || chr(10)
    || '品牌：' || Brand || chr(10) || '描述：' || chr(10) || '特点：' || Category || CASE WHEN Product_ID % 2 = 0 THEN chr(10) || '库存备注：有货' ELSE '' END || CASE WHEN Product_ID % 3 = 0 THEN chr(10) || '安全备注：远离火源' ELSE '' END, chr(10) || chr(10) ORDER BY n) AS message
    FROM c GROUP BY Category""",
)
def system_message(spark, d):
    notes = {"safety_note": F.when(F.col("Product_ID") % 3 == 0, F.lit(" 远离火源")), "availability": F.when(F.col("Product_ID") % 2 == 0, F.lit("有货"))}
    shown = P.evidence(F.col("Product_Title"), F.col("Price"), F.col("Rating"), F.col("Brand"), F.lit(None), F.col("Category"), notes)
    order = Window.partitionBy("Category").orderBy(F.desc("Rating"), "Product_ID")
    best = catalogue(spark, d).withColumn("n", F.row_number().over(order)).where("n <= 5")
    listed = best.groupBy("Category").agg(F.array_sort(F.collect_list(F.struct("n", shown.alias("text")))).alias("x"))
    return listed.select("Category", P.system_message("S", F.transform("x", lambda x: x["text"])).alias("message"))


@query("src_raw_products", f"WITH {CATALOGUE_SQL} SELECT Product_ID, Product_Title, Price, Rating, CAST(CASE WHEN Product_ID % 3 = 0 THEN 0 ELSE Rating_Count END AS BIGINT) AS Rating_Count FROM cat WHERE Product_ID % 7 > 1")
def raw_products(spark, d):
    k = F.col("Product_ID")
    raw = catalogue(spark, d).select(
        "Product_ID", F.col("Product_Title").alias("title"), F.when(k % 7 == 0, "-1").otherwise(F.col("Price").cast("string")).alias("price"),
        F.when(k % 7 == 1, "none").otherwise(F.col("Rating").cast("string")).alias("average_rating"), F.when(k % 3 > 0, F.col("Rating_Count").cast("string")).alias("rating_number"),
    )
    return read_raw_products(raw).select("Product_ID", "Product_Title", "Price", "Rating", "Rating_Count")


@query("snk_vectors", "SELECT count(*) AS rows, max(len(embedding)) AS dimensions FROM embeddings")
def vectors(spark, d):
    return write_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), working_dir(spark, "vectors"))


@query("ir_encode", "WITH v AS (SELECT item_id, length(text)::DOUBLE AS a, length(replace(text, 'e', ''))::DOUBLE AS b FROM benchmark) SELECT item_id, round(a / sqrt(a * a + b * b), 6) AS x, round(b / sqrt(a * a + b * b), 6) AS y FROM v")
def encode(spark, d):
    made = I.encoded(table(spark, d, "benchmark"), lambda texts: [[len(t), len(t.replace("e", ""))] for t in texts], id_col="item_id")
    return made.select("item_id", F.round(F.col("embedding")[0], 6).alias("x"), F.round(F.col("embedding")[1], 6).alias("y"))


@query("prj_product_rows", f"WITH {CATALOGUE_SQL} SELECT CAST(Product_ID AS VARCHAR) AS Product_ID, trim(Product_Title) AS Product_Title, trim(Category) AS Category, '' AS Description, trim(Brand) AS Brand, '' AS features, Price::DOUBLE AS Price, Rating::DOUBLE AS Rating FROM cat")
def product_rows(spark, d):
    return N.product_rows(catalogue(spark, d).withColumn("Product_Title", F.concat(F.lit(" \t"), "Product_Title", F.lit("\n"))))


@query("flt_bundle_records", f"WITH {CATALOGUE_SQL} SELECT l_orderkey, l_linenumber FROM lineitem JOIN cat ON Product_ID = l_partkey WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND Brand IN ('Brand#11', 'Brand#23')")
def bundle_records(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("dimension"), F.col("l_linestatus").alias("task"), F.col("l_partkey").alias("product_id"))
    products = catalogue(spark, d).drop("Category").withColumnRenamed("Brand", "Category")
    return N.bundle_records(lines, products, dimension="R", task="F", categories=["Brand#11", "Brand#23"], by_category=True).select("l_orderkey", "l_linenumber")


@query("prj_surrogate_ids", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || '_' || (row_number() OVER (ORDER BY event_id) - 1) ELSE 'e' || event_id END AS id FROM events")
def surrogate_ids(spark, d):
    given = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("e"), F.col("event_id").cast("string")))
    return N.surrogate_ids(table(spark, d, "events").withColumn("id", given), "id", "event_type", "event_id", width=1000).select("event_id", "id")
