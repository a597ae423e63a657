"""Registered round trips through the sources and sinks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query
from .sources import tables as T
from .sources.tables import table


@query("src_csv_round_trip", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ', \"' || chr(10) || p_brand || '\"' AS title, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part")
def csv_round_trip(spark, d):
    raw = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(', "\n'), "p_brand", F.lit('"')).alias("title"), F.col("p_retailprice").cast("double").alias("price"))
    path = T.resolve_path(spark, None, T.working_dir(spark, "csv"), lambda: raw)
    return T.read_csv(spark, path).select("id", "title", F.round(F.col("price").cast("double") * 100).cast("bigint").alias("cents"))


@query("src_json_lines_round_trip", "SELECT o_orderkey AS id, o_orderpriority AS title, o_orderstatus || ',键' AS tags, (SELECT count(*) FROM orders) AS written FROM orders")
def json_lines_round_trip(spark, d):
    path = T.working_dir(spark, "jsonl")
    raw = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.array("o_orderstatus", F.lit("键")).alias("tags"))
    written = T.write_json_lines(raw, path)
    return T.read_json_lines(spark, path, "id long, title string, tags array<string>").select("id", "title", F.array_join("tags", ",").alias("tags"), F.lit(written).cast("bigint").alias("written"))


@query("src_json_arrays", "SELECT n_nationkey AS id, n_name AS title FROM nation WHERE n_nationkey % 5 <> 0")
def json_arrays(spark, d):
    """One file per region holding an array; records without a title go."""
    path = T.working_dir(spark, "arrays")
    title = F.when(F.col("n_nationkey") % 5 == 0, F.lit(" ")).otherwise(F.col("n_name"))
    rows = table(spark, d, "nation").select("n_regionkey", F.struct(F.col("n_nationkey").alias("id"), title.alias("title")).alias("r"))
    rows.groupBy("n_regionkey").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("n_regionkey").text(path)
    return T.valid_crawl(T.read_json_arrays(spark, path, "id long, title string")).select("id", "title")


@query("src_cached_summary", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def cached_summary(spark, d):
    path = T.working_dir(spark, "summary")
    make = lambda: table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    T.cached(spark, path, make)
    return T.cached(spark, path, lambda: spark.createDataFrame([], "status string, n long"))


@query("snk_markdown_report", "SELECT '# 订单' || chr(10) || chr(10) || '| status | n |' || chr(10) || '| - | - |' || chr(10) || string_agg('| ' || status || ' | ' || n || ' |', chr(10) ORDER BY status) AS report FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1)")
def markdown_report(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return T.markdown_report(counts, "订单", ["status"])


@query("snk_product_rows", "SELECT p_partkey AS id, left(p_name, 8) AS title, round(CAST(p_retailprice AS DOUBLE), 1) AS price FROM part")
def product_rows(spark, d):
    kept = T.write_stage(table(spark, d, "part"), T.working_dir(spark, "stage"), "products")
    return kept.select(F.col("p_partkey").alias("id"), F.left("p_name", F.lit(8)).alias("title"), F.round(F.col("p_retailprice").cast("double"), 1).alias("price"))
