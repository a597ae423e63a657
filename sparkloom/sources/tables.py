"""Readers, and the adapters from the star schema to catalogue and orders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed column names of the runtime tables and their defaults.
PRODUCT_DEFAULTS = {
    "Product_ID": "", "Product_Title": "", "Category": "", "Description": "", "Brand": "", "Store": "",
    "Price": 0.0, "Rating": 0.0, "Rating_Count": 0, "features": "", "source": "", "Image": "",
}
ORDER_DEFAULTS = {
    "Order_ID": "", "Customer_Id": 0, "Product_ID": "", "Product": "", "Product_Category": "", "Sales": 0.0, "Quantity": 1, "Discount": 0.0, "Profit": 0.0,
    "Shipping_Cost": 0.0, "Order_Priority": "Medium", "Shipping_Status": "已签收", "Payment_Method": "Alipay", "Order_Date": "", "Time": "", "Order_DateTime": "", "source": "",
}
#: Column names of the three product dialects, and of orders.
PRODUCT_ALIASES = {
    "title": "Product_Title", "average_rating": "Rating", "description": "Description", "price": "Price", "parent_asin": "Product_ID", "main_category": "Category",
    "rating_number": "Rating_Count", "brand": "Brand", "store": "Store", "image_url": "Image",
    "product_id": "Product_ID", "category": "Category", "rating": "Rating", "review_count": "Rating_Count",
}
ORDER_ALIASES = {"payment_method": "Payment_Method", "Payment_method": "Payment_Method", "customer_id": "Customer_Id", "product_id": "Product_ID", "product_title": "Product"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column text: types are coerced later."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, lines that don't parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that each hold a JSON array; with the file's name, for its order. Bad files give no rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).withColumn("file_name", F.col("_metadata.file_name"))


def write_json_lines(df: DataFrame, path: str) -> int:
    """Rows written, counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation("rows")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return int(seen.get["n"])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a product table; ratings stand in from the quantities sold."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("Product_ID")).agg(F.least(F.lit(5.0), F.round(F.avg("l_quantity") / 6, 4)).alias("Rating"), F.count("*").alias("Rating_Count"))
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("Product_ID"), F.col("p_name").alias("Product_Title"), F.col("p_type").alias("Category"), F.col("p_brand").alias("Brand"), F.col("p_retailprice").alias("Price")
    )
    return part.join(sold, "Product_ID", "left").select("Product_ID", "Product_Title", "Category", "Brand", "Price", F.coalesce("Rating", F.lit(0.0)).alias("Rating"), F.coalesce("Rating_Count", F.lit(0)).alias("Rating_Count"))


CATALOGUE_SQL = """cat AS (
  SELECT p_partkey AS Product_ID, p_name AS Product_Title, p_type AS Category, p_brand AS Brand, p_retailprice AS Price,
         coalesce(Rating, 0.0) AS Rating, coalesce(Rating_Count, 0) AS Rating_Count
  FROM part LEFT JOIN (SELECT l_partkey, least(5.0, round(avg(l_quantity) / 6, 4)) AS Rating, count(*) AS Rating_Count FROM lineitem GROUP BY l_partkey) s ON l_partkey = p_partkey
)"""


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem and orders as an order table."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("Product_ID"), F.col("l_quantity").alias("Quantity"), F.col("l_discount").alias("Discount"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("Sales")
    )
    head = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("Customer_Id"), F.col("o_orderpriority").alias("Order_Priority"), F.col("o_orderdate").alias("Order_DateTime"))
    return items.join(head, "l_orderkey")


SALES_SQL = """ord AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS Product_ID, l_quantity AS Quantity, l_discount AS Discount, l_extendedprice * (1 - l_discount) AS Sales,
         o_custkey AS Customer_Id, o_orderpriority AS Order_Priority, o_orderdate AS Order_DateTime
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
)"""


def working_dir(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, else
    the warehouse, and only in local mode without either a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.startswith("local"):
        named = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def resolve_path(spark: SparkSession, explicit: str | None, default: str, make: Callable[[], DataFrame]) -> str:
    """The explicit path, else the default one, which is made as CSV where it is missing."""
    if explicit:
        if not exists(spark, explicit):
            raise FileNotFoundError(explicit)
        return explicit
    if not exists(spark, default):
        write_csv(make(), default)
    return default


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept at path, made and kept first where there is none."""
    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object over many lines, as a row."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def valid_crawl(df: DataFrame) -> DataFrame:
    """Crawled records with a title, as they are kept."""
    return df.where(F.trim(F.coalesce("title", F.lit(""))) != "")


def markdown_report(df: DataFrame, title: str, order: list[str]) -> DataFrame:
    """One row: a Markdown table of a summary's rows, under a title."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    lines = F.array_sort(F.collect_list(F.struct(*order, cells.alias("line"))))
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{' - |' * len(df.columns)}\n"
    return df.agg(lines.alias("l")).select(F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("report"))


def write_stage(df: DataFrame, base: str, stage: str) -> DataFrame:
    """A stage's table, whole before it takes its place; read back."""
    df.write.mode("overwrite").parquet(f"{base}/{stage}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/{stage}")


def read_raw_products(df: DataFrame) -> DataFrame:
    """A raw product dialect under the runtime's names, with numbers; rows without a price over 0 or a rating go."""
    # The raw names.
    names = {"title": "Product_Title", "main_category": "Category", "average_rating": "Rating", "rating_number": "Rating_Count", "price": "Price", "store": "Store", "description": "Description", "features": "Features"}
    out = df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})
    number = lambda c: F.col(c).cast("string").try_cast("double")
    out = out.withColumns({"Price": number("Price"), "Rating": number("Rating"), "Rating_Count": F.coalesce(number("Rating_Count").cast("bigint"), F.lit(0))})
    return out.where("Price > 0 AND Rating IS NOT NULL")


def write_vectors(df: DataFrame, path: str) -> DataFrame:
    """(id, embedding) as Parquet under path/vectors and one row (rows, dimensions) under path/info; returns the latter."""
    df.select("id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    kept = df.sparkSession.read.parquet(f"{path}/vectors")
    kept.agg(F.count("*").alias("rows"), F.max(F.size("embedding")).cast("bigint").alias("dimensions")).write.mode("overwrite").parquet(f"{path}/info")
    return df.sparkSession.read.parquet(f"{path}/info")


def read_batch_queries(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {text, customer_id}; a missing text is empty."""
    read = spark.read.schema("text string, customer_id bigint").option("multiLine", True).json(path)
    return read.withColumn("text", F.coalesce("text", F.lit("")))
