"""Seeded synthetic products and orders: every value is a hash of seed and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (category, brands, nouns, low price, high price)
BLUEPRINTS = (
    ("手机", ["星河", "云岭", "北辰"], ["旗舰手机", "轻薄手机", "长续航手机"], 999, 5999),
    ("耳机", ["音野", "声屿", "北辰"], ["降噪耳机", "运动耳机", "通勤耳机"], 99, 1499),
    ("键盘", ["键客", "云岭"], ["机械键盘", "静音键盘"], 129, 899),
    ("跑鞋", ["疾风", "山行"], ["缓震跑鞋", "越野跑鞋", "竞速跑鞋"], 199, 1299),
    ("护肤", ["沐岚", "清芷"], ["修护面霜", "温和洁面", "保湿精华"], 49, 699),
    ("家电", ["简居", "暖屋"], ["空气炸锅", "吸尘器"], 199, 2999),
    ("背包", ["山行", "旅匠"], ["通勤背包", "登山包"], 89, 799),
    ("显示器", ["清视", "星河"], ["高刷显示器", "护眼显示器"], 699, 3999),
)


def uniform(seed: int, *parts: str | Column) -> Column:
    """A number in [0, 1) from a hash of the seed and the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 40)) / float(1 << 40)


def pick(array: Column, u: Column) -> Column:
    return F.element_at(array, (F.floor(u * F.size(array)) + 1).cast("int"))


def synthetic_products(spark: SparkSession, seed: int = 42, per_category: int = 12) -> DataFrame:
    blue = spark.createDataFrame(list(BLUEPRINTS), "Category string, brands array<string>, nouns array<string>, low int, high int")
    rows = blue.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(per_category))))
    u = lambda slot: uniform(seed, "Category", "i", F.lit(slot))
    brand = pick(F.col("brands"), u("brand"))
    return rows.select(
        F.concat(F.lit("SYN-"), "Category", F.lit("-"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("Product_ID"),
        F.concat(brand, F.lit(" "), pick(F.col("nouns"), u("noun")), F.lit(" "), F.col("i").cast("string")).alias("Product_Title"),
        "Category",
        brand.alias("Brand"),
        F.round(F.col("low") + u("price") * (F.col("high") - F.col("low")), 2).alias("Price"),
        F.round(3.6 + u("rating") * 1.4, 1).alias("Rating"),
        (20 + F.floor(u("count") * 5000)).alias("Rating_Count"),
        F.lit("synthetic-demo").alias("source"),
    )


def synthetic_orders(products: DataFrame, now: str, seed: int = 42, count: int = 240) -> DataFrame:
    """Orders that walk back from now; priorities are Low, Medium, High at 2 : 5 : 3."""
    spark = products.sparkSession
    total = products.count()
    # A product's number comes from a sort of ids, joined by number: no list of products in one row.
    from pyspark.sql import Window

    numbered = products.withColumn("n", F.row_number().over(Window.orderBy("Product_ID")) - 1)
    rows = spark.range(count).withColumn("n", F.floor(uniform(seed, "id", F.lit("product")) * max(1, total)).cast("int"))
    u = lambda slot: uniform(seed, "id", F.lit(slot))
    priority = F.when(u("priority") < 0.2, "Low").when(u("priority") < 0.7, "Medium").otherwise("High")
    quantity = 1 + F.floor(u("quantity") * 3)
    return rows.join(numbered, "n").select(
        F.format_string("ORD%06d", F.col("id") + 1).alias("Order_ID"),
        (10_000 + F.floor(u("customer") * 60)).alias("Customer_Id"),
        "Product_ID",
        F.col("Product_Title").alias("Product"),
        F.col("Category").alias("Product_Category"),
        quantity.cast("double").alias("Quantity"),
        F.round(F.col("Price") * quantity, 2).alias("Sales"),
        priority.alias("Order_Priority"),
        F.date_format(F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), (F.col("id") * 5 + F.floor(u("hours") * 5)).cast("int")), "yyyy-MM-dd HH:mm:ss").alias("Order_DateTime"),
    )
