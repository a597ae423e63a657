"""Training samples from a catalogue: recommendations, comparisons, preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.synthetic import uniform


def recommendation_samples(products: DataFrame, per_category: int, seed: int = 42, picks: int = 3) -> DataFrame:
    """(sample_id, category, budget, prompt, answer): for each sample of a category,
    the picks products within the budget that come first in hash order; samples
    with fewer are left out. Budgets are quantiles of the category's prices."""
    q = products.groupBy("Category").agg(F.percentile("Price", F.array(F.lit(0.35), F.lit(0.55), F.lit(0.8))).alias("q"))
    asked = q.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_category - 1))))
    asked = asked.withColumn("budget", F.greatest(F.lit(1), F.floor(F.element_at("q", (F.col("i") % 3 + 1).cast("int")) / 10) * 10)).drop("q")
    fits = asked.join(products, "Category").where("Price <= budget").withColumn("u", uniform(seed, "Category", "i", "Product_ID"))
    chosen = fits.withColumn("n", F.row_number().over(Window.partitionBy("Category", "i").orderBy("u", "Product_ID"))).where(F.col("n") <= picks)
    line = F.concat(F.col("n").cast("string"), F.lit(". **"), "Product_Title", F.lit("** 价格：¥"), F.format_string("%.2f", "Price"), F.lit("，评分："), F.format_string("%.1f", "Rating"))
    grouped = chosen.groupBy("Category", "i", "budget").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines")).where(F.size("lines") == picks)
    return grouped.select(
        F.concat_ws("-", "Category", "i").alias("sample_id"),
        F.col("Category").alias("category"),
        "budget",
        F.concat(F.lit("预算 "), F.col("budget").cast("string"), F.lit(" 元，推荐几款"), "Category").alias("prompt"),
        F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("answer"),
    )


def comparison_samples(products: DataFrame, seed: int = 42) -> DataFrame:
    """(a, b, prompt, answer): each product beside the next of its category in hash order."""
    order = Window.partitionBy("Category").orderBy(uniform(seed, "Product_ID"), "Product_ID")
    columns = ["Product_ID", "Product_Title", "Price", "Rating"]
    beside = products.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("next_Product_ID IS NOT NULL")
    cheaper = F.when(F.col("Price") <= F.col("next_Price"), F.col("Product_Title")).otherwise(F.col("next_Product_Title"))
    better = F.when(F.col("Rating") >= F.col("next_Rating"), F.col("Product_Title")).otherwise(F.col("next_Product_Title"))
    return beside.select(
        F.col("Product_ID").alias("a"),
        F.col("next_Product_ID").alias("b"),
        F.concat("Product_Title", F.lit(" 和 "), "next_Product_Title", F.lit(" 怎么选？")).alias("prompt"),
        F.concat(F.lit("- 价格更低："), cheaper, F.lit("\n- 评分更高："), better).alias("answer"),
    )


def random_split(samples: DataFrame, id_col: str, val_ratio: float, seed: int = 42) -> DataFrame:
    """split by hash order: the last share is val, never empty where there are two rows."""
    total = samples.count()
    train = min(int(total * (1 - val_ratio)), max(1, total - 1))
    cut = samples.select(id_col, F.xxhash64(F.lit(seed), id_col).alias("h")).orderBy("h", id_col).limit(train).agg(F.max(F.struct("h", id_col)).alias("last"))
    marked = samples.withColumn("__k", F.struct(F.xxhash64(F.lit(seed), id_col).alias("h"), F.col(id_col).alias(id_col))).crossJoin(F.broadcast(cut))  # cut is one row
    return marked.withColumn("split", F.when(F.col("__k") <= F.col("last"), "train").otherwise("val")).drop("__k", "last")


def manifest(samples: DataFrame, slice_col: str, split_col: str = "split") -> DataFrame:
    """(slice, train, val, total)."""
    return samples.groupBy(F.col(slice_col).alias("slice")).agg(F.count_if(F.col(split_col) == "train").alias("train"), F.count_if(F.col(split_col) == "val").alias("val"), F.count("*").alias("total"))
