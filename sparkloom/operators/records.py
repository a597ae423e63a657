"""Cleaning, cards, selections and summaries of product, order and case records."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def preprocess_products(df: DataFrame) -> DataFrame:
    """Products with a price and a rating of 0 to 5, with their combined text."""
    text = F.concat_ws(" ", *[F.coalesce(strip(c), F.lit("")) for c in ("Product_Title", "Brand", "Category")])
    return df.where((F.col("Price") > 0) & F.col("Rating").between(0, 5)).withColumn("combined_text", text)


def preprocess_orders(df: DataFrame) -> DataFrame:
    """Orders with sales, amounts derived and the priority's words capitalised."""
    kept = df.where(F.col("Sales") > 0)
    return kept.withColumns({"Total_Amount": F.col("Sales") * F.col("Quantity"), "Net_Profit": F.col("Profit") - F.col("Shipping_Cost"), "Order_Priority": F.initcap(strip("Order_Priority"))})


def complete_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in order; those that df lacks are null text."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def valid_records(df: DataFrame, title: str = "title", price: str = "price") -> DataFrame:
    """Titles of two characters or more; prices unknown, not a number or above 0."""
    return df.where((F.length(strip(title)) >= 2) & (F.col(price).isNull() | F.isnan(price) | (F.col(price) > 0)))


def price_text(price: str | Column) -> Column:
    """¥ with thousands separators; 价格未知 for null and NaN."""
    p = _c(price).cast("double")
    return F.when(p.isNull() | F.isnan(p), "价格未知").otherwise(F.concat(F.lit("¥"), F.format_number(p, 2)))


def product_text(title: str | Column, price: str | Column, rating: str | Column) -> Column:
    return F.concat(_c(title), F.lit(" | "), price_text(price), F.lit(" | "), F.format_string("%.1f/5", _c(rating).cast("double")))


def feature_bullets(raw: str | Column, count: int = 4) -> Column:
    """Lines of the first features of a bracketed, quoted list, longer than two characters."""
    parts = F.transform(F.split(F.regexp_replace(_c(raw), r"^[\[\]]+|[\[\]]+$", ""), ","), lambda x: F.regexp_replace(strip(x), "^['\"]+|['\"]+$", ""))
    return F.array_join(F.transform(F.slice(F.filter(parts, lambda x: F.length(x) > 2), 1, count), lambda x: F.concat(F.lit("- "), x)), "\n")


def scene(description: str | Column, default: str = "日常使用") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(_c(description), "面向(.+?)场景设计", 1), F.lit("")), F.lit(default))


def known_brand(title: str | Column, brands: list[str]) -> Column:
    """The first listed brand that the title holds, whatever its case; empty if none."""
    low = F.lower(_c(title))
    return F.coalesce(*[F.when(F.contains(low, F.lit(b.lower())), b) for b in brands], F.lit(""))


def serialised(value: str | Column) -> Column:
    """JSON of a list or map, empty for none or nothing in it."""
    return F.when(F.coalesce(F.size(_c(value)), F.lit(0)) > 0, F.to_json(_c(value))).otherwise("")


def variant(text: str | Column, modulus: int = 3) -> Column:
    """Sum of code points, modulo."""
    letters = F.filter(F.split(_c(text), ""), lambda x: x != "")
    return (F.aggregate(letters, F.lit(0).cast("bigint"), lambda n, x: n + F.ascii(x)) % modulus).cast("int")


def date_bounds(first: str, last: str) -> tuple[date, date]:
    """Both days, YYYY-MM-DD; ValueError for another form or if they are reversed."""
    out = tuple(date.fromisoformat(x) if len(x) == 10 else _refuse(x) for x in (first, last))
    if out[0] > out[1]:
        raise ValueError(f"{first} is after {last}")
    return out


def _refuse(text: str) -> date:
    raise ValueError(f"{text!r} isn't YYYY-MM-DD")


def in_bundle(task: str, scenarios: list[str], categories: list[str]) -> Column:
    """Whether a record is of the task and a scenario and shares a category."""
    return (F.col("task") == task) & F.col("scenario").isin(scenarios) & F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories]))


def category_counts(df: DataFrame, allowed: list[str]) -> DataFrame:
    """(category, n) of the allowed ones, sorted."""
    some = F.array_intersect("categories", F.array(*[F.lit(c) for c in allowed]))
    return df.select(F.explode(some).alias("category")).groupBy("category").agg(F.count("*").alias("n")).orderBy("category")


def drop_reasons(prompt: str | Column, answer: str | Column, *, blocked: list[str], required: list[str]) -> Column:
    """Why a follow-up record goes: array of blocked, missing, unaligned; empty if it stays."""
    has = lambda text, words: reduce(lambda a, b: a | b, [F.contains(_c(text), F.lit(w)) for w in words])
    tests = {"blocked": has(answer, blocked), "missing": ~has(answer, required), "unaligned": ~has(prompt, required)}
    return F.filter(F.array(*[F.when(c, n) for n, c in tests.items()]), lambda x: x.isNotNull())


def partition_cases(df: DataFrame, actions: list[str], scenarios: list[str]) -> DataFrame:
    """Every case, with whether its action and scenario take it into a plan."""
    return df.withColumn("included", F.coalesce(F.col("action").isin(actions) & F.col("scenario").isin(scenarios), F.lit(False)))


def first_seen(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): distinct values in the order of their first row."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(key).agg(listed.alias("l")).select(key, F.array_distinct(F.transform("l", lambda x: x["v"])).alias("values"))


def showcase(scores: DataFrame) -> DataFrame:
    """(stage, case_id, margin): each stage's case with the largest lead over the
    best other stage, ties to the smaller case. scores(case_id, stage, overall)."""
    both = scores.groupBy("case_id").agg(F.sort_array(F.collect_list("overall"), asc=False).alias("all"), F.max_by("stage", F.struct("overall", "stage")).alias("best"))
    led = both.where(F.size("all") > 1).select("case_id", F.col("best").alias("stage"), F.round(F.get("all", F.lit(0)) - F.get("all", F.lit(1)), 6).alias("margin"))
    top = F.max(F.struct(F.col("margin"), (-F.col("case_id")).alias("neg")))
    return led.groupBy("stage").agg(top.alias("top")).select("stage", (-F.col("top.neg")).alias("case_id"), F.col("top.margin").alias("margin"))


def lead_items(df: DataFrame, key: str) -> DataFrame:
    """Each key's item by rating, then the lower price, then the smaller id."""
    order = F.struct((-F.col("Rating")).alias("r"), F.col("Price").alias("p"), F.col("Product_ID").alias("i"))
    return df.groupBy(key).agg(F.min_by("Product_ID", order).alias("lead"))


def order_breakdown(df: DataFrame) -> DataFrame:
    """Orders and sales in all, by priority and by status, in one pass."""
    return df.groupingSets([[], ["priority"], ["status"]], "priority", "status").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


def newest_orders(df: DataFrame, key: str, time: str, order: str, count: int = 5) -> DataFrame:
    place = Window.partitionBy(key).orderBy(F.desc(time), order)
    return df.withColumn("place", F.row_number().over(place)).where(F.col("place") <= count)


def order_answer(df: DataFrame, key: str) -> DataFrame:
    """(key, answer) from place, order and amount: numbered lines under a head."""
    line = F.format_string("%d. 订单 %s，金额 %s", F.col("place"), F.col("order").cast("string"), price_text("amount"))
    lines = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return df.groupBy(key).agg(lines.alias("l")).select(key, F.concat(F.format_string("最近 %d 笔订单：\n", F.size("l")), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("answer"))


#: Places of a product id in a URL, in order.
ID_PATTERNS = (r"[?&]id=(\d+)", r"/item/(\d+)", r"/(\d+)\.html", r"/(\d+)$")


def product_id(url: str | Column) -> Column:
    """The id that the first fitting pattern finds, else the URL."""
    return F.coalesce(*[F.nullif(F.regexp_extract(_c(url), p, 1), F.lit("")) for p in ID_PATTERNS], _c(url))


def specs(lines: str | Column) -> Column:
    """array of (key, value), cut at the first ： or else :, of lines that have both."""

    def pair(x: Column) -> Column:
        head = F.when(F.contains(x, F.lit("：")), F.substring_index(x, "：", 1)).otherwise(F.substring_index(x, ":", 1))
        return F.struct(strip(head).alias("key"), strip(F.substr(x, F.length(head) + 2)).alias("value"))

    pairs = F.transform(F.filter(_c(lines), lambda x: x.rlike("[：:]")), pair)
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))


def product_rows(df: DataFrame) -> DataFrame:
    """The fields that pair builders read: texts trimmed, null ones empty, price and rating as numbers."""
    text = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in df.columns else F.lit("")
    names = ("Product_ID", "Product_Title", "Category", "Description", "Brand", "features")
    return df.select(*[text(c).alias(c) for c in names], F.col("Price").cast("double").alias("Price"), F.col("Rating").cast("double").alias("Rating"))


def bundle_records(records: DataFrame, products: DataFrame, *, dimension: str, task: str, categories: list[str], by_category: bool) -> DataFrame:
    """Records of a dimension and a task; by category those whose product is of one
    of the categories, if any are named. A record without a product has no category."""
    some = records.where((F.col("dimension") == dimension) & (F.col("task") == task))
    if not by_category or not categories:
        return some
    known = products.where(strip(F.col("Category")).isin(categories)).select(strip(F.col("Product_ID").cast("string")).alias("__product")).where("__product <> ''")
    return some.join(known, strip(some["product_id"].cast("string")) == known["__product"], "left_semi")


def surrogate_ids(df: DataFrame, id_col: str, source_col: str, order: str, *, width: int = 1 << 16) -> DataFrame:
    """source_index for rows whose id is null or empty, the index counted from 0 over
    all rows by a unique whole number. Rows are numbered within ranges of that
    number, and only the counts of the ranges are added up in one place."""
    slot = F.floor(F.col(order) / width)
    counts = df.groupBy(slot.alias("__slot")).agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__slot", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    placed = df.withColumn("__slot", slot).join(starts, "__slot")
    index = F.col("__start") + F.row_number().over(Window.partitionBy("__slot").orderBy(order)) - 1
    made = placed.withColumn("__index", index).withColumn(id_col, F.when(F.coalesce(F.col(id_col).cast("string"), F.lit("")) == "", F.concat(F.coalesce(source_col, F.lit("")), F.lit("_"), F.col("__index").cast("string"))).otherwise(F.col(id_col).cast("string")))
    return made.drop("__slot", "__start", "__index")
