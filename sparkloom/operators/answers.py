"""Answers and prompts put together from ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_keywords


def match_reason(query: str | Column, text: str | Column, rating: str | Column, price: str | Column, median: str | Column) -> Column:
    """At most two of: matched keywords, a rating of 4.7 or more, a price up to the median."""
    q, t, r, p, m = (F.col(x) if isinstance(x, str) else x for x in (query, text, rating, price, median))
    words = F.slice(F.filter(query_keywords(q), lambda w: F.contains(F.lower(t), w)), 1, 2)
    reasons = F.filter(
        F.array(
            F.when(F.size(words) > 0, F.concat(F.lit("命中关键词："), F.array_join(words, " / "))),
            F.when(r >= 4.7, "口碑表现稳定"),
            F.when((p > 0) & (m > 0) & (p <= m), "价格带更友好"),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(reasons) == 0, "综合语义匹配、评分和价格推荐").otherwise(F.array_join(F.slice(reasons, 1, 2), "；"))


def listed(rows: DataFrame, key: str, order: list[str], line: Column, limit: int, name: str = "text") -> DataFrame:
    """(key, text): the first rows of each key by order, a numbered line each."""
    top = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= limit)
    made = top.select(key, F.struct("__n", line.alias("line")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return made.select(key, F.array_join(F.transform("xs", lambda x: F.concat(x["__n"].cast("string"), F.lit(". "), x["line"])), "\n").alias(name))


def template_answer(ranked: DataFrame, key: str = "qid") -> DataFrame:
    """A plain answer from ranked products (key, rank, Product_Title, Price, Rating)."""
    line = F.concat("Product_Title", F.lit(" — ¥"), F.format_number("Price", 2), F.lit(" ("), F.format_number("Rating", 1), F.lit("/5)"))
    return listed(ranked, key, ["rank"], line, 5, "answer")


def context_block(docs: DataFrame, key: str = "qid", limit: int = 5, chars: int = 300) -> DataFrame:
    """(key, context): the best documents of each key, cut to chars characters."""
    return listed(docs, key, ["rank"], F.left("text", F.lit(chars)), limit, "context")


def prompt(system: str, context: str | Column, history: str | Column, question: str | Column) -> Column:
    """array<struct<role,content>>: system with its context, history, question."""
    context, history, question = (F.col(x) if isinstance(x, str) else x for x in (context, history, question))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    head = F.when(F.coalesce(context, F.lit("")) == "", F.lit(system)).otherwise(F.concat(F.lit(system + "\n\n"), context))
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(F.array(message("system", head)), F.coalesce(history, empty), F.array(message("user", question)))
