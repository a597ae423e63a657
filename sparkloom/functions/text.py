"""Text, number and parsing functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"
#: Ends of the rating and price phrases that queries use.
RATING_PATTERNS = (r"(\d\.?\d?)\s*[分星]以上", r"above\s+(\d\.?\d?)")
PRICE_RANGE_PATTERNS = (r"(\d+\.?\d*)\s*元?\s*以[内下]", r"(\d+\.?\d*)\s*元?\s*以上", r"(\d+\.?\d*)\s*[-~到]\s*(\d+\.?\d*)\s*元?", r"(?i)under\s+\$?(\d+\.?\d*)", r"(?i)above\s+\$?(\d+\.?\d*)")
BUDGET_PATTERNS = (r"预算\s*(\d+(?:\.\d+)?)\s*元", r"(\d+(?:\.\d+)?)\s*元以内", r"控制在\s*(\d+(?:\.\d+)?)\s*元")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def strip(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def rstrip(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), r"(?U)\s+$", "")


def clean_text(value: str | Column) -> Column:
    """Trimmed, white space collapsed; null becomes empty."""
    return F.coalesce(F.regexp_replace(strip(value), r"(?U)\s+", " "), F.lit(""))


def contains_chinese(text: str | Column) -> Column:
    return _c(text).rlike(f"[{CJK}]")


def preprocess_text(text: str | Column) -> Column:
    """clean_text, in lower case where no Chinese occurs."""
    one = clean_text(text)
    return F.when(contains_chinese(one), one).otherwise(F.lower(one))


def without_spaces(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), r"(?U)\s+", "")


def word_characters(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), r"(?U)[\W_]+", "")


def query_keywords(text: str | Column) -> Column:
    """The first six runs of two or more Chinese or ASCII letters and digits, lower-cased."""
    runs = F.regexp_extract_all(F.lower(_c(text)), F.lit(rf"([{CJK}A-Za-z0-9]+)"), F.lit(1))
    return F.slice(F.filter(runs, lambda t: F.length(t) >= 2), 1, 6)


def tokens(text: str | Column) -> Column:
    """Single Chinese characters and runs of other letters and digits of two or more."""
    runs = F.regexp_extract_all(_c(text), F.lit(rf"([{CJK}]|[\p{{L}}\p{{N}}&&[^{CJK}]]+)"), F.lit(1))
    return F.filter(runs, lambda t: (F.length(t) > 1) | t.rlike(f"[{CJK}]"))


def semantic_fragments(text: str | Column) -> Column:
    """Pieces between punctuation marks, four characters or longer."""
    return F.filter(F.transform(F.split(_c(text), "[，。！？；、,.!?;\n]"), strip), lambda x: F.length(x) >= 4)


def feature_lines(text: str | Column, count: int = 3) -> Column:
    parts = F.filter(F.transform(F.split(_c(text), "[、，,]"), lambda x: F.regexp_replace(x, "^[ -]+|[ -]+$", "")), lambda x: x != "")
    return F.slice(parts, 1, count)


def clean_price(value: str | Column) -> Column:
    """The first price of a text; null for none or 0."""
    digits = F.regexp_replace(F.split_part(_c(value).cast("string"), F.lit("-"), F.lit(1)), "[^0-9.]", "")
    price = digits.try_cast("double")
    return F.when(price > 0, F.round(price, 2))


def clean_rating(value: str | Column) -> Column:
    """A rating of 0 to 5; percentages are scaled, others are null."""
    r = _c(value).cast("string").try_cast("double")
    r = F.when(~F.isnan(r), r)
    return F.when(r > 100, None).when(r > 5, F.round(r / 100 * 5, 1)).when(r >= 0, F.round(r, 1))


def clean_count(value: str | Column) -> Column:
    """Digits of a count; 万 stands for four zeros, wherever it stands."""
    text = F.replace(_c(value).cast("string"), F.lit("万"), F.lit("0000"))
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("bigint")


def number_or_zero(value: str | Column) -> Column:
    n = _c(value).cast("string").try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(0.0)).otherwise(n)


def rounded(number: str | Column, digits: int) -> Column:
    """Halves away from zero in binary, as SQL over doubles rounds; round() takes the decimal digits, where 0.0019985 is a half."""
    whole = F.round(_c(number) * F.lit(10.0**digits))
    return whole / F.lit(10.0**digits)


def rating_floor(text: str | Column) -> Column:
    """The least rating that a query asks for."""
    return F.coalesce(found(_c(text), RATING_PATTERNS[0]), found(F.lower(_c(text)), RATING_PATTERNS[1])).try_cast("double")


def price_range(text: str | Column) -> Column:
    """struct(low, high); the first pattern that matches decides."""
    t = _c(text)
    bounds = lambda low, high: F.struct(low.try_cast("double").alias("low"), high.try_cast("double").alias("high"))
    none = F.lit(None).cast("string")
    within, from_, between, under, above = PRICE_RANGE_PATTERNS
    return (
        F.when(t.rlike(within), bounds(none, found(t, within)))
        .when(t.rlike(from_), bounds(found(t, from_), none))
        .when(t.rlike(between), bounds(found(t, between, 1), found(t, between, 2)))
        .when(t.rlike(under), bounds(none, found(t, under)))
        .when(t.rlike(above), bounds(found(t, above), none))
        .otherwise(bounds(none, none))
    )


def budget_limit(text: str | Column) -> Column:
    return F.coalesce(*[found(_c(text), p) for p in BUDGET_PATTERNS]).try_cast("double")


def prices(text: str | Column) -> Column:
    """Prices after a currency sign, then prices before 元; repeats stay."""
    signs = F.regexp_extract_all(_c(text), F.lit(r"[$¥]\s*(\d+(?:\.\d+)?)"), F.lit(1))
    words = F.regexp_extract_all(_c(text), F.lit(r"(\d+(?:\.\d+)?)\s*元"), F.lit(1))
    return F.transform(F.concat(signs, words), lambda x: x.try_cast("double"))


def confidence(score: str | Column, rating: str | Column) -> Column:
    """35 to 99: retrieval score (a sigmoid outside 0 to 1) and rating, 0.6 to 0.4."""
    s = F.coalesce(_c(score).cast("double"), F.lit(0.0))
    part = F.when(s.between(0, 1), s).otherwise(1 / (1 + F.exp(-s / 5)))
    stars = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(_c(rating).cast("double"), F.lit(0.0)) / 5))
    return F.least(F.lit(99), F.greatest(F.lit(35), F.bround((part * 0.6 + stars * 0.4) * 100, 0).cast("int")))


def clamp_score(value: str | Column) -> Column:
    """0 to 1; 0.5 where the value is no number."""
    n = _c(value).cast("string").try_cast("double")
    return F.when(n.isNull() | F.isnan(n), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def hash_bucket(text: str | Column, modulus: int = 100) -> Column:
    """md5 as an integer, modulo: folded digit by digit."""
    digits = F.filter(F.split(F.md5(_c(text)), ""), lambda x: x != "")
    return F.aggregate(digits, F.lit(0), lambda acc, d: ((acc * 16 + F.conv(d, 16, 10).cast("int")) % modulus).cast("int"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def cut_before(text: Column, markers: tuple[str, ...]) -> Column:
    """The text up to each marker in turn, right-trimmed where one was cut."""
    one = lambda m: lambda t: F.when(F.contains(t, F.lit(m)), rstrip(F.substring_index(t, m, 1))).otherwise(t)
    return reduce(lambda t, m: let(t, one(m)), markers, text)


def budget_score(answer: str | Column, limit: str | Column) -> Column:
    """Share of surfaced prices within 1.12 of the budget, of at most three."""
    found_prices = F.transform(F.regexp_extract_all(_c(answer), F.lit(r"[¥￥]\s*(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.try_cast("double"))
    good = F.size(F.filter(found_prices, lambda p: p <= _c(limit) * 1.12))
    return (
        F.when(_c(limit).isNull(), 0.5)
        .when(F.size(found_prices) == 0, 0.2)
        .when(good == 0, 0.0)
        .otherwise(F.least(F.lit(1.0), good / F.greatest(F.lit(1), F.least(F.lit(3), F.size(found_prices)))))
    )


def presence(answer: str | Column, patterns: list[str]) -> Column:
    """Share of patterns that occur; 0.5 without patterns."""
    if not patterns:
        return F.lit(0.5)
    hits = reduce(lambda a, b: a + b, [_c(answer).rlike(p).cast("int") for p in patterns])
    return hits / len(patterns)


#: Words that turn the claim behind them around.
NEGATIONS = ("不", "别", "勿", "无法", "不能", "没法", "不可")


def hit_outside_negation(answer: str | Column, pattern: str) -> Column:
    """Whether the pattern occurs where no negation stands right before it."""
    guard = "".join(f"(?<!{n})" for n in NEGATIONS)
    return without_spaces(answer).rlike(f"{guard}(?:{pattern})")


def compliance(answer: str | Column, forbidden: list[str]) -> Column:
    """1 less the share of forbidden claims."""
    if not forbidden:
        return F.lit(1.0)
    hits = reduce(lambda a, b: a + b, [hit_outside_negation(answer, p).cast("int") for p in forbidden])
    return F.greatest(F.lit(0.0), 1 - hits / len(forbidden))
