"""URL filters: allow and block rules, then a logistic model on hashed n-grams.

Everything per URL is a DataFrame expression. The model is fitted to a small
labelled table: its features come from the same expression, one row per URL, and
the weights are found by gradient steps over those few rows. The table that
comes with it is made by rule from two lists of words, a part of it held out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1024
SIZES = (3, 4, 5)
#: Most labelled rows that a fit collects.
MOST_LABELS = 5000


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for null or where ``://`` is missing."""
    url = F.col(url) if isinstance(url, str) else url
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str | Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rule(text: str) -> Rule:
    """``block net/`` -> (block, net, /)."""
    verdict, where = text.split(None, 1)
    host, slash, path = where.partition("/")
    return Rule(verdict, host, slash + path)


def matching_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _hashed(mark: str, text: Column, n: int, buckets: int) -> Column:
    """Buckets of the n-grams; the text is split into characters once, so a long one costs no more by the gram."""

    def grams(chars: Column) -> Column:
        at = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.concat(*[F.get(chars, i + j) for j in range(n)])), F.lit(buckets)).cast("int"))

    return F.flatten(F.transform(F.array(F.split(text, "")), grams))


def gram_buckets(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Hashed character n-grams of host and path, each part marked as its own."""
    marked = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), F.lower(path), F.lit("$"))))
    return F.concat(*[_hashed(mark, text, n, buckets) for mark, text in marked for n in SIZES])


@dataclass(frozen=True)
class UrlModel:
    bias: float
    weights: tuple[float, ...]

    def logit(self, grams: Column) -> Column:
        """Mean weight of a URL's n-grams, scaled as in the fit, plus the bias."""
        table = F.array(*[F.lit(w) for w in self.weights])
        total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.element_at(table, g + 1))
        return F.lit(self.bias) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double"))


def fit_urls(labelled: DataFrame, *, url_col: str = "url", label_col: str = "blocked", steps: int = 200, rate: float = 0.5, decay: float = 0.002) -> UrlModel:
    """Logistic regression by full gradient steps on at most MOST_LABELS rows
    (smallest URLs first); rows without a label are skipped."""
    rows = (
        labelled.where(F.col(label_col).isin(0, 1)).orderBy(url_col, label_col).limit(MOST_LABELS)
        .select(gram_buckets(host_of(url_col), path_of(url_col)).alias("g"), F.col(label_col).cast("int").alias("y")).collect()
    )
    x, y = np.zeros((len(rows), BUCKETS)), np.array([r.y for r in rows], dtype=float)
    for i, r in enumerate(rows):
        np.add.at(x[i], r.g, 1 / math.sqrt(max(1, len(r.g))))
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(steps if rows else 0):
        miss = (1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30))) - y) / len(rows)
        weights -= rate * (x.T @ miss + decay * weights)
        bias -= rate * float(miss.sum())
    return UrlModel(bias, tuple(weights.tolist()))


#: Words that the labelled table puts into hosts and paths.
WANTED = (
    "library museum science weather recipes travel history garden music physics university journal news city forum wiki docs guide "
    "health school village energy river mountain poetry theatre cinema football chess cooking biology chemistry geology language "
    "dictionary archive gallery opinion report lecture course thesis dataset manual tutorial review interview essay novel painting"
).split()
UNWANTED = (
    "casino bonus poker jackpot slots betting lottery prize winner viagra pills pharmacy cheap replica watches payday loans cash "
    "xxx porn adult escort singles cams nude sexy warez crack keygen torrent serial hacked cheats spam backlinks clickbait popup "
    "adserver tracker banner promo affiliate malware phishing miracle detox crypto giveaway freebie"
).split()
_HOSTS = ("www.{a}-{b}.example", "{a}.{b}.example", "{a}{b}.example", "m.{a}.example", "{a}-online.example")
_PATHS = ("/{c}", "/{c}/{d}", "/{d}/{c}.html", "/2021/05/{c}-{d}", "/index.php/{c}/7", "/en/{d}")


def labelled_urls(rows_per_class: int = 240) -> list[tuple[str, int, bool]]:
    """(url, blocked, held out) by rule from the two word lists: every fourth is held out of the fit."""
    out = []
    for blocked, words in ((0, WANTED), (1, UNWANTED)):
        n = len(words)
        for i in range(rows_per_class):
            a, b, c, d = (words[(i * step + shift) % n] for step, shift in ((1, 0), (7, 3), (11, 5), (13, 1)))
            url = f"http{'s' * (i % 2)}://" + _HOSTS[i % len(_HOSTS)].format(a=a, b=b) + _PATHS[i // 2 % len(_PATHS)].format(c=c, d=d)
            out.append((url, blocked, i % 4 == 3))
    return out


def example_urls(spark: SparkSession) -> DataFrame:
    """The labelled table to start from, without what it holds out."""
    return spark.createDataFrame([(u, y) for u, y, held in labelled_urls() if not held], "url string, blocked int")


def filter_urls(pages: DataFrame, rules: list[Rule], model: UrlModel, *, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block) and block_logit.

    The longest rule that fits decides; else the model: block where its
    probability is threshold or more. A null URL or one without ``://`` has an
    empty host and path, fits no rule and gets the model's verdict on those; a
    long one is read whole. Columns of pages with these names are replaced, no
    other name matters; rows stay as they are, repeated ones too. An empty table
    gives an empty one.
    """
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    base = pages.drop("host", "path", "rule", "verdict", "block_logit")
    kept, url = [quoted(c) for c in base.columns], quoted(url_col) if url_col in base.columns else F.lit(None).cast("string")
    split = base.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
    fitting = matching_rule(rules, F.col("host"), F.col("path"))
    judged = split.select(*kept, "host", "path", fitting.alias("rule"), model.logit(gram_buckets(F.col("host"), F.col("path"))).alias("block_logit"))
    own = F.when(F.col("block_logit") >= math.log(threshold / (1 - threshold)), "block").otherwise("allow")
    return judged.select(*kept, "host", "path", F.col("rule.rule").alias("rule"), F.coalesce("rule.verdict", own).alias("verdict"), "block_logit")
