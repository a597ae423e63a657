"""Columns that read prompts, shorten reasons, clean leaked turns and write evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The form of a structured prompt, leaked turns and stray marks, openings and ends of reasons, labels of
# service notes, and the sentences around evidence.
STRUCTURED_PROMPT = r"预算(?:控制在)?(\p{Nd}+)元以内，主要用于([^\n]+?)，更看重([^\n]+?)。"
LEAKED_TURN = r"(?is)(?:^|\n)[^\n]{0,3}(?:user|assistant)\n.*"
STRAY_MARKS = ("🖇", "垞", "�", "ropic", "玭")
REASON_OPENINGS = ("^价格在预算内，?", r"结合[^\n]+?与当前评分表现，?")
SUITED, SUITED_MORE, LEANS, LEANS_MORE = "适合", "更适合", "偏", "更偏"
STEADY, PLAINLY_STEADY = "取向，当前评分也比较稳。", "价格和评分都比较稳。"
NOTE_LABELS = {"availability": "库存备注", "service_note": "客服备注", "promo_note": "价格备注", "safety_note": "安全备注"}
NO_EVIDENCE = "本轮没有可用商品证据。可以给通用建议，但不要编造具体价格、库存、售后结果。"
EVIDENCE = "下面是本轮唯一可用的商品资料，请仅基于这些资料中的事实回答：\n\n"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def structured_prompt(text: str | Column) -> Column:
    """(budget, scene, feature) of a structured prompt; empty texts where it has another form."""
    part = lambda i: strip(F.regexp_extract(F.coalesce(_c(text), F.lit("")), STRUCTURED_PROMPT, i))
    return F.struct(part(1).alias("budget"), part(2).alias("scene"), part(3).alias("feature"))


def without_leaks(text: str | Column) -> Column:
    """An answer up to a leaked turn, without stray marks and blank lines beyond one."""
    kept = F.regexp_replace(strip(F.replace(_c(text), F.lit("\r\n"), F.lit("\n"))), LEAKED_TURN, "")
    for mark in STRAY_MARKS:
        kept = F.replace(kept, F.lit(mark), F.lit(""))
    return strip(F.regexp_replace(kept, r"\n{3,}", "\n\n"))


def short_reason(reason: str | Column, feature: str | Column, scene: str | Column) -> Column:
    """A reason in one short sentence: the asked feature if it is named, else its own words, else the scene."""
    said, feature, scene = strip(F.coalesce(_c(reason), F.lit(""))), F.coalesce(_c(feature), F.lit("")), strip(F.coalesce(_c(scene), F.lit("")))
    bare = said
    for opening in REASON_OPENINGS:
        bare = F.regexp_replace(bare, opening, "")
    bare = F.regexp_replace(bare, "^[。 ]+|[。 ]+$", "")
    leaning = lambda how, what: F.concat(F.lit(how), what, F.lit(STEADY))
    return (
        F.when((feature != "") & F.contains(F.coalesce(_c(reason), F.lit("")), feature), leaning(LEANS_MORE, feature))
        .when(bare.startswith(SUITED_MORE), F.concat(F.regexp_replace(bare, f"^{SUITED_MORE}", LEANS), F.lit("。")))
        .when(bare.startswith(SUITED), F.concat(F.lit("更"), bare, F.lit("。")))
        .when(bare != "", F.concat(bare, F.lit("。")))
        .when(scene != "", leaning(LEANS, scene))
        .otherwise(PLAINLY_STEADY)
    )


def first_price(*texts: str | Column) -> Column:
    """The first of several texts whose digits and points make a number."""
    return F.coalesce(*[F.regexp_replace(_c(t), r"[^\p{Nd}.]", "").try_cast("double") for t in texts])


def percent_rating(text: str | Column) -> Column:
    """A share of good votes as a rating from 0 to 5."""
    return F.round(F.regexp_extract(_c(text), r"(\d+)", 1).try_cast("double") / 100 * 5, 1)


def with_extras(doc: Column, **extras: Column) -> Column:
    """A record as a map of texts, and those extras that are neither null nor empty; an extra replaces a field of its name."""
    given = F.map_filter(F.create_map(*[x for k, v in extras.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull() & (v != ""))
    return F.map_concat(F.map_filter(doc, lambda k, _: ~F.array_contains(F.map_keys(given), k)), given)


def note_lines(notes: dict[str, Column]) -> Column:
    """A line for each service note that is there, in the order of their labels."""
    said = {k: strip(F.coalesce(notes[k].cast("string"), F.lit(""))) for k in NOTE_LABELS if k in notes}
    lines = [F.when(v != "", F.concat(F.lit(f"\n{NOTE_LABELS[k]}：" ), v)).otherwise("") for k, v in said.items()]
    return F.concat(F.lit(""), *lines)


def evidence(title: Column, price: Column, rating: Column, brand: Column, description: Column, features: Column, notes: dict[str, Column]) -> Column:
    """One product as evidence, without its number."""
    text = lambda c, default="": F.coalesce(c.cast("string"), F.lit(default))
    return F.concat(
        text(title), F.format_string("\n价格：¥%.2f\n评分：", price.cast("double")), text(rating), F.lit("/5\n品牌："), text(brand, "未知"),
        F.lit("\n描述："), text(description), F.lit("\n特点："), text(features), note_lines(notes),
    )


def system_message(system: str, shown: Column) -> Column:
    """A system prompt with its evidence, an array of products in their order; a null or empty one says that there is none."""
    numbered = F.transform(shown, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x))
    return F.when(F.coalesce(F.size(shown), F.lit(0)) > 0, F.concat(F.lit(f"{system}\n\n{EVIDENCE}"), F.array_join(numbered, "\n\n"))).otherwise(f"{system}\n\n{NO_EVIDENCE}")
