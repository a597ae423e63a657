"""Cleaning of generated answers: column expressions, composed in a fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, cut_before, let, rstrip, strip, without_spaces

# Fixed values of the answer format.
END_MARKERS = (
    "以上为本次推荐结果。", "以上为本轮推荐结果。", "以上为本次对比结论。", "以上为本轮对比结论。",
    "以上为本次结论。", "以上为本轮结论。", "以上为本次回答。", "以上为本轮回答。",
)
STOP_MARKERS = ("rumpe", "spep", "+lsi", "𬭩user", "𬭩assistant", "RGBO")
NOISE = ("ropic", "玭", "🧐", "🖇", "垞", "�")
GARBAGE_MARKERS = ("rumpe", "spep", "+lsi", "𬭩user", "𬭩assistant")
TAIL_CUES = (
    "如果您愿意", "如果你愿意", "如果您下一轮", "如果你下一轮", "如需了解", "如需更多信息", "如果您有其他问题",
    "还有什么想了解", "请随时告诉我", "随时可以问我", "继续提问", "继续帮您", "进一步筛选", "需要我帮您",
)
LEAKED_ROLE = r"(?i)(?:^|\n)(?:[^\n]{0,3})?(?:user|assistant)\n"
EMPATHY = "抱歉|理解|麻烦|先别着急|我先帮您"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def to_end_marker(text: str | Column) -> Column:
    """Up to and with the end marker that comes first."""
    t = _c(text)
    ends = F.array(*[F.when(F.instr(t, m) > 0, F.struct(F.instr(t, m).alias("at"), F.lit(len(m)).alias("n"))) for m in END_MARKERS])
    first = F.array_min(F.filter(ends, lambda e: e.isNotNull()))
    return F.when(first.isNull(), t).otherwise(F.substring(t, F.lit(1), first["at"] + first["n"] - 1))


def before_leaked_role(text: str | Column) -> Column:
    t = _c(text)
    at = F.regexp_instr(t, F.lit(LEAKED_ROLE))
    return F.when(at > 0, rstrip(F.substring(t, F.lit(1), at - 1))).otherwise(t)


def without_noise(text: str | Column) -> Column:
    """Noise tokens go, then lines that hold no letter or digit."""
    t = reduce(lambda t, n: F.replace(t, F.lit(n), F.lit("")), NOISE, _c(text))
    kept = F.filter(F.transform(_lines(t), strip), lambda x: (x == "") | (F.regexp_replace(x, r"(?U)[\W_]+", "") != ""))
    return strip(F.array_join(kept, "\n"))


def plain_links(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), r"\[([^\]]+)\]\((https?://[^)]+)\)", "$1")


def normal_prices(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), r"价格\s*[:：]?\s*(?:¥|￥)?\s*(\d+(?:\.\d+)?)\s*元?", "价格：¥$1")


def numbered_lines(text: str | Column) -> Column:
    """``[2] name`` and ``先看 [2] name`` become ``2. [2] name``."""
    item = r"^\s*(?:先看\s*)?\[(\d+)\]\s*(.+)$"
    made = F.transform(
        _lines(_c(text)),
        lambda x: F.when(x.rlike(item), F.concat(F.regexp_extract(x, item, 1), F.lit(". ["), F.regexp_extract(x, item, 1), F.lit("] "), strip(F.regexp_extract(x, item, 2)))).otherwise(rstrip(x)),
    )
    return strip(F.array_join(made, "\n"))


def distinct_runs_of_lines(text: str | Column) -> Column:
    """A line that equals the last line with text goes; blank lines stay once."""
    state = "struct<out:array<string>,last:string>"
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last")).cast(state)
    ends_blank = lambda acc: (F.size(acc["out"]) == 0) | (F.try_element_at(acc["out"], F.lit(-1)) == "")

    def step(acc, x):
        line = strip(x)
        added = F.struct(F.concat(acc["out"], F.array(line)).alias("out"), F.when(line == "", acc["last"]).otherwise(line).alias("last")).cast(state)
        return F.when((line == "") & ends_blank(acc), acc).when((line != "") & F.equal_null(acc["last"], line), acc).otherwise(added)

    return strip(F.array_join(F.aggregate(_lines(_c(text)), empty, step, lambda acc: acc["out"]), "\n"))


def distinct_runs_of_sentences(text: str | Column) -> Column:
    """Within a line, a sentence goes that repeats the one before, or is a short start of it."""
    state = "struct<out:array<string>,last:string>"
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last")).cast(state)

    def step(acc, part):
        core = F.regexp_replace(without_spaces(part), "[。！？!?]+$", "")
        skip = (core == "") | (core == acc["last"]) | ((F.length(core) <= 6) & F.startswith(acc["last"], core))
        return F.when(skip, acc).otherwise(F.struct(F.concat(acc["out"], F.array(strip(part))).alias("out"), core.alias("last")).cast(state))

    def line(x):
        one = strip(x)
        parts = F.filter(F.regexp_extract_all(one, F.lit(r"([^。！？!?]+[。！？!?]?)"), F.lit(1)), lambda p: strip(p) != "")
        return F.when(F.size(parts) <= 1, one).otherwise(strip(F.array_join(F.aggregate(parts, empty, step, lambda acc: acc["out"]), "")))

    return strip(F.array_join(F.transform(_lines(_c(text)), line), "\n"))


def with_service_intro(text: str | Column) -> Column:
    t = _c(text)
    count = F.size(F.regexp_extract_all(t, F.lit(r"(?m)(^\s*\d+\.\s+)"), F.lit(1)))
    named = F.contains(t, F.lit("[1]")) | F.contains(t, F.lit("[2]"))
    return F.when(~t.rlike(EMPATHY) & (count >= 2) & named, F.concat(F.lit("我先帮您按当前需求筛 "), count.cast("string"), F.lit(" 款：\n\n"), t)).otherwise(t)


def with_full_reference(text: str | Column) -> Column:
    """A cut-off title behind ``推荐 [i]`` at the end is completed from item i."""
    t = _c(text)
    tail = r"推荐\s+\[(\d+)\]\s+([^。\n]+)$"
    index, partial = F.regexp_extract(t, tail, 1), strip(F.regexp_extract(t, tail, 2))
    item = r"^\s*\d+\.\s+\[(\d+)\]\s+([^，。\n]+)"
    titles = F.transform(F.filter(_lines(t), lambda x: x.rlike(item) & (F.regexp_extract(x, item, 1) == index)), lambda x: strip(F.regexp_extract(x, item, 2)))
    full = F.try_element_at(titles, F.lit(-1))
    grow = t.rlike(tail) & full.isNotNull() & (F.length(partial) < F.length(full)) & F.startswith(full, partial)
    return F.when(grow, F.concat(F.regexp_replace(t, r"([^。\n\]]+)$", " "), full)).otherwise(t)


def finished(text: str | Column) -> Column:
    t = _c(text)
    return F.when((t == "") | F.right(t, F.lit(1)).rlike("[。！？!?)）】\\]}」』]"), t).otherwise(F.concat(t, F.lit("。")))


def clean_answer(text: str | Column) -> Column:
    """All steps in their order."""
    steps = [
        to_end_marker, lambda t: cut_before(t, STOP_MARKERS), before_leaked_role, without_noise, plain_links, normal_prices, numbered_lines,
        distinct_runs_of_lines, distinct_runs_of_sentences, with_service_intro, with_full_reference, finished,
    ]
    t = reduce(let, steps, strip(F.replace(_c(text), F.lit("\r\n"), F.lit("\n"))))
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def clean_exported(text: str | Column) -> Column:
    """Assistant texts of an export: garbage and tail offers go."""
    t = cut_before(cut_before(strip(F.replace(_c(text), F.lit("\r\n"), F.lit("\n"))), GARBAGE_MARKERS), TAIL_CUES)
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "[ \n\t：:，,-]+$", "")
