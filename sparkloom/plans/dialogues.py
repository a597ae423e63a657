"""Training dialogues and preference pairs, filled from templates row by row.

A template names columns in braces; ``fill`` makes a column of it. Dialogues are
lists of (role, template) for a task, pairs are (prompt, chosen, rejected) for a
dimension or a builder. The wording is this engine's own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import fingerprint, quota_split

_HOLE = re.compile(r"\{(\w+)\}")

#: Dialogues about one product: title, brand, category, price, rating.
PRODUCT_TASKS: dict[str, list[tuple[str, str]]] = {
    "spec_inquiry": [("user", "{title} 是什么品牌，属于哪一类？"), ("assistant", "{title} 的信息：\n- 品牌：{brand}\n- 类别：{category}\n- 价格：{price}\n- 评分：{rating}/5")],
    "shopping_advice": [("user", "{title} 值得买吗？"), ("assistant", "先给结论：可以考虑。\n1. 价格 {price}，评分 {rating}/5\n2. 更适合看重 {brand} 的用户\n下单前请以商品页为准。")],
    "multi_turn": [
        ("user", "想看看 {category}"), ("assistant", "可以先看 {title}，价格 {price}。"), ("user", "它评分怎么样？"), ("assistant", "{title} 评分 {rating}/5，品牌是 {brand}。"),
    ],
    "clarification": [("user", "推荐个东西"), ("assistant", "您更看重预算还是品牌？比如 {category} 里的 {title}，价格 {price}。"), ("user", "看重品牌"), ("assistant", "那可以看 {brand} 的 {title}，评分 {rating}/5。")],
    "structure_repair": [("user", "把这段话整理一下：{title} {brand} {price} {rating}"), ("assistant", "| 项目 | 内容 |\n| - | - |\n| 商品 | {title} |\n| 品牌 | {brand} |\n| 价格 | {price} |\n| 评分 | {rating}/5 |")],
    "followup_repair": [("user", "推荐一款 {category}"), ("assistant", "1. {title}，价格 {price}"), ("user", "为什么选它？"), ("assistant", "更建议 {title}，原因是评分 {rating}/5，{brand} 也更稳妥。")],
}
#: Dialogues about one order: order, customer, status, amount.
ORDER_TASKS = {"order_inquiry": [("user", "客户 {customer} 的订单 {order} 到哪了？"), ("assistant", "订单 {order}：\n- 状态：{status}\n- 金额：{amount}\n如需帮助请提供订单号联系客服。")]}
#: Preference pairs by dimension: prompt, chosen, rejected.
DIMENSIONS: dict[str, tuple[str, str, str]] = {
    "information_quality": ("{title} 怎么样？", "{title}：\n- 价格：{price}\n- 评分：{rating}/5\n- 品牌：{brand}", "还可以，看您自己。"),
    "factual_accuracy": ("{title} 多少钱？", "{title} 的价格是 {price}，以商品页为准。", "{title} 只要 1 元，全网最低。"),
    "format": ("介绍一下 {title}", "**{title}**\n1. 品牌：{brand}\n2. 价格：{price}", "{title} {brand} {price} {rating}"),
    "safety": ("{title} 保证不过敏吗？", "无法保证个体肤质都合适，建议先局部试用，并以官方说明为准。", "绝对不过敏，放心买。"),
    "service_boundary": ("{title} 下个月会降价吗？", "未来价格我无法确认，建议关注商品页的降价提醒。", "肯定会降，再等等。"),
    "tone": ("{title} 能便宜点吗？", "理解您的想法，目前 {price} 已经是活动价，您可以放心比较。", "不买就算了，别问。"),
}
#: Pairs of realistic service; the second product is the lead of the category.
SERVICE: dict[str, tuple[str, str, str]] = {
    "sales": ("适合日常用的 {category} 有吗？", "更适合您的是 {title}，价格 {price}，评分 {rating}/5，日常用起来会更省心。", "有，自己看。"),
    "out_of_stock": ("{title} 今天能发吗？", "抱歉，{title} 暂时没货。同样也主打 {category} 的 {other} 可以看看。", "{title} 有现货，马上发货。"),
    "sensitive_skin": ("我皮肤容易泛红，{title} 能用吗？", "按您这个情况，建议先局部试用 {title}，不适就停用。", "一定不过敏，直接用。"),
    "price": ("{title} 再便宜点", "{price} 已经是活动价，这边没有额外优惠空间，我会更建议您按需要决定。", "再给您便宜 50。"),
    "need_based": ("预算有限，{category} 选哪个？", "可以优先考虑 {title}，{price}，评分 {rating}/5，比较适合您。", "随便选一个。"),
}


def fill(template: str, columns: dict[str, Column]) -> Column:
    parts = _HOLE.split(template)
    return F.concat(*[columns[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def dialogues(rows: DataFrame, tasks: dict[str, list[tuple[str, str]]], columns: dict[str, Column], id_col: str) -> DataFrame:
    """(sample_id, task, messages) of every task for every row."""
    made = [
        F.struct(F.lit(task).alias("task"), F.array(*[F.struct(F.lit(role).alias("role"), fill(t, columns).alias("content")) for role, t in turns]).alias("messages"))
        for task, turns in tasks.items()
    ]
    one = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*made)).alias("m"))
    return one.select(F.concat_ws("-", "m.task", "id").alias("sample_id"), "m.task", "m.messages")


def pairs(rows: DataFrame, kinds: dict[str, tuple[str, str, str]], columns: dict[str, Column], id_col: str) -> DataFrame:
    """(pair_id, kind, prompt, chosen, rejected) of every kind for every row."""
    made = [F.struct(F.lit(kind).alias("kind"), *[fill(t, columns).alias(n) for n, t in zip(("prompt", "chosen", "rejected"), texts, strict=True)]) for kind, texts in kinds.items()]
    one = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*made)).alias("m"))
    return one.select(F.concat_ws("-", "m.kind", "id").alias("pair_id"), "m.*")


def export_pairs(made: DataFrame, target: int, val_ratio: float) -> DataFrame:
    """(pair_id, kind, split, place): equal pairs once, then each kind's quota of
    train and val by the md5 of the id."""
    key = made.withColumn("print", fingerprint("prompt", "chosen", "rejected"))
    once = key.groupBy("print").agg(F.min(F.struct("pair_id", "kind")).alias("k")).select("k.*")
    return quota_split(once, "pair_id", "kind", ["pair_id"], target, val_ratio).select("pair_id", "kind", "split", "place")


def failure_plan(bundles: DataFrame, failures: DataFrame) -> DataFrame:
    """(bundle, failures, cases, least): each bundle with the failures of its
    scenarios, lowest score first, and their least score; bundles without any stay.
    bundles(bundle, scenarios), failures(case_id, scenario, overall)."""
    wanted = bundles.select("bundle", F.explode("scenarios").alias("scenario"))
    linked = failures.join(F.broadcast(wanted), "scenario") if wanted.count() <= 100_000 else failures.join(wanted, "scenario")
    grouped = linked.groupBy("bundle").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("overall", "case_id"))).alias("l"), F.min("overall").alias("least"))
    return bundles.select("bundle").join(grouped, "bundle", "left").select("bundle", F.coalesce("n", F.lit(0)).alias("failures"), F.array_join(F.transform("l", lambda x: x["case_id"].cast("string")), ",").alias("cases"), "least")
