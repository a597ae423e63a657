"""Chat formatting over reply trees.

Messages point at the message that they answer. Self-joins that double the
distance each round give every message its ancestors 1, 2, 4, ... steps up, so
root-to-leaf paths of any depth are enumerated in about log2(depth) joins. A
tree's branches are ranked by their score, and each chosen path becomes one
conversation under a template.

Template: ``<|turn|>role\\n`` + text + ``<|end|>\\n``. In roles and texts ``&``
becomes ``&amp;`` and ``<`` becomes ``&lt;``, so no control string can occur in
them and replacing the two in reverse order restores every text. A line feed in
a role becomes ``&nl;``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .scratch import Scratch

TURN, END = "<|turn|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def tree_paths(messages: DataFrame, *, top: int | None = None) -> DataFrame:
    """(tree, leaf, rank, depth, id) for every message of each tree's best branches.

    messages(tree, id, parent, score): parent is null or unknown for a root. A
    branch runs from a root to a message that none answers; its score is the sum
    over its messages (nulls count 0), the best has rank 1, ties go to the
    smaller leaf. depth counts from 0 at the root. With top, only that many
    branches of a tree. ids are unique within a tree; a message in a cycle
    reaches no root and is in no path.
    """
    scratch = Scratch(messages.sparkSession, "trees")
    known = messages.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    ids = known.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    linked = known.join(ids, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("parent"), "score")
    linked = scratch.keep(linked, "linked")
    longest = linked.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    answered = linked.where("parent IS NOT NULL").select("tree", F.col("parent").alias("id")).distinct()
    leaves = linked.join(answered, ["tree", "id"], "left_anti").select("tree", F.col("id").alias("leaf"), "id", F.lit(0).alias("up"))
    jump, members, step = linked.select("tree", "id", F.col("parent").alias("above")).where("above IS NOT NULL"), leaves, 1
    while step < longest:
        higher = jump.select("tree", "id", "above")
        found = members.join(higher, ["tree", "id"]).select("tree", "leaf", F.col("above").alias("id"), (F.col("up") + step).alias("up"))
        members = scratch.keep(members.union(found), f"members-{step}")
        next_ = jump.select("tree", F.col("id").alias("above"), F.col("above").alias("further"))
        jump = scratch.keep(jump.join(next_, ["tree", "above"]).select("tree", "id", F.col("further").alias("above")), f"jump-{step}")
        step *= 2
        if jump.isEmpty():
            # What is left within reach of the last jump is there already.
            break
    branch = members.join(linked.select("tree", "id", "score", "parent"), ["tree", "id"])
    total = branch.groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.max("up").alias("length"), F.max(F.col("parent").isNull()).alias("rooted")).where("rooted")
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return members.join(ranked, ["tree", "leaf"]).select("tree", "leaf", "rank", (F.col("length") - F.col("up")).alias("depth"), "id")


def format_paths(turns: DataFrame, key: list[str]) -> DataFrame:
    """(key..., formatted, loss_spans) from turns(key..., position, role, text).

    loss_spans holds [start, end) of each assistant text in formatted, in code
    points. Null roles and texts count as empty.
    """
    made = turns.select(
        *key,
        F.struct(
            F.col("position"),
            F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&nl;")).alias("role"),
            escaped(F.coalesce("text", F.lit(""))).alias("text"),
        ).alias("turn"),
    )
    listed = made.groupBy(*key).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), t["role"], F.lit("\n"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(END))), "")
    state = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(state),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(head(t)) + F.length(t["text"]) + len(END)).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(head(t))).alias("start"), (acc["at"] + F.length(head(t)) + F.length(t["text"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ).cast(state),
        lambda acc: acc["spans"],
    )
    return listed.select(*key, text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: str = "formatted") -> Column:
    """array<struct<role,text>> of a formatted conversation."""
    # Every turn starts with TURN, so the first part is empty.
    parts = F.filter(F.split(F.col(formatted), r"<\|turn\|>"), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(1), F.length(p) - len(END))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.replace(F.substring_index(body(p), "\n", 1), F.lit("&nl;"), F.lit("\n"))).alias("role"),
            unescaped(F.substring(body(p), F.length(F.substring_index(body(p), "\n", 1)) + 2, F.length(p))).alias("text"),
        ),
    )


def loss_texts(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescaped(F.substring(F.col(formatted), s["start"] + 1, s["end"] - s["start"])))


def linear_messages(rows: DataFrame) -> DataFrame:
    """(tree, id, parent, role, text, score) of rows(conv_id, turn, role, text)
    in turn order: each message answers the one before it. tree is conv_id as
    text, empty for null. Equal turns stand by role and text; a null turn stands
    first."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    named = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "turn", "role", "text")
    placed = named.withColumn("id", F.row_number().over(order).cast("long"))
    return placed.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
