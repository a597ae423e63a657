"""Connected components by joins, with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b): the smallest node that it reaches.

    Each round takes the least label among neighbours, hooks the old root of a
    node to it and jumps pointers, so a star needs two rounds and a chain of n
    nodes about log n. Every step aggregates before it shuffles; a hub's
    neighbours never meet in one list. Nulls and self-links are ignored. An
    empty input gives an empty result; RuntimeError if rounds run out.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = clean.union(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.keep(both, f"{label}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component"))
    for turn in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("best"))
        pulled = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "best").alias("best"))
        hooked = pulled.select("node", "best").union(pulled.where("best < was").select(F.col("was").alias("node"), "best")).groupBy("node").agg(F.min("best").alias("best"))
        up = hooked.select(F.col("node").alias("best"), F.col("best").alias("root"))
        jumped = hooked.join(up, "best", "left").select("node", F.least("best", "root").alias("component"))
        kept = scratch.keep(jumped.join(labels.withColumnRenamed("component", "was"), "node"), f"{label}-{turn}")
        labels = kept.select("node", "component")
        if turn:
            scratch.drop(f"{label}-{turn - 1}")
        if kept.where("component <> was").isEmpty():
            scratch.drop(f"{label}-edges")
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")
