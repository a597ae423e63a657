"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample: the exact neighbour graph of the sample is cut into
balanced parts, growing and refining parts so that neighbours stay together and
none exceeds its share; a small softmax classifier then learns, from the
vectors, in which parts a vector's neighbours lie. Parts of more than
``leaf_rows`` rows are cut again, each by a graph and a classifier of its own,
fitted where the part lies, so the number of parts grows with the table.

Index: every vector, in the sample or not, goes to the part that the classifiers
find most probable. Search: a query goes to its most probable parts, as many as
it takes to reach a probability mass learned on the sample, and is compared in
double precision with every vector there. Parts are split into blocks, so no
task holds a whole part, however many copies of one vector it has; a block of
vectors is sent once for each block of the queries that go to its part.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .scratch import Scratch, bounded_batches

#: Vectors that the fit sees at most.
SAMPLE = 6000
#: Rows of a block of candidates, and of queries.
BLOCK = 8192
#: Rows of a part that isn't cut again.
LEAF_ROWS = 100_000
#: Parts of one router.
MOST_PARTS = 64


def _ranked(scores: np.ndarray, k: int) -> np.ndarray:
    k = min(k, scores.shape[1])
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, axis=1), axis=1, kind="stable"), axis=1)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest inner products of each row with the others."""
    out = np.empty((len(x), min(k, len(x) - 1)), dtype=np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + 1024] = _ranked(s, out.shape[1])
    return out


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 1.15, rounds: int = 12) -> np.ndarray:
    """A part for each node: grown breadth-first to equal sizes, then refined by
    moving nodes to the part that holds most of their neighbours while it has room."""
    n = len(graph)
    room = int(np.ceil(n / parts * slack))
    label, size, part = np.full(n, -1), np.zeros(parts, dtype=np.int64), 0
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    share = -(-n // parts)
    for seed in range(n):
        queue = [seed] if label[seed] < 0 else []
        for node in queue:
            if label[node] >= 0:
                continue
            label[node] = part
            size[part] += 1
            if size[part] >= share and part < parts - 1:
                part += 1
                break
            queue.extend(j for j in (*graph[node], *back[node][:32]) if label[j] < 0)
    for _ in range(rounds):
        moved = 0
        votes = np.zeros((n, parts), dtype=np.int32)
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), label[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), label]
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            to = int(votes[node].argmax())
            if size[to] < room:
                size[label[node]] -= 1
                size[to] += 1
                label[node] = to
                moved += 1
        if moved < n // 500:
            break
    return label


@dataclass
class Router:
    weights: np.ndarray  # (dim + 1, parts)
    mass: float

    @property
    def parts(self) -> int:
        return self.weights.shape[1]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights[:-1] + self.weights[-1]
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(axis=1)

    def routes(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts): which parts a query goes to."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
        go = np.zeros_like(p, dtype=bool)
        np.put_along_axis(go, order, before < self.mass, axis=1)
        return go


def _softmax_fit(x: np.ndarray, target: np.ndarray, steps: int = 250, rate: float = 0.05) -> np.ndarray:
    """Full-batch Adam on the cross-entropy with soft targets."""
    xb = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros((xb.shape[1], target.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = xb @ w
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = xb.T @ (p - target) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def fit_router(sample: np.ndarray, *, parts: int, k: int = 20, recall: float = 0.97) -> Router:
    """The mass is the least that finds the share ``recall`` of the sample's own neighbours."""
    dim = sample.shape[1] if sample.ndim == 2 else 1
    if len(sample) < 4 * parts or parts == 1:
        return Router(np.zeros((dim + 1, 1)), 1.0)
    # Copies of one vector are one node of the graph.
    sample = np.unique(sample, axis=0)
    if len(sample) < 4 * parts:
        return Router(np.zeros((dim + 1, 1)), 1.0)
    rng = np.random.default_rng(7)
    sample = sample[rng.permutation(len(sample))]
    graph = neighbour_graph(sample, k)
    label = balanced_parts(graph, parts)
    target = np.zeros((len(sample), parts))
    np.add.at(target, (np.repeat(np.arange(len(sample)), graph.shape[1]), label[graph.ravel()]), 1.0)
    np.add.at(target, (np.arange(len(sample)), label), float(graph.shape[1]) / 2)
    target /= target.sum(axis=1, keepdims=True)
    router = Router(_softmax_fit(sample, target), 1.0)
    home = router.home(sample)
    p = router.probabilities(sample)
    # The mass before a part is reached, for the part of each true neighbour.
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.empty_like(p)
    np.put_along_axis(before, order, np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1), axis=1)
    need = np.take_along_axis(before, home[graph], axis=1).ravel()
    router.mass = float(min(1.0, np.quantile(need, recall) + 1e-9))
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class Tree:
    """A router and, for parts that are cut again, their own."""

    top: Router
    below: dict[int, Router]

    def __post_init__(self):
        sizes = [self.below[p].parts if p in self.below else 1 for p in range(self.top.parts)]
        self.first = np.concatenate(([0], np.cumsum(sizes)))

    @property
    def leaves(self) -> int:
        return int(self.first[-1])

    def home(self, x: np.ndarray) -> np.ndarray:
        part = self.top.home(x)
        leaf = self.first[part]
        for p, router in self.below.items():
            mine = np.flatnonzero(part == p)
            if len(mine):
                leaf[mine] += router.home(x[mine])
        return leaf

    def routes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a query goes to."""
        row, part = np.nonzero(self.top.routes(x))
        plain = ~np.isin(part, list(self.below))
        rows, leaves = [row[plain]], [self.first[part[plain]]]
        for p, router in self.below.items():
            mine = row[part == p]
            if len(mine):
                at, leaf = np.nonzero(router.routes(x[mine]))
                rows.append(mine[at])
                leaves.append(self.first[p] + leaf)
        return np.concatenate(rows), np.concatenate(leaves)


def _spread(ids: np.ndarray, factor: int, blocks: np.ndarray) -> np.ndarray:
    return (ids.view(np.uint64) * np.uint64(factor) >> np.uint64(40)).astype(np.int64) % np.maximum(blocks, 1)


def _homes(payload):
    """(part, id, vector) of candidates."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                part = payload.value.home(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column(0), batch.column(1)], names=["part", "id", "v"])

    return run


def _targets(payload):
    """Parts that queries go to."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(payload.value.routes(_matrix(batch.column(1)))[1].astype(np.int32))], names=["part"])

    return run


def _copies(part: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the rows, each as often as its count, and the number of each copy."""
    row = np.repeat(np.arange(len(part)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _place(blocks, q_blocks):
    """Candidates (part, id, vector): a row for each block of queries of their part."""

    def run(batches):
        per_part, per_query = blocks.value, q_blocks.value
        for batch in batches:
            if batch.num_rows:
                part, ids = np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1))
                block = _spread(ids, 0x9E3779B97F4A7C15, per_part[part])
                row, q = _copies(part, per_query[part])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(part[row].astype(np.int32)), pa.array(block[row].astype(np.int32)), pa.array(q.astype(np.int32)), batch.column(1).take(take), batch.column(2).take(take)], names=["part", "block", "q", "id", "v"])

    return run


def _route(payload, blocks, q_blocks):
    """Queries: a row for each tile (part, block, query block) that they go to."""

    def run(batches):
        per_part, per_query = blocks.value, q_blocks.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            row, part = payload.value.routes(_matrix(batch.column(1)))
            at, block = _copies(part, per_part[part])
            row, part = row[at], part[at]
            q = _spread(ids[row], 0xD6E8FEB86659FD93, per_query[part])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(q.astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)], names=["part", "block", "q", "id", "v"])

    return run


def _fit_part(k: int, leaf_rows: int, recall: float):
    """A router of one part's sample, pickled."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        x = _matrix(rows.column("v").combine_chunks())
        parts = min(MOST_PARTS, max(1, len(x) // 150), -(-rows.column("rows")[0].as_py() // leaf_rows))
        router = fit_router(x, parts=parts, k=k, recall=recall)
        return pa.table({"part": rows.column("part")[:1], "router": pa.array([pickle.dumps(router)], pa.binary())})

    return run


def _tile(k: int):
    """The k best candidates of one block for each query of the tile."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not candidates.num_rows:
            return empty
        qid, cid = np.asarray(queries.column("id").combine_chunks()), np.asarray(candidates.column("id").combine_chunks())
        order = np.argsort(cid, kind="stable")
        cid = cid[order]
        c = _matrix(candidates.column("v").combine_chunks())[order]
        with np.errstate(over="ignore"):
            longest = float(np.sqrt((c * c).sum(axis=1)).max())
        out_q, out_c, out_s = [], [], []
        for lo in range(0, len(qid), 512):
            ids = qid[lo : lo + 512]
            q = _matrix(queries.column("v").slice(lo, 512).combine_chunks())
            with np.errstate(over="ignore", invalid="ignore"):
                rough = q @ c.T
            rough[np.isnan(rough)] = -np.inf  # a sum that overflows both ways ranks last
            own = ids[:, None] == cid[None, :]
            least = np.partition(np.where(own, -np.inf, rough), -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
            # The two ways to sum differ by rounding, relative to the lengths of the vectors.
            slack = 1e-12 * c.shape[1] * np.sqrt((q * q).sum(axis=1)) * longest
            for i in range(len(ids)):
                near = np.flatnonzero(~(rough[i] < least[i] - slack[i]) & ~own[i])
                with np.errstate(over="ignore", invalid="ignore"):
                    exact = (c[near] * q[i]).sum(axis=1)  # the same sum for the same vector, wherever it stands
                best = np.lexsort((cid[near], -np.where(np.isnan(exact), -np.inf, exact)))[:k]
                out_q.append(np.full(len(best), ids[i]))
                out_c.append(cid[near[best]])
                out_s.append(exact[best])
        return pa.table({"query_id": pa.array(np.concatenate(out_q)), "vec_id": pa.array(np.concatenate(out_c)), "score": pa.array(np.concatenate(out_s))})

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows whose vector is not null, not zero and all finite."""
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    v = quoted(vector_col).cast("array<double>")
    good = quoted(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(good).select(quoted(id_col).cast("long").alias("id"), v.alias("v"))


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", parts: int | None = None, leaf_rows: int = LEAF_ROWS, recall: float = 0.97
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query.

    Nearness is the inner product in double precision; ties go to the smaller
    id, a vector's own id is no candidate of its own. Vectors that are null,
    zero, or hold null or non-finite components take no part, nor do those whose
    length differs from the commonest. A product that is no number, where large
    components overflow, ranks last. Fewer candidates than k give fewer rows;
    an empty table gives none. Repeated rows of one id count once. Other columns
    are ignored, whatever their names.

    The fit sees the SAMPLE rows of smallest hash over the whole table, and for
    each part that is cut again as many of its own.
    """
    spark: SparkSession = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "neighbours")
    good = usable(vectors, id_col, vector_col)
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim, total = (lengths[0]["n"], lengths[0]["count"]) if lengths else (1, 0)
    good = good.where(F.size("v") == dim)
    asked = usable(queries, id_col, vector_col).where(F.size("v") == dim).dropDuplicates(["id"])
    # The SAMPLE rows of smallest hash over all partitions; the filter only bounds what the sort reads.
    keep = min(1.0, 2.0 * SAMPLE / max(1, total))
    spread = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    drawn = good.where(spread < int(keep * (1 << 30))).orderBy(spread, "id").limit(SAMPLE).collect()
    sample = np.array([r.v for r in sorted(drawn, key=lambda r: r.id)], dtype=np.float64).reshape(len(drawn), dim)
    parts = parts or int(min(MOST_PARTS, max(1, len(sample) // 150)))
    tree = Tree(fit_router(sample, parts=parts, k=k, recall=recall), {})
    send = spark.sparkContext.broadcast
    ddl = "part int, id long, v array<double>"
    homes = scratch.keep(good.dropDuplicates(["id"]).mapInArrow(_homes(send(tree)), ddl), "homes")
    counts = {r.part: r.n for r in homes.groupBy("part").agg(F.count("*").alias("n")).collect()}
    large = [p for p, n in counts.items() if n > leaf_rows]
    if large:
        rank = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("id", F.lit(13)), "id"))
        sizes = spark.createDataFrame([(p, counts[p]) for p in large], "part int, rows long")
        own = homes.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).drop("rank").join(F.broadcast(sizes), "part")
        fitted = own.groupBy("part").applyInArrow(_fit_part(k, leaf_rows, recall), "part int, router binary").collect()
        tree = Tree(tree.top, {r.part: pickle.loads(bytes(r.router)) for r in sorted(fitted, key=lambda r: r.part)})
        homes = scratch.keep(homes.select("id", "v").mapInArrow(_homes(send(tree)), ddl), "leaves")
        counts = {r.part: r.n for r in homes.groupBy("part").agg(F.count("*").alias("n")).collect()}
    payload = send(tree)
    routed = {r.part: r.n for r in asked.mapInArrow(_targets(payload), "part int").groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks, q_blocks = (send(np.array([-(-of.get(p, 0) // BLOCK) for p in range(tree.leaves)], dtype=np.int64)) for of in (counts, routed))
    key, tiled = ["part", "block", "q"], "part int, block int, q int, id long, v array<double>"
    placed = homes.mapInArrow(_place(blocks, q_blocks), tiled)
    sent = asked.mapInArrow(_route(payload, blocks, q_blocks), tiled)
    tiles = sent.groupBy(*key).cogroup(placed.groupBy(*key)).applyInArrow(_tile(k), "query_id long, vec_id long, score double")
    worth = F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score"))
    best = tiles.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(worth.desc(), "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
