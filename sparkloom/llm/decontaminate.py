"""Benchmark decontamination by winnowing.

Both sides keep the minimum hash of every run of ``window - gram + 1``
consecutive word grams, so any ``window`` words that a document shares with a
benchmark item carry a common kept gram. Kept grams of the documents are joined
with those of the benchmark; a hit is extended to the windows around it, which
are compared as a whole. Items shorter than a window are one window of their own
length and are looked up at every position.

A benchmark of up to ``block_bytes``, which are counted, goes to the executors as
one index. A larger one is joined in Spark first: kept grams of its items with
those of the documents, both shuffled; only documents that share one go on, and
meet the items block by block. Items shorter than a window have no kept gram;
their blocks meet all documents. Hashes find windows; their words decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import Scratch, bounded_batches
from .wordhash import ALNUM_WORDS, U64, Words, grams, text_slices, window_mask, winnowed

_BITS = 22


class BenchmarkIndex:
    """Kept grams, windows and the items of each window, as sorted arrays."""

    def __init__(self, items: list[tuple[object, str]], gram: int, window: int):
        self.gram, self.window, self.ids = gram, window, [i for i, _ in items]
        column = pa.array([t for _, t in items], pa.string())
        fingerprints, short, whole, owner = [], {}, [], []
        self.texts: dict[tuple[int, int], bytes] = {}  # words of a window by its length and hash
        for first, end, data, offsets in text_slices(column):
            words = Words(data, offsets, ALNUM_WORDS)
            g, keep = winnowed(words, gram, window)
            fingerprints.append(g[keep])
            full, inside = grams(words.hash, window), window_mask(words.bounds, len(words.hash), window)
            at = np.flatnonzero(inside)
            whole.append(full[at])
            owner.append(np.searchsorted(words.bounds, at, side="right") - 1 + first)
            for i, h in zip(at.tolist(), full[at].tolist(), strict=True):
                if (window, h) not in self.texts:
                    self.texts[window, h] = words.joined(i, i + window)
            for i in range(end - first):
                lo, hi = int(words.bounds[i]), int(words.bounds[i + 1])
                if 0 < hi - lo < window:
                    h = int(grams(words.hash[lo:hi], hi - lo)[0])
                    short.setdefault(hi - lo, {}).setdefault(h, []).append(first + i)
                    self.texts[hi - lo, h] = words.joined(lo, hi)
        none = np.zeros(0, dtype=U64)
        self.fingerprints = np.unique(np.concatenate(fingerprints or [none]))
        self.windows, self.window_items, self.starts = self._csr(np.concatenate(whole or [none]), np.concatenate(owner or [np.zeros(0, np.int64)]))
        self.filter = np.zeros(1 << _BITS, dtype=bool)
        self.filter[self.fingerprints >> U64(64 - _BITS)] = True
        self.short = {n: self._csr(np.repeat(np.array(list(d), dtype=U64), [len(v) for v in d.values()]), np.array([i for v in d.values() for i in v])) for n, d in short.items()}

    @staticmethod
    def _csr(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        if len(hashes):
            fresh = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
            hashes, owner = hashes[fresh], owner[fresh]
        keys, starts = np.unique(hashes, return_index=True)
        return keys, owner, np.append(starts, len(owner))

    def _same(self, words: Words, length: int, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return np.array([self.texts[length, h] == words.joined(i, i + length) for i, h in zip(at.tolist(), keys.tolist(), strict=True)], dtype=bool)

    def hits(self, words: Words) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, window positions, index of the window, and the CSR of items) by window length."""
        out = []
        n = len(words.hash)
        if len(self.fingerprints) and n >= self.window:
            g, keep = winnowed(words, self.gram, self.window)
            at = np.flatnonzero(keep & self.filter[g >> U64(64 - _BITS)])
            at = at[_find(self.fingerprints, g[at]) >= 0]
            if len(at):
                whole, inside = grams(words.hash, self.window), window_mask(words.bounds, n, self.window)
                near = np.unique((at[:, None] - np.arange(self.window - self.gram + 1)[None, :]).ravel())
                near = near[(near >= 0) & (near < len(whole))]
                near = near[inside[near]]
                which = _find(self.windows, whole[near])
                near, which = near[which >= 0], which[which >= 0]
                same = self._same(words, self.window, near, self.windows[which])
                out.append((self.window, near[same], which[same], self.window_items, self.starts))
        for length, (keys, owner, starts) in self.short.items():
            if n >= length:
                g, inside = grams(words.hash, length), window_mask(words.bounds, n, length)
                which = np.where(inside[: len(g)], _find(keys, g), -1)
                at = np.flatnonzero(which >= 0)
                at = at[self._same(words, length, at, keys[which[at]])]
                out.append((length, at, which[at], owner, starts))
        return out


def _find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value among sorted keys, -1 where it isn't one."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


class Block:
    """Items on their way to the executors; a worker builds their index once."""

    def __init__(self, items: list[tuple[object, str]], gram: int, window: int):
        self.items, self.gram, self.window, self._index = items, gram, window, None

    def index(self) -> BenchmarkIndex:
        if self._index is None:
            self._index = BenchmarkIndex(self.items, self.gram, self.window)
        return self._index


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _marks(index: BenchmarkIndex, words: Words, rows: int) -> tuple[list[list[dict]], list[list]]:
    """Spans of hit words and ids of the items that hit, by text."""
    n = len(words.hash)
    cover, pairs = np.zeros(n + 1, dtype=np.int32), []
    for length, at, which, owner, starts in index.hits(words):
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        doc = np.searchsorted(words.bounds, at, side="right") - 1
        seen = np.unique(np.stack([doc, which]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        for d, w in seen.T:
            mine = owner[starts[w] : starts[w + 1]]
            pairs.append(np.stack([np.full(len(mine), d), mine]))
    hit = np.cumsum(cover[:n]) > 0
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    # A span ends with its text.
    cut = words.bounds[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = np.unique(cut[hit[cut - 1] & hit[cut]]) if n else cut
    begin, end = np.sort(np.concatenate((np.flatnonzero(edge == 1), cut))), np.sort(np.concatenate((np.flatnonzero(edge == -1), cut)))
    row_of = np.searchsorted(words.bounds, begin, side="right") - 1
    spans: list[list[dict]] = [[] for _ in range(rows)]
    for r, s, e in zip(row_of, begin, end, strict=True):
        spans[r].append({"start": int(s - words.bounds[r]), "end": int(e - words.bounds[r])})
    found: list[list] = [[] for _ in range(rows)]
    if pairs:
        for r, i in np.unique(np.concatenate(pairs, axis=1), axis=1).T:
            found[r].append(index.ids[i])
    return spans, found


def _finder(payload, id_type):
    made = pa.struct([("words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(to_arrow_type(id_type)))])

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = payload.value.index()
        for texts in columns:
            out: list[dict] = []
            for a, b, data, offsets in text_slices(texts):
                words = Words(data, offsets, ALNUM_WORDS)
                out += [{"words": n, "spans": s, "items": i} for n, s, i in zip(words.counts.tolist(), *_marks(index, words, b - a), strict=True)]
            yield pa.array(out, made)

    return F.arrow_udf(run, f"struct<words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<{id_type.simpleString()}>>").asNondeterministic()


def _kept(gram: int, window: int, carried: int):
    """(columns carried along, kept gram) of each text in the last column."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(carried)):
                words = Words(data, offsets, ALNUM_WORDS)
                g, keep = winnowed(words, gram, window)
                at = np.flatnonzero(keep)
                doc = np.searchsorted(words.bounds, at, side="right") - 1
                pair = np.unique(np.stack([doc.astype(np.uint64), g[at]]), axis=1)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a).take(pa.array(pair[0].astype(np.int64))) for i in range(carried)], pa.array(pair[1].view(np.int64))], names=[*batch.schema.names[:carried], "gram"])

    return run


def _word_count(texts: pa.Array) -> pa.Array:
    return pa.array([n for _, _, data, offsets in text_slices(texts) for n in Words(data, offsets, ALNUM_WORDS, hashes=False).counts.tolist()], pa.int64())


def _union(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Spans of several blocks; those that overlap or touch become one."""
    for lists in columns:
        out: list[list[dict]] = []
        for spans in lists.to_pylist():
            one: list[dict] = []
            for s in sorted(spans, key=lambda s: s["start"]):
                if one and s["start"] <= one[-1]["end"]:
                    one[-1]["end"] = max(one[-1]["end"], s["end"])
                else:
                    one.append(dict(s))
            out.append(one)
        yield pa.array(out, pa.list_(_SPAN))


def benchmark_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    gram: int = 5,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Adds n_words long, hit_spans array<struct<start,end>> (in words, end
    exclusive), n_hit long and item_ids array (the ids of items of which a
    window occurs) to every row of docs.

    Words are runs of letters, digits and non-ASCII characters after A-Z are
    lower-cased. A null or wordless text has no words and no hits; texts of any
    length are read whole. Items without words match nothing; equal items all
    count; rows of one item id are items of their own that share the id, listed
    once; a null id is listed as null. Every row of docs is returned as it
    stands, repeated rows too. Columns of docs named n_words, hit_spans, n_hit or
    item_ids are replaced, no other name matters. Either table may be empty.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    items = benchmark.select(quoted(item_id_col).alias("id"), F.coalesce(quoted(item_text_col).cast("string"), F.lit("")).alias("text"))
    base = docs.drop("n_words", "hit_spans", "n_hit", "item_ids")
    text = quoted(text_col).cast("string")
    id_type = items.schema["id"].dataType
    kept = [quoted(c) for c in base.columns]
    nothing = F.struct(F.lit(0).cast("bigint").alias("words"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.array().cast(f"array<{id_type.simpleString()}>").alias("items"))

    def looked_up(frame: DataFrame, found: DataFrame, scratch: Scratch | None, label: str) -> DataFrame:
        """frame(row, n_words, ...) after the found items, in blocks that are measured first."""
        size = found.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
        blocks = max(1, -(-size // block_bytes))
        for block in range(blocks):
            mine = found.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block) if blocks > 1 else found
            payload = spark.sparkContext.broadcast(Block([(r.id, r.text) for r in mine.collect()], gram, window))
            new = frame.withColumn("n_words", _finder(payload, id_type)(F.col("row")[text_col].cast("string")))
            frame = new.select("row", F.struct(F.col("n_words.words").alias("words"), *[F.concat(F.col(f"hit_spans.{x}"), F.col(f"n_words.{x}")).alias(x) for x in ("spans", "items")]).alias("hit_spans"))
            if scratch:
                frame = scratch.keep(frame, f"{label}-{block}")
        return frame

    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if total <= block_bytes:
        payload = spark.sparkContext.broadcast(Block([(r.id, r.text) for r in items.collect()], gram, window))
        made = base.select(*kept, _finder(payload, id_type)(text).alias("hit_spans"))
        spans = F.col("hit_spans.spans")
    else:
        scratch = Scratch(spark, "winnow")
        words = F.arrow_udf(_word_count, "bigint")(F.col("text"))
        long_, short = items.where(words >= window), items.where((words > 0) & (words < window))
        grams_ = items.select(F.lit(0).alias("one"), "text").mapInArrow(_kept(gram, window, 1), "one int, gram long").select("gram").distinct()
        marked = base.select(F.xxhash64(text).alias("mark"), F.coalesce(text, F.lit("")).alias("text"))
        shared = marked.mapInArrow(_kept(gram, window, 1), "mark long, gram long").join(grams_, "gram", "left_semi").select("mark").distinct()
        shared = scratch.keep(shared, "shared")
        rows = base.select(F.struct(*kept).alias("row"), nothing.alias("hit_spans"), F.xxhash64(text).alias("mark"))
        rest = rows.join(shared.hint("merge"), "mark", "left_anti").select("row", "hit_spans")
        some = scratch.keep(rows.join(shared.hint("merge"), "mark", "left_semi").select("row", "hit_spans"), "candidates")
        rest = looked_up(rest, short, None if short.isEmpty() else scratch, "rest")
        some = looked_up(looked_up(some, long_, scratch, "long"), short, scratch, "short")
        both = rest.unionByName(some)
        made = both.select(*[F.col("row")[c].alias(c) for c in base.columns], "hit_spans")
        spans = F.arrow_udf(_union, "array<struct<start:bigint,end:bigint>>")(F.col("hit_spans.spans"))
    last = made.select(*kept, F.col("hit_spans.words").alias("n_words"), spans.alias("hit_spans"), F.array_distinct("hit_spans.items").alias("item_ids"))
    return last.select(*kept, "n_words", "hit_spans", F.expr("aggregate(hit_spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit"), "item_ids")
