"""Repeated word spans by a compacted de Bruijn graph.

Words of a text are letters; a run of ``window`` words is an edge between the
two runs of ``window - 1`` words, the nodes, that it starts and ends with. Texts
are dealt to chunks, a partition each, by a hash of id and text, once; all passes
read that one exchange.

1. Of every window the least hash of its word grams is kept. A window that
   occurs in two documents has its kept gram in both, so edges whose kept gram
   is in one document only are no repeats and leave the graph.
2. Nodes of the other edges go, packed by hash range, with a signature of what
   stands before and after them: the edge into the node and the edge out of it,
   or that the text starts or ends there. A node with several edges in or out
   has several signatures: it branches.
3. Edges that follow each other through nodes that don't branch compact into one
   path. Every occurrence of one of its edges is an occurrence of the whole path,
   so paths, no longer edges, are joined: each chunk sends every path once, with
   a 128-bit digest of its words and the smallest and largest id that hold it.
4. Each chunk learns which of its paths a smaller document holds, and the words
   that they cover go.

A clash of hashes in 1 can only keep an edge that is no repeat, one of nodes in
2 only cut a path in two, everywhere alike. Between chunks equality of words is
decided by the digest of the words themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .scratch import bounded_batches
from .wordhash import PLAIN_WORDS, U64, Words, grams, least_grams, mix, text_slices, window_mask, winnowed

_TOLD = "chunk int, kind int, blob binary"
REPEATED, BRANCHING, DOOMED = 0, 1, 2


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Ascending 64-bit values as steps of 6 bytes; of 8 where a step is too large."""
    steps = np.diff(sorted_hashes, prepend=U64(0))
    if len(steps) > 1 and int(steps[1:].max()) < 1 << 48:
        return b"\6" + sorted_hashes[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"\x08" + sorted_hashes.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if blob[0] == 8:
        return np.frombuffer(blob, dtype=U64, offset=1)
    rest = np.frombuffer(blob, dtype=np.uint8, offset=9).reshape(-1, 6)
    steps = np.zeros((len(rest) + 1, 8), dtype=np.uint8)
    steps[0] = np.frombuffer(blob, dtype=np.uint8, count=8, offset=1)
    steps[1:, :6] = rest
    return np.cumsum(steps.reshape(-1).view(U64), dtype=U64)


def six_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(U64)


class Known:
    """Membership of hashes in a set: a bitmap first, then a search."""

    BITS = 20

    def __init__(self, blobs: list[bytes]):
        self.keys = np.sort(np.concatenate([unpack(b) for b in blobs])) if blobs else np.zeros(0, U64)
        self.map = np.zeros(1 << self.BITS, dtype=bool)
        self.map[self.keys >> U64(64 - self.BITS)] = True

    def has(self, values: np.ndarray) -> np.ndarray:
        out = self.map[values >> U64(64 - self.BITS)]
        some = np.flatnonzero(out)
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, values[some]), len(self.keys) - 1)
            out[some] = self.keys[at] == values[some]
        return out


def _cuts(keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal keys."""
    if not len(keys):
        return []
    at = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *at], [*at, len(keys)], strict=True))


def _runs(batches, columns: int):
    """(key, values of the other columns) of neighbouring rows with one key in the first column."""
    now, held = None, [[] for _ in range(columns - 1)]
    for batch in batches:
        for key, *values in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True):
            if key != now:
                if held[0]:
                    yield now, held
                now, held = key, [[] for _ in range(columns - 1)]
            for part, value in zip(held, values, strict=True):
                part.append(value)
    if held[0]:
        yield now, held


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the equal range of hashes that each lies in."""
    return ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)


def _kept_grams(window: int, gram: int, buckets: int):
    """Pass 1; a partition is a chunk."""

    def flush(chunk, hashes, ids):
        h, d = np.concatenate(hashes), np.concatenate(ids)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        fresh = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        lead = np.flatnonzero(fresh)
        last = np.append(lead[1:], len(h)) - 1
        shared, h = d[last] != d[lead], h[lead]
        bucket = _bucket(h, buckets)
        runs = _cuts(bucket)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[[a for a, _ in runs]]), pa.array(np.full(len(runs), chunk, np.int32)), pa.array([pack(h[a:b]) for a, b in runs], pa.binary()), pa.array([np.packbits(shared[a:b]).tobytes() for a, b in runs], pa.binary())],
            names=["bucket", "chunk", "blob", "shared"],
        )

    def run(batches):
        now, hashes, ids = None, [], []
        for batch in batches:
            chunks, docs = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for lo, hi in _cuts(chunks):
                if chunks[lo] != now:
                    if hashes:
                        yield flush(now, hashes, ids)
                    now, hashes, ids = chunks[lo], [], []
                for a, _, data, offsets in text_slices(batch.column(2).slice(lo, hi - lo)):
                    words = Words(data, offsets, PLAIN_WORDS)
                    g, keep = winnowed(words, gram, window)
                    at = np.flatnonzero(keep)
                    hashes.append(g[at])
                    ids.append(docs[lo + a + np.searchsorted(words.bounds, at, side="right") - 1])
        if hashes:
            yield flush(now, hashes, ids)

    return run


def _answers(chunks: np.ndarray, hashes: np.ndarray, kind: int):
    """What each chunk is told: its chosen hashes."""
    order = np.lexsort((hashes, chunks))
    chunks, hashes = chunks[order], hashes[order]
    runs = _cuts(chunks)
    return pa.RecordBatch.from_arrays([pa.array(chunks[[a for a, _ in runs]]), pa.array(np.full(len(runs), kind, np.int32)), pa.array([pack(hashes[a:b]) for a, b in runs], pa.binary())], names=["chunk", "kind", "blob"])


def _repeated(batches):
    """Kept grams of more than one document; rows of a bucket stand together."""
    for _, (chunks, blobs, shared) in _runs(batches, 4):
        parts = [unpack(b) for b in blobs]
        h, c = np.concatenate(parts), np.repeat(np.array(chunks, np.int32), [len(p) for p in parts])
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(p)) for s, p in zip(shared, parts, strict=True)])
        order = np.argsort(h, kind="stable")
        h, c, several = h[order], c[order], several[order]
        lead = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(lead, len(h)))
        chosen = np.repeat((size > 1) | (np.maximum.reduceat(several, lead) > 0), size)
        if chosen.any():
            yield _answers(c[chosen], h[chosen], REPEATED)


def _candidates(words: Words, gram: int, window: int, repeated: Known) -> np.ndarray:
    """Word positions that start an edge that stays in the graph."""
    least = least_grams(words, gram, window)[1]
    at = np.flatnonzero(window_mask(words.bounds, len(words.hash), window)[: len(least)])
    return at[repeated.has(least[at])]


def _told(rows: pa.Table, kind: int) -> Known:
    kinds = rows.column("kind").to_pylist()
    return Known([b for k, b in zip(kinds, rows.column("blob").to_pylist(), strict=True) if k == kind])


_NODES = "bucket int, chunk int, nodes binary, signatures binary, split binary"


def _nodes(window: int, gram: int, buckets: int):
    """Pass 2: a chunk's texts and its repeated kept grams."""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), *[(n, pa.binary()) for n in ("nodes", "signatures", "split")]])

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows or not told.num_rows:
            return schema.empty_table()
        repeated, parts = _told(told, REPEATED), []
        for _, _, data, offsets in text_slices(texts.column("text")):
            words = Words(data, offsets, PLAIN_WORDS)
            at = _candidates(words, gram, window, repeated)
            if not len(at):
                continue
            spots = np.unique(np.concatenate((at, at + 1)))  # the nodes on both sides of each edge
            edge, node = grams(words.hash, window), grams(words.hash, window - 1)
            valid = window_mask(words.bounds, len(words.hash), window)
            out = np.where(valid[spots], edge[np.minimum(spots, len(edge) - 1)], U64(0))
            before = np.maximum(spots - 1, 0)
            into = np.where((spots > 0) & valid[before], edge[np.minimum(before, len(edge) - 1)], U64(0))
            parts.append((node[spots], mix(mix(into + U64(1)) ^ out) >> U64(16)))
        if not parts:
            return schema.empty_table()
        h, signature = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        h, signature = h[order], signature[order]
        lead = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        split = np.minimum.reduceat(signature, lead) != np.maximum.reduceat(signature, lead)
        h, signature = h[lead], signature[lead]
        bucket, chunk = _bucket(h, buckets), texts.column("chunk")[0].as_py()
        runs = _cuts(bucket)
        blobs = [[f(x[a:b]) for a, b in runs] for f, x in ((pack, h), (six_bytes, signature), (lambda s: np.packbits(s).tobytes(), split))]
        return pa.Table.from_arrays([pa.array(bucket[[a for a, _ in runs]]), pa.array(np.full(len(runs), chunk, np.int32)), *[pa.array(b, pa.binary()) for b in blobs]], schema=schema)

    return run


def _branching(batches):
    """Nodes with several signatures; rows of a bucket stand together."""
    for _, (chunks, nodes, signatures, split) in _runs(batches, 5):
        parts = [unpack(b) for b in nodes]
        h, c = np.concatenate(parts), np.repeat(np.array(chunks, np.int32), [len(p) for p in parts])
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(p)) for s, p in zip(split, parts, strict=True)])
        order = np.argsort(h, kind="stable")
        h, c, signature = h[order], c[order], from_six_bytes(b"".join(signatures))[order]
        lead = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        branches = (np.maximum.reduceat(several[order], lead) > 0) | (np.minimum.reduceat(signature, lead) != np.maximum.reduceat(signature, lead))
        chosen = np.repeat(branches, np.diff(np.append(lead, len(h))))
        if chosen.any():
            yield _answers(c[chosen], h[chosen], BRANCHING)


class Joined:
    """Words first..end of a slice joined by one space."""

    def __init__(self, words: Words):
        self.words = words
        gap = np.ones(len(words.start), dtype=bool)
        if len(gap) > 1:
            gap[1:] = (words.start[1:] - words.end[:-1] != 1) | (words.data[words.end[:-1]] != 32)
        self.odd = np.flatnonzero(gap)  # words that don't follow the one before by a single space
        self.raw = memoryview(np.ascontiguousarray(words.data))

    def text(self, first: int, end: int) -> bytes:
        if first >= end:
            return b""
        w = self.words
        lo, hi = np.searchsorted(self.odd, (first, end - 1), side="right")
        if lo == hi:
            return bytes(self.raw[w.start[first] : w.end[end - 1]])
        starts = [first, *self.odd[lo:hi].tolist()]
        return b" ".join(self.raw[w.start[a] : w.end[b - 1]] for a, b in zip(starts, [*starts[1:], end], strict=True))


def _compacted(words: Words, gram: int, window: int, repeated: Known, branching: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first edge, last edge, key) of each path, in order; equal paths of a chunk have one key."""
    at = _candidates(words, gram, window, repeated)
    if not len(at):
        return at, at, np.zeros(0, U64)
    cut = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)) | branching.has(grams(words.hash, window - 1)[at]))
    first, last = at[cut], at[np.append(cut[1:], len(at)) - 1]
    edge = grams(words.hash, window)
    return first, last, mix(edge[first] + mix(edge[last] ^ (last - first).astype(U64)))


_PATHS = "digest binary, chunk int, key long, least long, most long"


def _paths(window: int, gram: int):
    """Pass 3: a chunk's texts and what it was told; each of its paths once."""
    schema = pa.schema([("digest", pa.binary()), ("chunk", pa.int32()), *[(n, pa.int64()) for n in ("key", "least", "most")]])

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows or not told.num_rows:
            return schema.empty_table()
        repeated, branching = _told(told, REPEATED), _told(told, BRANCHING)
        ids, parts, slices = np.asarray(texts.column("id").combine_chunks()), [], []
        for a, _, data, offsets in text_slices(texts.column("text")):
            words = Words(data, offsets, PLAIN_WORDS)
            first, last, key = _compacted(words, gram, window, repeated, branching)
            parts.append((key, first, last, ids[a + np.searchsorted(words.bounds, first, side="right") - 1], np.full(len(key), len(slices))))
            slices.append(Joined(words))
        key, first, last, doc, of = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(key):
            return schema.empty_table()
        order = np.argsort(key, kind="stable")
        lead = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        least, most, one = np.minimum.reduceat(doc[order], lead), np.maximum.reduceat(doc[order], lead), order[lead]
        digests = [hashlib.blake2b(slices[n].text(s, e + window), digest_size=16).digest() for n, s, e in zip(of[one].tolist(), first[one].tolist(), last[one].tolist(), strict=True)]
        chunk = texts.column("chunk")[0].as_py()
        return pa.Table.from_arrays([pa.array(digests, pa.binary()), pa.array(np.full(len(one), chunk, np.int32)), pa.array(key[one].view(np.int64)), pa.array(least), pa.array(most)], schema=schema)

    return run


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed_spans array<struct<start:int,end:int,source:bigint>>"


def _remove(window: int, gram: int):
    """Pass 4: a chunk's texts, and the keys of the paths that a smaller document holds."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        ids = np.asarray(texts.column("id").combine_chunks()) if texts.num_rows else np.zeros(0, np.int64)
        kinds = np.asarray(told.column("kind").combine_chunks()) if told.num_rows else np.zeros(0, np.int32)
        doomed = told.filter(pa.array(kinds == DOOMED)) if told.num_rows else told
        keys = np.asarray(doomed.column("key").combine_chunks()).view(U64) if doomed.num_rows else np.zeros(0, U64)
        order = np.argsort(keys)
        keys = keys[order]
        sources = np.asarray(doomed.column("source").combine_chunks())[order] if doomed.num_rows else np.zeros(0, np.int64)
        repeated, branching = _told(told, REPEATED), _told(told, BRANCHING)
        counts, lost, digests, listed = [], [], [], []
        for a, b, data, offsets in text_slices(texts.column("text")):
            words = Words(data, offsets, PLAIN_WORDS, hashes=bool(len(keys)))
            n, joined = len(words.start), Joined(words)
            first = last = source = doc = np.zeros(0, np.int64)
            if len(keys):
                first, last, key = _compacted(words, gram, window, repeated, branching)
                spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                doc = np.searchsorted(words.bounds, first, side="right") - 1
                go = (keys[spot] == key) & (ids[a + doc] > sources[spot])
                first, last, source, doc = first[go], last[go], sources[spot[go]], doc[go]
            cover = np.zeros(n + 1, dtype=np.int32)
            np.add.at(cover, first, 1)
            np.add.at(cover, last + window, -1)
            gone = np.cumsum(cover[:n]) > 0
            taken = np.concatenate(([0], np.cumsum(gone)))
            gone_in = taken[words.bounds[1:]] - taken[words.bounds[:-1]]
            counts.append(words.counts), lost.append(gone_in)
            for row, some in enumerate((gone_in > 0).tolist()):
                lo, hi = int(words.bounds[row]), int(words.bounds[row + 1])
                if some:
                    left = np.diff(np.concatenate(([0], (~gone[lo:hi]).view(np.int8), [0])))
                    kept = b" ".join(joined.text(lo + s, lo + e) for s, e in zip(np.flatnonzero(left == 1).tolist(), np.flatnonzero(left == -1).tolist(), strict=True))
                else:
                    kept = joined.text(lo, hi)
                digests.append(hashlib.sha256(kept).hexdigest())
            base = words.bounds[doc]
            spans = pa.StructArray.from_arrays([pa.array((first - base).astype(np.int32)), pa.array((last + window - base).astype(np.int32)), pa.array(source)], names=["start", "end", "source"])
            listed.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)), spans))
        none = pa.array([], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64())])))
        return pa.table({"doc_id": pa.array(ids), "n_words": pa.array(np.concatenate(counts or [ids]).astype(np.int64)), "n_removed": pa.array(np.concatenate(lost or [ids]).astype(np.int64)), "kept_sha256": pa.array(digests, pa.string()), "removed_spans": pa.concat_arrays(listed) if listed else none})

    return run


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 5, chunk_bytes: int = 6 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed_spans) for each row.

    A word is removed if a window of ``window`` consecutive words covers it
    whose word sequence also starts in a document with a smaller id; windows are
    judged on the input. removed_spans lists the paths that cover them, as
    [start, end) in words with the smallest document that holds the path; they
    may overlap. kept_sha256 is the SHA-256 of the words left, joined by one
    space.

    A null text has no words; shorter texts than a window lose nothing. A long
    text is one row of a chunk, whatever its length. Repeated rows of one id
    keep a row each and are no smaller document to each other. Rows with a null
    id are left out. Other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    if not 1 <= gram < window:
        raise ValueError(f"grams of {gram} words don't fit windows of {window}")
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id IS NOT NULL")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // chunk_bytes))
    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int").alias("chunk")
    dealt = source.select(chunk, "id", "text").repartitionById(parts, F.col("chunk"))

    def to_chunks(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(parts, F.col("chunk"))

    kept = dealt.mapInArrow(_kept_grams(window, gram, parts), "bucket int, chunk int, blob binary, shared binary")
    repeated = kept.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_repeated, _TOLD)
    nodes = dealt.groupBy("chunk").cogroup(to_chunks(repeated).groupBy("chunk")).applyInArrow(_nodes(window, gram, parts), _NODES)
    branching = nodes.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_branching, _TOLD)
    graph = repeated.union(branching)
    paths = dealt.groupBy("chunk").cogroup(to_chunks(graph).groupBy("chunk")).applyInArrow(_paths(window, gram), _PATHS)
    # A path has a row for each chunk at most, so a common one is no hot key.
    sourced = paths.withColumn("source", F.min("least").over(Window.partitionBy("digest"))).where("source < most")
    doomed = sourced.select("chunk", F.lit(DOOMED).alias("kind"), F.lit(None).cast("binary").alias("blob"), "key", "source")
    told = graph.withColumns({"key": F.lit(None).cast("long"), "source": F.lit(None).cast("long")}).union(doomed)
    return dealt.groupBy("chunk").cogroup(to_chunks(told).groupBy("chunk")).applyInArrow(_remove(window, gram), _OUT)
