"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is split by the tokenizer's pattern; distinct pieces that a worker hasn't
met go, by byte length, into padded matrices of token ids. In each round every
row looks up its adjacent pairs in a hash table, merges the leftmost pair of
minimum rank and closes the gap; finished rows leave. A piece that is a token as
a whole needs no merge. Pieces of more than
LONG_PIECE bytes, for which rounds over the whole row would take the square of
its length, merge by a heap of (rank, position), which is the same order.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches
from .wordhash import text_slices

LONG_PIECE = 128
#: A worker forgets its pieces beyond so many.
REMEMBERED = 250_000
_NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Open addressing: (left id, right id) -> merged id, which is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, _NONE, dtype=np.int32)
        k, v, at = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32), self._slot(np.array(keys, dtype=np.int64))
        self.probes = 0
        while len(k):
            self.probes += 1
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.keys[at[take]], self.values[at[take]] = k[take], v[take]
            rest = np.ones(len(k), dtype=bool)
            rest[take] = False
            k, v, at = k[rest], v[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        shape, keys = keys.shape, keys.ravel()
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out.reshape(shape)

    def one(self, left: int, right: int) -> int:
        key = left << 32 | right
        at = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.bits)
        while self.keys[at] != -1:
            if self.keys[at] == key:
                return int(self.values[at])
            at = (at + 1) & ((1 << self.bits) - 1)
        return int(_NONE)


def merge_matrix(ids: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> list[np.ndarray]:
    """ids: rows of token ids, padded behind lengths. The merged rows."""
    out: list = [None] * len(ids)
    rows = np.arange(len(ids))
    lengths = lengths.copy()
    rank = pairs.ranks(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 0), _NONE)
    rank[np.arange(rank.shape[1])[None, :] >= lengths[:, None] - 1] = _NONE
    while len(rows):
        at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
        best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), _NONE)
        done = best == _NONE
        if done.any():
            for i in np.flatnonzero(done):
                out[rows[i]] = ids[i, : lengths[i]]
            go = ~done
            rows, ids, lengths, rank, at, best = rows[go], ids[go], lengths[go], rank[go], at[go], best[go]
            if not len(rows):
                break
        n, width = len(rows), ids.shape[1]
        here = np.arange(n)
        ids[here, at] = best
        behind = np.arange(width - 1)[None, :]
        ids = np.where(behind > at[:, None], ids[:, 1:], ids[:, :-1])
        lengths -= 1
        top = max(int(lengths.max()), 1)
        ids = ids[:, :top]
        gap = np.arange(rank.shape[1] - 1)[None, :]
        rank = np.where(gap >= at[:, None], rank[:, 1:], rank[:, :-1])[:, : top - 1]
        # Only the pairs on both sides of the merge are new.
        for shift in (-1, 0):
            spot = at + shift
            ok = (spot >= 0) & (spot < lengths - 1)
            if ok.any():
                rank[here[ok], spot[ok]] = pairs.ranks(ids[here[ok], spot[ok]], ids[here[ok], spot[ok] + 1])
            gone = (spot >= 0) & (spot >= lengths - 1) & (spot < rank.shape[1])
            rank[here[gone], spot[gone]] = _NONE
    return out


def merge_long(ids: list[int], pairs: PairTable) -> np.ndarray:
    n = len(ids)
    nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.one(ids[i], ids[i + 1])) != _NONE]
    heapq.heapify(heap)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if not alive[i] or j >= n or ids[i] != left or ids[j] != right:
            continue
        ids[i], alive[j], nxt[i] = rank, False, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := pairs.one(ids[i], ids[nxt[i]])) != _NONE:
                heapq.heappush(heap, (r, i, ids[i], ids[nxt[i]]))
        if prev[i] >= 0 and (r := pairs.one(ids[prev[i]], ids[i])) != _NONE:
            heapq.heappush(heap, (r, prev[i], ids[prev[i]], ids[i]))
    return np.array([t for t, a in zip(ids, alive, strict=True) if a], dtype=np.int32)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.pairs, self.whole = PairTable(ranks), ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.vocab = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.vocab_at = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        # A piece that is a token as a whole is that token, whatever the merges would make of it.
        merged: list = [None if (t := self.whole.get(b)) is None else np.array([t], np.int32) for b in raw]
        by_width: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if merged[i] is not None:
                continue
            if len(b) > LONG_PIECE:
                merged[i] = merge_long(self.single[np.frombuffer(b, np.uint8)].tolist(), self.pairs)
            else:
                by_width.setdefault(len(b) if len(b) <= 16 else -(-len(b) // 16) * 16, []).append(i)
        for width, members in by_width.items():
            for lo in range(0, len(members), 8192):
                part = members[lo : lo + 8192]
                sizes = np.array([len(raw[i]) for i in part])
                flat = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
                for i, row in zip(part, merge_matrix(self.single[flat], sizes, self.pairs), strict=True):
                    merged[i] = row
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum([len(row) for row in merged])))
        self.flat = np.concatenate((self.flat, *merged)).astype(np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        if len(self.known) > REMEMBERED:
            self._forget()
        split = [self.pattern.findall(t) for t in texts]
        fresh = {p for pieces in split for p in pieces if p not in self.known}
        if fresh:
            self._learn(sorted(fresh))
        get = self.known.__getitem__
        which = np.fromiter((k for pieces in split for k in map(get, pieces)), dtype=np.int64, count=sum(map(len, split)))
        if not len(which):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        first = self.at[which]
        count = self.at[which + 1] - first
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(first - (ends - count), count) + np.arange(ends[-1])]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum([len(p) for p in split])))]
        return ids.astype(np.int32), bounds.astype(np.int64)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets by text)."""
        lengths = self.vocab_at[ids + 1] - self.vocab_at[ids]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        data = self.vocab[np.repeat(self.vocab_at[ids] - ends[:-1], lengths) + np.arange(ends[-1])]
        return data, ends[bounds]


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One per worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _loaded[path, pattern]


def _encoder(path: str, pattern: str, decoded: bool):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path, pattern)
        for texts in columns:
            parts = []
            for a, b, _, _ in text_slices(texts, 1 << 20):
                ids, bounds = bpe.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                new = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))]
                if decoded:
                    data, ends = bpe.decode(ids, bounds)
                    new.append(pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]))
                parts.append(pa.StructArray.from_arrays(new, names=["ids", *["decoded"] * decoded]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), *[("decoded", pa.binary())] * decoded]))

    return F.arrow_udf(run, "struct<ids:array<int>" + ",decoded:binary" * decoded + ">").asNondeterministic()


def _decoder(path: str, pattern: str):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path, pattern)
        for lists in columns:
            rows = [np.array(x or [], dtype=np.int64) for x in lists.to_pylist()]
            ids = np.concatenate(rows or [np.zeros(0, np.int64)])
            data, ends = bpe.decode(ids, np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64))
            yield pa.array([data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())

    return F.arrow_udf(run, "binary").asNondeterministic()


def _quoted(name: str):
    return F.col(f"`{name.replace('`', '``')}`")


def bpe_encode(docs: DataFrame, *, path: str, pattern: str, text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """Adds ids array<int>, and with_decoded the bytes that the ids stand for, to
    every row of docs. No special tokens. A null text counts as empty: no ids;
    long texts are read whole. The rank file at path is read by each worker.
    Repeated rows stay; columns of docs named ids or decoded are replaced, no
    other name matters. An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    base = docs.drop("ids", *["decoded"] * with_decoded)
    kept = [_quoted(c) for c in base.columns]
    coded = base.select(*kept, _encoder(path, pattern, with_decoded)(_quoted(text_col).cast("string")).alias("ids"))
    return coded.select(*kept, *[F.col("ids.decoded").alias("decoded")] * with_decoded, F.col("ids.ids").alias("ids"))


def bpe_decode(encoded: DataFrame, *, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded binary to every row; null ids decode to no bytes. A column
    named decoded is replaced, no other name matters."""
    bounded_batches(encoded.sparkSession)
    base = encoded.drop("decoded")
    return base.select(*[_quoted(c) for c in base.columns], _decoder(path, pattern)(_quoted(ids_col)).alias("decoded"))
