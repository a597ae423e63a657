"""Vectorised words, word hashes and word n-gram hashes of UTF-8 texts.

Works straight on Arrow string buffers: no Python object is made for a word.
All hashes are 64-bit and depend on the bytes of the words only, so they agree
between executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GRAM = U64(0xD6E8FEB86659FD93)
_LENGTH = U64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Low-order bytes of an eight-byte lane that belong to a word of so many bytes.
_MASK = np.array([(1 << 8 * r) - 1 for r in range(9)], dtype=U64)
#: Bytes of texts worked on at a time; temporaries are about 20 times this.
SLICE = 1 << 20


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


class WordClass:
    """Which bytes belong to words and whether A-Z are lower-cased first."""

    def __init__(self, separators: bytes, lower: bool):
        self.member = np.ones(256, dtype=bool)
        self.member[list(separators)] = False
        self.fold = _lowered() if lower else np.arange(256, dtype=np.uint8)


_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Runs of anything but ASCII white space.
PLAIN_WORDS = WordClass(_SPACES, lower=False)
FOLDED_WORDS = WordClass(_SPACES, lower=True)
#: Runs of ASCII letters, digits and all non-ASCII characters, after A-Z are lower-cased.
ALNUM_WORDS = WordClass(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90)), lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, in place on a fresh array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets from 0) for runs of rows of about
    limit bytes; a longer text is a run of its own. A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, where, values = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a run of texts: byte spans, 64-bit hashes, and bounds by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: WordClass, hashes: bool = True):
        self.data, self.offsets, self._fold = data, offsets, kind.fold
        inside = kind.member[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = np.unique(offsets)
        if len(edges) > 1:
            left = edges[edges < len(data)]
            first[left] = inside[left]
            right = edges[edges > 0] - 1
            last[right] = inside[right]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # text i has words bounds[i]:bounds[i + 1]
        if hashes:
            self.hash = self._hash(kind)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def joined(self, first: int, end: int) -> bytes:
        """Words first..end, folded, joined by a space."""
        return b" ".join(self._fold[self.data[a:b]].tobytes() for a, b in zip(self.start[first:end], self.end[first:end], strict=True))

    def _hash(self, kind: WordClass) -> np.ndarray:
        """Eight bytes at a time through a bijection, so words of up to eight
        bytes never share a hash with others of their length; longer than
        LONG_WORD by BLAKE2b."""
        lengths = self.end - self.start
        out = lengths.astype(U64) * _LENGTH
        data = np.concatenate((kind.fold[self.data], np.zeros(8, np.uint8)))
        lanes = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        todo = np.flatnonzero(lengths <= LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            todo = todo[lengths[todo] > at] if at else todo
            if not len(todo):
                break
            lane = lanes[self.start[todo] + at] & _MASK[np.minimum(lengths[todo] - at, 8)]
            out[todo] = mix(out[todo] ^ lane)
        for i in np.flatnonzero(lengths > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(data[self.start[i] : self.end[i]], digest_size=8).digest(), "little")
        return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    done, acc, power = 0, np.zeros(n, dtype=U64), 1
    block, length, factor = hashes, 1, int(_GRAM)
    while True:
        if k & length:
            acc = acc * U64(factor) + block[done : done + n]
            done += length
        if done == k:
            return mix(acc + U64(k))
        block = block[: len(block) - length] * U64(factor) + block[length:]
        factor = factor * factor & ((1 << 64) - 1)
        length *= 2


def least_grams(words: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each gram, the least of the window at each position; where none starts, anything)."""
    g, n = grams(words.hash, gram), len(words.hash) - window + 1
    least = g[: max(n, 0)].copy()
    for j in range(1, window - gram + 1):
        np.minimum(least, g[j : j + len(least)], out=least)
    return g, least


def winnowed(words: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each gram, whether it is the least of a window within one text)."""
    g, least = least_grams(words, gram, window)
    keep, n = np.zeros(len(g), dtype=bool), len(least)
    inside = window_mask(words.bounds, len(words.hash), window)[:n]
    for j in range(window - gram + 1 if n else 0):
        keep[j : j + n] |= inside & (g[j : j + n] == least)
    return g, keep


def window_mask(bounds: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the n word positions start k words of one text."""
    ok = np.zeros(n + 1, dtype=np.int32)
    lo, hi = bounds[:-1], bounds[1:] - (k - 1)
    some = hi > lo
    np.add.at(ok, lo[some], 1)
    np.add.at(ok, hi[some], -1)
    return np.cumsum(ok[:n]) > 0


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
