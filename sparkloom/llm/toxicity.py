"""Toxicity by compression distance.

zstandard trains two dictionaries on labelled text, over a common base that it
trains on windows of ordinary text: one on toxic text, one on as much ordinary
text. Toxic texts are ordinary for the most part, and a dictionary of whole toxic
windows holds mostly that; so the samples of the toxic dictionary are the words
of toxic texts that hold character grams bound to the class by a G-test, and
those of the other are ordinary words. A text is cut into short windows at
spaces, each window is compressed under either dictionary, and the difference of
the two lengths is the window's evidence. Thresholds on the differences, the
rates at which ordinary windows pass them, and a logistic model over a text's
windows are calibrated on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded_batches
from .wordhash import FOLDED_WORDS, text_slices

_FOLD = bytes(FOLDED_WORDS.fold)
THRESHOLDS = (2, 3, 4, 5)
#: Limits of the labelled sample: rows by class, and bytes of all texts.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 2500, 4500, 40_000_000
#: Sizes of the common base and, at most, of what a class adds to it.
BASE_BYTES, CLASS_BYTES = 32_000, 64_000


def windows(text: bytes, size: int) -> list[bytes]:
    """Runs of about size bytes that end at a space; all of the text."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = at + size
        if end < n:
            end = text.find(b" ", end, end + size)
            end = at + 2 * size if end < 0 else end
        out.append(text[at:end])
        at = end
    return out


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    window: int = 40
    level: int = 3
    weights: list[float] = field(default_factory=list)
    centre: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    rates: list[float] = field(default_factory=list)

    def compressors(self):
        make = lambda d: zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        return make(self.toxic).compress, make(self.ordinary).compress

    def differences(self, text: bytes, toxic, ordinary) -> np.ndarray:
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text, self.window)], dtype=np.int32)

    def features(self, diff: np.ndarray) -> list[float]:
        n = len(diff)
        top = np.sort(diff)[-3:][::-1] if n else np.zeros(0)
        top = np.concatenate((top, np.zeros(3 - len(top))))
        out = [float(top[0]), float(top[1]), float(top[2]), float(diff.mean()) if n else 0.0, float(np.clip(diff - 2.5, 0, None).sum() / max(1, n) ** 0.5)]
        for t, rate in zip(THRESHOLDS, self.rates or [0.01] * len(THRESHOLDS), strict=True):
            k = int((diff >= t).sum())
            out += [(k - rate * n) / (rate * n + 1) ** 0.5, float(np.log1p(max(0.0, k - rate * n)))]
        return out

    def score(self, diffs: list[np.ndarray]) -> np.ndarray:
        x = (np.array([self.features(d) for d in diffs]).reshape(len(diffs), -1) - self.centre) / self.spread
        z = np.clip(x, -8, 8) @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _grams_of(word: str) -> set[str]:
    word = " " + word
    return {word[i : i + m] for m in (5, 6, 7, 8) for i in range(len(word) - m + 1)}


def _word_counts(texts: list[str]) -> Counter:
    out: Counter = Counter()
    for t in texts:
        out.update(set(re.findall(r"\S+", t)))
    return out


def _bound_grams(of_toxic: Counter, of_ordinary: Counter, documents: int) -> tuple[list[str], float]:
    """Character grams bound to the toxic class by a G-test, the strongest first."""
    seen: Counter = Counter()
    for w, n in of_toxic.items():
        for g in _grams_of(w):
            seen[g] += n
    seen = Counter({g: n for g, n in seen.items() if n >= max(5, documents // 150)})
    other: Counter = Counter()
    for w, n in of_ordinary.items():
        for g in _grams_of(w):
            if g in seen:
                other[g] += n
    share = sum(of_toxic.values()) / max(1, sum(of_toxic.values()) + sum(of_ordinary.values()))
    ranked = []
    for g, v in seen.items():
        w = other[g]
        if v * (1 - share) > 3 * w * share:
            ranked.append((2 * (v * np.log(v / ((v + w) * share)) + w * np.log(max(w, 0.5) / ((v + w) * (1 - share)))), g))
    chosen: list[str] = []
    for z, g in sorted(ranked, key=lambda x: (-x[0], x[1])):
        if z < 12:
            break
        if not any(g in h or h in g for h in chosen):
            chosen.append(g)
    return chosen, share


def _marking_words(of_toxic: Counter, of_ordinary: Counter, grams: list[str], share: float) -> list[str]:
    """Words, commonest first, that hold one of the grams and are all but absent elsewhere."""
    marked = [w for w, _ in sorted(of_toxic.items(), key=lambda x: (-x[1], x[0])) if any(g in " " + w for g in grams)]
    return [w for w in marked if 10 * of_ordinary[w] * share <= of_toxic[w] * (1 - share)]


def _trained(samples: list[bytes], size: int, segment: int = 16, gram: int = 6) -> bytes:
    """A dictionary that zstandard trains; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=gram).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _rank_quality(score: np.ndarray, label: np.ndarray) -> float:
    """Area under the ROC curve."""
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    p = label.sum()
    return float((ranks[label == 1].sum() - p * (p + 1) / 2) / max(1, p * (len(label) - p)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w, pen = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pen[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (y - p) - pen * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _model(words: list[str], common: list[str], base: bytes) -> ToxicityModel:
    def samples(of: list[str], most: int) -> list[bytes]:
        out, size = [], 0
        for w in of:
            out.append(f" {w} ".encode())
            size += len(out[-1])
            if size >= most:
                break
        return out

    taken = set(words)
    toxic = samples(words, CLASS_BYTES)
    size = sum(map(len, toxic))
    ordinary = samples([w for w in common if w not in taken], size)
    return ToxicityModel(base + _trained(toxic, max(size, 256)), base + _trained(ordinary, max(size, 256)))


def fit(rows: list[tuple[str, int]], prior: float | None = None, base_bytes: int = BASE_BYTES, gram_counts: tuple[int, ...] = (16, 32, 64, 128, 256)) -> ToxicityModel:
    """rows: (text, label), in an order that doesn't depend on the label. Two
    thirds of each class make the dictionaries, one third calibrates: how many
    grams mark toxic words, the rates, and the logistic model. prior is the share
    of toxic labels where rows hold another one. Whole texts are read."""
    fold = lambda t: (t or "").encode().translate(_FOLD)
    bad = [fold(t) for t, y in rows if y == 1]
    good = [fold(t) for t, y in rows if y == 0]
    cut_b, cut_g = -(-len(bad) * 2 // 3), -(-len(good) * 2 // 3)
    of_toxic, of_ordinary = _word_counts([t.decode() for t in bad[:cut_b]]), _word_counts([t.decode() for t in good[:cut_g]])
    grams, share = _bound_grams(of_toxic, of_ordinary, cut_b)
    base = _trained([w for t in good[:cut_g] for w in windows(t, 40)], base_bytes, 48, 8)
    common = sorted((w for w in of_ordinary if len(w) > 3), key=lambda w: (-of_ordinary[w].bit_length(), zlib.crc32(w.encode())))
    held = [(t, 1) for t in bad[cut_b:]] + [(t, 0) for t in good[cut_g:]]
    y = np.array([y for _, y in held], dtype=float)
    width = 5 + 2 * len(THRESHOLDS)
    if not 0 < y.sum() < len(y):
        model = _model(_marking_words(of_toxic, of_ordinary, grams[: gram_counts[0]], share), common, base)
        # Nothing tells the classes apart: no text is called toxic.
        model.centre, model.spread, model.weights = [0.0] * width, [1.0] * width, [-40.0] + [0.0] * width
        return model
    best = None
    trial = [i for i in range(len(held)) if y[i] or i % 3 == 0]
    for n in gram_counts:
        model = _model(_marking_words(of_toxic, of_ordinary, grams[:n], share), common, base)
        pair = model.compressors()
        diffs = [model.differences(held[i][0], *pair) for i in trial]
        quality = _rank_quality(np.array([np.clip(d - 2.5, 0, None).sum() / max(1, len(d)) ** 0.5 if len(d) else 0.0 for d in diffs]), y[trial])
        if best is None or quality > best[0]:
            best = (quality, model)
        if n >= len(grams):
            break
    model = best[1]
    pair = model.compressors()
    diffs = [model.differences(t, *pair) for t, _ in held]
    plain = np.concatenate([d for d, label in zip(diffs, y, strict=True) if not label])
    model.rates = [float(max((plain >= t).mean(), 1e-5)) if len(plain) else 0.01 for t in THRESHOLDS]
    x = np.array([model.features(d) for d in diffs]).reshape(len(held), width)
    model.centre, model.spread = x.mean(axis=0).tolist(), (x.std(axis=0) + 1e-6).tolist()
    model.weights = _logistic(np.clip((x - model.centre) / model.spread, -8, 8), y).tolist()
    if prior is not None and 0 < prior < 1:
        model.weights[0] += float(np.log(prior / (1 - prior)) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def _scorer(payload):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = payload.value
        pair = model.compressors()
        for texts in columns:
            scores = []
            for _, _, data, offsets in text_slices(texts):
                text = data.tobytes().translate(_FOLD)
                scores.append(model.score([model.differences(text[a:b], *pair) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]))
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    return F.arrow_udf(run, "double").asNondeterministic()


def labelled_sample(
    docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", toxic: int = SAMPLE_TOXIC, ordinary: int = SAMPLE_ORDINARY, most_bytes: int = SAMPLE_BYTES
) -> tuple[list[tuple[str, int]], float | None]:
    """The texts and labels of at most so many labelled rows of either class,
    and of so many bytes, chosen by a hash of the id, without rows whose
    crc32(doc_id as text) mod 4 is 2; and the share of toxic labels among all
    such rows. An id with labels of both kinds has none; of repeated documents
    of one id the longest counts, as one. Rows with a null id or label are left
    out; either table may be empty."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))
    one = usable.groupBy("doc_id").agg(F.max(label_col).alias("y"), F.min(label_col).alias("z")).where("y = z").select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    sizes = {r.y: r["count"] for r in one.groupBy("y").count().collect()}
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else None
    picked = []
    for y, n in ((1, toxic), (0, ordinary)):
        picked += [(r.doc_id, y) for r in one.where(F.col("y") == y).orderBy("h", "doc_id").limit(n).collect()]
    if not picked:
        return [], prior
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = [F.octet_length("text").alias("size"), F.xxhash64("text").alias("mark")]

    def among(rows):
        return texts.join(F.broadcast(spark.createDataFrame(rows, "doc_id long, y int")), "doc_id")

    best: dict[int, tuple] = {}
    for r in among(picked).select("doc_id", "y", *key).distinct().collect():
        best[r.doc_id] = max(best.get(r.doc_id, (-1, 0, 0)), (r.size, r.mark, r.y))
    order = sorted(best, key=lambda i: (zlib.crc32(b"order" + str(i).encode()), i))
    chosen, left = {}, most_bytes
    for i in order:
        if best[i][0] <= left:
            left -= best[i][0]
            chosen[i] = best[i]
    found = {}
    for r in among([(i, b[2]) for i, b in chosen.items()] or [(None, 0)]).select("doc_id", "y", *key, "text").distinct().collect():
        if (r.size, r.mark, r.y) == chosen[r.doc_id]:
            found[r.doc_id] = (r.text, r.y)
    return [found[i] for i in order if i in found], prior


def toxicity_scores(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """Adds toxicity (0 to 1) to every row of docs.

    Whole texts count, window by window, however long. A null counts as an empty
    text, which has no window and gets the score of no evidence. Repeated rows
    get equal scores. A column of docs named toxicity is replaced, no other name
    matters. An empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    base = docs.drop("toxicity")
    payload = spark.sparkContext.broadcast(model)
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    return base.select(*[quoted(c) for c in base.columns], _scorer(payload)(quoted(text_col).cast("string")).alias("toxicity"))
