"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts makes each document's set of distinct word shingles,
   its size, a 128-bit fingerprint of the set and a MinHash signature.
   Documents with equal sets form a class; from here on only class
   representatives (smallest doc_id) are compared.
2. Bands of the signature give buckets. In each bucket the representative that
   shares most buckets overall is the pivot; every member is a candidate for it.
3. Candidates compare their signatures batch by batch. After each batch, the
   posterior of the similarity (uniform prior) tells how likely the threshold
   is reached; under the chosen miss probability the pair is dropped.
4. Survivors are verified on the full sets; components of the links follow.
5. Buckets whose members still lie in several components compare, in blocks, the
   members of different components, again by steps 3 and 4. So no pair that
   shares a bucket stays unjudged unless it is linked anyway, and never are all
   pairs of a group emitted: copies of one text hang on their pivot.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, bounded_batches
from .wordhash import FOLDED_WORDS, U64, Words, grams, mix, text_slices

HASHES = 256
BAND_ROWS = 6
BANDS = 25
#: Members of a bucket that one task compares at a time.
BLOCK = 2048


def prune_limits(threshold: float, miss: float, hashes: int = HASHES, step: int = 32) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on) after each batch: below it,
    P(similarity >= threshold | matches) under a uniform prior is under miss."""
    out = []
    for n in range(step, hashes + 1, step):
        total, least = 0.0, 0
        for m in range(n + 1):  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                least = m
                break
        out.append((n, least))
    return out


def _multipliers(n: int) -> np.ndarray:
    return (mix(np.arange(1, n + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words make one shingle."""
    all_grams = grams(words.hash, k)
    for lo, hi in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if hi - lo >= k:
            one = np.sort(all_grams[lo : hi - k + 1])
            yield one[np.concatenate(([True], one[1:] != one[:-1]))]
        elif hi > lo:
            yield grams(words.hash[lo:hi], int(hi - lo))
        else:
            yield np.zeros(0, dtype=U64)


def _fingerprint(one: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    return int(one.sum(dtype=U64).astype(np.int64)), int(mix(one ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64).astype(np.int64))


def _signatures(sets: list[np.ndarray], multipliers: np.ndarray) -> np.ndarray:
    flat = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    out, buffer = np.empty((len(multipliers), len(sets)), dtype=np.uint16), np.empty_like(flat)
    for j, m in enumerate(multipliers):
        np.multiply(flat, m, out=buffer)
        out[j] = (np.minimum.reduceat(buffer, at) * np.uint32(0x9E3779B1)) >> np.uint32(16)  # a minimum's own first bits are mostly zero
    return np.ascontiguousarray(out.T)


def _describe(k: int, hashes: int):
    def run(batches):
        multipliers = _multipliers(hashes)
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in text_slices(batch.column(1), 1 << 19):
                words = Words(data, offsets, FOLDED_WORDS)
                sets = list(shingle_sets(words, k))
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = [s for s in sets if len(s)]
                sigs = _signatures(full, multipliers) if full else np.zeros((0, hashes), np.uint16)
                one, two, sig, at = [], [], [], 0
                for s in sets:
                    if len(s):
                        x, y = _fingerprint(s)
                        one.append(x), two.append(y), sig.append(sigs[at].tobytes())
                        at += 1
                    else:
                        one.append(None), two.append(None), sig.append(None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(sizes), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary())],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "sig"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def _band_keys(sig: np.ndarray, band: int, rows: int) -> np.ndarray:
    """Bucket of each signature; its low 5 bits are the band."""
    acc = np.full(len(sig), band + 1, dtype=U64)
    for j in range(band * rows, (band + 1) * rows):
        acc = mix(acc * U64(0x9E3779B97F4A7C15) + sig[:, j].astype(U64))
    return (acc << U64(5) | U64(band)).astype(np.int64)


def _bands(bands: int, band_rows: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sig = _matrix(batch.column(1))
                for band in range(bands):
                    yield pa.RecordBatch.from_arrays([pa.array(_band_keys(sig, band, band_rows)), batch.column(0)], names=["bucket", "rep"])

    return run


def _still_possible(one: np.ndarray, two: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the row pairs that no batch has ruled out."""
    left, matches, before = np.arange(len(one)), np.zeros(len(one), dtype=np.int32), 0
    for n, least in limits:
        matches = matches + (one[left, before:n] == two[left, before:n]).sum(axis=1, dtype=np.int32)
        go = matches >= least
        left, matches, before = left[go], matches[go], n
    return left


def _judge_pairs(limits):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                kept = _still_possible(_matrix(batch.column(2)), _matrix(batch.column(3)), limits)
                yield batch.select([0, 1]).take(pa.array(kept))

    return run


def _judge_blocks(limits, farthest: float, band_rows: int):
    """Rows of (bucket, tile, ...) stand together; compares members of different
    components. A pair that shares an earlier band is left to that bucket. Where
    the exact distances of both to the pivot are known, the triangle inequality
    rules out pairs that must lie farther apart than a link allows."""

    def pairs(bucket, rows):
        ids = np.concatenate([r[0] for r in rows])
        comp = np.concatenate([r[1] for r in rows])
        side = np.concatenate([r[2] for r in rows])
        sig = np.concatenate([r[3] for r in rows])
        far = np.concatenate([r[4] for r in rows])
        earlier = [_band_keys(sig, band, band_rows) for band in range(bucket & 31)]
        out_a, out_b = [], []
        for i in range(len(ids)):
            others = np.flatnonzero(~(np.abs(far - far[i]) > farthest + 1e-9) & (comp != comp[i]) & ((ids > ids[i]) if (side == 0).all() else ((side == 1) & (side[i] == 0))))
            for lo in range(0, len(others), 4096):
                part = others[lo : lo + 4096]
                left, matches, before = part, np.zeros(len(part), np.int32), 0
                for n, least in limits:
                    matches = matches + (sig[left, before:n] == sig[i, before:n]).sum(axis=1, dtype=np.int32)
                    go = matches >= least
                    left, matches, before = left[go], matches[go], n
                    if not len(left):
                        break
                for keys in earlier:
                    left = left[keys[left] != keys[i]]
                out_a.append(np.minimum(ids[i], ids[left]))
                out_b.append(np.maximum(ids[i], ids[left]))
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, tile = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])) + 1
            ids, comp, side, sig = np.asarray(batch.column(2)), np.asarray(batch.column(3)), np.asarray(batch.column(4)), _matrix(batch.column(5))
            far = batch.column(6).to_numpy(zero_copy_only=False).astype(np.float64)  # unknown: NaN, which rules nothing out
            for lo, hi in zip([0, *change], [*change, len(bucket)], strict=True):
                key = (int(bucket[lo]), int(tile[lo]))
                if key != now:
                    if len(rows):
                        yield from pairs(now[0], rows)
                    now, rows = key, []
                rows.append((ids[lo:hi], comp[lo:hi], side[lo:hi], sig[lo:hi], far[lo:hi]))
        if rows:
            yield from pairs(now[0], rows)

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                sets = list(shingle_sets(Words(data, offsets, FOLDED_WORDS), k))
                prints = [_fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in prints], pa.int64()), pa.array([y for _, y in prints], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["rep", "n_shingles", "fp1", "fp2", "shingles"],
                )

    return run


def _exact(numerator: int, denominator: int):
    def run(batches):
        for batch in batches:
            linked, distance = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both = np.concatenate((np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(denominator * shared >= numerator * (len(both) - shared))
                distance.append(1 - shared / (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(distance, pa.float64())], names=["a", "b", "linked", "distance"])

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    similarity: tuple[int, int] = (85, 100),
    miss: float = 1e-5,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each distinct id.

    Links documents whose sets of distinct shingles (A-Z lower-cased, words are
    runs without ASCII white space) have intersection * 100 >= 85 * union, or
    what similarity says;
    component_id is the smallest linked id. A null or wordless text has no
    shingles and is linked with nothing; with fewer words than shingle_words,
    all of them are the one shingle. Repeated rows of one id count once, with
    the text of the largest set (then the largest fingerprint). Rows with a null id are left out. Other columns
    are ignored. An empty table gives an empty result.

    With 25 bands of 6 rows a pair at exactly 0.85 escapes all buckets once in
    about 140,000; miss bounds the loss by the sequential test at each batch.
    Another similarity wants bands of its own: 30 of 5 rows at 0.8 lose one in
    150,000. A bucket's key has room for 32 bands.
    """
    if not (0 < bands <= 32 and 0 < bands * band_rows <= HASHES):
        raise ValueError(f"{bands} bands of {band_rows} rows don't fit {HASHES} hashes and 32 bands")
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "neardup")
    limits = prune_limits(similarity[0] / similarity[1], miss)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")

    described = source.mapInArrow(_describe(shingle_words, HASHES), "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary")
    described = scratch.keep(described, "described")
    per_doc = described.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "fp1", "fp2")).alias("d")).select("doc_id", "d.*")
    classes = per_doc.where("n_shingles > 0").groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("rep"))
    classes = scratch.keep(classes, "classes")
    own = ["doc_id", "n_shingles", "fp1", "fp2"]
    sigs = described.join(classes.withColumnRenamed("rep", "doc_id"), own, "left_semi").select(F.col("doc_id").alias("rep"), "sig").dropDuplicates(["rep"])
    sigs = scratch.keep(sigs, "sigs")

    buckets = sigs.select("rep", "sig").mapInArrow(_bands(bands, band_rows), "bucket long, rep long")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = scratch.keep(buckets.join(sizes, "bucket"), "shared")
    crowd = shared.groupBy("rep").agg(F.sum("members").alias("crowd"))
    shared_by_crowd = shared.join(crowd, "rep")
    pivots = shared_by_crowd.groupBy("bucket").agg(F.max(F.struct("crowd", (-F.col("rep")).alias("neg"))).alias("top")).select("bucket", (-F.col("top.neg")).alias("pivot"))
    pivots = scratch.keep(pivots, "pivots")
    stars = shared.join(pivots, "bucket").where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()

    def with_sigs(pairs: DataFrame) -> DataFrame:
        one, two = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b")

    candidates = scratch.keep(with_sigs(stars).mapInArrow(_judge_pairs(limits), "a long, b long"), "stars")

    wanted = crowd.select(F.col("rep").alias("doc_id"))
    sets = source.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(shingle_words), "rep long, n_shingles long, fp1 long, fp2 long, shingles binary")
    sets = sets.join(classes, ["rep", "n_shingles", "fp1", "fp2"], "left_semi").select("rep", "shingles").dropDuplicates(["rep"])
    sets = scratch.keep(sets, "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        one, two = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
        return scratch.keep(pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(_exact(*similarity), "a long, b long, linked boolean, distance double"), name)

    judged = verified(candidates, "judged-1")
    labels = connected_components(judged.where("linked"), scratch, "cc1")

    # Buckets that still hold several components.
    member = shared.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("comp"))
    open_buckets = member.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("bucket", "members")
    member = member.join(open_buckets, "bucket").join(pivots, "bucket")
    ends = [F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")]
    member = member.select("bucket", "rep", "comp", "members", "pivot", *ends).join(judged.select("a", "b", "distance"), ["a", "b"], "left")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    at = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = member.withColumn("blocks", blocks).withColumn("at", at).withColumn("far", F.when(F.col("rep") == F.col("pivot"), 0.0).otherwise(F.col("distance")))
    # Tile (i, j), i <= j, compares block i with block j; a member of block i stands on side 0 of the tiles (i, *) and side 1 of (*, i).
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket",
        (F.least("at", "other") * F.col("blocks") + F.greatest("at", "other")).alias("tile"),
        "rep",
        "comp",
        F.when(F.col("at") > F.col("other"), 1).otherwise(0).alias("side"),
        "far",
    )
    tiled = spread.join(sigs, "rep").select("bucket", "tile", "rep", "comp", "side", "sig", "far")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiled = tiled.repartition(tasks, "bucket", "tile").sortWithinPartitions("bucket", "tile")
    late = tiled.mapInArrow(_judge_blocks(limits, 1 - similarity[0] / similarity[1], band_rows), "a long, b long").distinct().join(candidates, ["a", "b"], "left_anti")
    more = verified(late, "judged-2").where("linked")
    # Both rounds' links, between components of the first.
    first = labels.select(F.col("node").alias("x"), "component")
    joined = more.join(first.withColumnRenamed("x", "a").withColumnRenamed("component", "ca"), "a", "left").join(first.withColumnRenamed("x", "b").withColumnRenamed("component", "cb"), "b", "left")
    between = joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
    upper = connected_components(between, scratch, "cc2")
    final = (
        labels.select("node", "component")
        .union(upper.join(labels, "node", "left_anti").select("node", "component"))
        .join(upper.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
        .select(F.col("node").alias("rep"), F.coalesce("root", "component").alias("root"))
    )
    return (
        per_doc.join(classes, ["n_shingles", "fp1", "fp2"], "left")
        .join(final, "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
