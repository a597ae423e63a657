"""The pipeline against a brute-force version of its stages, on the smallest table."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F
from sparkloom.llm.toxicity import fit, labelled_sample, toxicity_scores
from tests.llm.test_operators import SF, SPACE, base_spans, contamination, documents, edited, lowered


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    model = fit(*labelled_sample(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    clean = [(r.doc_id, r.text) for r in toxicity_scores(docs, model).where("toxicity < 0.3").collect()]
    smallest, _ = smallest_linked(clean, 80)
    single = [(d, t) for d, t in clean if d in smallest]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = contamination(single, items)
    left = {d: t for d, t in single if hits[d][0][1] == 0}
    assert set(got) == set(left) and all(r.round_trip for r in got.values())
    assert all((r.n_chars == len(left[d])) or base_spans(left[d]) for d, r in got.items())


def test_stage_columns_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (None, "text without id", "en", "s", 15), (2, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("ids", F.lit(1))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns and now.count() == 3, name
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == 3


def smallest_linked(rows, percent, k=5):
    sets = {}
    for d, t in rows:
        w = re.findall(SPACE, lowered(t))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root, between = {d: d for d in sets}, set()
    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and sets[b]:
                shared, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if 100 * shared >= percent * union:
                    lo, hi = sorted((root[a], root[b]))
                    root = {d: lo if r == hi else r for d, r in root.items()}
                    between |= {(a, b)} if 100 * shared < 85 * union else set()
    return {d for d in sets if root[d] == d}, between


def test_near_duplicates_from_four_fifths(spark):
    rng = random.Random(8)
    extra = []
    for source in range(20):
        words = [f"s{source}x{rng.randrange(500)}" for _ in range(200)]
        extra += [(9000 + 10 * source + i, edited(rng, words, share)) for i, share in enumerate([0, 0.015, 0.02, 0.025])]
    rows, docs = documents(spark, extra)
    want, between = smallest_linked(rows, 80)
    assert len(between) >= 10
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == want
    assert (1 - 0.8**corpus_pipeline.BAND_ROWS) ** corpus_pipeline.BANDS < 1e-5
