"""The registered queries, with all their columns, against brute force on the smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from sparkloom.llm import queries as Q
from tests.llm.test_operators import SF, base_spans, contamination, groups, removal, sha


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_op1(spark):
    folder = SF.replace("0.001", "0.01")
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in Q.op1_secret_scan(spark, folder).collect()}
    assert len(got) == len(texts) and sum(r.n_literal for r in got.values()) > 0
    for i, t in texts:
        spans, r = base_spans(t), got[i]
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*[sum(k == x for _, _, k in spans) for x in ("assign", "access", "hex")], sha(joined))
        listed = [x.split(":") for x in r.spans.split(",") if x]
        assert [x for x in listed if x[0] != "literal"] == [[k, str(s), str(e)] for s, e, k in spans]
        assert [int(x[1]) for x in listed] == sorted(int(x[1]) for x in listed)


def test_op2(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    rows = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    got = Q.op2_url_filter(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", rows[r.page_id] or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = max(((len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
        assert (r.host, r.path, r.rule) == (host, path, fit[2] if fit else None)
        assert r.verdict == (fit[1] if fit else "block" if r.block_logit >= 0 else "allow")


def test_op4(spark, texts):
    got = {r.doc_id: r for r in Q.op4_compression_toxicity(spark, SF).collect()}
    assert set(got) == {i for i, _ in texts}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())


def test_op5(spark, texts):
    want = contamination(texts, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in Q.op5_winnowing(spark, SF).collect()}
    assert got == {d: (n, hit, len(items), sha(",".join(sorted(map(str, items)))), hit > 0) for d, ((n, hit, items),) in want.items()}


def test_op6(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in Q.op6_minhash_near_dedup(spark, SF).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in groups(texts).items()}


def test_op8_recall(spark):
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    got = {}
    for r in Q.op8_learned_partitions(spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    asked, found = [i for i in ids if i % 20 == 0], 0
    for q in asked:
        scores = x @ rows[q]
        scores[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[: min(20, len(ids) - 1)]]
        found += len({v for v, _ in got[q].values()} & set(best.tolist())) / len(best)
        assert all(abs(s - float(rows[v] @ rows[q])) < 1e-9 for v, s in got[q].values())
    assert set(got) == set(asked) and found / len(asked) >= 0.9


def test_op9(spark, texts):
    import public_tokenizers as P
    import tiktoken

    from sparkloom.llm.bpe import load_ranks

    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op9_byte_bpe(spark, SF).collect()}
    ids = {i: reference.encode_ordinary(t or "") for i, t in texts}
    assert got == {i: (len(ids[i]), sha(" ".join(map(str, ids[i]))), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts}


def test_op10(spark, texts):
    assert sorted(tuple(r) for r in Q.op10_debruijn_substrings(spark, SF).collect()) == removal(texts)
