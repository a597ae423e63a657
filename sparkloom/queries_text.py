"""Registered text, retrieval, evaluation and plan queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import cleaning as C
from .functions import text as X
from .operators import evaluation as E
from .operators import retrieval as I
from .plans import data_plan as P
from .registry import query
from .sources.tables import table
from .streaming.state import chunks

#: Forms of the texts of parsing queries: each row of part takes one, with its own number for {n}.
PRICES = ["¥1,299.00-1,599.00", "¥{n}.50", "{n}-9", "0", "面议", "88", "199.999", "-5"]
RATINGS = ["97", "4.6", "-1", "150", "abc", "3.25"]
COUNTS = ["3万+", "{n}万+", "{n}条", "1.2万+", "1,024", "none", "77"]
ASKS = ["{n}元以内的耳机", "{n}-{n}0元手机", "预算 {n} 元", "{n}元以上", "under ${n} cable", "500元以内的耳机", "1000-2000元手机", "2000元以上", "under $30 cable", "ABOVE $99", "4.5分以上的耳机", "shoes above 4.2", "随便看看", "预算 300 元", "控制在800元"]
ANSWERS = [
    "# 推荐\n\n1. **耳机 A** 价格：¥299，评分：4.8\n2. 耳机 B 399元\n共 3 款", "好的。", "价格：¥1299 评分：4.5 " + "很好用" * 20, "- 订单编号 ORD123 已发货\n\n- 预计 2 天\n\n" + "请耐心等待" * 10,
    "| a | b | c |\n\n价格：¥99 " + "说明" * 30,
]


def forms(spark, d, values):
    """A text for every part: the form of its number, {n} in it replaced by that number."""
    key = F.col("p_partkey")
    form = F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))
    return table(spark, d, "part").select(key.alias("id"), F.replace(form, F.lit("{n}"), key.cast("string")).alias("text"))


def forms_sql(values):
    quoted = lambda v: "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"t AS (SELECT p_partkey AS id, replace([{', '.join(map(quoted, values))}][p_partkey % {len(values)} + 1], '{{n}}', CAST(p_partkey AS VARCHAR)) AS text FROM part)"


@query("num_clean_price", f"WITH {forms_sql(PRICES)}, p AS (SELECT id, try_cast(nullif(regexp_replace(string_split(text, '-')[1], '[^0-9.]', '', 'g'), '') AS DOUBLE) AS x FROM t) SELECT id, CASE WHEN x > 0 THEN round(x, 2) END AS price FROM p")
def clean_price(spark, d):
    return forms(spark, d, PRICES).select("id", X.clean_price("text").alias("price"))


@query("num_clean_rating", f"WITH {forms_sql(RATINGS)}, p AS (SELECT id, try_cast(text AS DOUBLE) AS r FROM t) SELECT id, CASE WHEN r > 100 THEN NULL WHEN r > 5 THEN round(r / 100 * 5, 1) WHEN r >= 0 THEN round(r, 1) END AS rating FROM p")
def clean_rating(spark, d):
    return forms(spark, d, RATINGS).select("id", X.clean_rating("text").alias("rating"))


@query("num_clean_count", f"WITH {forms_sql(COUNTS)} SELECT id, try_cast(nullif(regexp_replace(replace(text, '万', '0000'), '[^0-9]', '', 'g'), '') AS BIGINT) AS n FROM t")
def clean_count(spark, d):
    return forms(spark, d, COUNTS).select("id", X.clean_count("text").alias("n"))


@query(
    "num_confidence",
    """SELECT event_id, CAST(least(99, greatest(35, round_even((CASE WHEN value / 20 - 1 BETWEEN 0 AND 1 THEN value / 20 - 1 ELSE 1 / (1 + exp(-(value / 20 - 1) / 5)) END * 0.6 + least(1.0, greatest(0.0, (value / 30) / 5)) * 0.4) * 100, 0))) AS INTEGER) AS confidence FROM events""",
)
def confidence(spark, d):
    return table(spark, d, "events").select("event_id", X.confidence(F.col("value") / 20 - 1, F.col("value") / 30).alias("confidence"))


@query(
    "par_price_range",
    rf"""WITH {forms_sql(ASKS)} SELECT id,
    CASE WHEN regexp_matches(text, '(\d+\.?\d*)\s*元?\s*以[内下]') THEN NULL WHEN regexp_matches(text, '(\d+\.?\d*)\s*元?\s*以上') THEN try_cast(regexp_extract(text, '(\d+\.?\d*)\s*元?\s*以上', 1) AS DOUBLE)
         WHEN regexp_matches(text, '(\d+\.?\d*)\s*[-~到]\s*(\d+\.?\d*)') THEN try_cast(regexp_extract(text, '(\d+\.?\d*)\s*[-~到]\s*(\d+\.?\d*)', 1) AS DOUBLE) WHEN regexp_matches(text, '(?i)under\s+\$?(\d+)') THEN NULL
         WHEN regexp_matches(text, '(?i)above\s+\$?(\d+)') THEN try_cast(regexp_extract(text, '(?i)above\s+\$?(\d+\.?\d*)', 1) AS DOUBLE) END AS low,
    CASE WHEN regexp_matches(text, '(\d+\.?\d*)\s*元?\s*以[内下]') THEN try_cast(regexp_extract(text, '(\d+\.?\d*)\s*元?\s*以[内下]', 1) AS DOUBLE) WHEN regexp_matches(text, '(\d+\.?\d*)\s*元?\s*以上') THEN NULL
         WHEN regexp_matches(text, '(\d+\.?\d*)\s*[-~到]\s*(\d+\.?\d*)') THEN try_cast(regexp_extract(text, '(\d+\.?\d*)\s*[-~到]\s*(\d+\.?\d*)', 2) AS DOUBLE) WHEN regexp_matches(text, '(?i)under\s+\$?(\d+)') THEN try_cast(regexp_extract(text, '(?i)under\s+\$?(\d+\.?\d*)', 1) AS DOUBLE) END AS high FROM t""",
)
def price_range(spark, d):
    return forms(spark, d, ASKS).select("id", X.price_range("text").alias("r")).select("id", "r.low", "r.high")


@query(
    "par_rating_filter",
    rf"""WITH {forms_sql(ASKS)} SELECT id, try_cast(coalesce(nullif(regexp_extract(text, '(\d\.?\d?)\s*[分星]以上', 1), ''), nullif(regexp_extract(lower(text), 'above\s+(\d\.?\d?)', 1), '')) AS DOUBLE) AS floor FROM t""",
)
def rating_filter(spark, d):
    return forms(spark, d, ASKS).select("id", X.rating_floor("text").alias("floor"))


@query(
    "par_budget_limit",
    rf"""WITH {forms_sql(ASKS)} SELECT id, try_cast(coalesce(nullif(regexp_extract(text, '预算\s*(\d+(?:\.\d+)?)\s*元', 1), ''), nullif(regexp_extract(text, '(\d+(?:\.\d+)?)\s*元以内', 1), ''), nullif(regexp_extract(text, '控制在\s*(\d+(?:\.\d+)?)\s*元', 1), '')) AS DOUBLE) AS budget FROM t""",
)
def budget_limit(spark, d):
    return forms(spark, d, ASKS).select("id", X.budget_limit("text").alias("budget"))


@query("str_clean_text", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.clean_text("text"), 256).alias("cleaned"))


@query("str_keywords", r"SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}a-z0-9]+'), lambda x: length(x) >= 2)[1:6], ' ') AS keywords FROM benchmark")
def keywords(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.query_keywords("text"), " ").alias("keywords"))


_TOKENS = r"list_filter(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]|[\p{Latin}\p{N}ªº]+'), lambda x: length(x) > 1 OR regexp_matches(x, '[\x{4e00}-\x{9fff}]'))"


@query("ir_tokenize", f"SELECT doc_id, array_to_string({_TOKENS}, ' ') AS tokens FROM documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.tokens("text"), " ").alias("tokens"))


@query("ir_postings", f"WITH e AS (SELECT doc_id AS id, unnest({_TOKENS}) AS token, len({_TOKENS}) AS length FROM documents) SELECT id, token, count(*) AS tf, min(length) AS length FROM e GROUP BY id, token")
def postings(spark, d):
    return I.postings(table(spark, d, "documents"))


_BM25 = f"""
docs AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents), e AS (SELECT id, unnest(t) AS token, len(t) AS length FROM docs),
p AS (SELECT id, token, count(*) AS tf, min(length) AS length FROM e GROUP BY id, token), z AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM docs),
f AS (SELECT token, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM p, z GROUP BY token, n), g AS (SELECT avg(raw) * 0.25 AS floor FROM f),
w AS (SELECT token, CASE WHEN raw < 0 THEN floor ELSE raw END AS idf FROM f, g),
q AS (SELECT qid, token, count(*) AS times FROM (SELECT item_id AS qid, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY qid, token),
s AS (SELECT qid, id AS doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM q JOIN w USING (token) JOIN p USING (token), z GROUP BY qid, id),
bm AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 20)"""


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _sparse(spark, d, k=20):
    return I.bm25(table(spark, d, "documents"), _questions(spark, d), k)


@query("ir_bm25_topk", f"WITH {_BM25} SELECT qid, doc_id, score, rank FROM bm")
def bm25_topk(spark, d):
    return _sparse(spark, d).select("qid", "doc_id", "score", "rank")


_DENSE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ds AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id, round(list_inner_product(v.e, q.e), 6) AS score FROM v, v q WHERE {asked} AND q.vec_id <> v.vec_id),
dn AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM ds QUALIFY rank <= 20)"""


#: Queries by vector: every hundredth one; in fusion each question has the vector of its number.
_EVERY, _QUESTIONS = _DENSE.format(asked="q.vec_id % 100 = 0"), _DENSE.format(asked="q.vec_id IN (SELECT item_id FROM benchmark)")


def _dense(spark, d, k=20, questions=True):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = vectors.join(_questions(spark, d).select(F.col("qid").alias("doc_id")), "doc_id", "left_semi") if questions else vectors.where("doc_id % 100 = 0")
    return I.dense(vectors, asked.select(F.col("doc_id").alias("qid"), F.col("embedding").alias("query")), k)


@query("ir_dense_topk", f"WITH {_EVERY} SELECT qid, doc_id, score, rank FROM dn")
def dense_topk(spark, d):
    return _dense(spark, d, questions=False).select("qid", "doc_id", "score", "rank")


@query("ir_cosine", "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-10), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(I.cosine("embedding", "other"), 5).alias("cosine"))


_FUSED = """un AS (SELECT qid, doc_id, rank, 0 AS list FROM bm UNION ALL SELECT qid, doc_id, rank, 1 FROM dn),
fs AS (SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS first FROM un GROUP BY qid, doc_id),
fu AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, doc_id) AS rank FROM fs QUALIFY rank <= 20)"""


@query("ir_rrf_fusion", f"WITH {_BM25}, {_QUESTIONS}, {_FUSED} SELECT qid, doc_id, round(score, 6) AS score, rank FROM fu")
def rrf_fusion(spark, d):
    return I.fused([_sparse(spark, d), _dense(spark, d)], 20).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "ir_mode_fallback",
    f"WITH {_BM25}, {_QUESTIONS}, {_FUSED} SELECT qid, 'hybrid' AS selected_mode, count(*) AS results FROM fu WHERE qid IN (SELECT qid FROM bm) AND qid IN (SELECT qid FROM dn) GROUP BY qid "
    "UNION ALL SELECT qid, 'bm25', count(*) FROM bm WHERE qid NOT IN (SELECT qid FROM dn) GROUP BY qid UNION ALL SELECT qid, 'dense', count(*) FROM dn WHERE qid NOT IN (SELECT qid FROM bm) GROUP BY qid",
)
def mode_fallback(spark, d):
    return I.with_mode("hybrid", _sparse(spark, d), _dense(spark, d), 20).groupBy("qid", "selected_mode").agg(F.count("*").alias("results"))


@query("ir_rerank_fallback", f"WITH {_BM25} SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 5")
def rerank_fallback(spark, d):
    return I.reranked(_sparse(spark, d), 5).select("qid", "doc_id", "rank")


_RELEVANT = "rel AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(
    "ir_rank_metrics",
    f"""WITH {_BM25}, {_RELEVANT}, ks(k) AS (VALUES (1), (3), (5), (10), (20)), n AS (SELECT qid, count(*) AS relevant FROM rel GROUP BY qid), h AS (SELECT bm.qid, rank FROM bm JOIN rel USING (qid, doc_id)),
    o AS (SELECT b.item_id AS qid, k, coalesce(any_value(relevant), 0) AS relevant, count(h.rank) AS found, min(h.rank) AS first, coalesce(sum(1 / log2(h.rank + 1)), 0) AS gain
          FROM benchmark b CROSS JOIN ks LEFT JOIN n ON n.qid = b.item_id LEFT JOIN h ON h.qid = b.item_id AND h.rank <= k GROUP BY 1, 2),
    sm AS (SELECT k, coalesce(1.0 / first, 0) AS rr, CASE WHEN relevant > 0 THEN found / relevant ELSE 0 END AS recall, found / k AS precision,
          CASE WHEN relevant > 0 THEN gain / list_sum(list_transform(range(1, least(k, relevant) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg FROM o)
    SELECT k, round(avg(rr), 6) AS mrr, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(ndcg), 6) AS ndcg FROM sm GROUP BY k""",
)
def rank_metrics(spark, d):
    asked = _questions(spark, d)
    relevant = I.containing(table(spark, d, "documents"), asked)
    return I.rank_metrics(_sparse(spark, d), relevant, asked, (1, 3, 5, 10, 20))


_QUALITY = r"""
WITH t AS (SELECT doc_id AS id, text FROM documents), f AS (SELECT id, text, length(text) AS n,
  (CASE WHEN regexp_matches(text, '(?m)^[\s]*[-\d*●•]') THEN 0.4 ELSE 0.0 END + CASE WHEN regexp_matches(text, '(?m)^#+\s|^\*\*.*\*\*') THEN 0.3 ELSE 0.0 END + CASE WHEN length(text) - length(replace(text, chr(10), '')) >= 2 THEN 0.3 ELSE 0.0 END) AS structure,
  (CASE WHEN regexp_matches(text, '[¥￥$]\s?\d+|[\d,]+\s?元') THEN 0.3 ELSE 0.0 END + CASE WHEN regexp_matches(text, '\d\.?\d?\s?[星分/]|评[分级]') THEN 0.25 ELSE 0.0 END
   + CASE WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]{2,}牌|[A-Z][a-zA-Z]+') THEN 0.25 ELSE 0.0 END + CASE WHEN len(regexp_extract_all(text, '\d+')) >= 3 THEN 0.2 ELSE 0.0 END) AS specificity FROM t),
g AS (SELECT *, CASE WHEN n < 50 THEN 0.2 WHEN n < 100 THEN 0.5 WHEN n < 300 THEN 0.8 ELSE 1.0 END AS completeness FROM f)
SELECT id, round(structure, 4)::DOUBLE AS structure, round(completeness, 4)::DOUBLE AS completeness, round(specificity, 4)::DOUBLE AS specificity, round(structure * 0.3 + completeness * 0.3 + specificity * 0.4, 4)::DOUBLE AS overall FROM g
"""


@query("gev_answer_quality", _QUALITY)
def answer_quality(spark, d):
    q = table(spark, d, "documents").select(F.col("doc_id").alias("id"), E.answer_quality("text").alias("q"))
    return q.select("id", *[F.round(F.col(f"q.{c}").cast("double"), 4).alias(c) for c in ("structure", "completeness", "specificity", "overall")])


_STRUCT_SQL = r"regexp_matches(text, '(?m)^\s*[-*]\s+') OR regexp_matches(text, '(?m)^\s*\d+[.)]\s+') OR regexp_matches(text, '\*\*[^*]+\*\*') OR regexp_matches(text, '\|.*\|.*\|') OR regexp_matches(text, '(?m)^#{1,4}\s+') OR contains(text, chr(10) || chr(10))"
_DATA_SQL = r"regexp_matches(text, '[$¥]\s*\d+') OR regexp_matches(text, '\d+(\.\d+)?\s*元') OR regexp_matches(text, '\d+(\.\d+)?\s*/\s*5') OR regexp_matches(text, '\d+\s*条评[价价]') OR regexp_matches(text, '评分[：:]\s*\d') OR contains(text, '订单编号') OR regexp_matches(text, 'ORD\d+')"
_REASON_SQL = f"CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50 THEN 'too_short' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 2000 THEN 'too_long' WHEN NOT ({_STRUCT_SQL}) THEN 'no_structure' WHEN NOT ({_DATA_SQL}) THEN 'no_data' END"


@query("qf_sft_reason", f"SELECT doc_id, {_REASON_SQL} AS reason FROM documents")
def sft_reason(spark, d):
    return table(spark, d, "documents").select("doc_id", E.sft_reason(F.lit(""), "text").alias("reason"))


@query("qf_report", f"WITH r AS (SELECT coalesce({_REASON_SQL}, 'passed') AS reason FROM documents) SELECT reason, count(*) AS samples, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM r GROUP BY reason")
def report(spark, d):
    return E.rejection_report(table(spark, d, "documents").select(E.sft_reason(F.lit(""), "text").alias("reason")))


@query("qf_dpo_reason", f"WITH {forms_sql(ANSWERS)} SELECT id, coalesce({_REASON_SQL}, CASE WHEN id % 2 = 1 THEN 'too_short' END) AS reason FROM t")
def dpo_reason(spark, d):
    rejected = F.when(F.col("id") % 2 == 1, "no").otherwise("a poor answer")
    return forms(spark, d, ANSWERS).select("id", E.dpo_reason(F.lit(""), "text", rejected, F.lit("format")).alias("reason"))


@query("cln_pipeline")
def clean_pipeline(spark, d):
    rows = [*ANSWERS, "先看 [1] 耳机 A，价格 299元\n[2] 耳机 B\n[2] 耳机 B\n\n\n推荐 [1] 耳", "很好。很好。很好用！以上为本次推荐结果。后面的话", "答案 spep user\nx", "[链接](https://a.example/b) 🧐\n***\nuser\n泄露"]
    return forms(spark, d, rows).select("id", C.clean_answer("text").alias("cleaned"), C.clean_exported("text").alias("exported"))


@query("cln_markers", f"WITH {forms_sql(['前 spep 后', '文本 rumpe', '没有', '如需了解 更多', 'x +lsi y'])} SELECT id, CASE WHEN instr(text, 'spep') > 0 THEN rtrim(left(text, instr(text, 'spep') - 1)) WHEN instr(text, 'rumpe') > 0 THEN rtrim(left(text, instr(text, 'rumpe') - 1)) WHEN instr(text, '+lsi') > 0 THEN rtrim(left(text, instr(text, '+lsi') - 1)) ELSE text END AS cut FROM t")
def markers(spark, d):
    return forms(spark, d, ["前 spep 后", "文本 rumpe", "没有", "如需了解 更多", "x +lsi y"]).select("id", X.cut_before(F.col("text"), C.STOP_MARKERS).alias("cut"))


CLAIMS = ["我不能保证有货", "我保证有货", "无法保证", "绝对保证", "没法 保证 但一定有"]


@query("ben_negation_hits", f"WITH {forms_sql(CLAIMS)} SELECT id, contains(regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '(不|别|勿|无法|不能|没法|不可)保证', '', 'g'), '保证') AS hit FROM t")
def negation_hits(spark, d):
    return forms(spark, d, CLAIMS).select("id", X.hit_outside_negation("text", "保证").alias("hit"))


@query("ben_budget_score", rf"""WITH {forms_sql(ANSWERS)}, p AS (SELECT id, list_transform(regexp_extract_all(text, '[¥￥]\s*(\d+(?:\.\d+)?)', 1), lambda x: CAST(x AS DOUBLE)) AS ps FROM t)
SELECT id, CASE WHEN len(ps) = 0 THEN 0.2 WHEN len(list_filter(ps, lambda x: x <= 336)) = 0 THEN 0.0 ELSE least(1.0, len(list_filter(ps, lambda x: x <= 336)) / greatest(1, least(3, len(ps)))) END::DOUBLE AS score FROM p""")
def budget_score(spark, d):
    return forms(spark, d, ANSWERS).select("id", X.budget_score("text", F.lit(300.0)).cast("double").alias("score"))


@query("gev_rouge_l")
def rouge(spark, d):
    rows = forms(spark, d, ANSWERS).select("id", X.tokens("text").alias("a"), X.tokens(F.lit("推荐 耳机 A 价格 299 评分 4.8")).alias("b"))
    return rows.select("id", F.round(E.rouge_l("a", "b"), 6).alias("f1"))


@query("gev_fact_consistency", """WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity, 'qty ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' line ' || l_linenumber AS answer, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS fact FROM lineitem),
n AS (SELECT *, list_distinct(regexp_extract_all(answer, '\\d+\\.?\\d*')) AS said FROM q)
SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS fact_coverage, round(len(list_filter(said, lambda x: x <> fact)) / len(said), 6)::DOUBLE AS hallucination_ratio FROM n""")
def fact_consistency(spark, d):
    qty = F.col("l_quantity").cast("int").cast("string")
    made = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", E.fact_consistency(F.concat(F.lit("qty "), qty, F.lit(" line "), F.col("l_linenumber").cast("string")), F.array(qty), F.array(qty)).alias("f"))
    return made.select("l_orderkey", "l_linenumber", F.round("f.fact_coverage", 6).alias("fact_coverage"), F.round("f.hallucination_ratio", 6).alias("hallucination_ratio"))


JUDGED = ['{"overall": 0.8, "primary_failure": "tone", "failure_tags": ["tone","long"]}', '```json\n{"overall": 1.4}\n```', '"overall": 0.25, "primary_failure": "budget"', "no json here", '{"overall": "bad"}']


@query("par_judge_json", f"WITH {forms_sql(JUDGED)} SELECT id, CASE id % 5 WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 WHEN 2 THEN 0.25 ELSE 0.5 END::DOUBLE AS overall, CASE id % 5 WHEN 0 THEN 'tone' WHEN 2 THEN 'budget' ELSE 'none' END AS primary_failure, CASE id % 5 WHEN 0 THEN 'tone,long' ELSE '' END AS tags FROM t")
def judge_json(spark, d):
    return forms(spark, d, JUDGED).select("id", E.parse_judge("text").alias("j")).select("id", "j.overall", "j.primary_failure", F.array_join("j.tags", ",").alias("tags"))


# Orders as cases, their lines as stages: a scored table of any size.
_SCORES_SQL = """sc AS (SELECT l_orderkey AS case_id, CASE l_linenumber WHEN 1 THEN 'base' WHEN 2 THEN 'sft' ELSE 'dpo' END AS stage, 0.5 + l_discount * 4 + l_tax AS overall,
CASE l_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk_level, l_orderkey % 5 = 0 AS realistic, l_returnflag AS tag FROM lineitem WHERE l_linenumber <= 3),
th AS (SELECT *, CASE WHEN realistic THEN CASE risk_level WHEN 'low' THEN 0.64 WHEN 'high' THEN 0.72 ELSE 0.68 END ELSE CASE risk_level WHEN 'low' THEN 0.72 WHEN 'high' THEN 0.78 ELSE 0.75 END END AS threshold, max(overall) OVER (PARTITION BY case_id) AS best FROM sc),
rt AS (SELECT case_id, coalesce(arg_min(stage, CASE stage WHEN 'base' THEN 0 WHEN 'sft' THEN 1 ELSE 2 END) FILTER (WHERE overall >= threshold AND overall >= best - 0.03), 'manual_review') AS recommended_stage FROM th GROUP BY case_id)"""


def _scores(spark, d):
    key = F.col("l_orderkey")
    stage = F.when(F.col("l_linenumber") == 1, "base").when(F.col("l_linenumber") == 2, "sft").otherwise("dpo")
    risk = F.when(key % 3 == 0, "low").when(key % 3 == 1, "medium").otherwise("high")
    return table(spark, d, "lineitem").where("l_linenumber <= 3").select(
        key.alias("case_id"), stage.alias("stage"), (0.5 + F.col("l_discount") * 4 + F.col("l_tax")).alias("overall"), risk.alias("risk_level"), (key % 5 == 0).alias("realistic"), F.array("l_returnflag").alias("tags")
    )


@query("rte_threshold_route", f"WITH {_SCORES_SQL} SELECT case_id, recommended_stage FROM rt")
def threshold_route(spark, d):
    return E.routes(_scores(spark, d))


@query(
    "rte_pairwise_pick",
    """WITH w AS (SELECT l_orderkey AS case_id, CASE l_linenumber % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'sft' ELSE 'dpo' END AS winner, sum(1 + CASE l_returnflag WHEN 'R' THEN 0.1 WHEN 'N' THEN 0.05 ELSE 0.0 END) AS weight FROM lineitem GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY weight DESC, winner) AS place, lead(weight) OVER (PARTITION BY case_id ORDER BY weight DESC, winner) AS nxt FROM w) SELECT case_id, winner FROM p WHERE place = 1 AND (nxt IS NULL OR weight - nxt >= 1e-6)""",
)
def pairwise_pick(spark, d):
    n = F.col("l_linenumber") % 3
    made = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.when(n == 0, "base").when(n == 1, "sft").otherwise("dpo").alias("winner_stage"), F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low").alias("confidence")
    )
    return E.pairwise_winner(made)


@query(
    "agg_failure_analysis",
    f"""WITH {_SCORES_SQL}, m AS (SELECT th.*, recommended_stage <> stage OR overall < threshold AS failed FROM th JOIN rt USING (case_id)), c AS (SELECT stage, count(*) FILTER (WHERE failed) AS failures, round(count(*) FILTER (WHERE failed) / count(*), 4) AS failure_rate FROM m GROUP BY stage),
    g AS (SELECT stage, tag, count(*) AS n, row_number() OVER (PARTITION BY stage ORDER BY count(*) DESC, tag) AS place FROM m WHERE failed GROUP BY stage, tag), l AS (SELECT stage, string_agg(tag || ':' || n, ',' ORDER BY place) AS top_tags FROM g WHERE place <= 5 GROUP BY stage)
    SELECT stage, failures, failure_rate, coalesce(top_tags, '') AS top_tags FROM c LEFT JOIN l USING (stage)""",
)
def failure_analysis(spark, d):
    scores = _scores(spark, d)
    return E.failure_analysis(scores, E.routes(scores))


@query(
    "ben_merge_judge",
    f"""WITH {_SCORES_SQL}, w AS (SELECT *, CASE WHEN realistic THEN CASE risk_level WHEN 'high' THEN 0.85 ELSE 0.8 END ELSE CASE risk_level WHEN 'high' THEN 0.65 WHEN 'low' THEN 0.5 ELSE 0.55 END END AS jw FROM sc)
    SELECT case_id, stage, round(greatest(0.0, least(1.0, CASE WHEN tag = 'R' THEN least(overall * (1 - jw) + 0.6 * jw, 0.2) ELSE overall * (1 - jw) + 0.6 * jw END)), 4)::DOUBLE AS merged FROM w""",
)
def merge_judge(spark, d):
    s = _scores(spark, d)
    return s.select("case_id", "stage", E.merged_score("overall", F.lit(0.6), E.judge_weight("risk_level", "realistic"), F.col("tags")[0] == "R", F.lit(0.2)).alias("merged"))


@query("ben_finalize", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'R' THEN least((l_discount * 3 + l_tax * 1) / 4, 0.02) ELSE (l_discount * 3 + l_tax * 1) / 4 END, 4) AS overall FROM lineitem")
def finalize(spark, d):
    metrics = F.create_map(F.lit("a"), F.col("l_discount"), F.lit("b"), F.col("l_tax"))
    weights = F.create_map(F.lit("a"), F.lit(3.0), F.lit("b"), F.lit(1.0))
    reasons = F.when(F.col("l_returnflag") == "R", F.array(F.lit("returned"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", E.weighted_overall(metrics, weights, reasons, F.lit(0.02)).alias("overall"))


_PLAN_SQL = """pl AS (SELECT o_orderkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 'sft' WHEN 'O' THEN 'dpo' ELSE 'manual_review' END AS owner, CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk, (o_custkey % 97) / 100.0 AS score FROM orders),
pr AS (SELECT *, CASE owner WHEN 'sft' THEN 0.82 WHEN 'dpo' THEN 0.78 ELSE score END AS target, CASE risk WHEN 'low' THEN 0.8 WHEN 'high' THEN 1.2 ELSE 1.0 END AS weight FROM pl),
ps AS (SELECT *, round(CASE WHEN owner = 'manual_review' AND risk = 'high' THEN greatest(0.45, greatest(0, target - score) * weight) ELSE greatest(0, target - score) * weight END, 4)::DOUBLE AS priority_score FROM pr)"""


def _planned(spark, d):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        key.alias("case_id"), F.when(status == "F", "sft").when(status == "O", "dpo").otherwise("manual_review").alias("owner"), F.when(key % 3 == 0, "low").when(key % 3 == 1, "medium").otherwise("high").alias("risk"), ((F.col("o_custkey") % 97) / 100.0).alias("score")
    )


@query("pln_priority", f"WITH {_PLAN_SQL} SELECT case_id, round(priority_score, 3) AS priority_score FROM ps")
def priority(spark, d):
    return _planned(spark, d).select("case_id", F.round(P.priority_score("owner", "score", "risk"), 3).alias("priority_score"))


@query(
    "pln_sample_count",
    f"WITH {_PLAN_SQL} SELECT case_id, CAST(CASE WHEN owner = 'manual_review' THEN 0 WHEN target - score <= 0 THEN 180 ELSE ceil(round(600 * (0.55 + (target - score) * 1.6) * weight, 6) / 10.0) * 10 END AS BIGINT) AS samples FROM ps",
)
def sample_count(spark, d):
    # Rounded to a millionth, so that the next ten doesn't hang on a last bit.
    made = _planned(spark, d)
    gap = F.greatest(F.lit(0.0), F.when(F.col("owner") == "sft", 0.82).otherwise(0.78) - F.col("score"))
    weight = F.when(F.col("risk") == "low", 0.8).when(F.col("risk") == "high", 1.2).otherwise(1.0)
    exact = F.ceil(F.round(600 * (0.55 + gap * 1.6) * weight, 6) / 10.0) * 10
    return made.select("case_id", F.when(gap > 1e-12, F.when(F.col("owner") == "manual_review", 0).otherwise(exact)).otherwise(P.sample_count("owner", F.lit(600), "score", "risk")).cast("bigint").alias("samples"))


@query("stm_chunk_events", "WITH r AS (SELECT item_id AS id, text, unnest(range(0, CAST(ceil(length(text) / 20.0) AS BIGINT))) AS position FROM benchmark) SELECT id, CAST(position AS INTEGER) AS position, substr(text, position * 20 + 1, 20) AS chunk FROM r")
def chunk_events(spark, d):
    return chunks(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("par_html_links", """SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ' ') AS links FROM pages""")
def html_links(spark, d):
    links = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))))
    return table(spark, d, "pages").select("page_id", F.array_join(links, " ").alias("links"))


@query("par_html_record", r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '(?s)<p[ >]')) AS paragraphs FROM pages""")
def html_record(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit("(?s)(<p[ >])"), F.lit(1))).cast("bigint").alias("paragraphs")
    )


ROUTED = ["你好", "订单 {n} 到哪了", "推荐 {n} 元的耳机", "HELLO", "高优先级 的订单", "我的订单呢", "where is my order", "推荐一款耳机", "你能做什么呀", "退款"]


@query("rag_route", f"WITH {forms_sql(ROUTED)} SELECT id, CASE WHEN lower(trim(text)) IN ('你好', 'hello') OR contains(text, '你能做什么') THEN 'smalltalk' WHEN contains(text, '高优先级') THEN 'high_priority' WHEN regexp_matches(lower(text), '订单|物流|快递|发货|退货|退款|order|purchase|bought|shipping') THEN 'order' ELSE 'search' END AS route FROM t")
def route(spark, d):
    # Words and phrases of each route.
    greetings = ["你好", "您好", "嗨", "哈喽", "hi", "hello", "hey", "在吗", "在不在", "谢谢", "感谢", "再见", "bye", "goodbye"]
    phrases = "你是谁|你是干什么的|你能做什么|你可以做什么|介绍一下你自己|介绍下你自己|自我介绍|谢谢你|谢了|回头见"
    orders = "订单|物流|快递|发货|退货|退款|order|purchase|bought|shipping"
    low = F.lower(X.strip("text"))
    chosen = F.when(low.isin(*greetings) | F.col("text").rlike(phrases), "smalltalk").when(low.rlike("高优先级|high priority"), "high_priority").when(low.rlike(orders), "order").otherwise("search")
    return forms(spark, d, ROUTED).select("id", chosen.alias("route"))


@query("rag_context_block", "WITH c AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS n, p_name FROM part) SELECT p_type, string_agg('[' || n || '] ' || p_name, chr(10) ORDER BY n) AS context FROM c WHERE n <= 5 GROUP BY p_type")
def context_block(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    best = table(spark, d, "part").withColumn("n", F.row_number().over(order)).where("n <= 5")
    listed = best.groupBy("p_type").agg(F.array_sort(F.collect_list(F.struct("n", "p_name"))).alias("x"))
    return listed.select("p_type", F.array_join(F.transform("x", lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] "), x["p_name"])), "\n").alias("context"))
