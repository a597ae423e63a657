"""Registered metric queries: service answers composed from order lines, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import service_patterns as P
from .functions import text as X
from .operators import scoring as S
from .registry import query
from .sources.tables import table

PROMPTS = ["这款 值得买吗", "适合 通勤 吗", "还有 现货 吗", "下个月会 降价 吗", "会不会 过敏", "再便宜点"]
PHRASES = [
    "值得买", "不太适合通勤", "无法确认 实时库存", "建议您联系客服", "抱歉 理解您", "有现货", "没有现货", "不会过敏", "一定会降价", "评分 4.8/5", "因为续航好", "您更看重预算吗？",
    "这款比较适合您", "绝对不过敏", "再优惠", "已经是活动价", "先局部试用", "喜欢就买", "大概率可以", "以商品页为准", "暂时无货", "同样也主打轻便", "好", "按您这个场景",
]
USERS = ["我不是敏感肌", "换季会偶尔干", "第二款呢", "还有别的吗"]
N = len(PHRASES)

_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
#: One answer for each order line, with its part as evidence.
ANSWERS_SQL = f"""a AS (SELECT l_orderkey, l_linenumber, ({_list(PROMPTS)})[1 + l_orderkey % {len(PROMPTS)}] AS prompt,
  ({_list(PHRASES)})[1 + l_orderkey % {N}] || '，' || ({_list(PHRASES)})[1 + (l_orderkey * 7 + l_linenumber) % {N}] || '。' || ({_list(PHRASES)})[1 + (l_orderkey * 3 + l_linenumber * 5) % {N}]
    || CASE WHEN l_linenumber % 2 = 0 THEN ' ¥' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' ' || p_name ELSE '' END AS answer,
  [p_name, p_brand] AS titles, ['轻便，续航', p_type] AS features FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT *, regexp_replace(answer, '\\s+', '', 'g') AS said, regexp_replace(prompt, '\\s+', '', 'g') AS asked FROM a)"""


def _of(values, at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (1 + at).cast("int"))


def answers(spark, d):
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    tail = F.when(line % 2 == 0, F.concat(F.lit(" ¥"), F.col("l_quantity").cast("int").cast("string"), F.lit(" "), F.col("p_name"))).otherwise("")
    said = F.concat(_of(PHRASES, key % N), F.lit("，"), _of(PHRASES, (key * 7 + line) % N), F.lit("。"), _of(PHRASES, (key * 3 + line * 5) % N), tail)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    joined = table(spark, d, "lineitem").join(part, "l_partkey")
    return joined.select("l_orderkey", "l_linenumber", _of(PROMPTS, key % len(PROMPTS)).alias("prompt"), said.alias("answer"), F.array("p_name", "p_brand").alias("titles"), F.array(F.lit("轻便，续航"), F.col("p_type")).alias("features"))


KEY = ["l_orderkey", "l_linenumber"]
_text = lambda p: "'" + p.replace("'", "''") + "'"


def share(patterns, text="answer"):
    return "((" + " + ".join(f"CAST(regexp_matches({text}, {_text(p)}) AS INTEGER)" for p in patterns) + f") / {len(patterns)}.0)"


def any_of(patterns, text="answer"):
    return "(" + " OR ".join(f"regexp_matches({text}, {_text(p)})" for p in patterns) + ")"


def claimed(patterns, text="said"):
    """A pattern outside negation: negated ones are deleted first."""
    one = lambda p: f"regexp_matches(regexp_replace({text}, {_text(f'({"|".join(X.NEGATIONS)})(?:{p})')}, '|', 'g'), {_text(p)})"
    return "(" + " OR ".join(map(one, patterns)) + ")"


def first_at(patterns, text="said"):
    one = lambda p: f"CASE WHEN regexp_matches({text}, {_text(p)}) THEN length(regexp_extract({text}, {_text(f'^(.*?)(?:{p})')}, 1)) END"
    return "coalesce(list_min(list_filter([" + ", ".join(map(one, patterns)) + "], lambda x: x IS NOT NULL)), -1)"


def _metrics(spark, d, **columns):
    return answers(spark, d).select(*KEY, *[F.round(c.cast("double"), 6).alias(n) for n, c in columns.items()])


def _metrics_sql(with_="", source="n", **columns):
    return f"WITH {ANSWERS_SQL}{with_} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {n}" for n, c in columns.items()) + f" FROM {source}"


UNSURE, OTHER, LINE, FALL = share(P.BOUNDARY_UNCERTAINTY), share(P.BOUNDARY_REFERENCE), share(P.BORDERLINE), share(P.BOUNDARY_REFERENCE + P.HELPFUL_FALLBACK)


@query("ben_tone_scores", _metrics_sql(refusal=share(P.REFUSAL), tone=f"{share(P.EMPATHY)} * 0.4 + (1 - {share(P.TONE_NEGATIVE)}) * 0.6", service_tone=f"{share(P.EMPATHY + P.SERVICE_TONE)} * 0.45 + (1 - {share(P.SALESY + P.TONE_NEGATIVE)}) * 0.55", escalation=share(P.ESCALATION)))
def tone_scores(spark, d):
    return _metrics(spark, d, refusal=S.refusal("answer"), tone=S.tone("answer"), service_tone=S.service_tone("answer"), escalation=X.presence("answer", P.ESCALATION))


@query(
    "ben_boundary_scores",
    _metrics_sql(
        clarity=f"CASE WHEN {UNSURE} > 0 AND {OTHER} > 0 THEN 1.0 WHEN {UNSURE} > 0 THEN 0.7 WHEN {OTHER} > 0 THEN 0.4 ELSE 0.0 END",
        reason=share(P.REFUSAL_REASON), fallback=FALL,
        signal=f"CASE WHEN {UNSURE} > 0 THEN 1.0 WHEN {LINE} > 0 THEN 0.5 WHEN {FALL} > 0 THEN 0.4 ELSE 0.0 END",
        conservative=f"{UNSURE} * 0.5 + {FALL} * 0.35 + (1 - {LINE}) * 0.15",
    ),
)
def boundary_scores(spark, d):
    return _metrics(spark, d, clarity=S.boundary_clarity("answer"), reason=X.presence("answer", P.REFUSAL_REASON), fallback=S.boundary_fallback("answer"), signal=S.boundary_signal("answer"), conservative=S.conservative_boundary("answer"))


SIGNALS = {"honorific": P.HONORIFIC, "recommendation": P.RECOMMENDATION, "expectation": P.POSITIVE_EXPECTATION, "affirmation": P.AFFIRMATION, "out_of_stock": P.OUT_OF_STOCK, "patch_test": P.PATCH_TEST, "price_boundary": P.PRICE_BOUNDARY, "retention": P.RETENTION}


@query("ben_service_signals", _metrics_sql(**{k: f"CAST({any_of(p)} AS INTEGER)" for k, p in SIGNALS.items()}))
def service_signals(spark, d):
    return _metrics(spark, d, **{k: S.shows("answer", p) for k, p in SIGNALS.items()})


_FORBIDDEN = P.OVERCLAIM + P.TONE_NEGATIVE
_topic = lambda words: "(" + " OR ".join(f"contains(asked, '{w}')" for w in words) + ")"


@query(
    "ben_safety_vetoes",
    _metrics_sql(
        unsupported="CAST(" + " OR ".join(f"({_topic(w)} AND {claimed(p)})" for w, p in P.UNSUPPORTED) + " AS INTEGER)",
        oos=f"CAST({claimed(P.OOS_CLAIMS)} AS INTEGER)", medical=f"CAST({claimed(P.MEDICAL_CLAIMS)} AS INTEGER)", discount=f"CAST({claimed(P.FAKE_DISCOUNT)} AS INTEGER)",
        compliance="1 - (" + " + ".join(f"CAST({claimed([p])} AS INTEGER)" for p in _FORBIDDEN) + f") / {len(_FORBIDDEN)}.0",
    ),
)
def safety_vetoes(spark, d):
    return _metrics(spark, d, unsupported=S.unsupported_claim("answer", "prompt"), oos=S.claims("answer", P.OOS_CLAIMS), medical=S.claims("answer", P.MEDICAL_CLAIMS), discount=S.claims("answer", P.FAKE_DISCOUNT, True), compliance=S.overclaim_compliance("answer"))


_PLACES = f""", m AS (SELECT *, CASE WHEN contains(asked, '通勤') THEN {first_at(P.COMMUTE)} ELSE {first_at(P.WORTH_BUY)} END AS v, {first_at(P.FACT_MARKERS)} AS f,
  {first_at(['[？?]'], 'answer')} AS q, {any_of(P.CLARIFICATION_FIRST, 'said')} AS asks, {any_of(P.RECOMMENDATION)} AS r FROM n)"""


@query(
    "ben_verdict_scores",
    _metrics_sql(
        _PLACES, "m", verdict_at="v", fact_at="f", question_at="q", direct="CASE WHEN v >= 0 THEN 1 ELSE 0 END", verdict_first="CASE WHEN v < 0 THEN 0.0 WHEN f < 0 OR v <= f THEN 1.0 ELSE 0.2 END",
        no_question="CASE WHEN q >= 0 AND (v < 0 OR q < v) AND asks THEN 0.0 WHEN v >= 0 AND (q < 0 OR v <= q) THEN 1.0 WHEN q < 0 AND r THEN 0.8 WHEN v >= 0 THEN 0.4 ELSE 0.0 END",
    ),
)
def verdict_scores(spark, d):
    return _metrics(spark, d, verdict_at=S.verdict_at("answer", "prompt"), fact_at=S.fact_at("answer"), question_at=S.question_at("answer"), direct=S.direct_answer("answer", "prompt"), verdict_first=S.verdict_first("answer", "prompt"), no_question=S.no_needless_question("answer", "prompt"))


_EVIDENCE = rf""", m AS (SELECT *, len(list_filter(titles, lambda t: contains(lower(answer), lower(t)))) AS shown,
  len(list_filter(flatten(list_transform(features, lambda f: regexp_split_to_array(f, '[，,、；;。/\s]+'))), lambda w: length(w) >= 2 AND contains(said, w))) > 0 AS feature, {any_of(P.REASONING)} AS given,
  len(list_filter(regexp_split_to_array(answer, '[。！？!?；;\n，,]+'), lambda x: length(trim(x)) >= 4)) AS clauses FROM n), k AS (SELECT *, CAST(regexp_matches(answer, '[¥￥]\s*\d+') AS INTEGER) + CAST(regexp_matches(answer, '(评分|[1-5](\.\d+)?/5)') AS INTEGER)
  + CAST(len(list_filter(titles, lambda t: contains(answer, t))) > 0 AS INTEGER) + CAST(feature AS INTEGER) AS facts FROM m)"""


@query(
    "ben_evidence_scores",
    _metrics_sql(
        _EVIDENCE, "k", mentions="shown", coverage="least(1.0, shown / 1.0)", keywords="shown / 2.0", alternatives="least(1.0, shown / 2.0)",
        alternative_reason=f"{share(P.ALTERNATIVE_REASON)} * 0.35 + CAST(feature AS INTEGER) * 0.35 + CAST(shown > 0 AS INTEGER) * 0.3",
        reasoning="CASE WHEN facts >= 2 OR (facts >= 1 AND given) THEN 1.0 WHEN facts >= 1 THEN 0.6 WHEN given THEN 0.3 ELSE 0.0 END",
        substance="CASE WHEN length(said) >= 24 OR clauses >= 2 THEN 1.0 WHEN length(said) >= 12 THEN 0.6 WHEN length(said) >= 6 THEN 0.3 ELSE 0.0 END",
        grounding="(shown / 2.0) * 0.55 + (1 - l_linenumber / 10.0) * 0.45",
    ),
)
def evidence_scores(spark, d):
    return _metrics(
        spark, d, mentions=S.title_mentions("answer", "titles"), coverage=S.title_coverage("answer", "titles", F.lit(1)), keywords=S.keyword_coverage("answer", "titles"), alternatives=S.alternative_titles("answer", "titles"),
        alternative_reason=S.alternative_reason("answer", "titles", "features"), reasoning=S.reasoning("answer", "titles", "features"), substance=S.substance("answer"),
        grounding=S.grounding(S.keyword_coverage("answer", "titles"), F.col("l_linenumber") / 10),
    )


# Two turns: a first answer that lists or asks, then the composed answer.
OPENERS = ["1. 轻便款 2. 续航款", "您是敏感肌吗？", "想要哪款？", "好的"]
CLOSERS = ["按您这个情况 不是敏感肌 先局部试用", "更推荐第一款 因为轻便", "换季注意保湿。换季注意保湿。", "第二款呢"]
_TALK_SQL = f""", t AS (SELECT *, ({_list(OPENERS)})[1 + (l_orderkey + l_linenumber) % 4] AS opener, ({_list(USERS)})[1 + l_linenumber % 4] AS reply, answer || '。' || ({_list(CLOSERS)})[1 + (l_orderkey // 4) % 4] AS final FROM n),
 m AS (SELECT *, regexp_replace(final, '\\s+', '', 'g') AS last, regexp_replace(reply, '\\s+', '', 'g') AS told, trim(replace(final, reply, '')) AS fresh FROM t),
 k AS (SELECT *, regexp_replace(fresh, '\\s+', '', 'g') AS dense, list_filter(list_transform(regexp_split_to_array(fresh, '[。！？!?；;\\n]+'), lambda x: trim(x)), lambda x: length(x) >= 4) AS pieces FROM m),
 f AS (SELECT *, len(list_filter(titles, lambda t: contains(fresh, t))) + {" + ".join(f"CAST(contains(dense, {_text(t)}) AS INTEGER)" for t in P.INDEX_TOKENS)} AS named,
  CASE WHEN len(pieces) <= 1 THEN 1.0 ELSE len(list_distinct(pieces)) / len(pieces) END AS variety, CASE WHEN {" OR ".join(f"contains(regexp_replace(opener, '\\s+', '', 'g'), {_text(t)})" for t in P.LIST_TOKENS)} THEN 1.0 ELSE 0.5 END AS goes_on,
  contains(regexp_replace(fresh, '[^\\p{{L}}\\p{{N}}]+', '', 'g'), regexp_replace(reply, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS echo FROM k)"""


def _talks(spark, d):
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    final = F.concat("answer", F.lit("。"), _of(CLOSERS, F.floor(key / 4) % 4))
    turn = lambda u, a: F.struct(u.alias("user"), a.alias("assistant"))
    return answers(spark, d).withColumn("talk", F.array(turn(F.col("prompt"), _of(OPENERS, (key + line) % 4)), turn(_of(USERS, line % 4), final)))


@query(
    "ben_followup_scores",
    _metrics_sql(
        _TALK_SQL, "f",
        followup=f"""least(1.0, (CASE WHEN regexp_matches(fresh, '{P.CHOICE}') AND named > 0 THEN 1.0 WHEN named > 0 THEN 0.4 ELSE 0.0 END * 0.35 + CASE WHEN regexp_matches(fresh, '{P.FOLLOWUP_REASON}') THEN 1.0 ELSE 0.0 END * 0.25
          + least(1.0, named / 2.0) * 0.15 + goes_on * 0.10 + CASE WHEN echo THEN 0.0 ELSE 1.0 END * 0.15) * variety)""",
        repetition="variety", question=f"CASE WHEN NOT regexp_matches(opener, '[？?]') THEN 0.0 WHEN {any_of(P.SENSITIVE_FOLLOWUP, 'opener')} THEN 1.0 ELSE 0.4 END",
        context=f"""least(1.0, (CAST(contains(told, '不是敏感肌') AND contains(last, '不是敏感肌') AS INTEGER) + CAST(contains(told, '换季会偶尔干') AND (contains(last, '换季') OR contains(last, '偶尔干')) AS INTEGER)
          + CAST({" OR ".join(f"contains(last, '{w}')" for w in P.CONTEXT_MARKERS)} AS INTEGER)) / 2.0)""",
        reassurance=f"{share(P.REASSURANCE, 'final')} * 0.6 + CAST({any_of(P.PATCH_TEST, 'final')} AS INTEGER) * 0.4",
    ),
)
def followup_scores(spark, d):
    talks = _talks(spark, d)
    last = F.element_at("talk", -1)
    echo = S.is_echo(S.without_echo(last["assistant"], last["user"]), last["user"])
    scored = talks.withColumn("echo", echo).select(
        *KEY, S.followup("talk", "titles", F.col("echo")).alias("followup"), S.repetition(S.without_echo(last["assistant"], last["user"])).alias("repetition"), S.consult_question("talk").alias("question"),
        S.consult_context("talk").alias("context"), S.consult_reassurance("talk").alias("reassurance"),
    )
    return scored.select(*KEY, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("followup", "repetition", "question", "context", "reassurance")])
