"""Hand-worked values, dialects, sinks and streams."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom import catalogue, queries_relational
from sparkloom.functions import cleaning as C
from sparkloom.functions import prompts as M
from sparkloom.functions import text as X
from sparkloom.operators import evaluation as E
from sparkloom.operators import records as N
from sparkloom.operators import relational as R
from sparkloom.operators import retrieval as I
from sparkloom.plans import data_plan as P
from sparkloom.sources import tables as T
from sparkloom.streaming.state import bounded_history, windowed_requests
from tests.oracle import difference


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "v string").select(column).first()[0]


def test_parsers(spark):
    assert tuple(one(spark, X.price_range("v"), "500元以内")) == (None, 500.0)
    assert tuple(one(spark, X.price_range("v"), "1000-2000元")) == (1000.0, 2000.0)
    assert tuple(one(spark, X.price_range("v"), "2000元以上")) == (2000.0, None)
    assert one(spark, X.rating_floor("v"), "4.5分以上的耳机") == 4.5
    assert one(spark, X.clean_price("v"), "¥1,299.00-1,599.00") == 1299.0
    assert one(spark, X.clean_count("v"), "3万+") == 30000 and one(spark, X.clean_count("v"), "none") is None
    assert one(spark, X.clean_rating("v"), "150") is None
    assert one(spark, X.confidence(F.lit(0.0325), F.lit(4.8))) == 40
    assert one(spark, X.hash_bucket("v"), "SYN-手机-001") == 97
    assert one(spark, X.hit_outside_negation("v", "保证"), "我不能保证") is False
    assert one(spark, X.hit_outside_negation("v", "保证"), "我保证") is True


def test_cleaning(spark):
    assert one(spark, C.clean_answer("v"), "先看 [1] 耳机 A，价格 299元\n[2] 耳机 B\n[2] 耳机 B\n\n\n推荐 [1] 耳") == "我先帮您按当前需求筛 2 款：\n\n1. [1] 耳机 A，价格：¥299\n2. [2] 耳机 B\n\n推荐 [1] 耳机 A。"
    assert one(spark, C.clean_exported("v"), "好的。如需了解更多") == "好的。"


def test_ranking(spark):
    a = spark.createDataFrame([(1, "A", 1), (1, "B", 2)], "qid int, doc_id string, rank int")
    b = spark.createDataFrame([(1, "B", 1), (1, "C", 2)], "qid int, doc_id string, rank int")
    got = [(r.doc_id, round(r.score, 7)) for r in I.fused([a, b], 5).orderBy("rank").collect()]
    assert got == [("B", 0.0325225), ("A", 0.0163934), ("C", 0.016129)]
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (2, "d", 2)], "qid int, doc_id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (2, "x")], "qid int, doc_id string")
    m = I.rank_metrics(results, relevant, spark.createDataFrame([(1,), (2,)], "qid int"), (2,)).first()
    assert m.mrr == 0.25 and m.recall == 0.5 and m.precision == 0.25 and abs(m.ndcg - 0.6309298 / 2) < 1e-6


def test_plans(spark):
    assert one(spark, P.sample_count(F.lit("sft"), F.lit(600), F.lit(0.5), F.lit("medium"))) == 640
    assert one(spark, P.priority_score(F.lit("sft"), F.lit(0.5), F.lit("medium"))) == 0.32


def test_dialects(spark):
    crawled = spark.createDataFrame([("p1", " A ", "耳机", "98.5", "4.9", "12"), (None, None, "", "5", "9", "x"), ("p3", "free", "", "0", "1", "1")], "product_id string, title string, category string, price string, rating string, review_count string")
    rows = {r.Product_ID: r for r in R.normalise_products(crawled).collect()}
    assert set(rows) == {"p1", "GEN-00002"} and rows["GEN-00002"].Product_Title == "未命名商品" and rows["GEN-00002"].Rating == 5.0
    assert rows["p1"].combined_text.startswith("A 精选 耳机，适合日常选购场景。 耳机")


def test_greedy_keeps_what_only_resembles_dropped_rows(spark):
    titles = spark.createDataFrame([(1, "abcdefghij"), (2, "abcdefghik"), (3, "abcdefghkl"), (4, "zyx")], "id long, title string")
    assert sorted(r.id for r in R.greedy_keep(titles, 0.8).collect()) == [1, 3, 4]


def test_quality_reasons(spark):
    prompt, answer = "预算 300 元以内", "\n\n价格：¥999" + "好" * 60
    assert one(spark, E.sft_reason(F.lit(prompt), F.lit(answer))) == "budget_mismatch"
    assert one(spark, E.sft_reason(F.lit(""), F.lit(answer))) is None


def test_json_lines(spark, tmp_path):
    df = spark.range(5).withColumn("t", F.lit("é"))
    assert T.write_json_lines(df, str(tmp_path / "x")) == 5
    assert T.read_json_lines(spark, str(tmp_path / "x"), "id long, t string").count() == 5


def test_streams(spark, tmp_path):
    turns = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(6)], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))
    bounded_history(stream, 1).writeStream.format("memory").queryName("history").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start().processAllAvailable()
    assert {r.turn: list(r.history) for r in spark.table("history").collect()}[5] == ["m3", "m4"]
    events = spark.createDataFrame([(1, "2026-01-01 00:00:10"), (1, "2026-01-01 00:00:40")], "k int, ts string")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    windowed_requests(stream, "k", "ts").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start().processAllAvailable()
    assert max(r.requests for r in spark.table("windows").collect()) == 2
    for q in spark.streams.active:
        q.stop()


def test_prompt_echo(spark):
    from sparkloom.operators.scoring import is_echo, rounded

    rows = [("预算三百的耳机推荐", "预算 300 的耳机推荐一下"), ("预算 300 的耳机！", "预算300的耳机"), ("你说预算300的耳机", "预算300的耳机"), ("推荐索尼这款，音质好", "预算300的耳机"), ("", "x"), ("便宜的蓝牙耳机。学生上课用的", "想买便宜的蓝牙耳机学生上课用的那种可以吗谢谢你啦啦啦啦啦啦啦啦")]
    got = [r.e for r in spark.createDataFrame(rows, "a string, b string").select(is_echo("a", "b").alias("e")).collect()]
    assert got == [False, True, True, False, False, True]
    from pyspark.sql import functions as F

    assert spark.range(1).select(rounded(F.create_map(F.lit("x"), F.lit(0.123456))).alias("m")).first().m == {"x": 0.1235}


def test_date_bounds():
    from datetime import date

    from sparkloom.operators.records import date_bounds

    assert date_bounds("2024-01-02", "2024-01-02") == (date(2024, 1, 2),) * 2
    for bad in (("2024-1-2", "2024-01-03"), ("2024-01-03", "2024-01-02"), ("x" * 10, "2024-01-02")):
        with pytest.raises(ValueError):
            date_bounds(*bad)


def test_prompts(spark):
    asked = "预算控制在300元以内，主要用于 通勤 ，更看重缓震。"
    assert tuple(one(spark, M.structured_prompt("v"), asked)) == ("300", "通勤", "缓震")
    assert tuple(one(spark, M.structured_prompt("v"))) == ("", "", "")
    assert one(spark, M.without_leaks("v"), " 好\r\n\n\n\n的🖇\n##User\n泄露\nx") == "好\n\n的"
    assert one(spark, M.without_leaks("v"), "user\nx") == ""
    assert one(spark, M.without_leaks("v")) is None
    short = lambda text, feature="", scene="": one(spark, M.short_reason("v", F.lit(feature), F.lit(scene)), text)
    assert short("价格在预算内，更适合通勤。") == "偏通勤。"
    assert short("结合通勤与当前评分表现，适合久走") == "更适合久走。"
    assert short("缓震好", "缓震") == "更偏缓震取向，当前评分也比较稳。"
    assert short(None, "缓震", "通勤") == "偏通勤取向，当前评分也比较稳。"
    assert short("。") == "价格和评分都比较稳。"


def test_detail_numbers(spark):
    assert one(spark, M.first_price(F.lit("暂无"), F.lit("1.2.3"), "v"), "¥1,299.50") == 1299.5
    assert one(spark, M.first_price("v")) is None
    assert one(spark, M.percent_rating("v"), "97%好评") == 4.9


def test_evidence(spark):
    assert one(spark, M.system_message("S", F.array().cast("array<string>"))) == "S\n\n" + M.NO_EVIDENCE
    assert one(spark, M.system_message("S", F.lit(None).cast("array<string>"))) == "S\n\n" + M.NO_EVIDENCE
    shown = M.evidence(F.lit("A"), F.lit(3), F.lit(4.5), F.lit(None), F.lit(None), F.col("v"), {"promo_note": F.lit(" 减10 "), "availability": F.lit("")})
    assert one(spark, shown) == "A\n价格：¥3.00\n评分：4.5/5\n品牌：未知\n描述：\n特点：\n价格备注：减10"
    assert one(spark, M.with_extras(F.create_map(F.lit("a"), F.lit("1")), a=F.lit("2"), b=F.lit(""), c=F.lit(None))) == {"a": "2"}


def test_alternatives_of_alike_products(spark):
    """Equal prices and repeated titles: the reach grows until three titles are new."""
    rows = [(i, f"t{i // 15}", "c", 10.0 + (i // 40), float(i % 5)) for i in range(90)] + [(100, "alone", "d", 1.0, 1.0), (101, "free", "c", None, 1.0)]
    df = spark.createDataFrame(rows, "Product_ID int, Product_Title string, Category string, Price double, Rating double")
    got = {}
    for r in sorted(R.nearest_alternatives(df, 3, df).collect(), key=lambda r: (r.target_id, r["rank"])):
        got.setdefault(r.target_id, []).append(r.Product_ID)
    want = {}
    for t in rows[:90]:
        near, seen, listed = sorted((abs(p[3] - t[3]), abs(p[4] - t[4]), p[1], p[0]) for p in rows[:90] if p[0] != t[0]), set(), []
        for x in near:
            listed.append((x[2] in seen, *x))
            seen.add(x[2])
        want[t[0]] = [x[4] for x in sorted(listed)[:3]]
    assert got == want


def test_search_floor_after_the_best(spark):
    found = spark.createDataFrame([(1, i, 1.0 - i / 10, i + 1) for i in range(6)], "qid int, doc_id int, score double, rank int")
    products = spark.createDataFrame([(i, 5.0 if i % 2 else None) for i in range(1, 6)], "doc_id int, Rating double")
    assert [(r.doc_id, r["rank"]) for r in I.search(found, products, 4, min_rating=4.0).orderBy("rank").collect()] == [(1, 1), (3, 2)]


def test_raw_products_and_batches(spark, tmp_path):
    raw = spark.createDataFrame([("a", "9.5", "4", "3"), ("b", "0", "4", None), ("c", "x", "4", None), ("d", "2", None, None), ("e", "2", "1", "")], "title string, price string, average_rating string, rating_number string")
    assert [(r.Product_Title, r.Price, r.Rating_Count) for r in T.read_raw_products(raw).collect()] == [("a", 9.5, 3), ("e", 2.0, 0)]
    (tmp_path / "q.json").write_text('[{"text": "a", "customer_id": 3}, {"customer_id": 4}]')
    assert sorted(map(tuple, T.read_batch_queries(spark, str(tmp_path / "q.json")).collect())) == [("", 4), ("a", 3)]


def test_encoder_hook(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "doc_id int, text string")
    made = {r.doc_id: r.embedding for r in I.encoded(docs, lambda texts: [[3.0 * bool(t), 4.0 * bool(t)] for t in texts], batch=2).collect()}
    assert made == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    assert I.encoded(docs, None).collect() == [] and I.encoded(docs.limit(0), lambda texts: []).collect() == []


def test_record_selections(spark):
    products = spark.createDataFrame([(" 1 ", "c", 2, None), ("2", "d", 3, 4.0), ("", "c", 1, 1.0)], "Product_ID string, Category string, Price int, Rating double")
    assert N.product_rows(products).where("Product_ID = '1'").first().asDict() == {"Product_ID": "1", "Product_Title": "", "Category": "c", "Description": "", "Brand": "", "features": "", "Price": 2.0, "Rating": None}
    records = spark.createDataFrame([(1, "x", "t", "1"), (2, "x", "t", "2"), (3, "x", "t", None), (4, "y", "t", "1"), (5, "x", "t", "")], "n int, dimension string, task string, product_id string")
    ids = lambda **how: sorted(r.n for r in N.bundle_records(records, products, dimension="x", task="t", **how).collect())
    assert ids(categories=["c"], by_category=True) == [1]
    assert ids(categories=[], by_category=True) == ids(categories=["c"], by_category=False) == [1, 2, 3, 5]


def test_surrogate_ids(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"p{i}", "s" if i < 8 else None) for i in range(0, 10)], "n long, id string, source string")
    assert [r.id for r in N.surrogate_ids(df, "id", "source", "n", width=3).orderBy("n").collect()] == ["p0", "s_1", "p2", "s_3", "p4", "s_5", "p6", "s_7", "p8", "_9"]
    assert N.surrogate_ids(df.limit(0), "id", "source", "n").collect() == []


def test_failure_plan_rounds_as_its_sql(spark, tmp_path):
    """1998.5 / 1000000 is a half in decimal digits and just below one in binary: it ties with 1998.2."""
    name = "pln_failure_first"
    prices = [(1, 1998.5, "1-URGENT"), (2, 1998.2, "2-HIGH"), (3, 1998.6, "2-HIGH"), (4, 1500.5, "5-LOW"), (5, -1998.5, "5-LOW"), (6, None, "5-LOW")]
    spark.createDataFrame(prices, "o_orderkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert difference(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name], str(tmp_path)) is None
    cents = spark.range(-200000, 200000).select((F.col("id") / 100).alias("v")).select("v", X.rounded(F.col("v") / 1000000, 6).alias("r"))
    want = dict(con.execute("SELECT i / 100, round(i / 100 / 1000000, 6) FROM range(-200000, 200000) t(i)").fetchall())
    assert [r for r in cents.collect() if r.r != want[r.v]] == []


def alternatives_differ(spark, rows, count=3):
    df = spark.createDataFrame(rows, "Product_ID long, Product_Title string, Category string, Price double, Rating double")
    got = R.nearest_alternatives(df, count, df).select("target_id", "Product_ID", "rank")
    con = duckdb.connect()
    con.execute("CREATE TABLE cat (Product_ID BIGINT, Product_Title VARCHAR, Category VARCHAR, Price DOUBLE, Rating DOUBLE)")
    con.executemany("INSERT INTO cat VALUES (?, ?, ?, ?, ?)", rows)
    want = con.execute("WITH u AS (SELECT 1) " + queries_relational._ALT.replace("rank <= 3", f"rank <= {count}")).fetchall()
    return sorted(set(map(tuple, got.collect())) ^ set(want))


def test_alternatives_as_their_sql(spark):
    """Runs of one title, few titles, prices and ratings whose gaps round to the same, no title, no rating."""
    dice = random.Random(7)
    rows = []
    for category, titles, prices, ratings in (
        ("copies", "ab", [1.0], [1.0]), ("runs", "a" * 40 + "bcd", range(60), range(3)), ("one level", "a" * 30 + "bcde", [5.0], [x / 8 for x in range(40)]), ("mixed", "abcdefgh", range(9), range(4)),
        ("far", "abcde", [1e16, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [1e16, 0.5, 1.0, 1.5, 2.0, 3.0]), ("odd", ["a", "b", None, "c"], [1.0, 1.1, 1.2, float("nan")], [1.0, None, 2.0]), ("three", "abc", range(5), range(2)), ("two", "ab", range(50), [1.0]),
    ):
        rows += [(len(rows) + i, dice.choice(titles), category, float(dice.choice(prices)), dice.choice(ratings)) for i in range(70)]
    rows = [(*r[:4], None if r[4] is None else float(r[4])) for r in rows] + [(9000, "x", "pair", 1.0, 1.0), (9001, "x", "pair", 2.0, 1.0), (9002, "x", "alone", 2.0, 1.0)]
    assert alternatives_differ(spark, rows) == []
    assert alternatives_differ(spark, rows[:300], 1) == []


def shuffled_records(spark):
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_alternatives_form_no_pairs(spark):
    df = spark.range(1500).selectExpr("id AS Product_ID", "concat('t', id % 2) AS Product_Title", "'c' AS Category", "1D AS Price", "1D AS Rating")
    before = shuffled_records(spark)
    assert R.nearest_alternatives(df, 3, df).count() == 4500
    assert shuffled_records(spark) - before < 100 * 1500
