"""Golden values and invariants of operators that have no SQL oracle, and of ingest."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import algebra, text
from tidemark.operators import contract, graph, ranking, statistics, trade
from tidemark.operators import interactions as I
from tidemark.sources import ingest
from tidemark.streaming.latest import upsert_latest


def test_full_normalisation_and_hash(spark):
    df = spark.createDataFrame([("  ＡBC\tStraße  ",), ("ＡBC  ",), ("abc",), (None,)], "x string")
    got = [r[0] for r in df.select(text.normalize_text(F.col("x"))).collect()]
    assert got == ["abc strasse", "abc", "abc", ""]


def test_ranking_golden(spark):
    users = spark.createDataFrame([(0, 0), (1, 0)], "user long, market int")
    truth = spark.createDataFrame([(0, 2), (1, 1), (1, 4)], "user long, item long")
    train = spark.createDataFrame([(0, 0), (1, 3)], "user long, item long")
    catalog = spark.createDataFrame([(0, i) for i in range(5)], "market int, item long")
    rows = [(u, i, s) for u, ss in enumerate([[9, 0.2, 0.9, 0.1, 0.0], [0.1, 0.5, 0.2, 9.0, 0.4]]) for i, s in enumerate(ss)]
    scores = spark.createDataFrame([(u, i, float(s)) for u, i, s in rows], "user long, item long, score double")
    cands = ranking.candidates(users, catalog, train)
    ranked = ranking.top_k(cands.join(scores, ["user", "item"]), 2)
    m = ranking.report(ranking.user_metrics(ranked, truth, users, [1, 2]), ranking.eligibility(cands, users, [1, 2]))
    got = {r["k"]: r for r in m.where("scope = 'micro'").collect()}
    assert got[1]["recall"] == pytest.approx(0.75) and got[2]["recall"] == pytest.approx(1.0)
    assert got[1]["hit"] == got[2]["hit"] == 1.0


def test_trade_golden(spark):
    flows = spark.createDataFrame([(1, 2, 300.0), (1, 3, 100.0), (1, 9, 600.0), (1, 1, 50.0)], "market int, partner int, value double")
    imp = trade.reported_imports(flows, F.col("partner").isin(2, 3))
    assert {r["origin"]: r["value"] for r in imp.collect()} == {2: 300.0, 3: 100.0, -1: 600.0}
    got = trade.shares(imp, spark.createDataFrame([(1,), (5,)], "market int")).collect()
    share = {(r["market"], r["origin"]): r["share"] for r in got}
    assert share[1, 2] == pytest.approx(0.3) and share[1, -1] == pytest.approx(0.6) and share[5, 3] == pytest.approx(0.1)
    pools = spark.createDataFrame([(2, 9), (3, 1)], "origin int, size int")
    none = spark.createDataFrame([(7, 2, 0.0), (7, 3, 0.0)], "market int, origin int, share double")
    assert sorted(r["p"] for r in trade.origin_probabilities(none, pools).collect()) == [pytest.approx(0.1), pytest.approx(0.9)]


def test_nearest_and_symmetric(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [-1.0, 0.0])], "id long, v array<double>")
    g = graph.symmetric(graph.nearest(v, 1, 2), "sim").collect()
    assert {(r["a"], r["b"]) for r in g} == {(0, 1), (1, 0)} and all(r["sim"] > 0 for r in g)


def test_violations_raise(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    found = contract.violations(df, {"positive": F.col("x") > 0})
    assert [tuple(r) for r in found.collect()] == [("positive", 2)]
    with pytest.raises(ValueError):
        contract.require(found)


def test_pairs_must_match(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "s int, v double")
    with pytest.raises(Exception, match="pairs do not match"):
        statistics.paired(a, a.where("s = 1"), ["s"], "v").collect()
    assert statistics.gates({"all": 0.0, "cold": -0.006}) == {"all": True, "cold": False, "accepted": False}


def test_ratings_and_metadata(spark, tmp_path):
    with gzip.open(tmp_path / "r.txt.gz", "wt") as f:
        f.write("u1 a1 5.0 2020-01-01\nu1  a1 4 2021-01-01\n")
    rows = ingest.read_ratings(spark, str(tmp_path / "r.txt.gz"))
    assert [tuple(r) for r in I.latest(rows, ["user", "asin"], "date").collect()] == [("u1", "a1", "2021-01-01")]
    (tmp_path / "bad.txt").write_text("u1 a1 x 2020\n")
    with pytest.raises(Exception, match="bad rating line"):
        ingest.read_ratings(spark, str(tmp_path / "bad.txt")).collect()
    with open(tmp_path / "m.json", "w") as f:
        f.write(json.dumps({"asin": "a1", "title": "old"}) + "\n" + json.dumps({"asin": "a1", "title": "new", "related": {"alsoBought": ["x", "y", "x"]}}) + "\n")
    meta = ingest.read_metadata(spark, str(tmp_path / "m.json"))
    got = meta.select("title", ingest.related_asins(F.col("related")).alias("rel")).collect()
    assert [tuple(r) for r in got] == [("new", ["x", "y"])]


def test_nested_products(spark, tmp_path):
    names = [("main", " Tea "), ("th", "x"), ("th", "ชา"), ("fr", "  ")]
    df = spark.createDataFrame([("12345678901", "en", names, ["en:thailand", "en:timor-leste"])], T.StructType([T.StructField("code", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("product_name", ingest.TEXTS), T.StructField("countries_tags", ingest.TAGS)]))
    df.write.parquet(str(tmp_path / "p"))
    rows = ingest.read_products(spark, str(tmp_path / "p"), "parquet")
    r = ingest.flat_record(rows, ["en", "th", "fr"]).first()
    assert (r["product_name"], r["product_name_en"], r["product_name_th"], r["product_name_fr"]) == ("Tea", "Tea", "ชา", None)
    codes = {"thailand": "TH", "timor-leste": "TL"}
    out = ingest.fan_out(rows, F.transform("countries_tags", lambda t: text.tag_code(t, codes)))
    ingest.write_markets(out, str(tmp_path / "markets"))
    assert spark.read.json(str(tmp_path / "markets")).groupBy("market").count().orderBy("market").collect() == [("TH", 1), ("TL", 1)]


def test_scalar_functions(spark):
    df = spark.createDataFrame([('{"http://b": [1], "http://a": [2]}', '["http://l"]', "http://p", ["b", "a", "b", "a"])], "o string, l string, p string, t array<string>")
    r = df.select(text.first_image(F.col("o")), text.first_image(F.col("l")), text.first_image(F.col("p")), text.first_mode(F.col("t")), text.last_n(F.col("t"), 9)).first()
    assert tuple(r) == ("http://a", "http://l", "", "b", ["b", "a", "b", "a"])
    w = df.select(algebra.masked_softmax(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(True), F.lit(False)))).first()[0]
    assert w == [1.0, 0.0]


def test_saved_table_is_checked(spark, tmp_path):
    ingest.save_table(spark.range(5).toDF("x"), str(tmp_path / "t"))
    assert ingest.load_table(spark, str(tmp_path / "t")).count() == 5
    spark.range(6).toDF("x").write.mode("overwrite").parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        ingest.load_table(spark, str(tmp_path / "t"))


def test_retry_reports_the_last_error():
    waits = []

    def fail():
        raise OSError("down")

    assert ingest.retried(fail, tries=3, sleep=waits.append) == {"_error": "down"} and waits == [30.0, 60.0]


def test_stream_upsert(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "u long, i long, ts string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], schema).coalesce(1).write.parquet(src)
    for rows in ([], [(1, 1, "c")]):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        upsert_latest(spark.readStream.schema(schema).parquet(src), ["u", "i"], "ts", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/version=1")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, 1, "c"), (1, 2, "b")]


def test_k_core_and_dictionary(spark):
    pairs = spark.createDataFrame([(u, i) for u in range(3) for i in range(3)] + [(9, 0)], "u long, i long")
    assert I.k_core(pairs, "u", "i", 3).count() == 9
    ids = I.dictionary(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "k string"), F.col("k"))
    assert {r["key"]: r["id"] for r in ids.collect()} == {"a": 0, "b": 1}


def test_quota_fills_the_total(spark):
    sizes = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "k int, size int")
    assert sorted((r["k"], r["quota"]) for r in I.quotas(2, sizes, "k", "size").collect()) == [(0, 1), (1, 1), (2, 0)]
