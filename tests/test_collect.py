"""Paged collection with resume, files that appear whole, datasets, manifests and small checks."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking, scoring, statistics, trade, views
from tidemark.operators import interactions as I
from tidemark.sources import collect, ingest


def service(n, fail=()):
    asked = []

    def fetch(p):
        asked.append((p["sort_by"], p["page"], p["page_size"]))
        if len(asked) in fail:
            return {"_error": "down"}
        order = range(n) if p["sort_by"] == "created_t" else range(n - 1, -1, -1)
        at = (p["page"] - 1) * p["page_size"]
        return {"count": n, "products": [{"code": i} for i in list(order)[at : at + p["page_size"]]] if p["page_size"] > 1 else []}

    return fetch, asked


def read(folder, market):
    return [json.loads(x)["code"] for x in (folder / f"{market}.jsonl").read_text().splitlines()]


def test_collection_goes_on_after_a_failure(tmp_path):
    fetch, asked = service(250, fail={4})
    assert collect.collect(fetch, ["th"], tmp_path, rounds=1) == ["th"]
    assert read(tmp_path, "th") == list(range(200))
    assert collect.collect(fetch, ["th"], tmp_path) == []
    assert read(tmp_path, "th") == list(range(250)) and [a[1] for a in asked if a[2] > 1] == [1, 2, 3, 3]
    (tmp_path / "th.jsonl").unlink()
    with pytest.raises(FileNotFoundError):
        collect.is_done(tmp_path, "th")


def test_what_one_order_does_not_reach_comes_from_the_other(tmp_path):
    fetch, asked = service(95)
    assert collect.collect_market(fetch, "vn", tmp_path, page=10, depth=60)
    assert set(read(tmp_path, "vn")) == set(range(95)) and collect.read_state(tmp_path / "vn.state")["coverage"] == "union_of_orders"
    fetch, _ = service(0)
    assert collect.collect_market(fetch, "bn", tmp_path) and read(tmp_path, "bn") == []


def test_download_is_whole_or_absent(tmp_path):
    def broken():
        yield b"a"
        raise OSError("cut off")

    with pytest.raises(OSError):
        collect.download(broken, tmp_path / "f")
    assert list(tmp_path.iterdir()) == []
    assert collect.download(lambda: [b"a", b"b"], tmp_path / "f") and not collect.download(lambda: [b"c"], tmp_path / "f")
    assert (tmp_path / "f").read_bytes() == b"ab"


def test_items_and_datasets_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 0, "b")], "item long, view int, text string")
    collect.write_items(rows, "item", "view", str(tmp_path / "items"))
    got = collect.read_items(spark, str(tmp_path / "items"), "item long, views array<struct<view int, text string>>")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    collect.write_dataset({"views": rows}, str(tmp_path / "d"), {"protocol": 1})
    tables, meta = collect.read_dataset(spark, str(tmp_path / "d"), ["views"], {"protocol": 1})
    assert tables["views"].count() == meta["tables"]["views"] == 3
    for expected, names in (({"protocol": 2}, ["views"]), ({}, ["other"])):
        with pytest.raises(ValueError):
            collect.read_dataset(spark, str(tmp_path / "d"), names, expected)
    n, some = collect.probe(rows, 2)
    assert (n, some.count()) == (3, 2)
    coded = collect.codes(rows.withColumn("text", F.coalesce("text", F.lit("z"))), "text").orderBy("item", "view").select("text_code")
    assert [r[0] for r in coded.collect()] == [0, 2, 1]


def test_runs_need_one_and_name_the_staged_model(spark, tmp_path):
    schema = "status string, model string, residual string"
    for i, (model, status) in enumerate([("own", "completed"), ("mf", "completed"), ("mf", "failed")]):
        ingest.write_json({"status": status, "model": model, "residual": "fused"}, tmp_path / f"r{i}.json")
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(schema)
    got = ingest.read_runs(spark, [str(tmp_path / "r*.json")], schema, "OWN")
    assert sorted(r["variant"] for r in got.collect()) == ["mf", "own-fused"]
    with pytest.raises(ValueError):
        ingest.read_runs(spark, [str(tmp_path / "r2.json")], schema, "own")
    made = collect.run_manifest({"k": 1}, {"test": {"overall": {"x": 1.0}, "subsets": {"cold": {"x": 2.0}}}}, [tmp_path / "r0.json"], 1.23456, {"split_seed": 3})
    assert made["artifacts"][str(tmp_path / "r0.json")] == ingest.file_hash(tmp_path / "r0.json") and made["duration_seconds"] == 1.235
    assert statistics.report_at(made["report"], "cold") == {"x": 2.0}
    with pytest.raises(KeyError):
        statistics.report_at(made["report"], "cross")


def test_settings_and_targets():
    assert collect.selected_metrics("cold", {"cold": {"x": 1}}) == {"x": 1}
    for target, found in (("cold", {"overall": {}}), ("other", {})):
        with pytest.raises(ValueError):
            collect.selected_metrics(target, found)
    assert (collect.split_seed({"seed": 1, "split_seed": 0}), collect.split_seed({"seed": 1, "split_seed": None})) == (0, 1)
    bad = collect.config_errors({"mode": "x", "p": 2.0, "q": True}, {"mode": ("a",)}, {"p": (0, 1), "q": (0, 1)})
    assert len(bad) == 3 and not collect.config_errors({"mode": "a", "p": 1}, {"mode": ("a",)}, {"p": (0, 1)})
    known = [("thailand", "TH"), ("timor-leste", "TL")]
    assert views.resolve_markets(["tl, Thailand"], known) == known and views.resolve_markets(["timor leste"], known) == known[1:]
    with pytest.raises(ValueError):
        views.resolve_markets(["france"], known)


def test_quotas_keep_capacities_and_deal_on(spark):
    sizes = spark.createDataFrame([(0, 10, 1), (1, 10, 10), (2, 4, 0)], "k int, size long, room long")
    got = {r["k"]: r["quota"] for r in I.quotas(9, sizes, "k", "size", "room").collect()}
    assert got == {0: 1, 1: 8, 2: 0}
    got = {r["k"]: r["quota"] for r in I.quotas(0, sizes, "k", "size").collect()}
    assert got == {0: 0, 1: 0, 2: 0}


def test_cold_items_take_whole_counts_of_a_market(spark):
    degree = spark.createDataFrame([(i, 1 + i % 5) for i in range(60)], "item long, degree long")
    got = [r["split"] for r in I.cold_items(degree, "item", 0.05, 7, "th:").collect()]
    assert (got.count("cold_val"), got.count("cold_test")) == (3, 3)
    assert I.cold_items(degree.limit(0), "item", 0.05, 7).count() == 0


def test_errors_are_raised_where_a_contract_is_broken(spark):
    triples = spark.createDataFrame([(1, 0, 2)], "h long, r int, t long")
    trade_rows = spark.createDataFrame([("TH", "CN", 0.0)], "market string, origin string, value double")
    names = spark.createDataFrame([("TH", 0)], "name string, id int")
    few = spark.createDataFrame([("a",), ("a",)], "k string")
    for df in (scoring.both_ways(triples, 2), triples.select(scoring.compact_relation(F.col("r"), 2)), trade.aligned(trade_rows, names, spark.createDataFrame([("CN", 5)], "name string, id int")), trade.granular(few, ["k"], 1)):
        with pytest.raises(Exception, match="interactions among|out of range|no trade|more rows"):
            df.collect()
    good = trade.aligned(spark.createDataFrame([("TH", "CN", 3.0), ("TH", "XX", 9.0), ("TH", "US", 1.0)], trade_rows.schema), names, spark.createDataFrame([("CN", 5), ("US", 6)], "name string, id int"))
    assert sorted(tuple(r) for r in good.collect()) == [(0, 5, 0.75), (0, 6, 0.25)]
    assert ranking.no_truth([1, 2], spark).count() == 4


def test_origin_axis_and_aggregate_rows(spark):
    markets = spark.createDataFrame([(0, "TH"), (1, "SG")], "position int, name string")
    axis = spark.createDataFrame([(0, "TH", 764), (1, "CN", 156), (2, "OTHER", None), (3, "US", None)], "position int, name string, code int")
    assert {r["rule"]: r["n"] for r in trade.axis_violations(axis, markets).collect()} == {"markets_first": 1, "other_last": 2, "coded": 1}
    rows = spark.createDataFrame([("0", None), ("1", "C00"), ("0", "C00"), ("0", "C01")], "mode string, customs string")
    assert trade.aggregate_rows(rows, {"mode": "0", "customs": "C00"}).count() == 2


def test_acceptance_needs_all_five(spark):
    names = ["primary", "recall", "overall_micro", "cold"]
    rows = [(n, 0.01, -0.004 if n in ("overall_micro", "cold") else 0.001) for n in names]
    got = statistics.acceptance(spark.createDataFrame(rows, "name string, mean double, low double")).first()
    assert got["default_residual"] == "market_reliable" and not got["decoupling_supported"]
    got = statistics.acceptance(spark.createDataFrame(rows[:3], "name string, mean double, low double")).first()
    assert got["default_residual"] == "none" and not got["cold_noninferior"]
    assert collect.markdown(spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double"), 2) == "|k|v|\n|-|-|\n|a|0.50|\n|b|-|"
