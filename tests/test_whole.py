"""Queries run over all rows: against whole SQL, where the registered SQL has a filter, or brute force."""

import numpy as np
import pytest
from oracle import connect, differences

from tidemark.operators import statistics
from tidemark.plans import preparation
from tidemark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def whole(name, cut):
    """The registered SQL without the filter `cut`."""
    return ORACLE_SQL[name].replace(cut, "")


@pytest.mark.parametrize("name", ["sym_norm_weights", "lightgcn_layers"])
def test_graph_holds_all_orders(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), whole(name, " WHERE o_custkey % 3 = 0")) == ""


def test_bootstrap_takes_all_pairs_and_10000_draws(spark, monkeypatch):
    seen, kept = [], statistics.bootstrap

    def watched(differences, key, draws, seed):
        seen.append((sorted(r["d"] for r in differences.collect()), draws))
        return kept(differences, key, draws, seed)

    monkeypatch.setattr(preparation.statistics, "bootstrap", watched)
    got = preparation.paired_bootstrap(spark, SF).first()
    sql = "WITH r AS (SELECT o_orderpriority AS v, o_custkey AS s, avg(o_totalprice) / 1000 AS x FROM orders GROUP BY 1, 2) SELECT a.x - b.x FROM r a JOIN r b ON a.s = b.s AND a.v[1] = '1' AND b.v[1] = '5'"
    d = np.sort([x for (x,) in connect(SF).execute(sql).fetchall()])
    assert seen[0][1] == 10_000 and seen[0][0] == pytest.approx(d.tolist())
    want = np.quantile(np.random.default_rng(1).choice(d, (10_000, len(d))).mean(1), [0.025, 0.975])
    assert [got["low"], got["high"]] == pytest.approx(want.tolist(), abs=d.std() / len(d) ** 0.5 / 10)


def test_bootstrap_over_chunks_is_one_resample_of_all(spark, monkeypatch):
    monkeypatch.setattr(statistics, "CHUNK", 7)
    x = np.random.default_rng(2).exponential(5.0, 100)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k long, d double")
    got = statistics.bootstrap(df, "k", 4000, 3).first()
    want = np.quantile(np.random.default_rng(1).choice(x, (10_000, 100)).mean(1), [0.025, 0.975])
    assert [got["low"], got["high"]] == pytest.approx(want.tolist(), abs=0.1)
    assert statistics.bootstrap(df.repartition(9), "k", 4000, 3).first() == got
    assert statistics.bootstrap(df.where("k < 0"), "k", 10, 3).first()["low"] is None
