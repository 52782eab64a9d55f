"""Hierarchical draws: the picks are never broadcast, and spans of picks give the same draws."""

import hashlib

import pytest

from tidemark.operators import statistics


def u(key):
    return (int(hashlib.md5(f"5:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


@pytest.mark.parametrize("aggregate", ["macro", "micro"])
@pytest.mark.parametrize("span", [3, 65_536])
def test_draws_equal_a_replay_and_picks_stay_apart(spark, monkeypatch, aggregate, span):
    monkeypatch.setattr(statistics, "SPAN", span, raising=False)
    values = {s: [s * 10 + i * i / 7 for i in range(n)] for s, n in ((1, 7), (4, 3), (6, 1))}
    rows = [(s, i, v) for s, vs in values.items() for i, v in enumerate(vs)]
    got = statistics.hierarchical_draws(spark.createDataFrame(rows, "stratum int, unit int, d double"), 6, 5, aggregate)
    want = []
    for draw in range(6):
        picks = [values[sorted(values)[int(u(f"{draw}:{slot}") * 3)]] for slot in range(3)]
        picks = [[vs[int(u(f"{draw}:{slot}:{i}") * len(vs))] for i in range(len(vs))] for slot, vs in enumerate(picks)]
        mean = lambda x: sum(x) / len(x)
        want.append(mean([mean(p) for p in picks]) if aggregate == "macro" else mean([v for p in picks for v in p]))
    assert [r["value"] for r in got.orderBy("draw").collect()] == pytest.approx(want)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin [place" in plan and "BroadcastHashJoin [place" not in plan
