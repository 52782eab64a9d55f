"""Negative tails: a triple is one row throughout, and heads may go on over Arrow batches."""

from tidemark.operators import sampling


def test_a_triple_is_never_several_rows(spark):
    rows = [(h, 1, (h * 7 + j * j) % 50) for h in range(60) for j in range(9)] + [(None, 1, 3), (5, 1, None), (3, 2, 1)]
    df = spark.createDataFrame(rows, "h long, r int, t long")
    out = sampling.negative_tails(df.where("t is not null"), 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    got = sorted(map(tuple, out.collect()), key=str)
    true = set(rows)
    assert {g[:3] for g in got} == {r for r in true if r[1] == 1 and r[2] is not None} and all((h, r, n) not in true for h, r, _, n in got if h is not None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert sorted(map(tuple, sampling.negative_tails(df.where("t is not null"), 4).collect()), key=str) == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
