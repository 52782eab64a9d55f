"""Queries that ask for training rows, over small tables: user 1 holds out items 3 and 4, user 2 none."""

from datetime import datetime

import pytest

from tidemark.plans import splits


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    bought = [(1, 1), (1, 2), (1, 3), (1, 4), (2, 3), (2, 5)]
    orders = [(k, u, datetime(2020, 1, 1 + k)) for k, (u, _) in enumerate(bought)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(k, i) for k, (_, i) in enumerate(bought)], "l_orderkey long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(1, 8)], "p_partkey long").write.parquet(f"{d}/part.parquet")
    return d


def test_items_without_any_training_row(spark, tables):
    assert sorted(r["item_id"] for r in splits.zero_train_items(spark, tables).collect()) == [4, 6, 7]


def test_held_out_rows_of_every_user_with_training_rows(spark, tables):
    assert sorted(tuple(r) for r in splits.held_out_of_known_users(spark, tables).collect()) == [(1, 3, "val"), (1, 4, "test")]
