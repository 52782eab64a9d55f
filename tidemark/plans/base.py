"""Registration of queries, and the driver's tables seen as interactions, catalogs and text views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


INTER = """inter AS (SELECT o_custkey AS user_id, l_partkey AS item_id, strftime(o_orderdate, '%Y-%m-%d') AS ts
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
LATEST = f"{INTER}, latest AS (SELECT user_id, item_id, max(ts) AS ts FROM inter GROUP BY 1, 2)"


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("user_id", "item_id", "ts")
