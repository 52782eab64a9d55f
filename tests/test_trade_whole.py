"""Trade over all markets: against the registered SQL without its filter on markets; and a market
without imports, over small tables."""

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from tidemark.operators import trade
from tidemark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["trade_other_residual", "trade_shares", "trade_matrix_coalesced"])
def test_trade_holds_all_markets(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name].replace(" AND market % 5 <> 4", "")) == ""


def test_a_market_without_imports_has_its_mirror(spark):
    flows = spark.createDataFrame([(1, 2, 300.0), (1, 4, 100.0), (2, 1, 50.0)], "market int, partner int, value double")
    both = trade.reported_imports(flows, F.col("partner") < 6).withColumn("source", F.lit(0)).unionByName(trade.mirror_exports(flows).withColumn("source", F.lit(1)))
    got = {tuple(r) for r in trade.first_source(both, "market", "source").where("market = 4 or origin >= 0").collect()}
    assert got == {(1, 2, 300.0, 0), (1, 4, 100.0, 0), (2, 1, 50.0, 0), (4, 1, 100.0, 1)}
