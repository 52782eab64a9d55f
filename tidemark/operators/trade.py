"""Trade shares by market and origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reported_imports(flows: DataFrame, named: Column) -> DataFrame:
    """(market, origin, value): positive values by named partner other than the market itself, and
    OTHER: the market's world total less the named ones, not below 0."""
    f = flows.where((F.col("value") > 0) & (F.col("market") != F.col("partner")))
    by = f.where(named).groupBy("market", F.col("partner").alias("origin")).agg(F.sum("value").alias("value"))
    rest = f.groupBy("market").agg(F.greatest(F.sum("value") - F.coalesce(F.sum(F.when(named, F.col("value"))), F.lit(0.0)), F.lit(0.0)).alias("value"))
    return by.unionByName(rest.select("market", F.lit(-1).alias("origin"), "value"))


def mirror_exports(flows: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """What partners report, with the sides exchanged; nothing between a market and itself. With
    `missing` (market) only for those markets."""
    f = flows.where((F.col("value") > 0) & (F.col("market") != F.col("partner")))
    out = f.groupBy(F.col("partner").alias("market"), F.col("market").alias("origin")).agg(F.sum("value").alias("value"))
    return out if missing is None else out.join(F.broadcast(missing.select("market").distinct()), "market", "left_semi")  # a row a market


def coalesced(by_year: DataFrame, mirrored: DataFrame, years: list[int]) -> DataFrame:
    """(market, origin, value, source, year) from (market, year, origin, value): a market's rows of the
    first of `years` that has its reported imports, else of the first that has mirrored ones."""
    place = F.array_position(F.array(*map(F.lit, years)), F.col("year"))
    both = by_year.withColumn("source", F.lit(0)).unionByName(mirrored.withColumn("source", F.lit(1))).withColumn("__at", place).where("__at > 0")
    both = both.withColumn("__at", F.struct("source", "__at"))
    return first_source(both, "market", "__at").select("market", "origin", "value", "source", "year")


def aggregate_rows(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Rows whose breakdown columns hold their totals' codes; a missing code counts as the total's."""
    ok = F.lit(True)
    for name, code in defaults.items():
        ok = ok & (F.coalesce(F.col(name).cast("string"), F.lit(code)) == code)
    return rows.where(ok)


def granular(rows: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """`rows`, or an error where a group of `keys` has more of them than expected."""
    n = F.count("*").over(Window.partitionBy(*keys))
    too_many = F.raise_error(F.concat(F.lit("more rows than aggregates in "), F.to_json(F.struct(*keys)))).cast("boolean")
    return rows.withColumn("__n", n).where(F.when(F.col("__n") > expected, too_many).otherwise(True)).drop("__n")


def top_partners(rows: DataFrame, key: str, partner: str, value: str, n: int = 8) -> DataFrame:
    """(key, rank, partner, value): the largest n of each key, ties to the smaller partner."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), partner))
    return rows.withColumn("rank", place).where(F.col("rank") <= n).select(key, "rank", partner, value)


def aligned(trade: DataFrame, markets: DataFrame, countries: DataFrame) -> DataFrame:
    """(market_id, country_id, share): rows of both vocabularies (name, id), each market's values
    normalised; a market without a positive value is an error."""
    x = markets.select(F.col("id").alias("market_id"), F.col("name").alias("market")).join(trade, "market", "left")
    x = x.join(countries.select(F.col("id").alias("country_id"), F.col("name").alias("origin")), "origin", "left")
    x = x.withColumn("value", F.when(F.col("country_id").isNotNull(), F.col("value")))
    total = F.coalesce(F.sum("value").over(Window.partitionBy("market_id")), F.lit(0.0))
    share = F.when(total > 0, F.col("value") / total).otherwise(F.raise_error(F.concat(F.lit("no trade of market "), F.col("market"))).cast("double"))
    return x.withColumn("share", share).where("country_id is not null").select("market_id", "country_id", "share")


def axis_violations(origins: DataFrame, markets: DataFrame, other: str = "OTHER") -> DataFrame:
    """(rule, n) of an origin axis (position, name, code): the markets first in their order, `other`
    last, every other origin with a code."""
    m = markets.select(F.col("position").alias("at"), F.col("name").alias("market"))
    n = F.count("*").over(Window.partitionBy())
    x = origins.withColumn("n", n).join(F.broadcast(m), F.col("position") == F.col("at"), "left")  # a row a market
    rules = {
        "markets_first": F.col("market").isNotNull() & (F.col("name") != F.col("market")),
        "other_last": (F.col("name") == other) != (F.col("position") == F.col("n") - 1),
        "coded": (F.col("name") != other) & F.col("code").isNull(),
    }
    sums = x.agg(*[F.count(F.when(bad, 1)).alias(k) for k, bad in rules.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("x")).select("x.rule", "x.n")


def first_source(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """Of each key all rows of its first source that has any, by priority."""
    return rows.withColumn("__first", F.min(priority).over(Window.partitionBy(key))).where(F.col(priority) == F.col("__first")).drop("__first")


def shares(imports: DataFrame, markets: DataFrame, prior: float = 0.01) -> DataFrame:
    """(market, origin, share): rows normalised, mixed with the pooled shares, and normalised again;
    a market without imports has the pooled shares. Tables of markets by origins are small."""
    total = F.sum("value").over(Window.partitionBy("market"))
    own = imports.withColumn("s", F.col("value") / total).select("market", "origin", "s")
    pooled = imports.groupBy("origin").agg(F.sum("value").alias("v")).withColumn("pool", F.col("v") / F.sum("v").over(Window.partitionBy()))
    grid = markets.select("market").crossJoin(F.broadcast(pooled.select("origin", "pool")))  # markets by origins
    x = grid.join(own, ["market", "origin"], "left")
    has = F.max(F.col("s").isNotNull()).over(Window.partitionBy("market"))
    mixed = F.when(has, (1 - prior) * F.coalesce("s", F.lit(0.0)) + prior * F.col("pool")).otherwise(F.col("pool"))
    x = x.withColumn("m", mixed)
    return x.select("market", "origin", (F.col("m") / F.sum("m").over(Window.partitionBy("market"))).alias("share"))


def origin_probabilities(shares_: DataFrame, pools: DataFrame) -> DataFrame:
    """Foreign shares among origins with items, normalised; by pool size where they sum to 0."""
    x = shares_.join(pools.where("size > 0"), "origin").where("market <> origin")
    per = Window.partitionBy("market")
    s = F.sum("share").over(per)
    return x.select("market", "origin", F.when(s > 0, F.col("share") / s).otherwise(F.col("size") / F.sum("size").over(per)).alias("p"))
