"""Paired comparisons of runs: effect sizes, bootstraps, gates, training curves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .interactions import checkpointed

CHUNK = 65_536  #: pairs that a task of a bootstrap holds
BLOCK = 500  #: draws that it makes
SPAN = 65_536  #: picks of a stratum that one row stands for until they are made


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, d = a - b); a key that one side lacks, or has twice, is an error."""
    x = a.groupBy(*keys).agg(F.count("*").alias("na"), F.first(value).alias("va"))
    y = b.groupBy(*keys).agg(F.count("*").alias("nb"), F.first(value).alias("vb"))
    both = x.join(y, keys, "full")
    ok = (F.coalesce("na", F.lit(0)) == 1) & (F.coalesce("nb", F.lit(0)) == 1)
    return both.select(*keys, F.when(ok, F.col("va") - F.col("vb")).otherwise(F.raise_error(F.lit("pairs do not match")).cast("double")).alias("d"))


def effect(differences: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean, sd, dz): sample deviation, 0 for a single pair; dz null without spread."""
    sd = F.coalesce(F.stddev_samp("d"), F.lit(0.0))
    return differences.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), sd.alias("sd")).withColumn("dz", F.col("mean") / F.nullif(F.round("sd", 12), F.lit(0.0)))


def bootstrap(differences: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """(low, high): 95 % percentile interval of the mean over `draws` resamples of all pairs. Pairs are
    numbered by key over range partitions and cut into chunks; each draw deals its n picks out to the
    chunks by a multinomial of its own seed, so that no task holds all pairs."""
    spark = differences.sparkSession
    d = differences.select(key, F.col("d").cast("double").alias("d"))
    d = checkpointed(d.repartitionByRange(key, "d").withColumn("__p", F.spark_partition_id()))
    sizes = d.groupBy("__p").agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.withColumn("__b", F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).select("__p", F.coalesce("__b", F.lit(0)).alias("__b"))
    n = d.count()
    if not n:
        return spark.createDataFrame([(None, None)], "low double, high double")
    place = F.row_number().over(Window.partitionBy("__p").orderBy(key, "d")) - 1
    i = d.withColumn("__o", place).join(F.broadcast(before), "__p").select((F.col("__o") + F.col("__b")).alias("i"), "d")
    held = [min(CHUNK, n - a) for a in range(0, n, CHUNK)]
    blocks = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // BLOCK)))
    dealt = i.select(F.floor(F.col("i") / CHUNK).cast("int").alias("chunk"), "i", "d", blocks.alias("block"))

    def resample(k: tuple, t: pa.Table) -> pa.Table:
        chunk, block = (x.as_py() for x in k)
        x = t.column("d").to_numpy()[np.argsort(t.column("i").to_numpy())]
        mine = range(block * BLOCK, min(draws, (block + 1) * BLOCK))
        sums = []
        for draw in mine:
            count = np.random.default_rng([seed, draw]).multinomial(n, np.array(held) / n)[chunk]
            sums.append(float(x[np.random.default_rng([seed, draw, chunk + 1]).integers(0, len(x), count)].sum()))
        return pa.table({"draw": pa.array(mine, pa.int32()), "s": pa.array(sums, pa.float64())})

    means = dealt.groupBy("chunk", "block").applyInArrow(resample, "draw int, s double").groupBy("draw").agg((F.sum("s") / n).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def protocol_violations(runs: DataFrame, same: list[str], near: str, tolerance: float = 1.01) -> DataFrame:
    """(rule, n): columns that differ between runs, and a count that spreads beyond the tolerance."""
    one = runs.agg(*[(F.count_distinct(c) > 1).cast("int").alias(c) for c in same], (F.max(near) > tolerance * F.min(near)).cast("int").alias(near))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in [*same, near]])).alias("x")).select("x.rule", "x.n")


def best_epoch(curve: DataFrame, by: list[str], epoch: str, value: str, patience: int) -> DataFrame:
    """Each curve's epoch of its best value (strictly better than all before) up to where `patience`
    epochs without one have passed."""
    per = Window.partitionBy(*by).orderBy(epoch)
    before = F.max(value).over(per.rowsBetween(Window.unboundedPreceding, -1))
    x = curve.withColumn("__new", before.isNull() | (F.col(value) > before))
    x = x.withColumn("__last", F.max(F.when(F.col("__new"), F.col(epoch))).over(per))
    x = x.withColumn("__stop", F.max((F.col(epoch) - F.col("__last") >= patience).cast("int")).over(per.rowsBetween(Window.unboundedPreceding, -1)))
    live = x.where((F.coalesce("__stop", F.lit(0)) == 0) & F.col("__new"))
    return live.groupBy(*by).agg(F.max(epoch).alias("best_epoch"), F.max(value).alias("best"))


def gates(effects: dict[str, float], margin: float = -0.005) -> dict[str, bool]:
    """Which comparisons are not worse than the margin, and whether all are."""
    out = {k: v >= margin for k, v in effects.items()}
    return out | {"accepted": all(out.values())}


def hierarchical_draws(strata: DataFrame, draws: int, seed: int, aggregate: str = "macro") -> DataFrame:
    """(draw, value): each draw picks as many strata as there are, with replacement, and from each pick as
    many values (stratum, unit, d) as it has, with replacement; macro is the mean of the picks' means,
    micro the mean of all values. Picks are hashes of draw and place, so they are the same everywhere;
    every pick of a value is a row of an equi-join. Spark takes the picks for as few as the rows that they are
    made from, so the join is told to hash the values, dealt out by place, and never to broadcast the picks."""
    from .interactions import numbered
    from .sampling import uniform

    if aggregate not in ("macro", "micro"):
        raise ValueError(f"unknown aggregate {aggregate!r}")
    rows = numbered(strata.select("stratum", "unit", "d"), ["stratum", "unit"])
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.min("place").alias("first"))  # a row a stratum
    sizes = sizes.select("n", "first", (F.row_number().over(Window.orderBy("stratum")) - 1).alias("s"))
    m = sizes.count()
    slot = strata.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(max(m, 1) - 1))).alias("slot"))
    key = lambda *c: F.concat_ws(":", *[F.col(x).cast("string") for x in c])
    picked = slot.withColumn("s", F.floor(uniform(key("draw", "slot"), seed) * m).cast("int")).join(F.broadcast(sizes), "s")
    picked = picked.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SPAN).cast("long"))))
    # a number of its own, for the few small rows would be put into one task
    picked = picked.repartition(int(strata.sparkSession.conf.get("spark.sql.shuffle.partitions")), "draw", "slot", "from")
    picked = picked.withColumn("i", F.explode(F.sequence("from", F.least(F.col("from") + SPAN, "n") - 1)))
    place = F.col("first") + F.floor(uniform(key("draw", "slot", "i"), seed) * F.col("n"))
    got = picked.select("draw", "slot", place.alias("place")).join(rows.select("place", "d").hint("shuffle_hash"), "place")
    if aggregate == "micro":
        return got.groupBy("draw").agg(F.avg("d").alias("value"))
    return got.groupBy("draw", "slot").agg(F.avg("d").alias("m")).groupBy("draw").agg(F.avg("m").alias("value"))


def interval(draws: DataFrame, value: str = "value") -> DataFrame:
    """(low, high): 95 % percentile interval of the draws."""
    return draws.agg(F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def compared(runs: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(comparison, n, mean, sd, dz) of candidate less base, by seed; runs: (variant, seed, value)."""
    found = None
    for a, b in pairs:
        side = lambda v: runs.where(F.col("variant") == v).select("seed", F.col("value").alias(f"v_{v}"))
        d = side(a).join(side(b), "seed").select(F.lit(f"{a}-{b}").alias("comparison"), (F.col(f"v_{a}") - F.col(f"v_{b}")).alias("d"))
        found = d if found is None else found.unionByName(d)
    return effect(found, ["comparison"])


def acceptance(comparisons: DataFrame, margin: float = -0.005) -> DataFrame:
    """One row of checks from (name, mean, low): the primary difference and its lower bound above 0, the
    recall's mean above 0, micro and cold not below the margin, decoupling and conditioning above 0; and
    whether the first five hold, which switches the residual on. A comparison that is missing fails."""
    one = comparisons.agg(*[F.max(F.when(F.col("name") == n, F.col(c))).alias(f"{n}_{c}") for n in ("primary", "recall", "overall_micro", "cold", "decoupling", "conditioning") for c in ("mean", "low")])
    holds = {
        "primary_mean_positive": F.col("primary_mean") > 0, "primary_ci_above_zero": F.col("primary_low") > 0, "macro_recall_mean_positive": F.col("recall_mean") > 0,
        "overall_micro_noninferior": F.col("overall_micro_low") >= margin, "cold_noninferior": F.col("cold_low") >= margin,
        "decoupling_supported": F.col("decoupling_low") > 0, "market_conditioning_supported": F.col("conditioning_low") > 0,
    }
    out = one.select(*[F.coalesce(ok, F.lit(False)).alias(n) for n, ok in holds.items()])
    needed = list(holds)[:5]
    on = F.col(needed[0])
    for n in needed[1:]:
        on = on & F.col(n)
    return out.withColumn("default_residual", F.when(on, "market_reliable").otherwise("none"))


def unequal(rows: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """(key, n): groups whose payload is not the same in all rows; as JSON, nulls included."""
    said = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    return rows.groupBy(*key).agg(F.count_distinct(said).alias("n")).where("n > 1")


def report_at(report, subset: str):
    """The part of a run's report for a subset: in `test`, else in its `subsets`; a missing one is an error."""
    test = report.get("test", {})
    found = test.get(subset) or test.get("subsets", {}).get(subset)
    if found is None:
        raise KeyError(f"no report of {subset!r}")
    return found
