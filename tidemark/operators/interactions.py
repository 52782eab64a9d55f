"""Interactions: latest-wins dedup, k-core, splits and their repair, dictionaries."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stable_order


def with_checkpoints(spark: SparkSession) -> None:
    """The cluster's shared folder. Where none is set, a local session gets a folder of its own; a cluster
    gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the cluster's shared folder."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint()


class Written:
    """Intermediate tables as Parquet in the shared folder; the shuffle files of a step go when its table
    is written, a table when it is dropped by name."""

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        with_checkpoints(spark)
        self.spark, self.root = spark, f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        before = self.spark.conf.get(self.CLEAN)
        self.spark.conf.set(self.CLEAN, "true")
        try:
            df.write.parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(self.CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for n in names:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def numbered(rows: DataFrame, by: list[str], name: str = "place") -> DataFrame:
    """`rows` with their place from 0 in the order of `by`, nulls first: the place in their range
    partition plus the sizes of those before it, so no task sorts all rows. Rows alike in `by` are
    numbered in any order; an empty table stays empty."""
    rows = checkpointed(rows.repartitionByRange(*by).withColumn("__p", F.spark_partition_id()))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.withColumn("__before", F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*by))
    out = rows.withColumn("__o", own).join(F.broadcast(before.select("__p", "__before")), "__p")
    return out.withColumn(name, (F.col("__o") - 1 + F.coalesce("__before", F.lit(0))).cast("long")).drop("__p", "__o", "__before")


def latest(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The latest time of each key; a combinable maximum, so hot keys shrink before the shuffle."""
    return rows.groupBy(*keys).agg(F.max(ts).alias(ts))


def degrees(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of every id of `ids`, zero where there is none."""
    n = rows.groupBy(key).agg(F.count("*").alias("degree"))
    return ids.select(key).distinct().join(n, key, "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def k_core(pairs: DataFrame, user: str, item: str, least: int, every: int = 4) -> DataFrame:
    """Pairs whose user and item both keep `least` pairs; filters both at once until nothing goes."""
    now, n = checkpointed(pairs.select(user, item).distinct()), -1
    left = now.count()
    while left != n:
        n = left
        for _ in range(every):  # rounds past the fixpoint change nothing
            users = now.groupBy(user).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(user)
            items = now.groupBy(item).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(item)
            now = now.join(users, user, "left_semi").join(items, item, "left_semi")
        now = checkpointed(now)
        left = now.count()
    return now


def leave_two_out(rows: DataFrame, user: list[str], item: str, ts: str, seed: int) -> DataFrame:
    """`split` of every row: a user's last is test, the one before val, the rest train; users of
    fewer than three rows train only. Order is by time and item, or by hash for a user with any
    null time."""
    per = Window.partitionBy(*user)
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in [*user, item]])
    timed = rows.withColumn("__timed", F.min(F.col(ts).isNotNull()).over(per)).withColumn("__n", F.count("*").over(per))
    order = [F.when(F.col("__timed"), F.col(ts)), F.when(~F.col("__timed"), stable_order(key, seed)), F.col(item)]
    place = F.row_number().over(per.orderBy(*order))
    split = F.when((F.col("__n") >= 3) & (F.col("__place") == F.col("__n")), "test").when((F.col("__n") >= 3) & (F.col("__place") == F.col("__n") - 1), "val").otherwise("train")
    return timed.withColumn("__place", place).withColumn("split", split).drop("__timed", "__n", "__place")


def cold_items(degree: DataFrame, item: str, share: float, seed: int, prefix: str = "") -> DataFrame:
    """(item, degree, bucket, split): cold_val and cold_test items, each round(share * items) of them
    (half to even), dealt over strata of floor(log2(degree)) by largest remainders; test within what
    val leaves of a stratum. Within a stratum items come in the order of the hash of `prefix` and the
    item. No item: no row."""
    strata = degree.withColumn("bucket", F.floor(F.log2(F.greatest("degree", F.lit(1)))).cast("int"))
    sizes = strata.groupBy("bucket").agg(F.count("*").alias("size"))  # a row a stratum
    total = F.bround(F.sum("size").over(Window.partitionBy()) * F.lit(share)).cast("long")
    val = quotas(total, sizes, "bucket", "size").withColumnRenamed("quota", "nv")
    both = quotas(total, val.withColumn("room", F.col("size") - F.col("nv")), "bucket", "size", "room").withColumnRenamed("quota", "nt")
    key = stable_order(F.concat(F.lit(prefix), F.col(item).cast("string")), seed)
    places = numbered(strata.withColumn("__h", key), ["bucket", "__h", item], "__place")
    first = places.groupBy("bucket").agg(F.min("__place").alias("__first"))
    x = places.join(F.broadcast(both.join(first, "bucket").select("bucket", "nv", "nt", "__first")), "bucket")
    at = F.col("__place") - F.col("__first")
    split = F.when(at < F.col("nv"), "cold_val").when(at < F.col("nv") + F.col("nt"), "cold_test")
    return x.withColumn("split", split).where("split is not null").select(item, "degree", "bucket", "split")


def cold_sample(degree: DataFrame, item: str, share: float, val_share: float, seed: int) -> DataFrame:
    """(item, split): int(items * share) of the items with interactions, never all of them, in the order
    of a hash; round(that * val_share) of these (at least one, and one less than all, where there are two)
    are cold_val, the others cold_test."""
    seen = degree.where("degree > 0").withColumn("__h", stable_order(F.col(item).cast("string"), seed))
    n = seen.count()
    cold = min(int(n * share), max(n - 1, 0))
    val = min(max(round(cold * val_share), 1), cold - 1) if cold > 1 else cold
    place = numbered(seen.select(item, "__h"), ["__h", item], "__place").where(F.col("__place") < cold)
    return place.select(item, F.when(F.col("__place") < val, "cold_val").otherwise("cold_test").alias("split"))


def chronological_split(rows: DataFrame, market: str, user: str, item: str, ts: str, cold: DataFrame, seed: int) -> DataFrame:
    """`split` of every row: rows of the market's cold items (market, item, split) go with their item;
    the rest of a user's rows in a market are split by `leave_two_out`, so only warm rows count."""
    held = cold.select(F.col(market).alias("__m"), F.col(item).alias("__i"), F.col("split").alias("__cold"))
    x = rows.join(held, (F.col(market) == F.col("__m")) & (F.col(item) == F.col("__i")), "left").drop("__m", "__i")
    warm = leave_two_out(x.where("__cold is null").drop("__cold"), [market, user], item, ts, seed)
    return warm.unionByName(x.where("__cold is not null").withColumnRenamed("__cold", "split"))


def user_positives(rows: DataFrame, user: str, item: str) -> DataFrame:
    """(user, items): each user's distinct items, ascending."""
    return rows.groupBy(user).agg(F.array_sort(F.collect_set(item)).alias("items"))


def merged_positives(parts: list[DataFrame], user: str, item: str) -> DataFrame:
    """The positives of several splits as one list a user."""
    return user_positives(reduce(DataFrame.unionByName, [p.select(user, item) for p in parts]), user, item)


def only_items(positives: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """Rows of the given items; a user without any is gone."""
    return positives.join(items.select(item).distinct(), item, "left_semi").select(*positives.columns)


def ratio_split(pairs: DataFrame, user: str, item: str, val: float, test: float, seed: int) -> DataFrame:
    """Per user int(n * ratio) rows for val and test, by hash order; at least one row trains (the
    larger held-out part gives way, test at a tie)."""
    per = Window.partitionBy(user)
    key = F.concat_ws(":", F.col(user).cast("string"), F.col(item).cast("string"))
    rows = pairs.withColumn("__n", F.count("*").over(per)).withColumn("__p", F.row_number().over(per.orderBy(stable_order(key, seed), item)))
    t, v = F.floor(F.col("__n") * F.lit(test)), F.floor(F.col("__n") * F.lit(val))
    rows = rows.withColumns({"__t": t, "__v": v})
    over = (F.col("__t") + F.col("__v")) >= F.col("__n")
    rows = rows.withColumns({"__t": F.when(over & (F.col("__t") >= F.col("__v")), F.greatest(F.col("__t") - 1, F.lit(0))).otherwise(F.col("__t")), "__v": F.when(over & (F.col("__t") < F.col("__v")), F.col("__v") - 1).otherwise(F.col("__v"))})
    split = F.when(F.col("__p") <= F.col("__t"), "test").when(F.col("__p") <= F.col("__t") + F.col("__v"), "val").otherwise("train")
    return rows.withColumn("split", split).drop("__n", "__p", "__t", "__v")


def repair_warm(split: DataFrame, user: str, item: str, never: DataFrame | None = None) -> DataFrame:
    """Moves, for each item without a training row, its first held-out row (val before test, then the
    smallest user) to train; items of `never` stay."""
    trained = split.where("split = 'train'").select(item).distinct()
    missing = split.select(item).distinct().join(trained, item, "left_anti")
    if never is not None:
        missing = missing.join(never, item, "left_anti")
    held = split.where("split <> 'train'").join(missing, item, "left_semi")
    first = held.groupBy(F.col(item).alias("__i")).agg(F.min(F.struct(F.when(F.col("split") == "val", 0).otherwise(1).alias("k"), F.col(user).alias("u"))).alias("__f"))
    out = split.join(first, F.col(item) == F.col("__i"), "left")
    hit = (F.col(user) == F.col("__f.u")) & (F.col("split") == F.when(F.col("__f.k") == 0, "val").otherwise("test"))
    return out.withColumn("split", F.when(F.coalesce(hit, F.lit(False)), "train").otherwise(F.col("split"))).drop("__i", "__f")


def dictionary(rows: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """(key, id): dense ids from 0 in sorted order; null keys get none."""
    return numbered(rows.select(key.alias(name)).where(F.col(name).isNotNull()).distinct(), [name], "id")


def overlaps(split: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one split."""
    return split.groupBy(*keys).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def quotas(total: int | Column, sizes: DataFrame, key: str, size: str, capacity: str | None = None) -> DataFrame:
    """Shares of `total` in proportion to `size` by largest remainders, ties by key, none above its
    capacity (its size, if none is given); places that a full group can't take go to the next ones of
    the order, round by round. For tables of groups, not of rows."""
    total, cap = (total if isinstance(total, Column) else F.lit(total)), F.col(capacity or size)
    whole = Window.partitionBy()
    ideal = total.cast("double") * F.col(size) / F.sum(size).over(whole)
    x = sizes.withColumn("__ideal", ideal).withColumn("__base", F.least(F.floor("__ideal"), cap))
    x = x.withColumn("__left", total - F.sum("__base").over(whole)).withColumn("__rest", F.round(F.col("__ideal") - F.col("__base"), 9))
    # a place of round j (from 1) exists for a group with room for j more; the first `left` of all are taken
    room = F.least(cap - F.col("__base"), F.col("__left")).cast("long")
    seats = x.where(room >= 1).withColumn("__j", F.explode(F.sequence(F.lit(1).cast("long"), room)))
    seats = seats.withColumn("__n", F.row_number().over(Window.orderBy("__j", F.desc("__rest"), key))).where("__n <= __left")
    more = seats.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__more"))
    out = x.join(more, F.col(key) == F.col("__k"), "left")
    return out.withColumn("quota", (F.col("__base") + F.coalesce("__more", F.lit(0))).cast("long")).drop("__ideal", "__base", "__left", "__rest", "__k", "__more")
