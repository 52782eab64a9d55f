"""Queries over interactions: dedup, cores, splits, dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import interactions as I
from .base import INTER, LATEST, interactions, query, table

CORE, ROUNDS = 20, 12
_CORE_SQL = f"WITH {INTER}, c0 AS (SELECT DISTINCT user_id, item_id FROM inter)" + "".join(
    f""", c{i + 1} AS MATERIALIZED (SELECT * FROM c{i} WHERE user_id IN (SELECT user_id FROM c{i} GROUP BY 1 HAVING count(*) >= {CORE})
  AND item_id IN (SELECT item_id FROM c{i} GROUP BY 1 HAVING count(*) >= {CORE}))"""
    for i in range(ROUNDS)
)
#: Times with gaps, so that some users fall back to hash order.
GAPS = f"{LATEST}, gaps AS (SELECT user_id, item_id, CASE WHEN (user_id * 31 + item_id) % 200 = 0 THEN NULL ELSE ts END AS ts FROM latest)"
TWO = f"""{GAPS}, w AS (SELECT *, bool_and(ts IS NOT NULL) OVER (PARTITION BY user_id) AS timed, count(*) OVER (PARTITION BY user_id) AS n,
    substr(sha256('17:' || user_id || ':' || item_id), 1, 16) AS h FROM gaps),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN timed THEN ts END, CASE WHEN NOT timed THEN h END, item_id) AS place FROM w),
  two AS (SELECT user_id, item_id, CASE WHEN n >= 3 AND place = n THEN 'test' WHEN n >= 3 AND place = n - 1 THEN 'val' ELSE 'train' END AS split FROM p)"""
RATIO = f"""{LATEST}, r0 AS (SELECT user_id, item_id, count(*) OVER (PARTITION BY user_id) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY substr(sha256('5:' || user_id || ':' || item_id), 1, 16), item_id) AS p FROM latest),
  r1 AS (SELECT *, floor(n * 0.45::DOUBLE) AS t, floor(n * 0.45::DOUBLE) AS v FROM r0),
  ratio AS (SELECT user_id, item_id, CASE WHEN p <= t THEN 'test' WHEN p <= t + v THEN 'val' ELSE 'train' END AS split FROM r1)"""
DEGREE = f"{LATEST}, degree AS (SELECT p_partkey AS item_id, count(user_id) AS degree FROM part LEFT JOIN latest ON p_partkey = item_id GROUP BY 1)"


def latest(spark, sf_dir):
    return I.latest(interactions(spark, sf_dir), ["user_id", "item_id"], "ts")


def gapped(spark, sf_dir):
    gap = (F.col("user_id") * 31 + F.col("item_id")) % 200 == 0
    return latest(spark, sf_dir).withColumn("ts", F.when(~gap, F.col("ts")))


def two_out(spark, sf_dir):
    return I.leave_two_out(gapped(spark, sf_dir), ["user_id"], "item_id", "ts", 17).select("user_id", "item_id", "split")


def ratio(spark, sf_dir):
    return I.ratio_split(latest(spark, sf_dir).select("user_id", "item_id"), "user_id", "item_id", 0.45, 0.45, 5)


def item_degrees(spark, sf_dir):
    return I.degrees(latest(spark, sf_dir), "item_id", table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id")))


@query(f"WITH {LATEST} SELECT * FROM latest")
def latest_interaction(spark, sf_dir):
    return latest(spark, sf_dir)


@query(f"{_CORE_SQL} SELECT user_id, item_id FROM c{ROUNDS}")
def kcore_filter(spark, sf_dir):
    return I.k_core(interactions(spark, sf_dir), "user_id", "item_id", CORE)


@query(f"WITH {DEGREE} SELECT item_id, degree FROM degree")
def degree_with_zeros(spark, sf_dir):
    return item_degrees(spark, sf_dir)


@query(f"WITH {TWO} SELECT user_id, item_id, split FROM two")
def leave_two_out(spark, sf_dir):
    return two_out(spark, sf_dir)


@query("SELECT p_partkey AS item_id, CAST(CAST('0x' || substr(sha256('2026:' || p_partkey), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS fraction FROM part")
def stable_fractions(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), X.stable_fraction(F.col("p_partkey").cast("string"), 2026).alias("fraction"))


#: Strata are large beside the places, so a stratum is never full and one place each is left to deal.
COLD = f"""{DEGREE}, b AS (SELECT *, CAST(floor(log2(greatest(degree, 1))) AS INT) AS bucket FROM degree),
  z AS (SELECT bucket, count(*) AS size FROM b GROUP BY 1), zt AS (SELECT *, round_even(sum(size) OVER () * 0.05::DOUBLE, 0) AS total FROM z),
  zi AS (SELECT *, total * size / sum(size) OVER () AS ideal FROM zt),
  zv AS (SELECT *, floor(ideal) + CASE WHEN row_number() OVER (ORDER BY round(ideal - floor(ideal), 9) DESC, bucket) <= total - sum(floor(ideal)) OVER () THEN 1 ELSE 0 END AS nv FROM zi),
  zf AS (SELECT *, least(floor(ideal), size - nv) AS base FROM zv), zr AS (SELECT *, total - sum(base) OVER () AS rest FROM zf),
  zn AS (SELECT *, base + CASE WHEN base < size - nv AND row_number() OVER (ORDER BY base >= size - nv, round(ideal - base, 9) DESC, bucket) <= rest THEN 1 ELSE 0 END AS nt FROM zr),
  zp AS (SELECT b.*, nv, nt, row_number() OVER (PARTITION BY bucket ORDER BY substr(sha256('3:us:' || item_id), 1, 16), item_id) AS p FROM b JOIN zn USING (bucket)),
  cold AS (SELECT item_id, degree, bucket, CASE WHEN p <= nv THEN 'cold_val' ELSE 'cold_test' END AS split FROM zp WHERE p <= nv + nt)"""


def cold(spark, sf_dir):
    return I.cold_items(item_degrees(spark, sf_dir), "item_id", 0.05, 3, "us:")


@query(f"WITH {COLD} SELECT * FROM cold")
def stratified_cold_items(spark, sf_dir):
    return cold(spark, sf_dir)


@query(f"""WITH {COLD}, gaps AS (SELECT user_id, item_id, CASE WHEN (user_id * 31 + item_id) % 200 = 0 THEN NULL ELSE ts END AS ts FROM latest),
  warm AS (SELECT * FROM gaps WHERE item_id NOT IN (SELECT item_id FROM cold)),
  w AS (SELECT *, bool_and(ts IS NOT NULL) OVER (PARTITION BY user_id) AS timed, count(*) OVER (PARTITION BY user_id) AS n, substr(sha256('3:us:' || user_id || ':' || item_id), 1, 16) AS h FROM warm),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN timed THEN ts END, CASE WHEN NOT timed THEN h END, item_id) AS place FROM w)
  SELECT user_id, item_id, CASE WHEN n >= 3 AND place = n THEN 'test' WHEN n >= 3 AND place = n - 1 THEN 'val' ELSE 'train' END AS split FROM p
  UNION ALL SELECT user_id, gaps.item_id, cold.split FROM gaps JOIN cold ON gaps.item_id = cold.item_id""")
def chronological_split(spark, sf_dir):
    rows = gapped(spark, sf_dir).withColumn("market", F.lit("us"))
    held = cold(spark, sf_dir).withColumn("market", F.lit("us"))
    return I.chronological_split(rows, "market", "user_id", "item_id", "ts", held, 3).select("user_id", "item_id", "split")


@query(f"""WITH {DEGREE}, n AS (SELECT count(*) AS n FROM degree WHERE degree > 0), c AS (SELECT n, least(CAST(floor(n * 0.1::DOUBLE) AS BIGINT), n - 1) AS cold FROM n),
  p AS (SELECT item_id, row_number() OVER (ORDER BY substr(sha256('9:' || item_id), 1, 16), item_id) AS p FROM degree WHERE degree > 0)
  SELECT item_id, CASE WHEN p <= round_even(cold * 0.25::DOUBLE, 0) THEN 'cold_val' ELSE 'cold_test' END AS split FROM p, c WHERE p <= cold""")
def cold_sample(spark, sf_dir):
    return I.cold_sample(item_degrees(spark, sf_dir), "item_id", 0.1, 0.25, 9)


@query(f"WITH {COLD} SELECT user_id, item_id FROM latest WHERE item_id NOT IN (SELECT item_id FROM cold)")
def without_cold_items(spark, sf_dir):
    return latest(spark, sf_dir).select("user_id", "item_id").join(cold(spark, sf_dir), "item_id", "left_anti").select("user_id", "item_id")


@query(f"""WITH {COLD}, r AS (SELECT user_id, item_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY substr(sha256('5:' || user_id || ':' || item_id), 1, 16), item_id) AS p FROM latest),
  ratio AS (SELECT user_id, item_id, CASE WHEN p <= floor(n * 0.45::DOUBLE) THEN 'test' WHEN p <= 2 * floor(n * 0.45::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r),
  missing AS (SELECT item_id FROM ratio GROUP BY 1 HAVING count(*) FILTER (split = 'train') = 0),
  firsts AS (SELECT item_id, user_id FROM ratio JOIN missing USING (item_id) WHERE item_id NOT IN (SELECT item_id FROM cold)
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY CASE split WHEN 'val' THEN 0 ELSE 1 END, user_id) = 1)
  SELECT r.user_id, r.item_id, CASE WHEN f.user_id IS NOT NULL THEN 'train' ELSE r.split END AS split FROM ratio r LEFT JOIN firsts f ON r.item_id = f.item_id AND r.user_id = f.user_id""")
def warm_repair_but_cold(spark, sf_dir):
    return I.repair_warm(ratio(spark, sf_dir), "user_id", "item_id", cold(spark, sf_dir).select("item_id"))


@query(f"""WITH {TWO} SELECT user_id, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM two WHERE split <> 'train' GROUP BY 1""")
def merged_user_positives(spark, sf_dir):
    rows = two_out(spark, sf_dir)
    both = I.merged_positives([rows.where("split = 'val'"), rows.where("split = 'test'")], "user_id", "item_id")
    return both.select("user_id", F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).alias("items"))


@query(f"WITH {COLD}, {TWO.split('latest AS', 1)[1].split('), ', 1)[1]} SELECT user_id, item_id FROM two WHERE split = 'test' AND item_id IN (SELECT item_id FROM cold)")
def positives_of_cold_items(spark, sf_dir):
    return I.only_items(two_out(spark, sf_dir).where("split = 'test'").select("user_id", "item_id"), cold(spark, sf_dir), "item_id")


@query(f"WITH {RATIO} SELECT user_id, item_id, split FROM ratio")
def ratio_split(spark, sf_dir):
    return ratio(spark, sf_dir)


@query(f"""WITH {RATIO}, missing AS (SELECT item_id FROM ratio GROUP BY 1 HAVING count(*) FILTER (split = 'train') = 0),
  firsts AS (SELECT item_id, user_id FROM ratio JOIN missing USING (item_id)
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY CASE split WHEN 'val' THEN 0 ELSE 1 END, user_id) = 1)
  SELECT r.user_id, r.item_id, CASE WHEN f.user_id IS NOT NULL THEN 'train' ELSE r.split END AS split
  FROM ratio r LEFT JOIN firsts f ON r.item_id = f.item_id AND r.user_id = f.user_id""")
def warm_repair(spark, sf_dir):
    return I.repair_warm(ratio(spark, sf_dir), "user_id", "item_id")


@query(f"""WITH {TWO.replace("two AS (", "two AS MATERIALIZED (")}, known AS (SELECT DISTINCT user_id FROM two WHERE split = 'train')
  SELECT two.* FROM two JOIN known USING (user_id) WHERE split <> 'train'""")
def held_out_of_known_users(spark, sf_dir):
    rows = two_out(spark, sf_dir)
    known = rows.where("split = 'train'").select("user_id")
    return rows.where("split <> 'train'").join(known, "user_id", "left_semi")


@query(f"WITH {TWO}, trained AS (SELECT DISTINCT item_id FROM two WHERE split = 'train') SELECT p_partkey AS item_id FROM part LEFT JOIN trained ON p_partkey = item_id WHERE item_id IS NULL")
def zero_train_items(spark, sf_dir):
    train = two_out(spark, sf_dir).where("split = 'train'")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id")).join(train, "item_id", "left_anti")


@query("SELECT key, row_number() OVER (ORDER BY key) - 1 AS id FROM (SELECT DISTINCT p_type || '/' || p_brand AS key FROM part)")
def dictionary_encode(spark, sf_dir):
    return I.dictionary(table(spark, sf_dir, "part"), F.concat_ws("/", "p_type", "p_brand"))


@query(f"""WITH {TWO}, dirty AS (SELECT * FROM two UNION ALL SELECT user_id, item_id, 'val' FROM two WHERE split = 'test' AND user_id % 7 = 0)
  SELECT user_id, item_id, count(DISTINCT split) AS n_splits FROM dirty GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""")
def split_overlap_check(spark, sf_dir):
    rows = two_out(spark, sf_dir)
    dirty = rows.unionByName(rows.where("split = 'test' and user_id % 7 = 0").withColumn("split", F.lit("val")))
    return I.overlaps(dirty, ["user_id", "item_id"])


@query(f"""WITH {DEGREE}, b AS (SELECT CAST(floor(log2(greatest(degree, 1))) AS INT) AS bucket, count(*) AS size FROM degree GROUP BY 1),
  q AS (SELECT *, 101.0::DOUBLE * size / sum(size) OVER () AS raw FROM b)
  SELECT bucket, size, CAST(floor(raw) + CASE WHEN row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, bucket) <= 101 - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q""")
def proportional_quota(spark, sf_dir):
    sizes = item_degrees(spark, sf_dir).groupBy(F.floor(F.log2(F.greatest("degree", F.lit(1)))).cast("int").alias("bucket")).agg(F.count("*").alias("size"))
    return I.quotas(101, sizes, "bucket", "size")
