"""Queries for ingest, functions, sampling, statistics and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import algebra, text
from ..operators import graph, sampling, statistics
from ..operators import interactions as I
from ..sources import ingest
from .base import query, table
from .evaluation import rounded
from .splits import latest

U = lambda key, seed: f"(CAST(CAST('0x' || substr(md5('{seed}:' || {key}), 1, 13) AS UBIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0"
LATEST = "latest AS (SELECT DISTINCT o_custkey AS user, l_partkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"""WITH {LATEST}, w AS (SELECT *, count(*) OVER (PARTITION BY user) AS du, count(*) OVER (PARTITION BY item) AS di FROM latest)
  SELECT user, item FROM w ORDER BY round(-ln({U("user || ':' || item", 9)}) * sqrt(du * di), 9), user, item LIMIT (SELECT CAST(ceil(count(*) * 0.4) AS BIGINT) FROM latest)""")
def degree_sensitive_sample(spark, sf_dir):
    pairs = latest(spark, sf_dir).select(F.col("user_id").alias("user"), F.col("item_id").alias("item"))
    return sampling.keep_by_degree(pairs, 0.6, 9)


@query("""WITH s AS (SELECT c_nationkey AS market, count(*) AS size FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
  r AS (SELECT *, pow(size, 0.5) / sum(pow(size, 0.5)) OVER () * 1000 AS raw FROM s)
  SELECT market, size, CAST(floor(raw) + CASE WHEN row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, market) <= 1000 - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def market_quota_alpha(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    sizes = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("market")).agg(F.count("*").alias("size"))
    return sampling.alpha_quota(sizes, "market", 1000, 0.5)


@query(f"WITH u AS (SELECT DISTINCT o_custkey AS user FROM orders) SELECT user FROM u ORDER BY {U('user', 0)}, user LIMIT 100")
def capped_user_sample(spark, sf_dir):
    return sampling.capped(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user"), "user", 100, 0)


@query(f"""WITH t AS (SELECT DISTINCT p_partkey AS h, 1 AS r, p_size::BIGINT AS t FROM part UNION SELECT p_partkey, 2, length(p_type)::BIGINT FROM part),
  tails AS (SELECT r, t AS negative, row_number() OVER (PARTITION BY r ORDER BY t) - 1 AS i FROM (SELECT DISTINCT r, t FROM t)), n AS (SELECT r, count(*) AS n FROM tails GROUP BY 1),
  d AS (SELECT h, t.r, t.t, k, CAST(floor({U("h || ':' || t.r || ':' || t.t || ':' || k", 4)} * n) AS BIGINT) AS i FROM t JOIN n ON t.r = n.r, (SELECT unnest([0, 1, 2, 3]) AS k)),
  drawn AS (SELECT h, r, t, negative FROM (SELECT d.h, d.r, d.t, k, negative FROM d JOIN tails ON d.r = tails.r AND d.i = tails.i
    WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.h = d.h AND x.r = d.r AND x.t = negative)) QUALIFY row_number() OVER (PARTITION BY h, r, t ORDER BY k) = 1),
  lacked AS (SELECT o.h, o.r, o.t, tails.negative, row_number() OVER (PARTITION BY o.h, o.r, o.t ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY o.h, o.r, o.t) AS m
    FROM (SELECT t.* FROM t LEFT JOIN drawn USING (h, r, t) WHERE drawn.negative IS NULL) o JOIN tails ON o.r = tails.r WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.h = o.h AND x.r = o.r AND x.t = tails.negative))
  FROM drawn UNION ALL SELECT h, r, t, negative FROM lacked WHERE pos = CAST(floor({U("h || ':' || r || ':' || t || ':4'", 4)} * m) AS BIGINT)""")
def kg_negatives(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = p.select(F.col("p_partkey").alias("h"), F.lit(1).alias("r"), F.col("p_size").cast("long").alias("t")).unionByName(p.select(F.col("p_partkey").alias("h"), F.lit(2).alias("r"), F.length("p_type").cast("long").alias("t")))
    return sampling.negative_tails(t.distinct(), 4)


RUNS = """runs AS (SELECT o_orderpriority AS variant, o_custkey AS seed, avg(o_totalprice) / 1000 AS value FROM orders GROUP BY 1, 2)"""


def runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("variant"), F.col("o_custkey").alias("seed")).agg((F.avg("o_totalprice") / 1000).alias("value"))


@query(f"""WITH {RUNS}, p AS (SELECT a.variant, a.value - b.value AS d FROM runs a JOIN runs b ON a.seed = b.seed AND b.variant = (SELECT min(variant) FROM runs) AND a.variant <> b.variant)
  SELECT variant, count(*) AS n, round(avg(d), 6) AS mean, round(coalesce(stddev_samp(d), 0), 6) AS sd, round(avg(d) / nullif(round(stddev_samp(d), 12), 0), 6) AS dz FROM p GROUP BY 1""")
def paired_effect_size(spark, sf_dir):
    r = runs(spark, sf_dir)
    first = r.agg(F.min("variant").alias("base"))
    base = r.join(F.broadcast(first), r.variant == first.base).select("seed", F.col("value").alias("base_value"))
    d = r.join(F.broadcast(first), r.variant != first.base).join(base, "seed").withColumn("d", F.col("value") - F.col("base_value"))
    return rounded(statistics.effect(d, ["variant"]), "mean", "sd", "dz", digits=6)


@query(f"""WITH {RUNS} SELECT variant, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, round(min(value), 6) AS least, round(max(value), 6) AS most FROM runs GROUP BY 1""")
def variant_summaries(spark, sf_dir):
    r = runs(spark, sf_dir).groupBy("variant").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"))
    return rounded(r, "mean", "sd", "least", "most", digits=6)


@query()
def paired_bootstrap(spark, sf_dir):
    """Rows-only: 95 % interval of the difference between two order priorities over 10,000 resamples."""
    r = runs(spark, sf_dir)
    a, b = (r.where(F.col("variant").startswith(x)).select("seed", F.col("value").alias(v)) for x, v in (("1", "a"), ("5", "b")))
    return statistics.bootstrap(a.join(b, "seed").select("seed", (F.col("a") - F.col("b")).alias("d")), "seed", 10_000, 11)


@query("""WITH c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value FROM events),
  n AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c),
  f AS (SELECT *, max(CASE WHEN m IS NULL OR value > m THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS last FROM n),
  s AS (SELECT *, max(CAST(epoch - last >= 5 AS INT)) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM f)
  SELECT user_id, max(epoch) AS best_epoch, max(value) AS best FROM s WHERE coalesce(stop, 0) = 0 AND (m IS NULL OR value > m) GROUP BY 1""")
def best_epoch_patience(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    curve = e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("epoch"), "value")
    return statistics.best_epoch(curve, ["user_id"], "epoch", "value", 5)


@query("""SELECT p_partkey AS item, list_distinct_sorted AS tags, len(w) AS n, w[greatest(len(w) - 1, 1):] AS last_two, (SELECT arg_min(x, k) FROM (SELECT x, (-count(*), min(i)) AS k FROM (SELECT unnest(w) AS x, generate_subscripts(w, 1) AS i) GROUP BY x)) AS mode
  FROM (SELECT p_partkey, string_split(p_type || ' ' || p_brand || ' ' || p_type, ' ') AS w, list_sort(list_distinct(string_split(p_type || ' ' || p_brand, ' '))) AS list_distinct_sorted FROM part)""")
def tag_functions(spark, sf_dir):
    w = F.split(F.concat_ws(" ", "p_type", "p_brand", "p_type"), " ")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.array_sort(F.array_distinct(w)).alias("tags"), F.size(w).cast("long").alias("n"), text.last_n(w, 2).alias("last_two"), text.first_mode(w).alias("mode"))


@query("""WITH x AS (SELECT p_partkey AS item, unnest(string_split(p_type, ' ')) AS market FROM part)
  SELECT market, count(*) AS rows_written, count(DISTINCT item) AS unique_items FROM (SELECT DISTINCT item, market FROM x) GROUP BY 1""")
def market_fan_out(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("code", F.col("p_partkey").cast("string"))
    return ingest.fan_out(p, F.split("p_type", " ")).groupBy("market").agg(F.count("*").alias("rows_written"), F.count_distinct("p_partkey").alias("unique_items"))


@query("""WITH x AS (SELECT doc_id, 'code' || (doc_id % 300) AS code, source, lang, text FROM documents)
  SELECT code, doc_id, lang FROM x QUALIFY row_number() OVER (PARTITION BY code ORDER BY CAST(substr(source, 4) AS INT), doc_id) = 1""")
def barcode_dedup(spark, sf_dir):
    x = table(spark, sf_dir, "documents").withColumn("code", F.concat(F.lit("code"), (F.col("doc_id") % 300).cast("string")))
    return ingest.first_by_code(x, [F.substring("source", 4, 9).cast("int"), F.col("doc_id")]).select("code", "doc_id", "lang")


@query("""SELECT lang, count(*) AS n, round(avg(CAST(text <> '' AS INT)), 9) AS text_rate, round(avg(CAST(quality IS NOT NULL AS INT)), 9) AS label_rate, round(avg(CAST(coalesce(quality, 0) = 1 AS INT)), 9) AS good_rate
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def fill_rates(spark, sf_dir):
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rate = lambda c, n: F.round(F.avg(c.cast("int")), 9).alias(n)
    return x.groupBy("lang").agg(F.count("*").alias("n"), rate(F.col("text") != "", "text_rate"), rate(F.col("quality").isNotNull(), "label_rate"), rate(F.coalesce("quality", F.lit(0)) == 1, "good_rate"))


@query("""WITH v AS (SELECT language, n, row_number() OVER (ORDER BY n DESC, first) AS place FROM (SELECT lang AS language, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1)) SELECT * FROM v""")
def language_histogram(spark, sf_dir):
    from pyspark.sql import Window

    x = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).drop("first")


@query("""WITH e AS (SELECT user_id, event_type, value, event_id FROM events) SELECT doc.user_id, doc.event_type, doc.best, doc.n FROM (SELECT user_id, event_type, max(value) AS best, count(*) AS n FROM e GROUP BY ROLLUP(user_id, event_type)) doc""")
def grouping_sets(spark, sf_dir):
    return table(spark, sf_dir, "events").rollup("user_id", "event_type").agg(F.max("value").alias("best"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_returnflag = 'R')
  SELECT 'both' AS part, item FROM (FROM a INTERSECT FROM r) UNION ALL SELECT 'only_a', item FROM (FROM a EXCEPT FROM r) UNION ALL SELECT 'only_r', item FROM (FROM r EXCEPT FROM a)""")
def set_operations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, r = (li.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("item")) for x in "AR")
    tag = lambda d, n: d.select(F.lit(n).alias("part"), "item")
    return tag(a.intersect(r), "both").unionByName(tag(a.subtract(r), "only_a")).unionByName(tag(r.subtract(a), "only_r"))


@query("""WITH e AS (SELECT vec_id, embedding[1:8] AS u, embedding[9:16] AS i, embedding[17:20] AS uv, embedding[21:24] AS iv FROM embeddings)
  SELECT vec_id, round(list_sum([u[k]::DOUBLE * i[k]::DOUBLE FOR k IN range(1, 9)]), 6) AS bpr_score,
    round(list_sum([u[k]::DOUBLE * i[k]::DOUBLE FOR k IN range(1, 9)]) + CASE WHEN vec_id % 3 <> 0 THEN list_sum([uv[k]::DOUBLE * iv[k]::DOUBLE FOR k IN range(1, 5)]) ELSE 0 END, 6) AS visual_score FROM e""")
def factor_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[F.slice("embedding", a, n).alias(c) for c, a, n in (("u", 1, 8), ("i", 9, 8), ("uv", 17, 4), ("iv", 21, 4))])
    mask = F.col("vec_id") % 3 != 0
    return rounded(e.select("vec_id", graph.dot(F.col("u"), F.col("i")).alias("bpr_score"), algebra.visual_score(F.col("u"), F.col("i"), F.col("uv"), F.col("iv"), mask).alias("visual_score")), "bpr_score", "visual_score", digits=6)


@query("""WITH e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding[1:4]] AS s, [vec_id % 2 = 0, true, vec_id % 3 = 0, false] AS m FROM embeddings),
  x AS (SELECT vec_id, [CASE WHEN m[k] THEN exp(s[k]) ELSE 0 END FOR k IN range(1, 5)] AS x FROM e) SELECT vec_id, [round(v / list_sum(x), 6) FOR v IN x] AS weights FROM x""")
def residual_weights(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("s"))
    mask = F.array(F.col("vec_id") % 2 == 0, F.lit(True), F.col("vec_id") % 3 == 0, F.lit(False))
    return e.select("vec_id", F.transform(algebra.masked_softmax(F.col("s"), mask), lambda v: F.round(v, 6)).alias("weights"))


@query("""SELECT event_id, CASE WHEN v IN ('', '-', 'none', 'null', 'nan') THEN NULL ELSE coalesce(TRY_CAST(raw AS DOUBLE), epoch_us(TRY_CAST(raw AS TIMESTAMP)) / 1e6) END AS seconds
  FROM (SELECT event_id, raw, lower(trim(raw)) AS v FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '-' WHEN 1 THEN 'None' WHEN 2 THEN CAST(event_id * 10 AS VARCHAR) WHEN 3 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw FROM events))""")
def timestamp_values(spark, sf_dir):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "-").when(k == 1, "None").when(k == 2, (F.col("event_id") * 10).cast("string")).when(k == 3, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", text.timestamp_value(raw).alias("seconds"))


@query("""WITH v AS (SELECT user_id, event_type, max(ts) AS t FROM events GROUP BY 1, 2), n AS (SELECT event_type AS market, count(*) AS interactions, count(DISTINCT user_id) AS users FROM v GROUP BY 1) SELECT * FROM n""")
def market_counts(spark, sf_dir):
    v = I.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")
    return v.groupBy(F.col("event_type").alias("market")).agg(F.count("*").alias("interactions"), F.count_distinct("user_id").alias("users"))
