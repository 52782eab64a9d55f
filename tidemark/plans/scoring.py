"""Queries for samplers, representations, full-catalog scores and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, ranking, sampling, scoring, statistics
from . import evaluation, splits
from .base import query, table
from .evaluation import KG, rounded, triples
from .preparation import RUNS, U, runs
from .splits import COLD, TWO

HOME = "home AS (SELECT c_custkey AS user, n_regionkey AS market FROM customer JOIN nation ON c_nationkey = n_nationkey)"
POOL = """tr AS (SELECT DISTINCT o_custkey AS user, l_partkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N'), {home},
  own AS (SELECT user, item, market FROM tr JOIN home USING (user)), cat AS (SELECT DISTINCT market, item FROM own UNION SELECT p_size % 5, p_partkey FROM part),
  tails AS (SELECT market, item AS negative, row_number() OVER (PARTITION BY market ORDER BY item) - 1 AS i FROM cat WHERE item IN (SELECT item FROM tr)), n AS (SELECT market, count(*) AS n FROM tails GROUP BY 1)""".format(home=HOME)


def homes(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("user"), F.col("n_regionkey").alias("market"))


def trained(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).distinct()


KEY = "o.user || ':' || o.market || ':' || o.item || ':' || "


@query(f"""WITH {POOL}, d AS (SELECT o.user, o.item, o.market, k, CAST(floor({U(KEY + 'k', 11)} * n) AS BIGINT) AS i FROM own o JOIN n USING (market), (SELECT unnest([0, 1, 2, 3]) AS k)),
  drawn AS (SELECT d.user, d.item, d.market, negative FROM d JOIN tails ON d.market = tails.market AND d.i = tails.i
    WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user = d.user AND tr.item = negative) QUALIFY row_number() OVER (PARTITION BY d.user, d.item ORDER BY k) = 1),
  lacked AS (SELECT o.user, o.item, negative, o.market, row_number() OVER (PARTITION BY o.user, o.item ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY o.user, o.item) AS m
    FROM (SELECT own.* FROM own LEFT JOIN drawn USING (user, item) WHERE drawn.negative IS NULL) o JOIN tails USING (market) WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user = o.user AND tr.item = negative))
  SELECT user, item, negative FROM drawn UNION ALL SELECT user, item, negative FROM lacked o WHERE pos = CAST(floor({U(KEY + "'4'", 11)} * m) AS BIGINT)""")
def bpr_negatives(spark, sf_dir):
    pairs, home = trained(spark, sf_dir), homes(spark, sf_dir)
    sold = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("market"), F.col("p_partkey").alias("item"))
    catalog = pairs.join(home, "user").select("market", "item").unionByName(sold)
    return sampling.bpr_pairs(pairs, home, catalog, 11)


@query(f"""WITH {POOL}, z AS (SELECT market, count(*) AS size, sqrt(count(*)) AS w FROM own GROUP BY 1), q0 AS (SELECT *, w / sum(w) OVER () * sum(size) OVER () AS raw, sum(size) OVER () AS total FROM z),
  q AS (SELECT *, CAST(floor(raw) + CASE WHEN row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, market) <= total - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q0),
  p AS (SELECT own.*, row_number() OVER (PARTITION BY market ORDER BY {U("user || ':' || item", 12)}, user, item) - 1 AS pos FROM own)
  SELECT user, item, market, unnest(range(CAST(quota // size + CASE WHEN pos < quota % size THEN 1 ELSE 0 END AS BIGINT))) AS pass FROM p JOIN q USING (market)""")
def epoch_pairs(spark, sf_dir):
    return sampling.epoch_draw(trained(spark, sf_dir).join(homes(spark, sf_dir), "user"), "market", 0.5, 12)


@query(f"WITH {POOL}, p AS (SELECT user, item, row_number() OVER (ORDER BY user, item) - 1 AS pos FROM tr) SELECT user, item, pos // 64 AS batch, pos // 64 // 4 AS macro FROM p")
def macro_batches(spark, sf_dir):
    return sampling.macro_batches(trained(spark, sf_dir), ["user", "item"], 64, 200)


@query(f"""WITH {KG}, {POOL.split(', home AS', 1)[0]}, du AS (SELECT user, count(*) AS n FROM tr GROUP BY 1), di AS (SELECT item, count(*) AS n FROM tr GROUP BY 1),
  w AS (SELECT user, item, round(-ln({U("user || ':' || item", 13)}) * sqrt(du.n * di.n), 9) AS k FROM tr JOIN du USING (user) JOIN di USING (item)),
  kept AS (SELECT user + 300000 AS src, item AS dst, 0 AS type FROM w QUALIFY row_number() OVER (ORDER BY k, user, item) <= ceil(count(*) OVER () * (1 - 0.3::DOUBLE))),
  fwd AS (FROM kept UNION ALL SELECT h, t, r FROM kg) SELECT * FROM fwd UNION ALL SELECT dst, src, type + 3 FROM fwd""")
def training_graph(spark, sf_dir):
    kept = sampling.keep_by_degree(trained(spark, sf_dir), 0.3, 13)
    return graph.collaborative(triples(spark, sf_dir), kept, 2, 300_000)


@query(f"WITH {KG} SELECT h, r, t, r - 1 AS place FROM kg UNION ALL SELECT t, r + 3, h, r + 1 FROM kg")
def kg_both_ways(spark, sf_dir):
    both = scoring.both_ways(triples(spark, sf_dir), 2)
    return both.withColumn("place", scoring.compact_relation(F.col("r"), 2))


EDGES = f"""{KG}, i AS (SELECT DISTINCT o_custkey + 300000 AS src, l_partkey AS dst, 0 AS type FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'),
  fwd AS (SELECT * FROM i UNION ALL SELECT h, t, r FROM kg), e AS (SELECT *, (src * 3 + dst) % 7 / 5.0::DOUBLE AS logit FROM (SELECT * FROM fwd UNION ALL SELECT dst, src, type + 3 FROM fwd)),
  hy AS (SELECT src, dst, type, 1 / sqrt(count(*) OVER (PARTITION BY src) * count(*) OVER (PARTITION BY dst)) AS weight FROM e WHERE type IN (0, 3)
    UNION ALL SELECT src, dst, type, 0.3::DOUBLE * exp(logit) / sum(exp(logit)) OVER (PARTITION BY dst) FROM e WHERE type NOT IN (0, 3))"""


def hybrid(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    pairs = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).distinct()
    edges = graph.collaborative(triples(spark, sf_dir), pairs, 2, 300_000)
    return scoring.hybrid_weights(edges.withColumn("logit", (F.col("src") * 3 + F.col("dst")) % 7 / 5.0), 2, 0.3)


@query(f"WITH {EDGES} SELECT src, dst, type, round(weight, 9) AS weight FROM hy")
def hybrid_edge_weights(spark, sf_dir):
    return rounded(hybrid(spark, sf_dir), "weight")


X0 = "x0 AS (SELECT DISTINCT src AS node, dim, ((src * 7 + dim * 3) % 11 - 4) / 10.0::DOUBLE AS value FROM hy, (SELECT unnest([0, 1]) AS dim))"


@query(f"""WITH {EDGES}, {X0}, x1 AS (SELECT dst AS node, dim, sum(weight * value) AS value FROM hy JOIN x0 ON src = node GROUP BY 1, 2),
  x2 AS (SELECT dst AS node, dim, sum(weight * value) AS value FROM hy JOIN x1 ON src = node GROUP BY 1, 2),
  l AS (SELECT *, 0 AS layer FROM x0 UNION ALL SELECT *, 1 FROM x1 UNION ALL SELECT *, 2 FROM x2)
  SELECT node, dim + 2 * layer AS dim, round(value / greatest(sqrt(sum(value * value) OVER (PARTITION BY node, layer)), 1e-12), 7) AS value FROM l""")
def propagated_layers(spark, sf_dir):
    edges = hybrid(spark, sf_dir)
    x0 = edges.select(F.col("src").alias("node")).distinct().withColumn("dim", F.explode(F.array(F.lit(0), F.lit(1))))
    x0 = x0.withColumn("value", ((F.col("node") * 7 + F.col("dim") * 3) % 11 - 4) / 10.0)
    return rounded(scoring.propagated(edges, x0, 2, 2), "value", digits=7)


@query("""WITH g AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings WHERE vec_id % 3 = 0 AND vec_id + 1 IN (SELECT vec_id FROM embeddings)), e AS (SELECT a AS src, b AS dst FROM g UNION SELECT b, a FROM g),
  x0 AS (SELECT vec_id AS node, d AS dim, embedding[d + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest([0, 1, 2]) AS d)), x1 AS (SELECT dst AS node, dim, sum(value) AS value FROM e JOIN x0 ON src = node GROUP BY 1, 2),
  s AS (SELECT node, dim + 3 AS dim, value / greatest(sqrt(sum(value * value) OVER (PARTITION BY node)), 1e-12) AS value FROM x1)
  SELECT node, dim, round(sum(value), 7) AS value FROM (SELECT * FROM x0 UNION ALL SELECT node, dim, 0.5 * value FROM s) GROUP BY 1, 2""")
def item_graph_side_branch(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    x0 = scoring.long_form(v.withColumn("x", F.slice("embedding", 1, 3)), "vec_id", "x")
    g = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    g = g.join(v.select(F.col("vec_id").alias("b")), "b", "left_semi")
    edges = graph.sym_norm(graph.symmetric(g)).select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    return rounded(scoring.added(x0, scoring.item_graph(edges, x0, 1, 2, 3), 0.5), "value", digits=7)


@query("""WITH v AS (SELECT label AS item, embedding[1:4] AS x FROM embeddings WHERE vec_id % 4 <> 0) SELECT item AS node, d AS dim, round(avg(x[d + 1]::DOUBLE), 9) AS value FROM v, (SELECT unnest([0, 1, 2, 3]) AS d) GROUP BY 1, 2""")
def pooled_views(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("item"), (F.col("vec_id") % 4 != 0).alias("keep"), F.slice("embedding", 1, 4).alias("x"))
    return rounded(scoring.pooled(v, "item", "keep", "x"), "value")


@query(f"WITH {COLD}, tr AS (SELECT DISTINCT l_partkey AS item_id FROM lineitem WHERE l_linenumber = 6) SELECT p_partkey AS item_id, CAST(cold.item_id IS NULL AND tr.item_id IS NOT NULL AS INT) AS keep FROM part LEFT JOIN cold ON cold.item_id = p_partkey LEFT JOIN tr ON tr.item_id = p_partkey")
def item_id_keep(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber = 6").select(F.col("l_partkey").alias("item_id"))
    return scoring.id_keep(items, "item_id", splits.cold(spark, sf_dir), rows)


LINKS = """l AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey > a.n_nationkey WHERE a.n_nationkey < 20 AND b.n_nationkey < 20),
  s AS (SELECT a, b FROM l UNION SELECT b, a FROM l)"""


def links(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    side = lambda x: n.select(F.col("n_name").alias(f"name_{x}"), F.col("n_nationkey").alias(f"k{x}"), "n_regionkey")
    pairs = side("a").join(side("b"), "n_regionkey").where("kb > ka")
    return scoring.country_links(pairs, n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")))


@query(f"WITH {LINKS} SELECT a, b FROM s")
def country_links(spark, sf_dir):
    return links(spark, sf_dir)


TABLE = f"""{LINKS}, f AS (SELECT n_nationkey AS node, d AS dim, ((n_nationkey * 5 + d * 2) % 9) / 9.0::DOUBLE AS value FROM nation, (SELECT unnest([0, 1, 2]) AS d) WHERE n_nationkey < 20),
  e AS (SELECT a, b FROM s UNION ALL SELECT DISTINCT node, node FROM f), w AS (SELECT a, b, 1 / sqrt(count(*) OVER (PARTITION BY a) * count(*) OVER (PARTITION BY b)) AS w FROM e),
  c AS (SELECT node, dim, sum(value) / 2 AS value FROM (SELECT * FROM f UNION ALL SELECT b, dim, sum(w * value) FROM w JOIN f ON a = node GROUP BY 1, 2) GROUP BY 1, 2)"""


def countries(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("node"), F.explode(F.array(*map(F.lit, range(3)))).alias("dim"))
    return scoring.country_table(n.withColumn("value", (F.col("node") * 5 + F.col("dim") * 2) % 9 / 9.0), links(spark, sf_dir))


@query(f"WITH {TABLE} SELECT node, dim, round(value, 9) AS value FROM c")
def country_propagation(spark, sf_dir):
    return rounded(countries(spark, sf_dir), "value")


@query(f"""WITH {TABLE}, i AS (SELECT vec_id AS item, d AS dim, embedding[d + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest([0, 1, 2]) AS d)),
  g AS (SELECT item, node AS market, i.dim, x, value AS c, 1 / (1 + exp(-(0.5::DOUBLE * (i.dim + 1) * x - 0.25::DOUBLE * value + 0.1::DOUBLE))) AS g FROM i JOIN c ON c.dim = i.dim AND node < 5),
  t AS (SELECT item, market, list(x * g + c * (1 - g) ORDER BY dim) AS v FROM g GROUP BY 1, 2), u AS (SELECT c_custkey AS user, c_nationkey % 5 AS market, [(c_custkey % 7) / 7.0::DOUBLE, (c_custkey % 5) / 5.0::DOUBLE, 0.5::DOUBLE] AS v FROM customer),
  sc AS (SELECT user, u.market, item, round(list_sum([u.v[k] * t.v[k] FOR k IN [1, 2, 3]]), 9) AS score FROM u JOIN t USING (market) WHERE (item + u.market) % 3 <> 0)
  SELECT user, market, item, score, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank FROM sc QUALIFY rank <= 10""")
def gated_catalog_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    items = scoring.long_form(e.withColumn("x", F.slice("embedding", 1, 3)), "vec_id", "x")
    weights = spark.createDataFrame([(d, 0.5 * (d + 1), -0.25, 0.1) for d in range(3)], "dim int, w_x double, w_c double, bias double")
    wide = scoring.gated(items, countries(spark, sf_dir).where("node < 5"), weights).groupBy("item", "market").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v"))
    made = wide.withColumn("v", F.transform("v", lambda x: x["value"]))
    k = F.col("c_custkey")
    users = table(spark, sf_dir, "customer").select(k.alias("user"), (F.col("c_nationkey") % 5).alias("market"), F.array(k % 7 / 7.0, k % 5 / 5.0, F.lit(0.5)).alias("v"))
    catalog = made.select("market", "item").where((F.col("item") + F.col("market")) % 3 != 0)
    return scoring.catalog_scores(users, made, catalog, 10)


@query(f"WITH {evaluation.BRANDS} SELECT t.user, t.item FROM truth t WHERE NOT EXISTS (SELECT 1 FROM cands c WHERE c.user = t.user AND c.item = t.item AND c.user % 10 <> 0)")
def truth_outside_candidates(spark, sf_dir):
    _, _, truth, _, _, cands = evaluation.setting(spark, sf_dir)
    return ranking.truth_outside(truth, cands.where("user % 10 <> 0"))


@query(f"""WITH {RUNS}, v AS (SELECT left(variant, 1) AS variant, seed, value FROM runs), p AS (SELECT a.variant || '-' || b.variant AS comparison, a.value - b.value AS d FROM v a JOIN v b ON a.seed = b.seed
    WHERE (a.variant, b.variant) IN (('2', '1'), ('3', '2'), ('4', '3'), ('4', '1')))
  SELECT comparison, count(*) AS n, round(avg(d), 6) AS mean, round(coalesce(stddev_samp(d), 0), 6) AS sd, round(avg(d) / nullif(stddev_samp(d), 0), 6) AS dz FROM p GROUP BY 1""")
def screening(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("variant", F.left("variant", F.lit(1)))
    return rounded(statistics.compared(r, [("2", "1"), ("3", "2"), ("4", "3"), ("4", "1")]), "mean", "sd", "dz", digits=6)


DRAWS = 20
STRATA = "st AS (SELECT n_regionkey AS stratum, c_custkey AS unit, c_acctbal / 1000.0::DOUBLE AS d FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _hierarchy(agg: str) -> str:
    return f"""WITH {STRATA}, z AS (SELECT stratum, count(*) AS n, row_number() OVER (ORDER BY stratum) - 1 AS s FROM st GROUP BY 1), p AS (SELECT st.*, row_number() OVER (PARTITION BY stratum ORDER BY unit) - 1 AS pos FROM st),
  slot AS (SELECT draw, slot, CAST(floor({U("draw || ':' || slot", 21)} * m) AS BIGINT) AS s FROM (SELECT unnest(range({DRAWS})) AS draw), (SELECT unnest(range(m)) AS slot, m FROM (SELECT count(*) AS m FROM z))),
  i AS (SELECT draw, slot, stratum, unnest(range(n)) AS i, n FROM slot JOIN z USING (s)),
  g AS (SELECT draw, slot, d FROM (SELECT *, CAST(floor({U("draw || ':' || slot || ':' || i", 21)} * n) AS BIGINT) AS pos FROM i) x JOIN p ON x.stratum = p.stratum AND x.pos = p.pos)
  SELECT draw, round({agg}) AS value FROM """


@query(_hierarchy("avg(m), 6") + "(SELECT draw, slot, avg(d) AS m FROM g GROUP BY 1, 2) GROUP BY 1")
def hierarchical_bootstrap_macro(spark, sf_dir):
    return rounded(statistics.hierarchical_draws(strata(spark, sf_dir), DRAWS, 21), "value", digits=6)


@query(_hierarchy("avg(d), 6") + "g GROUP BY 1")
def hierarchical_bootstrap_micro(spark, sf_dir):
    return rounded(statistics.hierarchical_draws(strata(spark, sf_dir), DRAWS, 21, "micro"), "value", digits=6)


def strata(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_regionkey").alias("stratum"), F.col("c_custkey").alias("unit"), (F.col("c_acctbal") / 1000.0).alias("d"))


@query(f"""WITH {RUNS}, c AS (SELECT CASE left(variant, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'recall' WHEN '3' THEN 'overall_micro' WHEN '4' THEN 'cold' ELSE 'decoupling' END AS name, avg(value) - 140 AS mean, min(value) - 141 AS low FROM runs GROUP BY 1)
  SELECT coalesce(max(mean) FILTER (name = 'primary') > 0, false) AS primary_mean_positive, coalesce(max(low) FILTER (name = 'primary') > 0, false) AS primary_ci_above_zero, coalesce(max(mean) FILTER (name = 'recall') > 0, false) AS macro_recall_mean_positive,
    coalesce(max(low) FILTER (name = 'overall_micro') >= -0.005, false) AS overall_micro_noninferior, coalesce(max(low) FILTER (name = 'cold') >= -0.005, false) AS cold_noninferior, coalesce(max(low) FILTER (name = 'decoupling') > 0, false) AS decoupling_supported,
    false AS market_conditioning_supported, 'none' AS default_residual FROM c""")
def acceptance_checks(spark, sf_dir):
    v = F.left("variant", F.lit(1))
    name = F.when(v == "1", "primary").when(v == "2", "recall").when(v == "3", "overall_micro").when(v == "4", "cold").otherwise("decoupling")
    c = runs(spark, sf_dir).groupBy(name.alias("name")).agg((F.avg("value") - 140).alias("mean"), (F.min("value") - 141).alias("low"))
    return statistics.acceptance(c)


@query("""SELECT c_mktsegment AS k, count(DISTINCT (c_nationkey % 3, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE 1 END)) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT (c_nationkey % 3, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE 1 END)) > 1""")
def unequal_coverage(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("k"), (F.col("c_nationkey") % 3).alias("x"), F.when(F.col("c_custkey") % 50 != 0, 1).alias("y"))
    return statistics.unequal(c, ["k"], ["x", "y"])
