"""Queries for ranking, graphs, contracts and trade over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import contract, graph, ranking, trade
from ..operators import interactions as I
from .base import query, table

KS = [1, 2, 5]
# users by brand: train is all but a user's last two brands by latest date
BRANDS = """ub AS (SELECT o_custkey AS user, p_brand AS item, max(strftime(o_orderdate, '%Y-%m-%d')) AS ts
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
  place AS (SELECT *, count(*) OVER (PARTITION BY user) AS n, row_number() OVER (PARTITION BY user ORDER BY ts, item) AS p FROM ub),
  split AS (SELECT user, item, CASE WHEN n >= 3 AND p = n THEN 'test' WHEN n >= 3 AND p = n - 1 THEN 'val' ELSE 'train' END AS split FROM place),
  home AS (SELECT c_custkey AS user, n_regionkey AS market FROM customer JOIN nation ON c_nationkey = n_nationkey),
  truth AS (SELECT user, item FROM split WHERE split = 'test'),
  users AS (SELECT DISTINCT user, market FROM home JOIN truth USING (user)),
  catalog AS (SELECT DISTINCT market, item FROM ub JOIN home USING (user)),
  cands AS (SELECT u.user, u.market, c.item FROM users u JOIN catalog c USING (market)
    WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.user = u.user AND s.item = c.item AND s.split <> 'test')),
  pop AS (SELECT market, item, count(*) AS score FROM split JOIN home USING (user) WHERE split = 'train' GROUP BY 1, 2),
  ranked AS (SELECT * FROM (SELECT c.user, c.market, c.item, coalesce(score, 0) AS score,
      row_number() OVER (PARTITION BY c.user ORDER BY coalesce(score, 0) DESC, c.item) AS rank
      FROM cands c LEFT JOIN pop p ON c.market = p.market AND c.item = p.item) WHERE rank <= 5),
  ks AS (SELECT unnest([1, 2, 5]) AS k),
  elig AS (SELECT market, k, min(c) >= k AS eligible, min(c) AS min_candidates, count(*) AS users
    FROM (SELECT u.user, u.market, count(c.item) AS c FROM users u LEFT JOIN cands c ON u.user = c.user GROUP BY 1, 2), ks GROUP BY market, k)"""
METRICS = f"""{BRANDS}, n AS (SELECT user, count(*) AS n FROM truth GROUP BY 1),
  met AS (SELECT u.user, u.market, k, count(r.rank) / any_value(n.n)::DOUBLE AS recall,
      coalesce(sum(1 / log2(r.rank + 1)), 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, CAST(least(any_value(n.n), k) AS BIGINT) + 1)]) AS ndcg,
      CAST(count(r.rank) > 0 AS INT)::DOUBLE AS hit
    FROM users u JOIN n USING (user), ks LEFT JOIN (SELECT ranked.* FROM ranked JOIN truth USING (user, item)) r ON r.user = u.user AND r.rank <= ks.k GROUP BY 1, 2, 3)"""


def setting(spark, sf_dir):
    """Split, users with a truth, catalog and candidates."""
    o, li, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    rows = o.join(li, o.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey)
    ub = rows.groupBy(F.col("o_custkey").alias("user"), F.col("p_brand").alias("item")).agg(F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ts"))
    split = I.leave_two_out(ub, ["user"], "item", "ts", 0)
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    home = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("user"), F.col("n_regionkey").alias("market"))
    truth = split.where("split = 'test'").select("user", "item")
    users = home.join(truth, "user", "left_semi")
    catalog = ub.join(home, "user").select("market", "item").distinct()
    return split, home, truth, users, catalog, ranking.candidates(users, catalog, split.where("split <> 'test'"))


def ranked(split, home, cands):
    pop = split.where("split = 'train'").join(home, "user").groupBy("market", "item").agg(F.count("*").alias("score"))
    scored = cands.join(pop, ["market", "item"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    return ranking.top_k(scored, max(KS)).select("user", "market", "item", "score", "rank")


@query(f"WITH {BRANDS} SELECT user, market, item, score, rank FROM ranked")
def popularity_topk(spark, sf_dir):
    split, home, _, _, _, cands = setting(spark, sf_dir)
    return ranked(split, home, cands)


@query(f"WITH {BRANDS} SELECT * FROM elig")
def eligible_markets(spark, sf_dir):
    *_, users, _, cands = setting(spark, sf_dir)
    return ranking.eligibility(cands, users, KS)


def rounded(df, *names, digits=9):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"""WITH {METRICS}, e AS (SELECT met.*, eligible FROM met JOIN elig USING (market, k)),
  per AS (SELECT k, market, eligible, avg(recall) AS recall, avg(ndcg) AS ndcg, avg(hit) AS hit FROM e GROUP BY 1, 2, 3)
  SELECT k, scope, market, round(recall, 9) AS recall, round(ndcg, 9) AS ndcg, round(hit, 9) AS hit FROM (
    SELECT k, 'market' AS scope, market, CASE WHEN eligible THEN recall ELSE 0 END AS recall, CASE WHEN eligible THEN ndcg ELSE 0 END AS ndcg, CASE WHEN eligible THEN hit ELSE 0 END AS hit FROM per
    UNION ALL SELECT k, 'micro', -1, coalesce(avg(recall) FILTER (eligible), 0), coalesce(avg(ndcg) FILTER (eligible), 0), coalesce(avg(hit) FILTER (eligible), 0) FROM e GROUP BY k
    UNION ALL SELECT k, 'macro', -1, coalesce(avg(recall) FILTER (eligible), 0), coalesce(avg(ndcg) FILTER (eligible), 0), coalesce(avg(hit) FILTER (eligible), 0) FROM per GROUP BY k)""")
def rank_metrics_micro_macro(spark, sf_dir):
    split, home, truth, users, _, cands = setting(spark, sf_dir)
    m = ranking.user_metrics(ranked(split, home, cands), truth, users, KS)
    return rounded(ranking.report(m, ranking.eligibility(cands, users, KS)), "recall", "ndcg", "hit")


@query(f"""WITH {BRANDS}, pos AS (SELECT market, count(*) AS positives FROM users JOIN truth USING (user) GROUP BY 1)
  SELECT k, coalesce(sum(users) FILTER (eligible), 0)::BIGINT AS users_in, coalesce(sum(users) FILTER (NOT eligible), 0)::BIGINT AS users_out,
    coalesce(sum(positives) FILTER (eligible), 0)::BIGINT AS positives_in, coalesce(sum(positives) FILTER (NOT eligible), 0)::BIGINT AS positives_out,
    coalesce(min(min_candidates) FILTER (eligible), 0) AS min_candidates, coalesce(string_agg(market, ',' ORDER BY market) FILTER (eligible), '') AS markets_in, coalesce(string_agg(market, ',' ORDER BY market) FILTER (NOT eligible), '') AS markets_out,
    coalesce(sum(users) FILTER (eligible), 0) / sum(users)::DOUBLE AS users_share, coalesce(sum(positives) FILTER (eligible), 0) / sum(positives)::DOUBLE AS positives_share
  FROM elig LEFT JOIN pos USING (market) GROUP BY k""")
def coverage_report(spark, sf_dir):
    _, _, truth, users, _, cands = setting(spark, sf_dir)
    return ranking.coverage(ranking.eligibility(cands, users, KS), truth, users)


@query(f"WITH {BRANDS} SELECT market, item FROM catalog")
def market_catalog(spark, sf_dir):
    return setting(spark, sf_dir)[4]


@query(f"WITH {BRANDS} SELECT c.user, c.market, c.item FROM cands c LEFT JOIN truth t ON c.user = t.user AND c.item = t.item WHERE t.item IS NULL")
def bpr_negative_pool(spark, sf_dir):
    *_, truth, _, _, cands = setting(spark, sf_dir)[0:6]
    return cands.join(truth, ["user", "item"], "left_anti").select("user", "market", "item")


@query("""WITH f AS (SELECT s_nationkey AS o, c_nationkey AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
  SELECT m AS market, count(*) AS n, round(avg(CAST(m <> o AS INT)), 9) AS cross_border_share FROM f GROUP BY 1""")
def cross_border_share(spark, sf_dir):
    f = flows(spark, sf_dir)
    return f.groupBy("market").agg(F.count("*").alias("n"), F.round(F.avg((F.col("market") != F.col("partner")).cast("int")), 9).alias("cross_border_share"))


FLOWS = "f AS (SELECT s_nationkey AS partner, c_nationkey AS market, l_extendedprice AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
IMPORTS = f"""{FLOWS}, pos AS (SELECT * FROM f WHERE value > 0 AND market <> partner),
  imp AS (SELECT market, partner AS origin, sum(value) AS value FROM pos WHERE partner < 6 GROUP BY 1, 2
    UNION ALL SELECT market, -1, greatest(sum(value) - coalesce(sum(value) FILTER (partner < 6), 0), 0) FROM pos GROUP BY 1)"""


def flows(spark, sf_dir):
    li, s, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders", "customer"))
    x = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return x.select(F.col("s_nationkey").alias("partner"), F.col("c_nationkey").alias("market"), F.col("l_extendedprice").alias("value"))


def imports(spark, sf_dir):
    return trade.reported_imports(flows(spark, sf_dir), F.col("partner") < 6)


@query(f"WITH {IMPORTS} SELECT market, origin, round(value, 2) AS value FROM imp")
def trade_other_residual(spark, sf_dir):
    return rounded(imports(spark, sf_dir), "value", digits=2)


@query(f"""WITH {IMPORTS}, own AS (SELECT market, origin, value / sum(value) OVER (PARTITION BY market) AS s FROM imp),
  pool AS (SELECT origin, sum(value) / (SELECT sum(value) FROM imp) AS pool FROM imp GROUP BY 1),
  g AS (SELECT n_nationkey AS market, p.origin, pool, s, max(s) OVER (PARTITION BY n_nationkey) IS NOT NULL AS has FROM nation CROSS JOIN pool p LEFT JOIN own ON own.market = n_nationkey AND own.origin = p.origin),
  m AS (SELECT market, origin, CASE WHEN has THEN 0.99 * coalesce(s, 0) + 0.01 * pool ELSE pool END AS m FROM g)
  SELECT market, origin, round(m / sum(m) OVER (PARTITION BY market), 9) AS share FROM m""")
def trade_shares(spark, sf_dir):
    markets = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("market"))
    return rounded(trade.shares(imports(spark, sf_dir), markets), "share")


@query(f"WITH {FLOWS} SELECT partner AS market, market AS origin, round(sum(value), 2) AS value FROM f WHERE value > 0 AND market <> partner GROUP BY 1, 2")
def mirror_exports(spark, sf_dir):
    return rounded(trade.mirror_exports(flows(spark, sf_dir)), "value", digits=2)


@query(f"""WITH {IMPORTS}, mir AS (SELECT partner AS market, market AS origin, sum(value) AS value FROM f WHERE value > 0 AND market <> partner GROUP BY 1, 2),
  u AS (SELECT *, 0 AS source FROM imp UNION ALL SELECT *, 1 FROM mir)
  SELECT market, origin, round(value, 2) AS value, source FROM u QUALIFY source = min(source) OVER (PARTITION BY market)""")
def trade_matrix_coalesced(spark, sf_dir):
    both = imports(spark, sf_dir).withColumn("source", F.lit(0)).unionByName(trade.mirror_exports(flows(spark, sf_dir)).withColumn("source", F.lit(1)))
    return rounded(trade.first_source(both, "market", "source"), "value", digits=2)


# text views: documents of a source are an item's views
VIEWS = """v AS (SELECT CAST(substr(source, 4) AS BIGINT) AS item, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS view, lang AS language,
    sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS content_hash, coalesce(quality, 0) = 1 AS valid, coalesce(toxic, 0) = 1 AS is_fallback,
    CAST(0.5 + (doc_id % 6) / 10.0 AS DOUBLE) AS language_confidence, CASE WHEN doc_id % 4 = 0 THEN 'description' ELSE 'product_name' END AS role
  FROM documents LEFT JOIN labels USING (doc_id)),
  d AS (SELECT *, valid AND row_number() OVER (PARTITION BY item, content_hash, valid ORDER BY view) = 1 AS dedup FROM v)"""


def views(spark, sf_dir):
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    hashed = X.content_hash(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))))
    return contract.dedup_mask(x.select(
        F.substring("source", 4, 9).cast("long").alias("item"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("view"), F.col("lang").alias("language"),
        hashed.alias("content_hash"), (F.coalesce("quality", F.lit(0)) == 1).alias("valid"), (F.coalesce("toxic", F.lit(0)) == 1).alias("is_fallback"),
        (F.lit(0.5) + F.col("doc_id") % 6 / 10.0).alias("language_confidence"), F.when(F.col("doc_id") % 4 == 0, "description").otherwise("product_name").alias("role"),
    ))


@query(f"WITH {VIEWS} SELECT item, view, dedup FROM d")
def text_dedup_mask(spark, sf_dir):
    return views(spark, sf_dir).select("item", "view", "dedup")


@query(f"""WITH {VIEWS}, g AS (SELECT * FROM d WHERE valid AND NOT is_fallback AND dedup AND language_confidence >= 0.8 AND role = 'product_name')
  SELECT a.item, a.view AS view_a, b.view AS view_b FROM g a JOIN g b ON a.item = b.item AND a.view <> b.view AND a.language <> b.language AND a.content_hash <> b.content_hash""")
def alignment_pairs(spark, sf_dir):
    return contract.alignment_pairs(views(spark, sf_dir))


@query(f"WITH {VIEWS} SELECT item, view, content_hash, CAST(CAST('0x' || substr(content_hash, 1, 16) AS UBIGINT) & 9223372036854775807 AS BIGINT) AS hash_id FROM v")
def content_hash_id(spark, sf_dir):
    return views(spark, sf_dir).select("item", "view", "content_hash", X.hash_id(F.col("content_hash")).alias("hash_id"))


@query(f"""WITH {VIEWS} SELECT 'confidence' AS rule, count(*) FILTER (NOT language_confidence BETWEEN 0.6 AND 0.9) AS n FROM d
  UNION ALL SELECT 'dedup_valid', count(*) FILTER (dedup AND NOT valid) FROM d UNION ALL SELECT 'hash', count(*) FILTER (NOT regexp_full_match(content_hash, '[0-9a-f]{{64}}')) FROM d
  UNION ALL SELECT 'language', count(*) FILTER (NOT language IN ('en', 'fr')) FROM d UNION ALL SELECT 'role', count(*) FILTER (role = '') FROM d""")
def constraint_violations(spark, sf_dir):
    rules = {"confidence": F.col("language_confidence").between(0.6, 0.9), "dedup_valid": ~F.col("dedup") | F.col("valid"), "hash": F.col("content_hash").rlike("^[0-9a-f]{64}$"), "language": F.col("language").isin("en", "fr"), "role": F.col("role") != ""}
    return contract.violations(views(spark, sf_dir), rules)


@query(f"""WITH {VIEWS}, l AS (SELECT item, count(DISTINCT language) AS langs FROM v WHERE valid AND NOT is_fallback GROUP BY 1),
  deg AS (SELECT l_suppkey AS item, count(*) AS degree FROM lineitem GROUP BY 1), cut AS (SELECT CAST(floor(quantile_cont(degree, 0.2)) AS INT) AS cut FROM deg)
  SELECT s_suppkey AS item, s_suppkey % 3 = 0 AS missing_image, coalesce(langs, 0) >= 2 AS genuine_multilingual, coalesce(degree > 0 AND degree <= cut, false) AS long_tail
  FROM supplier LEFT JOIN l ON l.item = s_suppkey LEFT JOIN deg ON deg.item = s_suppkey, cut""")
def diagnostic_subsets(spark, sf_dir):
    items = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), (F.col("s_suppkey") % 3 != 0).alias("has_image"))
    degree = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("item")).agg(F.count("*").alias("degree"))
    return ranking.diagnostic_subsets(items, views(spark, sf_dir), degree)


@query(f"""WITH {VIEWS}, r AS (SELECT item, CAST(max(CAST(dedup AS INT)) AS DOUBLE) AS text, greatest(count(*) FILTER (dedup), 1) AS n, count(*) FILTER (dedup AND NOT is_fallback) AS g,
    count(*) FILTER (dedup AND NOT is_fallback AND language = 'en') AS l, count(*) FILTER (dedup AND is_fallback) AS f FROM d GROUP BY 1)
  SELECT item, text, round(g / n, 9) AS genuine, round(l / n, 9) AS local, round(f / n, 9) AS fallback, CAST(item % 3 <> 0 AS INT)::DOUBLE AS observed, CAST(item % 3 <> 0 AS INT)::DOUBLE AS completion FROM r""")
def reliability_features(spark, sf_dir):
    v = views(spark, sf_dir).withColumn("is_local", F.col("language") == "en")
    images = v.select("item").distinct().withColumn("observed", F.col("item") % 3 != 0)
    return rounded(contract.reliability(v, images.withColumn("completion", F.col("observed").cast("double"))), "genuine", "local", "fallback")


# graphs over parts: words of the type (frequent ones) and the brand
KG = """words AS (SELECT p_partkey AS h, unnest(string_split(p_type, ' ')) AS key FROM part), freq AS (SELECT key FROM words GROUP BY 1 HAVING count(*) >= 30),
  voc AS (SELECT key, row_number() OVER (ORDER BY key) - 1 + 100000 AS id FROM freq), bvoc AS (SELECT key, row_number() OVER (ORDER BY key) - 1 + 200000 AS id FROM (SELECT DISTINCT p_brand AS key FROM part)),
  kg AS (SELECT DISTINCT h, 1 AS r, id AS t FROM words JOIN voc USING (key) UNION SELECT p_partkey, 2, id FROM part JOIN bvoc ON p_brand = key)"""


def triples(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.split("p_type", " ").alias("words"), "p_brand")
    words = graph.frequent(p.select(F.explode("words").alias("key")), "key", 30)
    voc = I.dictionary(words, F.col("key")).withColumn("id", F.col("id") + 100_000)
    brands = I.dictionary(p, F.col("p_brand")).withColumn("id", F.col("id") + 200_000)
    return graph.emit_edges(p, F.col("words"), voc, 1).unionByName(graph.emit_edges(p, F.array("p_brand"), brands, 2))


@query(f"WITH {KG} SELECT * FROM kg")
def kg_triples(spark, sf_dir):
    return triples(spark, sf_dir)


@query(f"""WITH {KG}, i AS (SELECT DISTINCT o_custkey + 300000 AS src, l_partkey AS dst, 0 AS type FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  fwd AS (SELECT * FROM i UNION ALL SELECT h, t, r FROM kg) SELECT * FROM fwd UNION ALL SELECT dst, src, type + 3 FROM fwd""")
def ckg_edges(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pairs = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).distinct()
    return graph.collaborative(triples(spark, sf_dir), pairs, 2, 300_000)


SYM = """e AS (SELECT DISTINCT o_custkey AS a, l_partkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  w AS (SELECT a, b, 1 / sqrt(count(*) OVER (PARTITION BY a) * count(*) OVER (PARTITION BY b)) AS weight FROM e)"""


def bipartite(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("a"), F.col("l_partkey").alias("b")).distinct()


@query(f"WITH {SYM} SELECT a, b, round(weight, 9) AS weight FROM w")
def sym_norm_weights(spark, sf_dir):
    return rounded(graph.sym_norm(bipartite(spark, sf_dir)), "weight")


LIGHT = f"""{SYM}, edges AS (SELECT -a AS src, b AS dst, weight FROM w UNION ALL SELECT b, -a, weight FROM w),
  f0 AS (SELECT DISTINCT src AS node, d AS dim, ((abs(src) * 7 + d * 3) % 11) / 10.0::DOUBLE AS value FROM edges, (SELECT unnest([0, 1]) AS d)),
  f1 AS (SELECT dst AS node, dim, sum(weight * value) AS value FROM edges JOIN f0 ON src = node GROUP BY 1, 2),
  f2 AS (SELECT dst AS node, dim, sum(weight * value) AS value FROM edges JOIN f1 ON src = node GROUP BY 1, 2)"""


@query(f"WITH {LIGHT} SELECT node, dim, round(sum(value) / 3, 8) AS value FROM (FROM f0 UNION ALL FROM f1 UNION ALL FROM f2) GROUP BY 1, 2")
def lightgcn_layers(spark, sf_dir):
    w = graph.sym_norm(bipartite(spark, sf_dir))
    edges = w.select((-F.col("a")).alias("src"), F.col("b").alias("dst"), "weight").unionByName(w.select(F.col("b").alias("src"), (-F.col("a")).alias("dst"), "weight"))
    f0 = edges.select(F.col("src").alias("node")).distinct().withColumn("dim", F.explode(F.array(F.lit(0), F.lit(1))))
    f0 = f0.withColumn("value", (F.abs("node") * 7 + F.col("dim") * 3) % 11 / 10.0)
    return rounded(graph.layers_mean(edges, f0, 2), "value", digits=8)


KNN = """u AS (SELECT vec_id AS id, [x::DOUBLE / sqrt(list_sum([y::DOUBLE * y::DOUBLE FOR y IN embedding])) FOR x IN embedding] AS v, label FROM embeddings),
  s AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 9) AS sim FROM u a JOIN u b ON a.id <> b.id),
  knn AS (SELECT a, b, sim FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 4), pos AS (SELECT * FROM knn WHERE sim > 0)"""


def neighbours(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return graph.nearest(v, 4)


@query(f"WITH {KNN} SELECT a, b, round(max(sim), 7) AS sim FROM (SELECT a, b, sim FROM pos UNION ALL SELECT b, a, sim FROM pos) GROUP BY 1, 2")
def knn_graph(spark, sf_dir):
    return rounded(graph.symmetric(neighbours(spark, sf_dir), "sim"), "sim", digits=7)


@query(f"""WITH {KNN}, g1 AS (SELECT a, b FROM pos UNION SELECT b, a FROM pos), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND abs(a.vec_id - b.vec_id) BETWEEN 1 AND 40),
  n1 AS (SELECT a, b, 0.7 / sqrt(count(*) OVER (PARTITION BY a) * count(*) OVER (PARTITION BY b)) AS w FROM g1), n2 AS (SELECT a, b, 0.3 / sqrt(count(*) OVER (PARTITION BY a) * count(*) OVER (PARTITION BY b)) AS w FROM l)
  SELECT a, b, round(sum(w), 9) AS weight FROM (FROM n1 UNION ALL FROM n2) GROUP BY 1, 2""")
def fused_item_graph(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    # ids at most 40 apart lie in the same run of 41 or in runs side by side
    run = F.floor(F.col("vec_id") / 41)
    near = F.explode(F.array(run - 1, run, run + 1))
    same = e.select(F.col("vec_id").alias("a"), "label", run.alias("run")).join(e.select(F.col("vec_id").alias("b"), "label", near.alias("run")), ["label", "run"])
    same = same.where(F.abs(F.col("a") - F.col("b")).between(1, 40)).select("a", "b")
    return rounded(graph.fused_graph([(neighbours(spark, sf_dir), 0.7), (same, 0.3)]), "weight")


@query("""WITH x AS (SELECT o_custkey AS k, o_orderkey AS o, o_totalprice / 100000 AS x FROM orders), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY k)) AS e FROM x)
  SELECT k, o, round(x, 9) AS x, round(e / sum(e) OVER (PARTITION BY k), 9) AS p FROM e""")
def group_softmax(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), (F.col("o_totalprice") / 100000).alias("x"))
    return rounded(graph.group_softmax(x, "k", "x"), "x", "p")
