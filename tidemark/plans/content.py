"""Queries over catalog records: text views, origins, admission and dataset rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trade, views
from . import evaluation
from .base import query, table

# products: parts, with names by language where the key has a remainder
PRODUCTS = """pr AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE p_brand || ', other' END AS brands,
    CASE p_partkey % 4 WHEN 0 THEN 'th' WHEN 1 THEN 'xx' WHEN 2 THEN NULL ELSE 'de' END AS lang, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE lower(p_type) END AS plain,
    CASE WHEN p_partkey % 3 = 0 THEN 'th  ' || lower(p_type) || ' ' END AS name_th, CASE WHEN p_partkey % 2 = 0 THEN 'en ' || lower(p_type) END AS name_en,
    CASE WHEN p_partkey % 7 = 0 THEN 'made of ' || p_size END AS ing_en FROM part)"""


def products(spark, sf_dir):
    k = F.col("p_partkey")
    lower = F.lower("p_type")
    maps = lambda *kv: F.map_from_arrays(F.array(*map(F.lit, kv[::2])), F.array(*kv[1::2]))
    return table(spark, sf_dir, "part").select(
        k.alias("item"), F.when(k % 11 == 0, "  ").otherwise(F.concat("p_brand", F.lit(", other"))).alias("brands"),
        F.when(k % 4 == 0, "th").when(k % 4 == 1, "xx").when(k % 4 == 3, "de").alias("lang"), F.when(k % 5 != 0, lower).alias("product_name"),
        maps("th", F.when(k % 3 == 0, F.concat(F.lit("th  "), lower, F.lit(" "))), "en", F.when(k % 2 == 0, F.concat(F.lit("en "), lower))).alias("names"),
        maps("en", F.when(k % 7 == 0, F.concat(F.lit("made of "), F.col("p_size").cast("string"))), "th", F.lit(None).cast("string")).alias("ingredients"),
    )


@query(f"""WITH {PRODUCTS}, b AS (SELECT *, trim(split_part(brands, ',', 1)) AS brand FROM pr),
  v0 AS (SELECT *, CASE WHEN name_th IS NOT NULL THEN trim(brand || ' ' || trim(replace(name_th, '  ', ' '))) WHEN name_en IS NOT NULL THEN trim(brand || ' ' || name_en)
      WHEN plain IS NOT NULL THEN trim(brand || ' ' || plain) ELSE brand END AS text,
    CASE WHEN name_th IS NOT NULL THEN 'th' WHEN name_en IS NOT NULL THEN 'en' WHEN lang IN ('th', 'de') THEN lang ELSE 'en' END AS language,
    CASE WHEN name_th IS NOT NULL THEN 'product_name_th' WHEN name_en IS NOT NULL THEN 'product_name_en' WHEN plain IS NOT NULL THEN 'product_name' ELSE 'brands' END AS source,
    name_th IS NULL AND name_en IS NULL AND plain IS NULL AS is_fallback, CASE WHEN name_th IS NOT NULL OR name_en IS NOT NULL OR lang IN ('th', 'de') THEN 1.0 ELSE 0.0 END::DOUBLE AS conf FROM b),
  v AS (SELECT item, 0 AS view, text, language, source, 'product_name' AS role, is_fallback, conf FROM v0
    UNION ALL SELECT item, 1, CASE WHEN name_en IS NOT NULL THEN trim(brand || ' ' || name_en) ELSE text END, CASE WHEN name_en IS NOT NULL THEN 'en' ELSE language END,
      CASE WHEN name_en IS NOT NULL THEN 'product_name_en' ELSE source END, 'product_name', name_en IS NULL, CASE WHEN name_en IS NOT NULL THEN 1.0 ELSE conf END FROM v0
    UNION ALL SELECT item, 2, coalesce(ing_en, text), CASE WHEN ing_en IS NOT NULL THEN 'en' ELSE language END, CASE WHEN ing_en IS NOT NULL THEN 'ingredients_text_en' ELSE source END, 'ingredients',
      ing_en IS NULL, CASE WHEN ing_en IS NOT NULL THEN 1.0 ELSE conf END FROM v0)
  SELECT item, view, text, language, source, role, text <> '' AS valid, is_fallback, sha256(lower(text)) AS content_hash, conf AS language_confidence FROM v""")
def text_views(spark, sf_dir):
    made = views.product_views(products(spark, sf_dir), F.array(F.lit("th")), ["th", "en", "de"])
    return made.select("item", F.posexplode("views").alias("view", "v")).select("item", "view", "v.*")


# records of items by market: part of the suppliers' nations' regions
RECORDS = """rec AS (SELECT ps.l_partkey AS item, CASE n_regionkey WHEN 0 THEN 'us' WHEN 1 THEN 'cn' WHEN 2 THEN 'in' ELSE 'sg' END AS market, max(s_name) AS text
    FROM lineitem ps JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 4 AND l_returnflag = 'A' GROUP BY 1, 2)"""


def records(spark, sf_dir):
    li, s, n = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation").where("n_regionkey < 4")
    x = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    market = F.when(F.col("n_regionkey") == 0, "us").when(F.col("n_regionkey") == 1, "cn").when(F.col("n_regionkey") == 2, "in").otherwise("sg")
    return x.groupBy(F.col("l_partkey").alias("item"), market.alias("market")).agg(F.max("s_name").alias("text"))


@query(f"WITH {RECORDS} SELECT item, market, text FROM rec QUALIFY row_number() OVER (PARTITION BY item ORDER BY market <> 'us', market) = 1")
def representative_records(spark, sf_dir):
    return views.representative(records(spark, sf_dir), "item", "market")


@query(f"""WITH {RECORDS}, rep AS (SELECT item, market, text FROM rec QUALIFY row_number() OVER (PARTITION BY item ORDER BY market <> 'us', market) = 1),
  m AS (SELECT unnest(['us', 'cn', 'in', 'sg']) AS market)
  SELECT p_partkey AS item, m.market, coalesce(rec.text, rep.text, CAST(p_partkey AS VARCHAR)) AS text, coalesce(rec.market, rep.market, 'us') AS source,
    rec.item IS NULL AND NOT (rep.item IS NULL AND m.market = 'us') AS is_fallback, CASE WHEN rep.item IS NULL THEN 'unknown' ELSE 'en' END AS language, CASE WHEN rep.item IS NULL THEN 0 ELSE 0.5 END::DOUBLE AS language_confidence
  FROM part CROSS JOIN m LEFT JOIN rec ON rec.item = p_partkey AND rec.market = m.market LEFT JOIN rep ON rep.item = p_partkey""")
def market_text_views(spark, sf_dir):
    markets = spark.createDataFrame([(m,) for m in ("us", "cn", "in", "sg")], "market string")
    told = records(spark, sf_dir).withColumns({"language": F.lit("en"), "language_confidence": F.lit(0.5)})
    return views.market_views(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")), told, markets)


@query("SELECT p_partkey AS item, CASE p_partkey % 4 WHEN 0 THEN lower(p_brand) WHEN 1 THEN lower(p_type) WHEN 2 THEN 'maker' ELSE '' END AS brand FROM part")
def brands_of_details(spark, sf_dir):
    k = F.col("p_partkey") % 4
    keys = F.array(F.lit("Brand"), F.lit("brand"), F.lit("Manufacturer"))
    values = F.array(F.when(k == 0, F.col("p_brand")).otherwise(" "), F.when(k == 1, F.col("p_type")), F.when(k < 3, "Maker"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), views.brand_of(F.map_from_arrays(keys, values)).alias("brand"))


NAMES = {"steel": "ST", "polished steel": "PS", "tin": "TI", "nickel": "NI", "brass": "BR"}


@query("""SELECT p_partkey AS item, CASE WHEN contains(lower(p_type), 'polished steel') THEN 'PS' WHEN contains(lower(p_type), 'nickel') THEN 'NI' WHEN contains(lower(p_type), 'steel') THEN 'ST'
  WHEN contains(lower(p_type), 'brass') THEN 'BR' WHEN contains(lower(p_type), 'tin') THEN 'TI' END AS code FROM part""")
def freetext_codes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), views.freetext_code(F.col("p_type"), NAMES).alias("code"))


ORIGINS = """o AS (SELECT p_partkey AS item, string_split(lower(p_type), ' ') AS w, p_partkey % 6 AS k, CASE WHEN p_partkey % 3 = 0 THEN 'from Tin works' ELSE '' END AS place FROM part),
  c AS (SELECT item, k, place, w, [CASE x WHEN 'steel' THEN 'ST' WHEN 'nickel' THEN 'NI' WHEN 'brass' THEN 'BR' END FOR x IN w] AS codes FROM o),
  r AS (SELECT item, k, list_filter(codes, lambda x: x IS NOT NULL)[1] AS voted, CASE WHEN place <> '' THEN 'TI' END AS named FROM c),
  g AS (SELECT item, coalesce(voted, named) AS code, CASE WHEN voted IS NOT NULL THEN 'origins_tags' WHEN named IS NOT NULL THEN 'manufacturing_places' END AS field,
    CASE WHEN k = 5 THEN 'no_market' WHEN coalesce(voted, named) IS NULL THEN 'no_origin' ELSE 'kept' END AS verdict FROM r)"""


def origins(spark, sf_dir):
    by_tag = {"steel": "ST", "nickel": "NI", "brass": "BR"}
    tags = F.transform(F.split(F.lower("p_type"), " "), lambda t: F.concat(F.lit("en:"), t))
    place = F.when(F.col("p_partkey") % 3 == 0, "from Tin works").otherwise("")
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), views.origin(tags, place, by_tag, {"tin": "TI"}).alias("o"), F.when(F.col("p_partkey") % 6 != 5, F.array(F.lit("TH"))).alias("markets"))
    return views.admitted(x, F.col("markets"), F.col("o.code")).select("item", "o.code", "o.field", "verdict")


@query(f"WITH {ORIGINS} SELECT item, code, field, verdict FROM g")
def origin_and_admission(spark, sf_dir):
    return origins(spark, sf_dir)


@query(f"WITH {ORIGINS} SELECT code, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, code) AS rank FROM g WHERE verdict = 'kept' GROUP BY 1 ORDER BY rank LIMIT 15")
def top_origins(spark, sf_dir):
    n = origins(spark, sf_dir).where("verdict = 'kept'").groupBy("code").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    return trade.top_partners(n, "all", "code", "n", 15).select("code", "n", "rank")


@query(f"WITH {evaluation.FLOWS}, s AS (SELECT market, partner, sum(value) AS value FROM f GROUP BY 1, 2) SELECT market, partner, round(value, 2) AS value, row_number() OVER (PARTITION BY market ORDER BY round(value, 2) DESC, partner) AS rank FROM s QUALIFY rank <= 8")
def top_trade_partners(spark, sf_dir):
    s = evaluation.flows(spark, sf_dir).groupBy("market", "partner").agg(F.round(F.sum("value"), 2).alias("value"))
    return trade.top_partners(s, "market", "partner", "value")


YEARS = [1997, 1995, 1996]
FLOWS_BY_YEAR = "f AS (SELECT s_nationkey AS partner, c_nationkey AS market, l_extendedprice AS value, year(o_orderdate) AS year FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey)"


@query(f"""WITH {FLOWS_BY_YEAR}, y AS (SELECT unnest([1997, 1995, 1996]) AS year, unnest([1, 2, 3]) AS pos),
  own AS (SELECT market, year, partner AS origin, sum(value) AS value FROM f WHERE market < 9 AND (market + year) % 3 = 0 GROUP BY ALL), mir AS (SELECT partner AS market, year, market AS origin, sum(value) AS value FROM f GROUP BY ALL),
  u AS (SELECT *, 0 AS source FROM own UNION ALL SELECT *, 1 FROM mir)
  SELECT market, origin, round(value, 2) AS value, source, u.year FROM u JOIN y ON u.year = y.year QUALIFY source * 10 + pos = min(source * 10 + pos) OVER (PARTITION BY market)""")
def trade_by_first_year(spark, sf_dir):
    li, s, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders", "customer"))
    f = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).where("s_nationkey <> c_nationkey")
    f = f.select(F.col("s_nationkey").alias("partner"), F.col("c_nationkey").alias("market"), F.col("l_extendedprice").alias("value"), F.year("o_orderdate").alias("year"))
    own = f.where("market < 9 and (market + year) % 3 = 0").groupBy("market", "year", F.col("partner").alias("origin")).agg(F.sum("value").alias("value"))
    mirrored = f.groupBy(F.col("partner").alias("market"), "year", F.col("market").alias("origin")).agg(F.sum("value").alias("value"))
    return evaluation.rounded(trade.coalesced(own, mirrored, YEARS), "value", digits=2)


@query(f"""WITH {evaluation.VIEWS}, l AS (SELECT *, CASE language WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 9 END AS language_id FROM d),
  n AS (SELECT count(*) FILTER (language_id NOT BETWEEN 0 AND 2) AS a, count(*) FILTER (role = '') AS z FROM l)
  SELECT 'language_range' AS rule, a AS n FROM n UNION ALL SELECT unnest(['confidence', 'hash', 'dedup_recomputed', 'dedup_valid', 'source']), 0 UNION ALL SELECT 'role', z FROM n""")
def view_contract(spark, sf_dir):
    from ..operators import contract

    v = evaluation.views(spark, sf_dir)
    again = contract.dedup_mask(v.withColumnRenamed("dedup", "told")).withColumnRenamed("dedup", "expected_dedup").withColumnRenamed("told", "dedup")
    lang = F.when(F.col("language") == "de", 0).when(F.col("language") == "en", 1).when(F.col("language") == "es", 2).otherwise(9)
    return contract.violations(again.withColumns({"language_id": lang, "source": F.lit("documents")}), views.view_rules(3))


DATASET = """pairs AS (SELECT o_custkey AS user, l_partkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey), tri AS (SELECT p_partkey AS h, p_size % 9 AS r, p_size + 100 AS t FROM part),
  us AS (SELECT c_custkey AS user, c_nationkey % 6 AS market FROM customer), it AS (SELECT p_partkey AS item, p_size AS country, p_size / 40.0::DOUBLE AS image_mask, p_size > 21 AS observed FROM part),
  cat AS (SELECT DISTINCT p_size % 6 AS market, p_partkey AS item FROM part)"""


@query(f"""WITH {DATASET} SELECT 'pair_users' AS rule, count(*) FILTER (user >= 100) AS n FROM pairs UNION ALL SELECT 'pair_items', count(*) FILTER (item >= 150) FROM pairs
  UNION ALL SELECT 'pairs_unique', count(*) FROM (SELECT 1 FROM pairs GROUP BY user, item HAVING count(*) > 1) UNION ALL SELECT 'heads', count(*) FILTER (h >= 140) FROM tri UNION ALL SELECT 'relations', count(*) FILTER (r NOT BETWEEN 1 AND 7) FROM tri
  UNION ALL SELECT 'tails', count(*) FILTER (t >= 140) FROM tri UNION ALL SELECT 'user_markets', count(*) FILTER (market >= 5) FROM us UNION ALL SELECT 'item_countries', count(*) FILTER (country >= 45) FROM it
  UNION ALL SELECT 'features_finite', count(*) FILTER (item % 50 = 0) FROM it UNION ALL SELECT 'image_mask', count(*) FILTER (image_mask > 1) FROM it UNION ALL SELECT 'image_observed', count(*) FILTER (observed <> (image_mask > 0.5)) FROM it
  UNION ALL SELECT 'sellable', count(*) FROM pairs JOIN us USING (user) WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.market = us.market AND cat.item = pairs.item)""")
def dataset_violations(spark, sf_dir):
    o, li, p, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "customer"))
    item, size = F.col("p_partkey").alias("item"), F.col("p_size")
    tables = {
        "pairs": o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")),
        "triples": p.select(F.col("p_partkey").alias("h"), (size % 9).alias("r"), (size + 100).alias("t")),
        "users": c.select(F.col("c_custkey").alias("user"), (F.col("c_nationkey") % 6).alias("market")),
        "items": p.select(item, size.alias("country"), F.array(F.lit(1.0), F.when(F.col("p_partkey") % 50 == 0, float("nan")).otherwise(2.0)).alias("feature"), (size / 40.0).alias("image_mask"), (size > 21).alias("observed")),
        "catalog": p.select((size % 6).alias("market"), item),
    }
    return views.dataset_violations(tables, {"users": 100, "items": 150, "entities": 140, "relations": 7, "markets": 5, "countries": 45})


@query(f"WITH {DATASET}, n AS (SELECT market, count(*) AS n FROM cat GROUP BY 1) SELECT 'market_counts' AS rule, (SELECT count(*) FROM n WHERE market >= 3) AS n UNION ALL SELECT 'union_count', CAST((SELECT count(*) FROM part) <> 200 AS BIGINT)")
def catalog_violations(spark, sf_dir):
    cat = table(spark, sf_dir, "part").select((F.col("p_size") % 6).alias("market"), F.col("p_partkey").alias("item"))
    told = cat.groupBy("market").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("market") < 3, F.col("n")).otherwise(F.col("n") + 1))
    return views.catalog_violations(cat, told, 200)


@query(f"WITH {DATASET} SELECT user, item, market FROM pairs JOIN us USING (user) WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.market = us.market AND cat.item = pairs.item)")
def unsellable_interactions(spark, sf_dir):
    o, li, p, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "customer"))
    pairs = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"))
    return views.unsellable(pairs, c.select(F.col("c_custkey").alias("user"), (F.col("c_nationkey") % 6).alias("market")), p.select((F.col("p_size") % 6).alias("market"), F.col("p_partkey").alias("item")))


@query("SELECT DISTINCT p_size - 20 AS market, p_partkey AS item FROM part WHERE p_size BETWEEN 20 AND 30 AND p_partkey % 4 = 1")
def sold_in_catalog(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("h"), (F.col("p_partkey") % 4 + 4).alias("r"), F.col("p_size").alias("t"))
    return views.sold_in_catalog(t, 5, 20, 11)
