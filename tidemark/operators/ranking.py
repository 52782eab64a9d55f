"""Full-catalog ranking: candidates, top-k, metrics, eligibility and coverage by market."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidates(users: DataFrame, catalog: DataFrame, seen: DataFrame) -> DataFrame:
    """(user, market, item): each user's market's catalog without what the user has seen. The join is
    on the market, the exclusion an anti-join."""
    return users.join(catalog, "market").join(seen.select("user", "item"), ["user", "item"], "left_anti")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each user with their rank; ties to the smaller item."""
    per = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    return scores.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= k)


def ideal(n, k) -> F.Column:
    """Best possible discounted gain with n relevant items among k places."""
    return F.aggregate(F.sequence(F.lit(1), F.least(n, k).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + F.lit(1.0)))


def user_metrics(ranked: DataFrame, truth: DataFrame, users: DataFrame, ks: list[int]) -> DataFrame:
    """(user, market, k, recall, ndcg, hit) of every user with a truth."""
    size = truth.groupBy("user").agg(F.count("*").cast("int").alias("n"))
    hits = ranked.join(truth.select("user", "item"), ["user", "item"]).select("user", "rank")
    per = users.join(size, "user").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hits = per.join(hits, "user", "left").withColumn("in", F.col("rank") <= F.col("k"))
    got = hits.groupBy("user", "market", "k", "n").agg(
        F.count(F.when(F.col("in"), 1)).alias("h"), F.coalesce(F.sum(F.when(F.col("in"), 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg")
    )
    return got.select("user", "market", "k", (F.col("h") / F.col("n")).alias("recall"), (F.col("dcg") / ideal(F.col("n"), F.col("k"))).alias("ndcg"), (F.col("h") > 0).cast("double").alias("hit"))


def eligibility(cands: DataFrame, users: DataFrame, ks: list[int]) -> DataFrame:
    """(market, k, eligible, min_candidates, users): a market counts at k if every one of its users
    has at least k candidates."""
    n = cands.groupBy("user").agg(F.count("*").alias("c"))
    each = users.join(n, "user", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    by = each.groupBy("market").agg(F.min("c").alias("min_candidates"), F.count("*").alias("users"))
    return by.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).select("market", "k", (F.col("min_candidates") >= F.col("k")).alias("eligible"), "min_candidates", "users")


def report(metrics: DataFrame, eligible: DataFrame) -> DataFrame:
    """(k, scope, market, metric values): per market, micro over users and macro over markets, the
    last two over eligible markets only; without any, 0."""
    m = metrics.join(eligible.select("market", "k", "eligible"), ["market", "k"])
    names = ["recall", "ndcg", "hit"]
    per = m.groupBy("k", "market", "eligible").agg(*[F.avg(c).alias(c) for c in names])
    shown = per.select("k", F.lit("market").alias("scope"), "market", *[F.when(F.col("eligible"), F.col(c)).otherwise(0.0).alias(c) for c in names])
    mean = [F.coalesce(F.avg(F.when(F.col("eligible"), F.col(c))), F.lit(0.0)).alias(c) for c in names]
    micro = m.groupBy("k").agg(*mean).select("k", F.lit("micro").alias("scope"), F.lit(-1).alias("market"), *names)
    macro = per.groupBy("k").agg(*mean).select("k", F.lit("macro").alias("scope"), F.lit(-1).alias("market"), *names)
    return shown.unionByName(micro).unionByName(macro)


def coverage(eligible: DataFrame, truth: DataFrame, users: DataFrame) -> DataFrame:
    """A row a k: users and truths in and out of eligible markets and their shares, the smallest candidate
    set of an eligible market (0 without one), and the markets in and out, ascending and joined by commas."""
    n = users.join(truth, "user").groupBy("market").agg(F.count("*").alias("positives"))
    x = eligible.join(n, "market", "left").withColumn("positives", F.coalesce("positives", F.lit(0)))
    part = lambda c, ok: F.coalesce(F.sum(F.when(F.col("eligible") == F.lit(ok), F.col(c))), F.lit(0)).alias(f"{c}_{'in' if ok else 'out'}")
    names = lambda ok: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("eligible") == F.lit(ok), F.col("market")))), lambda m: m.cast("string")))
    least = F.coalesce(F.min(F.when(F.col("eligible"), F.col("min_candidates"))), F.lit(0)).alias("min_candidates")
    out = x.groupBy("k").agg(*[part(c, ok) for c in ("users", "positives") for ok in (True, False)], least, names(True).alias("markets_in"), names(False).alias("markets_out"))
    share = lambda c: F.coalesce(F.try_divide(f"{c}_in", F.col(f"{c}_in") + F.col(f"{c}_out")), F.lit(0.0))
    return out.withColumns({"users_share": share("users"), "positives_share": share("positives")})


def no_truth(ks: list[int], spark) -> DataFrame:
    """The report without any user: zeros for every k."""
    return spark.createDataFrame([(k, scope, -1, 0.0, 0.0, 0.0) for k in ks for scope in ("micro", "macro")], "k int, scope string, market int, recall double, ndcg double, hit double")


def truth_outside(truth: DataFrame, cands: DataFrame) -> DataFrame:
    """(user, item) of truths that are no candidate of their user; a ranking needs it empty."""
    return truth.select("user", "item").join(cands.select("user", "item"), ["user", "item"], "left_anti")


def diagnostic_subsets(items: DataFrame, views: DataFrame, degree: DataFrame) -> DataFrame:
    """(item, missing_image, genuine_multilingual, long_tail): no image; two or more languages among
    valid views that are no fallback; positive degree up to the 0.2 quantile of positive degrees."""
    langs = views.where("valid and not is_fallback").groupBy("item").agg(F.count_distinct("language").alias("langs"))
    cut = degree.where("degree > 0").agg(F.expr("percentile(degree, 0.2)").cast("int").alias("cut"))
    x = items.join(langs, "item", "left").join(degree.select("item", "degree"), "item", "left").crossJoin(F.broadcast(cut))  # one row
    return x.select("item", (~F.col("has_image")).alias("missing_image"), (F.coalesce("langs", F.lit(0)) >= 2).alias("genuine_multilingual"), F.coalesce((F.col("degree") > 0) & (F.col("degree") <= F.col("cut")), F.lit(False)).alias("long_tail"))
