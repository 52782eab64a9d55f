"""The text-view contract: dedup masks, alignment pairs, rule violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 2


def dedup_mask(views: DataFrame) -> DataFrame:
    """dedup: whether a view is the first valid one of its item with its content hash."""
    first = F.row_number().over(Window.partitionBy("item", "content_hash", "valid").orderBy("view")) == 1
    return views.withColumn("dedup", F.col("valid") & first)


def alignment_pairs(views: DataFrame, least: float = 0.8) -> DataFrame:
    """(item, view_a, view_b), both directions: genuine views of an item in other languages with
    other content."""
    genuine = views.where(F.col("valid") & ~F.col("is_fallback") & F.col("dedup") & (F.col("language_confidence") >= least) & (F.col("role") == "product_name"))
    a = genuine.select("item", F.col("view").alias("view_a"), F.col("language").alias("la"), F.col("content_hash").alias("ha"))
    b = genuine.select("item", F.col("view").alias("view_b"), F.col("language").alias("lb"), F.col("content_hash").alias("hb"))
    return a.join(b, "item").where("view_a <> view_b and la <> lb and ha <> hb").select("item", "view_a", "view_b")


def reliability(views: DataFrame, images: DataFrame) -> DataFrame:
    """(item, text, genuine, local, fallback, observed, completion): whether an item has a view, the
    shares of its views (those of the dedup mask, at least 1) that are genuine, genuine and of the asked
    market, and fallbacks, whether its image was observed, and how sure a completed one is (0 to 1)."""
    genuine = ~F.col("is_fallback")
    n = lambda ok: F.count(F.when(F.col("dedup") & ok, 1))
    per = F.greatest(n(F.lit(True)), F.lit(1))
    out = views.groupBy("item").agg(
        F.max(F.col("dedup").cast("double")).alias("text"), (n(genuine) / per).alias("genuine"),
        (n(genuine & F.col("is_local")) / per).alias("local"), (n(F.col("is_fallback")) / per).alias("fallback"),
    )
    image = images.select("item", F.col("observed").cast("double").alias("observed"), F.col("completion").cast("double").alias("completion"))
    return out.join(image, "item", "left").fillna(0.0, ["observed", "completion"])


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule, in one pass; a null condition breaks it too."""
    sums = rows.agg(*[F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(name) for name, ok in rules.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n")) for n in rules])).alias("x")).select("x.rule", "x.n")


def require(found: DataFrame) -> None:
    """Raise if any rule is broken."""
    if bad := {r["rule"]: r["n"] for r in found.where("n > 0").collect()}:
        raise ValueError(f"contract violations: {bad}")
