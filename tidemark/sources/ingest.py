"""Sources and sinks: ratings, product metadata, nested products, run manifests, market files."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, clean, first_distinct, language_map

TEXTS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())]))
TAGS = T.ArrayType(T.StringType())
PRODUCT = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("product_name", TEXTS), T.StructField("ingredients_text", TEXTS), T.StructField("brands", T.StringType())]
    + [T.StructField(f"{n}_tags", TAGS) for n in ("brands", "categories", "labels", "origins", "countries")]
    + [T.StructField("manufacturing_places", T.StringType()), T.StructField("quantity", T.StringType()), T.StructField("created_t", T.LongType()), T.StructField("last_modified_t", T.LongType())]
)
METADATA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("asin", "title", "description")]
    + [T.StructField(n, TAGS) for n in ("features", "categories")]
    + [T.StructField("productDetails", T.MapType(T.StringType(), T.StringType())), T.StructField("related", T.StructType([T.StructField(n, TAGS) for n in ("alsoBought", "boughtTogether", "alsoViewed")])), T.StructField("imgUrl", T.StringType())]
)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """(user, asin, rating, date) of white-space separated lines, gzip or not; a line that does not
    have four fields with a number third stops the read."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(f.alias("f"))
    ok = (F.size("f") == 4) & F.get("f", F.lit(2)).try_cast("double").isNotNull()
    rating = F.when(ok, F.get("f", F.lit(2)).try_cast("double")).otherwise(F.raise_error(F.concat(F.lit("bad rating line: "), F.array_join("f", " "))))
    return rows.select(F.col("f")[0].alias("user"), F.get("f", F.lit(1)).alias("asin"), rating.alias("rating"), F.get("f", F.lit(3)).alias("date"))


def read_metadata(spark: SparkSession, path: str, allowed: DataFrame | None = None) -> DataFrame:
    """Product records, malformed lines an error; of an asin's records the last line holds."""
    rows = spark.read.schema(METADATA).option("mode", "FAILFAST").json(path).withColumn("__line", F.monotonically_increasing_id())
    rows = rows if allowed is None else rows.join(allowed.select("asin"), "asin", "left_semi")
    last = F.row_number().over(Window.partitionBy("asin").orderBy(F.desc("__line")))
    return rows.withColumn("__r", last).where("__r = 1").drop("__r", "__line")


def read_products(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Nested products under the fixed schema: malformed JSON lines are skipped; of Parquet, columns
    that are missing are null, except countries_tags, which must be there."""
    if form == "json":
        return spark.read.schema(PRODUCT).option("mode", "DROPMALFORMED").json(path)
    rows = spark.read.parquet(path)
    if "countries_tags" not in rows.columns:
        raise ValueError("countries_tags is missing")
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PRODUCT.fields])


def first_by_code(rows: DataFrame, order: list[Column], code: str = "code") -> DataFrame:
    """One row a barcode, the first in the given order; blank codes go."""
    named = rows.withColumn(code, blank_to_null(F.col(code))).where(F.col(code).isNotNull())
    return named.withColumn("__r", F.row_number().over(Window.partitionBy(code).orderBy(*order))).where("__r = 1").drop("__r")


def fan_out(rows: DataFrame, markets: Column) -> DataFrame:
    """A row for each market it is sold in, with `market`; blank codes go."""
    return rows.where(blank_to_null(F.col("code")).isNotNull()).withColumn("market", F.explode(F.array_distinct(markets)))


def write_markets(rows: DataFrame, path: str) -> None:
    """Market files by Spark's commit protocol: readers see a whole result or none."""
    rows.write.mode("overwrite").partitionBy("market").json(path)


def flat_record(rows: DataFrame, languages: list[str], fields: tuple[str, ...] = ("product_name", "ingredients_text")) -> DataFrame:
    """Nested texts as one column a language; the main text is its own language's where that is
    absent, and stands under the field's name."""
    out = rows
    for f in fields:
        m = language_map(F.col(f))
        main = F.coalesce(F.try_element_at(m, F.lit("main")), F.try_element_at(m, F.col("lang")))
        cols = {f"{f}_{x}": F.coalesce(F.try_element_at(m, F.lit(x)), F.when(F.col("lang") == x, main)) for x in languages}
        out = out.withColumns({**cols, f"__{f}": main})
    return out.drop(*fields).withColumnsRenamed({f"__{f}": f for f in fields})


def record_text(title: Column, description: Column, features: Column, longest: int = 6000) -> Column:
    """Title, description and the first 8 features, collapsed and cut."""
    return F.left(clean(F.concat_ws(" ", title, description, F.concat_ws(" ", F.slice(features, 1, 8)))), F.lit(longest))


def related_asins(related: Column, most: int = 20) -> Column:
    parts = [F.coalesce(related[n], F.array().cast("array<string>")) for n in ("alsoBought", "boughtTogether", "alsoViewed")]
    return first_distinct(F.concat(*parts), most)


def read_runs(spark: SparkSession, patterns: list[str], schema: T.StructType, staged: str) -> DataFrame:
    """Completed run manifests of one or more globs, each file once, with `path` and `variant`: the
    model, and for the model `staged` (in any case) its residual stage too. No run is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).json(patterns).withColumn("path", F.input_file_name())
    rows = rows.dropDuplicates(["path"]).where("status = 'completed'")
    if rows.isEmpty():
        raise ValueError(f"no completed runs in {patterns}")
    return rows.withColumn("variant", F.when(F.lower("model") != staged.lower(), F.col("model")).otherwise(F.concat_ws("-", "model", "residual")))


def write_json(value, path: str | Path) -> None:
    """Small host-side documents: written aside and renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    aside = path.with_suffix(f"{path.suffix}.{os.getpid()}.part")
    aside.write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, default=str))
    aside.replace(path)


def file_hash(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def snapshot_hash(paths: Iterable[str | Path]) -> str:
    """One hash of files by sorted path, each name and content with its length before it."""
    h = hashlib.sha256()
    for p in sorted(map(str, paths)):
        for part in (p.encode(), file_hash(p).encode()):
            h.update(len(part).to_bytes(8, "big") + part)
    return h.hexdigest()


def verify_hashes(expected: dict[str, str]) -> None:
    if bad := [p for p, h in expected.items() if not os.path.exists(p) or file_hash(p) != h]:
        raise ValueError(f"changed or missing sources: {sorted(bad)}")


def table_fingerprint(df: DataFrame) -> str:
    """Hash of the schema and of the rows in any order."""
    got = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{df.schema.json()}|{got['n']}|{got['s']}".encode()).hexdigest()


def save_table(df: DataFrame, path: str) -> str:
    """Parquet with a fingerprint beside it; `load_table` refuses other data."""
    df.write.mode("overwrite").parquet(path)
    mark = table_fingerprint(df.sparkSession.read.parquet(path))
    df.sparkSession.createDataFrame([(mark,)], "fingerprint string").coalesce(1).write.mode("overwrite").json(f"{path}.fingerprint")
    return mark


def load_table(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    want = spark.read.schema("fingerprint string").json(f"{path}.fingerprint").first()[0]
    if table_fingerprint(df) != want:
        raise ValueError(f"{path} is not what was saved")
    return df


def retried(fetch: Callable[[], dict], tries: int = 5, wait: float = 30.0, most: float = 300.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A source that may fail for a while: waits double up to `most`; the last error is returned."""
    error = ""
    for i in range(tries):
        try:
            return fetch()
        except Exception as e:  # noqa: BLE001  whatever the source raises is reported
            error = str(e)
            if i + 1 < tries:
                sleep(min(wait * 2**i, most))
    return {"_error": error}


def images(spark: SparkSession, path: str, least: int = 500) -> DataFrame:
    """(path, length, available): local image files; those under `least` bytes count as missing."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", "length", (F.col("length") >= least).alias("available"))
