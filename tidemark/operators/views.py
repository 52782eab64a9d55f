"""Catalog records: text views of an item, origins, market lists, admission and the rules of a dataset.

Cases, unless said otherwise: null and blank fields count as missing, repeated rows give repeated
results, an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, clean, content_hash, first_mode, normalize_text, tag_code

#: The keys that name a brand, in order of preference.
BRAND_KEYS = ("Brand", "brand", "Manufacturer")


def text_view(text: Column, language: Column, source: Column, role: str, fallback: Column | bool = False, confidence: Column | float = 1.0) -> Column:
    """A view as a struct; its hash is of the normalised text, a confidence outside [0, 1] is an error."""
    given = F.trim(F.coalesce(text, F.lit("")))
    sure = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    bad = F.raise_error(F.lit("language_confidence must lie in [0, 1]")).cast("double")
    normal = normalize_text(given)
    return F.struct(
        given.alias("text"), language.alias("language"), source.alias("source"), F.lit(role).alias("role"), (normal != "").alias("valid"),
        (fallback if isinstance(fallback, Column) else F.lit(fallback)).alias("is_fallback"), content_hash(normal).alias("content_hash"),
        F.when(sure.between(0, 1), sure).otherwise(bad).alias("language_confidence"),
    )


def _chosen(options: Column) -> Column:
    """The first option (text, language, source, is_fallback, confidence) that has a text."""
    return F.get(F.filter(options, lambda o: o["text"] != ""), F.lit(0))


def _option(text: Column, language: Column, source: Column, fallback=False, confidence: Column | float = 1.0) -> Column:
    sure = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    fall = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), language.alias("language"), source.alias("source"), fall.alias("is_fallback"), sure.alias("confidence"))


def product_views(rows: DataFrame, priority: Column, known: list[str], longest: int = 1_000) -> DataFrame:
    """`rows` with `views`: the local name, the English name and the ingredients.

    Columns: brands, lang, product_name and maps names and ingredients by language. `priority` holds the
    languages of the markets in order. The local name is the first of these, the declared language and
    English that has one, else the name without a language, else the brand alone (a fallback); its
    language is the declared one where that is known, else English with no confidence. Names carry the
    brand in front. A missing English name or missing ingredients are fallback copies of the local name
    with its language and source. Ingredients are cut to `longest` characters."""
    brand = clean(F.coalesce(F.split_part("brands", F.lit(","), F.lit(1)), F.lit("")))
    declared = blank_to_null(F.col("lang"))
    in_known = lambda lc: lc.isin(*known)
    trusted = F.coalesce(in_known(declared), F.lit(False))
    branded = lambda t: F.when(F.coalesce(t, F.lit("")) != "", F.trim(F.concat(brand, F.lit(" "), t)))
    named = lambda lc: branded(clean(F.col("names")[lc]))
    languages = F.filter(F.concat(priority, F.array(F.coalesce(declared, F.lit("en")), F.lit("en"))), in_known)
    plain = clean(F.coalesce("product_name", F.lit("")))
    bare = F.struct(
        F.when(plain != "", F.trim(F.concat(brand, F.lit(" "), plain))).otherwise(brand).alias("text"), F.when(trusted, declared).otherwise("en").alias("language"),
        F.when(plain != "", "product_name").otherwise("brands").alias("source"), (plain == "").alias("is_fallback"), F.when(trusted, 1.0).otherwise(0.0).alias("confidence"),
    )
    local = F.coalesce(_chosen(F.transform(languages, lambda lc: _option(named(lc), lc, F.concat(F.lit("product_name_"), lc)))), bare)
    x = rows.withColumn("__v0", local)
    copied = F.col("__v0").withField("is_fallback", F.lit(True))
    english = F.coalesce(_chosen(F.array(_option(named(F.lit("en")), F.lit("en"), F.lit("product_name_en")))), copied)
    spoken = F.concat(F.array(F.col("__v0.language")), F.array(*[F.lit(c) for c in ("en", "th", "vi", "id", "ms", "zh")]))
    made_of = F.transform(spoken, lambda lc: _option(F.left(clean(F.col("ingredients")[lc]), F.lit(longest)), lc, F.concat(F.lit("ingredients_text_"), lc)))
    x = x.withColumns({"__v1": english, "__v2": F.coalesce(_chosen(made_of), copied)})
    as_view = lambda c, role: text_view(F.col(f"{c}.text"), F.col(f"{c}.language"), F.col(f"{c}.source"), role, F.col(f"{c}.is_fallback"), F.col(f"{c}.confidence"))
    return x.withColumn("views", F.array(as_view("__v0", "product_name"), as_view("__v1", "product_name"), as_view("__v2", "ingredients"))).drop("__v0", "__v1", "__v2")


def representative(records: DataFrame, item: str, market: str, preferred: str = "us") -> DataFrame:
    """One record an item: the preferred market's, else that of the first market by name."""
    order = Window.partitionBy(item).orderBy(F.col(market) != preferred, market)
    return records.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def market_views(items: DataFrame, records: DataFrame, markets: DataFrame, item: str = "item", preferred: str = "us") -> DataFrame:
    """(item, market, text, source, is_fallback, language, language_confidence): a view of every item for
    every market, from the market's own record, else a fallback from the item's representative one, else
    the item's name; an empty text is the item's name too. records: (item, market, text, language,
    language_confidence). The markets are few and broadcast."""
    per = records.dropDuplicates([item, "market"])
    chosen = representative(per, item, "market", preferred).select(F.col(item).alias("__i"), F.struct("market", "text", "language", "language_confidence").alias("__other"))
    own = per.select(F.col(item).alias("__k"), F.col("market").alias("__m"), F.struct("market", "text", "language", "language_confidence").alias("__own"))
    x = items.select(item).distinct().crossJoin(F.broadcast(markets.select("market")))
    x = x.join(own, (F.col(item) == F.col("__k")) & (F.col("market") == F.col("__m")), "left").join(chosen, F.col(item) == F.col("__i"), "left")
    from_ = F.coalesce("__own", "__other")
    x = x.withColumn("__r", from_)
    name = F.col(item).cast("string")
    return x.select(
        item, "market", F.coalesce(blank_to_null(F.col("__r.text")), name).alias("text"), F.coalesce("__r.market", F.lit(preferred)).alias("source"),
        (F.col("__own").isNull() & ~(F.col("__r").isNull() & (F.col("market") == preferred))).alias("is_fallback"),
        F.coalesce("__r.language", F.lit("unknown")).alias("language"), F.coalesce("__r.language_confidence", F.lit(0.0)).alias("language_confidence"),
    )


def brand_of(details: Column) -> Column:
    """The first brand of a map of details that is not blank, in lower case, else empty."""
    return F.lower(F.coalesce(*[F.nullif(clean(details[k]), F.lit("")) for k in BRAND_KEYS], F.lit("")))


def freetext_code(text: Column, codes: dict[str, str]) -> Column:
    """The code of the longest name that stands anywhere in the text (of equal lengths the first of
    `codes`), else null. The names are a fixed table."""
    low, found = F.lower(text), F.lit(None).cast("string")
    for name in reversed(sorted(codes, key=len, reverse=True)):
        found = F.when(low.contains(name), codes[name]).otherwise(found)
    return found


def origin(tags: Column, places: Column, by_tag: dict[str, str], by_name: dict[str, str]) -> Column:
    """(code, field): the most frequent code among the tags (ties to the first), else that named in the
    text of places, else nulls."""
    votes = first_mode(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: tag_code(t, by_tag)), lambda c: c.isNotNull()))
    named = freetext_code(places, by_name)
    return F.struct(F.coalesce(votes, named).alias("code"), F.when(votes.isNotNull(), "origins_tags").when(named.isNotNull(), "manufacturing_places").alias("field"))


def admitted(rows: DataFrame, markets: Column, code: Column) -> DataFrame:
    """`rows` with `verdict`: kept, no_market (looked at first) or no_origin."""
    return rows.withColumn("verdict", F.when(F.coalesce(F.size(markets), F.lit(0)) < 1, "no_market").when(code.isNull(), "no_origin").otherwise("kept"))


def resolve_markets(values: list[str] | None, markets: list[tuple[str, str]], more: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """The markets (name, code) that a list of names, codes or comma-joined ones asks for, in the order of
    `markets`; all without any; `more` maps further spellings to names. An unknown one is an error."""
    if not values:
        return list(markets)
    known = {alias: name for name, code in markets for alias in (name, name.replace("-", " "), code.lower())} | (more or {})
    asked = [t.strip().lower() for v in values for t in v.split(",") if t.strip()]
    if unknown := sorted({t for t in asked if t not in known}):
        raise ValueError(f"unknown markets: {', '.join(unknown)}")
    chosen = {known[t] for t in asked}
    return [m for m in markets if m[0] in chosen]


def unsellable(pairs: DataFrame, users: DataFrame, catalog: DataFrame) -> DataFrame:
    """(user, item, market) of interactions with items that the user's market does not sell."""
    return pairs.join(users, "user").join(catalog, ["market", "item"], "left_anti").select("user", "item", "market")


def sold_in_catalog(triples: DataFrame, relation: int, first: int, n_markets: int) -> DataFrame:
    """(market, item) of the triples (h, r, t) of a relation whose tail is a market's entity; market
    entities are numbered from `first`."""
    at = F.col("t") - first
    return triples.where((F.col("r") == relation) & at.between(0, n_markets - 1)).select(at.alias("market"), F.col("h").alias("item")).distinct()


def view_rules(n_languages: int) -> dict[str, Column]:
    """What holds for every view; `expected_dedup` is the mask as recomputed."""
    sure = F.col("language_confidence")
    return {
        "language_range": F.col("language_id").between(0, n_languages - 1),
        "confidence": ~F.isnan(sure.cast("double")) & sure.between(0, 1),
        "hash": F.col("content_hash").rlike("^[0-9a-f]{64}$"),
        "dedup_recomputed": F.col("dedup") == F.col("expected_dedup"),
        "dedup_valid": ~F.col("dedup") | F.col("valid"),
        "source": F.length("source") > 0,
        "role": F.length("role") > 0,
    }


def counted(found: list[tuple[str, DataFrame]]) -> DataFrame:
    """(rule, n): the sizes of tables of offenders."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, df in found]
    return reduce(DataFrame.unionByName, parts)


def outside(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Rows whose number is null or not from low to high - 1."""
    return df.where(~F.coalesce(F.col(column).between(low, high - 1), F.lit(False)))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def infinite(df: DataFrame, column: str) -> DataFrame:
    """Rows whose array holds a null, NaN or infinite element."""
    return df.where(F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def dataset_violations(tables: dict[str, DataFrame], sizes: dict[str, int]) -> DataFrame:
    """(rule, n) of a whole dataset: pairs (user, item) in range and unique, triples (h, r, t) and users
    (user, market) and items (item, country, feature, image_mask, observed) in range, features finite, masks
    in [0, 1], observed where the mask is above a half, and pairs of items that the user's market sells."""
    p, t, u, i = (tables[k] for k in ("pairs", "triples", "users", "items"))
    mask = F.col("image_mask")
    return counted([
        ("pair_users", outside(p, "user", 0, sizes["users"])), ("pair_items", outside(p, "item", 0, sizes["items"])), ("pairs_unique", repeated(p, ["user", "item"])),
        ("heads", outside(t, "h", 0, sizes["entities"])), ("relations", outside(t, "r", 1, sizes["relations"] + 1)), ("tails", outside(t, "t", 0, sizes["entities"])),
        ("user_markets", outside(u, "market", 0, sizes["markets"])), ("item_countries", outside(i, "country", 0, sizes["countries"])),
        ("features_finite", infinite(i, "feature")), ("image_mask", i.where(~F.coalesce(mask.between(0, 1) & ~F.isnan(mask.cast("double")), F.lit(False)))),
        ("image_observed", i.where(~F.col("observed").eqNullSafe(mask > 0.5))), ("sellable", unsellable(p, u, tables["catalog"])),
    ])


def catalog_violations(catalog: DataFrame, expected: DataFrame, union: int) -> DataFrame:
    """(rule, n): markets whose catalog has another size than expected (market, n), and whether the union
    has another one."""
    n = catalog.groupBy(F.col("market").alias("__m")).agg(F.count_distinct("item").alias("__n"))
    wrong = expected.join(n, F.col("market") == F.col("__m"), "left").where(F.coalesce("__n", F.lit(0)) != F.col("n"))
    other = catalog.agg(F.count_distinct("item").alias("n")).where(F.col("n") != union)
    return counted([("market_counts", wrong), ("union_count", other)])
