"""Scalar text and hash functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(x: Column) -> Column:
    """White space (of any script) collapsed to one blank and trimmed; null stays null."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def normalized(s: str | None) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s or "").casefold()).strip()


def normalize_text(x: Column) -> Column:
    """NFKC, full case folding, white space collapsed; null counts as empty. No built-in folds fully."""

    def each(s: pd.Series) -> pd.Series:
        return s.map(normalized)

    return F.pandas_udf(each, T.StringType())(x)


def content_hash(normal: Column) -> Column:
    return F.sha2(normal, 256)


def hash_id(digest: Column) -> Column:
    """Non-negative 63-bit id from the first 16 hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("long").bitwiseAND(F.lit(2**63 - 1))


def stable_fraction(value: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the seed and the value's text only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), value), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def stable_order(value: Column, seed: int) -> Column:
    """Sorts as `stable_fraction` does, without rounding."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), value), 256), 1, 16)


def timestamp_value(x: Column) -> Column:
    """Epoch seconds of a number or an ISO time; '-', none, null, nan and blanks are null."""
    t = F.lower(F.trim(x))
    known = F.when(~t.isin("", "-", "none", "null", "nan"), F.trim(x))
    return F.coalesce(known.try_cast("double"), F.unix_micros(known.try_cast("timestamp")) / 1e6)


def tag_code(tag: Column, codes: dict[str, str]) -> Column:
    """The code of a tag such as 'en:some-name'; unknown tags are null."""
    table = F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])
    return F.try_element_at(table, F.lower(F.trim(F.regexp_replace(tag, "^[^:]*:", ""))))


def first_mode(tags: Column) -> Column:
    """The most frequent element of an array; of equals the one that comes first."""
    distinct = F.array_distinct(F.filter(tags, lambda t: t.isNotNull()))
    scored = F.transform(distinct, lambda t: F.struct((-F.size(F.filter(tags, lambda x: x == t))).alias("n"), F.array_position(tags, t).alias("p"), t.alias("t")))
    return F.array_min(scored)["t"]


def last_n(x: Column, n: int) -> Column:
    return F.slice(x, F.greatest(F.size(x) - (n - 1), F.lit(1)), F.lit(n))


def first_distinct(x: Column, n: int) -> Column:
    return F.slice(F.array_distinct(x), 1, n)


def language_map(cell: Column) -> Column:
    """array<struct<lang,text>> to a map of trimmed texts; blanks go, a later duplicate wins."""
    kept = F.filter(cell, lambda e: blank_to_null(e["text"]).isNotNull() & e["lang"].isNotNull())
    langs = F.array_distinct(F.transform(kept, lambda e: e["lang"]))
    last = F.transform(langs, lambda k: F.struct(k.alias("key"), F.trim(F.element_at(F.filter(kept, lambda e: e["lang"] == k), -1)["text"]).alias("value")))
    return F.map_from_entries(last)


def image_url(base: str, code: Column, key: Column, rev: Column) -> Column:
    """Address of a product image: codes of more than 8 digits are split 3/3/3/rest."""
    padded = F.lpad(code, 13, "0")
    path = F.when(F.length(code) > 8, F.concat_ws("/", F.substring(padded, 1, 3), F.substring(padded, 4, 3), F.substring(padded, 7, 3), F.substring(padded, 10, 99))).otherwise(code)
    return F.concat(F.lit(base + "/"), path, F.lit("/"), key, F.lit("."), rev.cast("string"), F.lit(".400.jpg"))


def first_image(x: Column) -> Column:
    """From a JSON text: the smallest key of an object, the first element of a list, else empty."""
    t = F.trim(x)
    return F.coalesce(F.when(t.startswith("{"), F.array_min(F.map_keys(F.from_json(x, "map<string,string>")))).when(t.startswith("["), F.get(F.from_json(x, "array<string>"), F.lit(0))), F.lit(""))
