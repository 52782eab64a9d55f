"""Language identification by rank-order profiles.

A language's profile is its `TOP` most frequent character n-grams (one to three characters of words
set between blanks), in order of frequency. A text's own most frequent n-grams are ranked likewise,
and the language with the smallest out-of-place distance wins: the sum, over the text's n-grams, of
how far each one's rank is from its rank in the profile, or `TOP` if it isn't in it.

Profiles are learned from texts with a language; of a language with more than `MAX_TRAIN` of them, a
share by hash of id and text is read that holds about `MAX_TRAIN`. Every whole text is predicted.

Cases: null texts and texts without a letter are `und`, score 0, as is any text where nothing was
learned; of equal n-gram counts the one of smaller code points comes first, of equal distances the
language that sorts first; texts of any length are read whole; rows with a null language or null
text teach nothing; repeated rows are predicted each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices

TOP = 300
MAX_TRAIN = 3_000
SALTS = 8
CACHE_WORDS = 150_000
WORDS = re.compile(r"[^\W\d_]+")

Profiles = dict[str, list[int]]
_CACHE: dict[str, np.ndarray] = {}


def grams(word: str) -> np.ndarray:
    """Codes of the word's n-grams: up to three code points, 21 bits each."""
    got = _CACHE.get(word)
    if got is None:
        c = [32, *map(ord, word), 32]
        two = [a << 21 | b for a, b in zip(c, c[1:], strict=False)]
        three = [a << 21 | b for a, b in zip(two, c[2:], strict=False)]
        got = np.array(c[1:-1] + two + three, dtype=np.int64)
        if len(word) <= 64:
            if len(_CACHE) >= CACHE_WORDS:
                _CACHE.clear()
            _CACHE[word] = got
    return got


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-gram codes, ascending, and how often each occurs."""
    words = Counter(w for w in WORDS.findall(text.lower()))
    if not any(c.isalpha() for w in words for c in w):
        return np.empty(0, np.int64), np.empty(0)
    each = [grams(w) for w in words]
    codes, at = np.unique(np.concatenate(each), return_inverse=True)
    weights = np.repeat(np.fromiter(words.values(), float, len(words)), [len(g) for g in each])
    return codes, np.bincount(at, weights)


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return codes[np.lexsort((codes, -counts))[:TOP]]


class Judge:
    def __init__(self, profiles: Profiles):
        self.langs = sorted(profiles)
        self.sorted, self.ranks = [], []
        for lang in self.langs:
            codes = np.array(profiles[lang], dtype=np.int64)
            order = np.argsort(codes, kind="stable")
            self.sorted.append(codes[order])
            self.ranks.append(order)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = counted(text) if text else (np.empty(0, np.int64), None)
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = ranked(codes, counts)
        place, best = np.arange(len(own)), (np.inf, "und")
        for lang, known, ranks in zip(self.langs, self.sorted, self.ranks, strict=True):
            i = np.minimum(np.searchsorted(known, own), len(known) - 1)
            apart = np.where(known[i] == own, np.abs(ranks[i] - place), TOP)
            best = min(best, (int(apart.sum()), lang))
        return best[1], 1.0 - best[0] / (TOP * len(own))


def learn(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train: Column | None = None,
    max_train: int = MAX_TRAIN,
) -> Profiles:
    """Profiles of the rows for whose id (`__id`) the condition `train` holds."""
    rows = docs.select(
        docs[id_col].cast("long").alias("__id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")
    ).where("lang is not null and text is not null")
    rows = rows if train is None else rows.where(train)
    # of rows with one id and text all or none are in the share
    place = F.xxhash64("__id", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return {}
    share = docs.sparkSession.createDataFrame(
        [(r["lang"], min((max_train << 64) // r["n"], (1 << 64) - 1) - (1 << 63)) for r in sizes], "lang string, last long"
    )
    picked = rows.join(F.broadcast(share), "lang").where(place <= F.col("last"))

    def run(batches):
        for b in batches:
            by: dict[str, Counter] = {}
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                codes, counts = counted(text.as_py())
                by.setdefault(lang, Counter()).update(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
            out = [(lang, k, int(n)) for lang, c in by.items() for k, n in c.items()]
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["lang", "gram", "n"]
            )

    totals = picked.select("text", "lang").mapInArrow(in_slices(run), "lang string, gram long, n long")
    totals = totals.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the first TOP of each language and salt, then of each language: the driver gets TOP rows a language
    first = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS))).withColumn("r", F.row_number().over(first))
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = top.where(F.col("r") <= TOP).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= TOP)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "gram", "n").collect():
        found.setdefault(r["lang"], []).append((-r["n"], r["gram"]))
    return {lang: [g for _, g in sorted(x)] for lang, x in found.items()}


def predict_documents(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for every row."""

    def run(batches):
        judge = Judge(profiles)
        for b in batches:
            got = [judge.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(in_slices(run), "doc_id long, lang_pred string, score double")
