"""Toxicity by a weighted lexicon.

Texts are folded (look-alike letters of other scripts, accents, digits and signs that stand for
letters, case, marks around words), and an Aho-Corasick automaton over the folded text finds the
lexicon's terms as whole words or (marked by a star) as beginnings that many words share; a word counts
with the strongest of its terms. Exception phrases, a word with a term and the word before or after it, take
the weight back. The sum of the weights, as it stands and for the text's length, goes through a
logistic curve to a score from 0 to 1.

Lexicon, weights, phrases and curve are learned from labelled rows: a term's weight is its log-odds
of being dense (at least one word in `SPARSE`) in a toxic document, kept where it is high and so far
from chance that of all candidates less than one would be by accident; a phrase becomes an exception
where it mostly stands in clean documents. The curve is fitted on each half of the rows with the
lexicon of the other half. Learning reads at most `MAX_TRAIN` labelled ids (those of the smallest
hash), one text each; that sample is written to the checkpoint folder. Scoring reads every whole text.

Cases: a null or empty text scores as one without any term; texts of any length are read whole;
labels that are null, or of ids without a document, are left out, and of repeated ones the larger
holds; of different texts of one id the one that sorts last teaches; without labelled rows of both
classes the lexicon is empty and every score is the share of toxic rows; repeated rows are scored
each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fit_logistic, id_remainder, in_slices

MAX_TRAIN = 20_000
SPARSE = 200
STEMS = range(4, 9)  #: lengths of beginnings of words that may be terms
MIN_Z, MIN_W, STEM_W = 3.0, 2.0, 3.0
THRESHOLD = 0.3

# Look-alike letters and what they stand for.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ԁ": "d", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x", "ԛ": "q", "ԝ": "w",
    "А": "a", "В": "b", "С": "c", "Е": "e", "Н": "h", "І": "i", "Ј": "j", "К": "k", "М": "m", "О": "o", "Р": "p",
    "Ѕ": "s", "Т": "t", "У": "y", "Х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n",
    "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae",
}
# Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}

_OTHER = re.compile("[" + "".join(LOOKALIKES) + "]")
_SIGNS = re.compile(r"[@$!|]")
_LOOSE = re.compile(r"(?<![A-Za-z0-9])[@$!|]+(?![A-Za-z0-9])|(?<=[A-Za-z0-9])[@$!|]+(?![A-Za-z0-9@$!|])")
_TABLE = str.maketrans(
    {chr(i): " " for i in range(128) if not chr(i).isalnum() and chr(i) not in "'"} | {"'": ""} | SUBSTITUTES
)


_MARKS = re.compile("[\u0300-\u036f\u200b-\u200f\u2060\ufeff]+")
_OUTSIDE = re.compile(r"[^\w\x00-\x7f]+|_")


def fold(text: str) -> list[str]:
    """Words of the folded text; letters of other scripts stay, but for look-alikes."""
    if not text.isascii():
        text = _OTHER.sub(lambda m: LOOKALIKES[m.group()], text.replace("\u2019", ""))
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        text = _OUTSIDE.sub(" ", text)
    if _SIGNS.search(text):
        text = _LOOSE.sub(" ", text)
    return text.lower().translate(_TABLE).split()


def stems(word: str) -> list[str]:
    return [f"{word[:k]}*" for k in STEMS if len(word) >= k]


def dense(words: list[str]) -> set[str]:
    """The words and beginnings of words that make up at least one word in `SPARSE`."""
    n = Counter(words)
    out = Counter()
    for w, k in n.items():
        for x in stems(w):
            out[x] += k
    out.update(n)
    return {x for x, k in out.items() if k * SPARSE >= len(words)}


@dataclass
class Lexicon:
    terms: dict[str, float] = field(default_factory=dict)  #: whole words, and beginnings that end in a star
    exceptions: dict[str, str] = field(default_factory=dict)  #: phrase -> its word whose weight it takes back
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    intercept: float = 0.0

    def has(self, word: str) -> bool:
        return word in self.terms or any(x in self.terms for x in stems(word))

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            shape = f" {t[:-1]}" if t.endswith("*") else f" {t} "
            a.add_word(shape, (len(shape), t, w))
        for phrase, word in self.exceptions.items():  # from the phrase's end back to the blank before the word
            first, last = phrase.split(" ")
            a.add_word(f" {phrase} ", (len(last) + 2 if word == last else len(phrase) + 2, "", 0.0))
        a.make_automaton()
        return a

    def features(self, text: str | None, automaton) -> tuple[float, float, float]:
        """Weight found (log), weight a hundred words (log), and number of different terms."""
        words = fold(text or "")
        if not words or not self.terms:
            return 0.0, 0.0, 0.0
        best: dict[int, tuple[float, str]] = {}
        excepted = set()
        for end, (size, t, w) in automaton.iter(f" {' '.join(words)} "):
            at = end - size
            if not t:
                excepted.add(at)
            elif w > best.get(at, (0.0, ""))[0]:
                best[at] = (w, t)
        found = [x for at, x in best.items() if at not in excepted]
        total = sum(w for w, _ in found)
        return float(np.log1p(total)), float(np.log1p(100 * total / len(words))), float(len({t for _, t in found}))

    def score(self, x: tuple[float, float, float]) -> float:
        z = self.intercept + sum(a * b for a, b in zip(self.curve, x, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _counted(rows: DataFrame, keys_of) -> DataFrame:
    """(key, toxic, clean): in how many toxic and clean texts each of the keys_of(words, half) stands."""

    def run(batches):
        for b in batches:
            both = (Counter(), Counter())
            for text, y, half in zip(b.column("text"), b.column("y").to_pylist(), b.column("half").to_pylist(), strict=True):
                both[y].update(keys_of(fold(text.as_py() or ""), half))
            keys = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in both[::-1])],
                ["key", "toxic", "clean"],
            )

    got = rows.mapInArrow(in_slices(run), "key string, toxic long, clean long")
    return got.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _far(candidates: int) -> float:
    """So many standard deviations that of these candidates half a one gets there by accident."""
    return max(MIN_Z, NormalDist().inv_cdf(1 - 0.5 / max(candidates, 2)))


def _weighed(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """w: log-odds between the classes; z: signed root of the likelihood ratio, how far from chance."""
    a, b, p = F.col("toxic"), F.col("clean"), n_toxic / (n_toxic + n_clean)
    w = F.log((a + 0.5) / (n_toxic + 1.0 - a)) - F.log((b + 0.5) / (n_clean + 1.0 - b))
    part = lambda n, share: F.when(n > 0, n * F.log(n / ((a + b) * share))).otherwise(0.0)
    z = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(a, p) + part(b, 1 - p))))
    return counts.withColumn("w", w).withColumn("z", F.when(a > (a + b) * p, z).otherwise(-z))


def _chosen(found) -> dict[str, float]:
    """Weights of the terms; a beginning counts only if it tells more (`STEM_W`) and no single word with
    it makes up half of its documents."""
    main: dict[str, int] = {}
    for r in found:
        for x in [] if r["key"].endswith("*") else stems(r["key"]):
            main[x] = max(main.get(x, 0), r["toxic"])
    stays = lambda r: not r["key"].endswith("*") or (r["w"] >= STEM_W and 2 * main.get(r["key"], 0) < r["toxic"])
    return {r["key"]: float(r["w"]) for r in found if stays(r)}


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train: Column | None = None,
    max_train: int = MAX_TRAIN,
) -> Lexicon:
    """A lexicon from the labelled rows for whose id (`__id`) the condition `train` holds."""
    picked = (
        labels.select(labels[id_col].cast("long").alias("__id"), labels[label_col].cast("int").alias("y"))
        .where("y in (0, 1) and __id is not null")
        .where(F.lit(True) if train is None else train)
        .groupBy("__id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_train)
    )
    # at most max_train ids and labels; one text each
    rows = docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), "__id").groupBy("__id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.put("sample", rows.select("text", "y", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(2)).cast("int").alias("half")))
    sizes = {(r["half"], r["y"]): r["n"] for r in rows.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    total = tuple(sum(sizes.get((h, y), 0) for h in (0, 1)) for y in (0, 1))
    # variants: the rows of half 0, those of half 1, and (2) all
    n = [*((sizes.get((h, 0), 0), sizes.get((h, 1), 0)) for h in (0, 1)), total]
    made = [Lexicon() for _ in n]
    if all(total):
        of = lambda keys, half: {f"{v} {k}" for k in keys for v in (half, 2)}

        def best(counts: DataFrame, v: int, side: str):
            """The counts of one variant that stand out from chance, by key without the variant."""
            own = counts.where(F.col("key").startswith(f"{v} ")).where(F.col(side) >= 3).withColumn("key", F.substring("key", 3, 1 << 30))
            far = _far(own.count())
            weighed = _weighed(own, n[v][1], n[v][0])
            hit = (F.col("z") >= far) & (F.col("w") >= MIN_W) if side == "toxic" else F.col("z") <= -far
            return weighed.where(hit).select("key", "w", "toxic").collect()  # from a bounded sample

        words = scratch.put("words", _counted(rows, lambda ws, half: of(dense(ws), half)))
        for v, lexicon in enumerate(made):
            if all(n[v]):
                lexicon.terms = _chosen(best(words, v, "toxic"))

        def phrases(ws: list[str], half: int) -> set[str]:
            out = set()
            for v in (half, 2):
                hit = [made[v].has(w) for w in ws]
                out |= {f"{v} {a} {b}" for a, b, x, y in zip(ws, ws[1:], hit, hit[1:], strict=False) if x != y}
            return out

        odd = scratch.put("phrases", _counted(rows, phrases))
        for v, lexicon in enumerate(made):
            if all(n[v]):
                pairs = [r["key"].split(" ") for r in best(odd, v, "clean")]
                lexicon.exceptions = {f"{a} {b}": a if lexicon.has(a) else b for a, b in pairs}
    # a half's own lexicon knows its rows too well: each row is measured by that of the other half
    whole = made[2]
    judges = [made[1] if all(n[1]) else whole, made[0] if all(n[0]) else whole]

    def run(batches):
        automata = [j.automaton() if j.terms else None for j in judges]
        for b in batches:
            x = [judges[h].features(t.as_py(), automata[h]) for t, h in zip(b.column("text"), b.column("half").to_pylist(), strict=True)]
            cols = list(zip(*x, strict=True)) if x else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.float64()) for c in cols), b.column("y").cast(pa.int32())], ["a", "b", "c", "y"]
            )

    got = rows.mapInArrow(in_slices(run), "a double, b double, c double, y int").collect()  # max_train rows at most
    x, y = np.array([(r["a"], r["b"], r["c"]) for r in got]).reshape(-1, 3), np.array([r["y"] for r in got], dtype=float)
    if len(y):
        w, whole.intercept = fit_logistic(x, y)
        whole.curve = tuple(map(float, w))
    scratch.drop()
    return whole


def score_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and n_terms (how many different terms) for every row."""

    def run(batches):
        automaton = lexicon.automaton() if lexicon.terms else None
        for b in batches:
            x = [lexicon.features(t.as_py(), automaton) for t in b.column("text")]
            s = [lexicon.score(v) for v in x]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s, pa.float64()), pa.array([int(v >= THRESHOLD) for v in s], pa.int32()), pa.array([int(v[2]) for v in x], pa.int64())],
                ["doc_id", "score", "predicted", "n_terms"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(in_slices(run), "doc_id long, score double, predicted int, n_terms long")


def reject(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below the threshold."""
    at = docs.columns.index(text_col)

    def run(batches):
        automaton = lexicon.automaton() if lexicon.terms else None
        for b in batches:
            keep = [lexicon.score(lexicon.features(t.as_py(), automaton)) < THRESHOLD for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(in_slices(run), docs.schema)


def trained(docs: DataFrame, labels: DataFrame, held: int = 2, modulus: int = 4) -> Lexicon:
    """A lexicon from all labelled rows but those whose id's remainder is `held`."""
    return learn(docs, labels, train=id_remainder(F.col("__id"), modulus) != held)
