"""Quality classification by hierarchical empirical Bayes.

A document classifier (logistic, on measures of the characters, words and lines of the whole text)
gives each document its own log-odds of being good. Sites, that is hosts and the paths below them,
add what their other documents show: the mean of the documents' probabilities, each path shrunk
toward its host and each host toward the global mean, the more so the fewer documents it has. How
strongly is estimated from how far hosts (and paths about their hosts) differ beyond what their
sizes explain, by the method of moments over grouped sums. A document's final log-odds are its own
plus those of its site, less the document itself, relative to the global ones.

The classifier is fitted on at most `MAX_TRAIN` labelled ids (smallest hash), one text each (of
different texts the one that sorts last); measures and site statistics take in every document.

Cases: a null or empty text has all measures zero and takes part; a null host or path is a site of
its own; labels that are null or without a document are left out, and of repeated ones the larger
holds; without labels every document scores 0.5 and stays; repeated rows count each; texts of any
length are measured whole; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fit_logistic, in_slices, join_sites

MAX_TRAIN = 20_000
THRESHOLD = 0.5
N_MEASURES = 10
_CLASS = np.zeros(256, dtype=np.int64)  # 0 letters and bytes of other scripts
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[[33, 35, 36, 37, 38, 42, 64, 94, 126]] = 4  # ! # $ % & * @ ^ ~
_CLASS[[ord(c) for c in "|<>{}[]\\/=_+"]] = 5
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 6


def measures(text: str | None) -> list[float]:
    """Shares of character classes, lengths of words, and how often words and lines repeat."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * N_MEASURES
    n = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.sqrt(n[2])), float(n[3]), float(np.sqrt(n[4])), float(np.sqrt(n[5])), float(n[6]),
        float(np.log(len(raw) / len(words))), float(np.log1p(len(words))),
        len(set(words)) / len(words), 1 - len(set(lines)) / len(lines),
        sum([w[-1:].isalnum() for w in words]) / len(words),
    ]


def measured(docs: DataFrame, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, x): the measures of every text, without the text."""

    def run(batches):
        for b in batches:
            x = [measures(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("host"), b.column("path"), pa.array(x, pa.list_(pa.float64()))],
                ["doc_id", "host", "path", "x"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path")
    )
    return rows.mapInArrow(in_slices(run), "doc_id long, host string, path string, x array<double>")


def _strength(groups: DataFrame, prior: Column) -> float:
    """How many documents the prior is worth: by moments, from squared deviations of group means."""
    g = groups.where("n > 1").agg(
        F.count("*").alias("k"),
        F.sum((F.col("s") / F.col("n") - prior) ** 2).alias("between"),
        F.sum((F.col("q") - F.col("s") ** 2 / F.col("n")) / (F.col("n") - 1)).alias("within"),
        F.sum((F.col("q") - F.col("s") ** 2 / F.col("n")) / (F.col("n") - 1) / F.col("n")).alias("noise"),
    ).first()
    if not g["k"] or g["k"] < 2 or not g["within"]:
        return 100.0
    spread = max(g["between"] / g["k"] - g["noise"] / g["k"], 1e-6)
    return float(np.clip(g["within"] / g["k"] / spread, 1.0, 1e6))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: Column | None, max_train: int):
    """(weights, intercept) of the document classifier over the measures, or None without labels."""
    picked = (
        labels.select(labels[id_col].cast("long").alias("__id"), labels[label_col].cast("int").alias("__y"))
        .where("__y in (0, 1) and __id is not null")
        .where(F.lit(True) if train is None else train)
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_train)
    )
    # at most max_train ids and labels; one text each, whose measures come to the driver
    rows = docs.select(docs[id_col].cast("long").alias("__id"), docs[text_col].cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), "__id").groupBy("__id").agg(F.max("text").alias("text"), F.max("__y").alias("y"))
    got = measured(rows, "__id", "text", F.col("y"), F.lit("")).select("x", "host").collect()
    if not got:
        return None
    a, y = np.array([r["x"] for r in got]), np.array([float(r["host"]) for r in got])
    mid, dev = a.mean(0), np.maximum(a.std(0), 1e-6)
    w, c = fit_logistic((a - mid) / dev, y, ridge=1e-3)
    return w / dev, float(c - (w / dev) @ mid)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train: Column | None = None,
    max_train: int = MAX_TRAIN,
) -> DataFrame:
    """doc_id, host, path, doc_score (the text alone), site_score (path posterior without the
    document), score (both) and kept (score at least `THRESHOLD`), for every row of `docs`."""
    x = measured(docs, id_col, text_col, host, path)
    model = fit(docs, labels, id_col, text_col, label_col, train, max_train)
    if model is None:
        half = F.lit(0.5)
        return x.select("doc_id", "host", "path", half.alias("doc_score"), half.alias("site_score"), half.alias("score"), F.lit(True).alias("kept"))
    w, c = model
    z = F.lit(c)
    for i, v in enumerate(w):
        z = z + F.lit(float(v)) * F.col("x")[i]
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    scored = x.select("doc_id", "host", "path", z.alias("z"), (1 / (1 + F.exp(-z))).alias("p"))
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") ** 2).alias("q")]
    paths = scored.groupBy("host", "path").agg(*sums)
    # a row for each path only: small beside the documents; cut here so that texts are read once more, not thrice
    paths = Scratch(docs.sparkSession, "quality").put("paths", paths)
    n_paths = paths.count()
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not total["n"]:
        return x.select("doc_id", "host", "path", *(F.lit(0.5).alias(n) for n in ("doc_score", "site_score", "score")), F.lit(True).alias("kept"))
    mean = total["s"] / total["n"]
    hosts = paths.groupBy("host").agg(*(F.sum(k).alias(k) for k in ("n", "s", "q")))
    k_host = _strength(hosts, F.lit(mean))
    hosts = hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs"))
    sites = join_sites(paths, hosts, ["host"], n_paths)
    k_path = _strength(sites, F.col("hs") / F.col("hn"))
    # each posterior leaves out the document that it is used for
    host_mean = (F.col("hs") - F.col("p") + k_host * mean) / (F.col("hn") - 1 + k_host)
    site = (F.col("s") - F.col("p") + k_path * host_mean) / (F.col("n") - 1 + k_path)
    site = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), site))
    final = F.col("z") + F.log(site / (1 - site)) - F.lit(float(np.log(mean / (1 - mean))))
    out = join_sites(scored, sites.select("host", "path", "n", "s", "hn", "hs"), ["host", "path"], n_paths)
    score = 1 / (1 + F.exp(-final))
    return out.select("doc_id", "host", "path", F.col("p").alias("doc_score"), site.alias("site_score"), score.alias("score"), (score >= THRESHOLD).alias("kept"))
