"""The paths of many chunks, with chunks made small, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neighbours, ngrams, topk


@pytest.fixture(scope="module")
def clouds():
    """Clouds of near vectors, equal ones, and vectors on their own."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((60, 16))
    near = x[0] + rng.uniform(0.02, 0.3, (90, 1)) * rng.standard_normal((90, 16))
    return np.concatenate([x, near, np.repeat(x[:1], 50, 0), np.repeat(x[7:9], 3, 0) * 2])


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_near_duplicates_in_small_chunks(spark, clouds, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_duplicates(table(spark, clouds)).collect()}
    y = clouds / np.linalg.norm(clouds, axis=1, keepdims=True)
    link = y @ y.T >= 0.95
    least = np.arange(len(y))
    for _ in range(len(y)):
        least = np.where(link, least, len(y)).min(1)
    assert got == {i: (int(link[i].sum()) - 1, int(least[i])) for i in range(len(y))}


def test_topk_in_small_chunks(spark, clouds, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 8)
    for scale in (1.0, 1e4):
        v = np.floor(64 * scale * clouds)
        want = []
        for q in range(0, len(v), 3):
            score = v @ v[q]
            order = [i for i in np.lexsort((np.arange(len(v)), -score)) if i != q][:20]
            want += [(q, r + 1, int(i), int(score[i])) for r, i in enumerate(order)]
        got = topk.search(table(spark, scale * clouds), F.col("id") % 3 == 0, k=20).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_bounds_of_groups_hold(clouds):
    v = np.floor(64 * clouds)
    d, size = topk.distances(v, v[:5]), (v**2).sum(1)
    g = {"n": np.array([40, len(v) - 40]), "size": np.array([size[:40].max(), size[40:].max()])}
    g |= {k: np.array([f(d[:40], axis=0), f(d[40:], axis=0)]) for k, f in (("low", np.min), ("high", np.max))}
    top = topk.reachable(d, size, g)
    assert (v @ v[:40].T <= top[:, :1]).all() and (v @ v[40:].T <= top[:, 1:]).all()


def test_join_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "LEFT", 2)
    monkeypatch.setattr(ngrams, "RIGHT", 3)
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 500, n)]
    texts = []
    for _ in range(3):
        base = words(120)
        for _ in range(14):
            t = list(base)
            for at in rng.integers(0, 120, int(rng.integers(0, 7))):
                t[at] = "changed"
            texts.append(t)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    link = np.array([[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets])
    least = np.arange(len(texts))
    for _ in texts:
        least = np.where(link, least, len(texts)).min(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngrams.join_documents(docs).collect()}
    assert got == {i: (len(sets[i]), int(least[i])) for i in range(len(texts))}
