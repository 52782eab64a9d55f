"""Each operator against brute force, an exact round trip or held-out accuracy, with nulls, empty and
long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, links, mixing, neighbours, ngrams, pieces, quality, queries, secrets, substrings, topk, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, id long, score double, node string"


def documents(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, 1, 0.5, "x") for i, t, s in rows], DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (30, 60, 120, 200, 45)]
    near = base[3].replace("w1 ", "zz ", 1)
    edits = base[3].split()
    edits[100] = "changed"
    rows = [*base, base[1], near, " ".join(edits), base[2][: len(base[2]) // 2] + " " + base[0], base[0].upper(), "a b", "a b", "a", "", None]
    rows += ["spam " * 60, base[1].replace(" ", " \n\t "), prose(rng, 5000)]
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(rows)]
    return [*out, out[2], (None, base[4], None)]


def test_substrings_equal_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in substrings.dedup(documents(spark, texts), digests=True).collect()}
    seen, docs = {}, dict((i if i is not None else 10**9, t) for i, t, _ in texts)
    for i, t in sorted(docs.items()):
        w = WORD.findall((t or "").encode())
        drop = [False] * len(w)
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                drop[s : s + 20] = [True] * 20
        kept = b" ".join(x for x, d in zip(w, drop, strict=True) if not d)
        r = got[None if i == 10**9 else i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), sum(drop), hashlib.sha256(kept).hexdigest()), i


def test_substrings_buckets_meet_copies_of_different_tasks(spark):
    rng = random.Random(8)
    common = prose(rng, 60, 10_000)
    rows = [(i, f"{prose(rng, 30, 10_000)} {common} {prose(rng, 30, 10_000)}", "s") for i in range(60)]
    got = substrings.dedup(documents(spark, rows).repartition(4)).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in got] == [0] + [60] * 59
    assert got[0]["kept"] == rows[0][1]


def jaccard_components(texts, n, percent):
    sets = []
    for _, t, _ in texts:
        w = WORD.findall((t or "").encode().lower())
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        x = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * x >= percent * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    smallest = {}
    for i, (d, _, _) in enumerate(texts):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    return sorted((d if d is not None else -1, len(sets[i]), smallest.get(find(i), -1)) for i, (d, _, _) in enumerate(texts))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, texts, n, percent):
    rng = random.Random(3)
    more = list(texts)
    for g in range(4):  # chains of near copies around the threshold
        words = prose(rng, 150).split()
        for j in range(12):
            words = [f"x{rng.randrange(10**6)}" if rng.random() < 0.012 else w for w in words]
            more.append((1000 + 100 * g + j, " ".join(words), "s"))
    got = ngrams.join_documents(documents(spark, more).repartition(3), n, percent).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got) == jaccard_components(more, n, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_always_share_enough_keys(percent):
    rng, classes = np.random.default_rng(1), ngrams.Classes(percent)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, max(1, len(a) * (100 - percent) // 100) + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            f = classes.fragments(classes.of(max(len(a), len(b))))
            need = max(1, f - classes.difference(len(a), len(b)) - ngrams.SLACK)
            assert len(np.intersect1d(classes.keys(a), classes.keys(b))) >= need
            x, y = classes.sketch(a).view(np.uint64), classes.sketch(b).view(np.uint64)
            short = min(len(x), len(y))
            x, y = (np.bitwise_xor.reduce(z.reshape(-1, short), axis=0) for z in (x, y))
            assert np.bitwise_count(x ^ y).sum() <= classes.difference(len(a), len(b))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 200 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50)) and len(got) == 92
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, x):
    return spark.createDataFrame(x, "vec_id long, embedding array<float>, node long")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    mid = rng.standard_normal((12, 16))
    x = [m + s * rng.standard_normal(16) for m in mid for s in (0, 0.05, 0.12, 0.2, 0.25)]
    rows = [(i, [float(np.float32(v)) for v in p], 0) for i, p in enumerate(x)]
    rows += [(100, rows[0][1], 0), (101, [2 * v for v in rows[0][1]], 0), (102, None, 0), (103, [0.0] * 16, 0), (104, [float("nan")] * 16, 0), (105, [None] * 16, 0), (106, [], 0), (107, [1.0, 2.0], 0)]
    return [*rows, (3, rows[7][1], 0)]


def usable(v, zero):
    return bool(v) and None not in v and np.isfinite(v).all() and (zero or any(v))


def test_near_duplicates_equal_brute_force(spark, points):
    got = sorted(tuple(r) for r in neighbours.near_duplicates(vectors(spark, points)).collect())
    n = len(points)
    link = np.zeros((n, n), bool)
    for a, b in itertools.combinations(range(n), 2):
        x, y = points[a][1], points[b][1]
        if usable(x, False) and usable(y, False) and len(x) == len(y):
            link[a, b] = link[b, a] = np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y)) >= 0.95
    root = np.arange(n)
    for _ in range(n):
        for a, b in zip(*np.nonzero(link), strict=True):
            root[a] = min(root[a], root[b])
    smallest = {r: min(points[i][0] for i in range(n) if root[i] == r) for r in set(root)}
    want = [(points[i][0], int(link[i].sum()), smallest[root[i]], points[i][0] == smallest[root[i]]) for i in range(n)]
    assert got == sorted(want)
    assert neighbours.near_duplicates(vectors(spark, [])).count() == 0


def test_topk_equals_brute_force(spark, points):
    got = sorted(tuple(r) for r in topk.search(vectors(spark, points), F.col("id") % 5 == 0, k=7).collect())
    ok = [(i, np.floor(64 * np.array(v))) for i, v, _ in points if usable(v, True)]
    want = []
    for q, x in ok:
        if q % 5 == 0:
            scores = sorted((-int(np.dot(x, y)), i) for i, y in ok if i != q and len(x) == len(y))[:7]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert got == sorted(want)
    assert topk.search(vectors(spark, []), F.col("id") % 5 == 0).count() == 0


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = queries.tokenizer_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "ß", "😀", "日本", " ", "0", "12", "Ing", "http://", "<s>", "<0x0A>", "​", "\x00", "\r", "é", "<unk>", "%%%"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(400)] + ["", None, " ", "x" * 5000, prose(rng, 3000)]
    df = documents(spark, [(i, t, "s") for i, t in enumerate(rows)] + [(0, rows[0], "s")])
    out = {r["doc_id"]: r for r in pieces.encode_documents(df, path).collect()}
    assert len(out) == len(rows)
    for i, t in enumerate(rows):
        ids = sp.encode(t or "")
        assert (out[i]["n_tokens"], out[i]["ids"], out[i]["decoded"]) == (len(ids), ",".join(map(str, ids)), sp.decode(ids)), repr(t)
    model = pieces.model_of(open(path, "rb").read())
    for _ in range(300):
        ids = [rng.randrange(3, 300) if rng.random() < 0.5 else rng.randrange(32000) for _ in range(rng.randrange(1, 9))]
        ids = [i for i in ids if i > 2]
        assert model.decode(ids) == sp.decode(ids), ids


def test_secrets_base_equals_plain_patterns_and_links(spark):
    rng = random.Random(4)
    parts = ["token", "Secret", "api_key", "apikey", "=", ":", " ", "'", '"', "AKIA", "AKIA" + "Z9" * 9, "deadbeef", "0123456789abcdef", "longvalue12345", "é", "\n\n", "ſecret", "password: token: abcdefghijklmnop"]
    key = "q9Xv2LmT7rKd4WzP8nBy"
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(400)]
    texts += ["", None, f"client_id = someclient then {key}", key, f"client_id = someclient\n\n{key}", f"user: bob {key} https://h.example.com/x", "see https://h.example.com/x", f"client_id: abcd {'z ' * 400}{key}"]
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in secrets.find_secrets(df).collect()}
    plain = [
        ("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m.group(2)) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 16),
    ]
    for i, t in enumerate(texts):
        spans = [(m.start(), j, m.end(), k) for j, (k, p, ok) in enumerate(plain) for m in re.finditer(p, t or "") if ok(m)]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
        n = Counter(x[3] for x in spans)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (n["assign"], n["access"], n["hex"], hashlib.sha256(joined.encode()).hexdigest()), repr(t)
    kinds = [sorted(x.split(":")[0] for x in got[i]["spans"].split(",") if x) for i in range(402, 408)]
    assert kinds == [["ident", "key"], [], [], ["endpoint", "ident", "key"], [], []]
    assert secrets.mask_spans(texts[402]) == "client_id = <ident> then <key>" and secrets.mask_spans(None) is None


def test_toxicity_learns_folds_and_excepts(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        words, toxic = prose(rng, 60).split(), i % 4 == 0
        if toxic:
            for w in ("idiot", "scum"):
                words[rng.randrange(60)] = w
        elif i % 4 == 1:
            words[10:12] = ["scum", "pond"]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    lab = spark.createDataFrame([*labels, (None, 1), (9999, 1), (0, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(documents(spark, rows), lab, train=F.col("__id") < 300)
    assert "idiot" in lexicon.terms
    extra = [(1000, "you are an 1d10t and sсum", "s"), (1001, "IDIOT!!! scum...", "s"), (1002, None, "s"), (1003, "", "s"), (1004, "idiotic scummy", "s")]
    got = {r["doc_id"]: r for r in toxicity.score_documents(documents(spark, rows[300:] + extra + rows[300:301]), lexicon).collect()}
    assert all(got[i]["predicted"] == labels[i][1] for i in range(300, 400))
    assert [got[i]["predicted"] for i in range(1000, 1005)] == [1, 1, 0, 0, 0]
    kept = toxicity.reject(documents(spark, rows[300:]), lexicon)
    assert kept.count() == 75 and kept.columns == documents(spark, []).columns
    empty = toxicity.learn(documents(spark, []), lab)
    assert empty.terms == {} and toxicity.score_documents(documents(spark, rows[:3]), empty).count() == 3


def test_language_equals_plain_profiles_and_is_accurate(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op8_language(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert {r["doc_id"] for r in held} == {i for i, r in got.items() if r["held_out"]}
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.95

    def profile(texts):
        n = Counter()
        for t in texts:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                p = f" {w} "
                n.update(w)
                n.update(p[i : i + k] for k in (2, 3) for i in range(len(p) - k + 1))
        return n

    def order(n):  # shorter n-grams have smaller codes
        return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[: language.TOP]]

    train = [r for r in rows if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    ranks = {lang: {g: i for i, g in enumerate(order(profile(r["text"] for r in train if r["lang"] == lang)))} for lang in {r["lang"] for r in train}}
    for r in held[:60]:
        own = order(profile([r["text"]]))
        best = min((sum(abs(i - ranks[x][g]) if g in ranks[x] else language.TOP for i, g in enumerate(own)), x) for x in ranks)
        assert got[r["doc_id"]]["lang_pred"] == best[1]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - best[0] / (language.TOP * len(own)))


def test_language_edges(spark):
    odd = [(0, None, "s"), (1, "", "s"), (2, "12 ²³ !!", "s"), (3, "the the", "s")]
    profiles = language.learn(documents(spark, [(i, "the cat and the dog", "s") for i in range(5)]))
    got = {r["doc_id"]: tuple(r)[1:] for r in language.predict_documents(documents(spark, odd), profiles).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3 and got[3][0] == "en" and 0 <= got[3][1] <= 1
    assert language.learn(documents(spark, [])) == {}


def test_mixing_weights_passes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 300)
    rng = random.Random(7)
    size = {"big": 300, "mid": 60, "small": 12}
    rows = [(1000 * k + i, prose(rng, rng.randrange(5, 30)), s) for k, (s, n) in enumerate(size.items()) for i in range(n)]
    docs = documents(spark, [*rows, (5000, None, None), (5001, "", "big")])
    counts = mixing.token_counts(docs, "doc_id", "text", "source").cache()
    tokens = {r["s"]: r["t"] for r in counts.groupBy("s").agg(F.sum("tokens").alias("t")).collect()}
    out = mixing.mix_documents(docs, repetition=3.0).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in rows} | {5000, 5001}
    got = Counter()
    for r in out:
        got[r["source"]] += r["n_tokens"]
    a = mixing.plan(counts, repetition=3.0).exponent
    assert (tokens["big"] / tokens["small"]) ** (1 - a) == pytest.approx(3.0)
    for s in size:
        want = (tokens[s] / tokens["big"]) ** (a - 1) * tokens[s]
        assert want - 30 <= got[s] <= want + 1e-6, s
    assert Counter((r["doc_id"], r["epoch"]) for r in out).most_common(1)[0][1] == 1
    assert all(0 <= r["position"] < 1 for r in out)
    target = 0.9
    a = mixing.plan(counts, entropy=target).exponent
    w = np.array([tokens[s] for s in size], float) ** a
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(target, abs=1e-6)
    assert mixing.mix_documents(documents(spark, []), repetition=2.0).count() == 0


def test_quality_shrinks_sites_and_is_accurate(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op10_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([got[r["doc_id"]]["kept"] == bool(r["quality"]) for r in held]) > 0.95
    none = quality.classify(documents(spark, [(1, None, None), (1, "", "s")]), spark.createDataFrame([], "doc_id long, quality int"), F.col("source"), F.col("lang"))
    assert [tuple(r)[3:] for r in none.collect()] == [(0.5, 0.5, 0.5, True)] * 2


def test_sites_pull_toward_their_own_documents(spark):
    rng = random.Random(9)
    good = lambda: prose(rng, 40)
    bad = lambda: prose(rng, 40).replace(" ", "$$$ ")
    rows = [(i, good() if i % 2 else bad(), "a" if i % 2 else "b") for i in range(200)]
    rows += [(1000, good()[:20] + "$$$ x$$$", "a"), (1001, rows[-1][1], "b")]
    rows[-1] = (1001, rows[-2][1], "b")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(documents(spark, rows), labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()}
    assert got[1000]["doc_score"] == got[1001]["doc_score"] and got[1000]["site_score"] > got[1001]["site_score"] and got[1000]["score"] > got[1001]["score"]


def test_pipeline_stages(spark, tmp_path):
    corpus = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = docs.count()
    for name, stage in corpus.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "ngram_jaccard":
            want = jaccard_components([(r["doc_id"], r["text"], "") for r in before.collect()], 5, 80)
            assert sorted(r["doc_id"] for r in docs.collect()) == [d for d, _, c in want if d == c]
        if name == "secrets":
            assert docs.count() == before.count() and not any(secrets.base_spans(r["text"]) for r in docs.collect())
        if name == "mixing":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
        if name != corpus.STAGES[-1][0]:
            assert docs.columns == before.columns
    assert 0 < docs.select("doc_id").distinct().count() <= start
