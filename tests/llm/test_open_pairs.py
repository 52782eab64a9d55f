"""The n-gram join names a pair of nodes once, however many keys they share."""

import numpy as np
import pytest
from tidemark.llm import common, ngrams


def test_a_pair_is_named_once(spark, monkeypatch):
    rng, base = np.random.default_rng(5), [f"w{i}" for i in range(400)]

    def copy(name, edits):
        t = list(base)
        for at in rng.choice(np.arange(5, 395, 6), edits, replace=False):
            t[at] = f"{name}x{at}"
        return t

    # those of 4 edits link with the base; those of 9 differ in 2 n-grams too many, which sketches can't tell
    texts = [base, *(copy(f"a{i}", 4) for i in range(10)), *(copy(f"b{i}", 9) for i in range(12))]
    kind = type(spark.range(1))
    made, plain = [], kind.mapInArrow

    def watched(self, run, schema, *args, **more):
        out = plain(self, run, schema, *args, **more)
        made.extend([out] if schema == "a long, b long" else [])
        return out

    monkeypatch.setattr(kind, "mapInArrow", watched)
    monkeypatch.setattr(common.Scratch, "drop", lambda self, *names: None)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngrams.join_documents(docs).collect()}
    assert got == {i: 0 if i < 11 else i for i in range(23)}
    rows = [(df.count(), df.distinct().count()) for df in made]
    assert rows[-1][1] >= 8
    assert all(n == distinct for n, distinct in rows), rows


@pytest.mark.parametrize("seed", range(20))
def test_meetings_miss_no_pair_that_shares_a_key(seed):
    rng = np.random.default_rng(seed)
    n, kinds = int(rng.integers(1, 40)), int(rng.integers(1, 12))
    group = np.unique(np.sort(rng.integers(0, 4, n)), return_inverse=True)[1]
    side = rng.choice([0, 1, 2], n)
    keys = [rng.choice(kinds, int(rng.integers(1, kinds + 1)), replace=False).astype(np.uint64) for _ in range(n)]
    row, at = ngrams.meetings(group, side, np.array([len(k) for k in keys]), np.concatenate(keys))
    assert (np.diff(at) >= 0).all()
    meets = {(a, b) for a, x in zip(row, at, strict=True) for b, y in zip(row, at, strict=True) if x == y and side[a] != 1 and side[b] != 0}
    assert all(group[a] == group[b] for a, b in meets)
    assert {(a, b) for a in range(n) for b in range(n) if group[a] == group[b] and side[a] != 1 and side[b] != 0 and set(keys[a]) & set(keys[b])} <= meets
    for g in range(group[-1] + 1):
        of = np.flatnonzero(group == g)
        by_key = sum(sum(k in keys[i] for i in of if side[i] != 1) * sum(k in keys[i] for i in of if side[i] != 0) for k in range(kinds))
        made = sum(np.count_nonzero(side[row[(at == x) & (group[row] == g)]] != 1) * np.count_nonzero(side[row[(at == x) & (group[row] == g)]] != 0) for x in range(at[-1] + 1))
        assert made == min(by_key, np.count_nonzero(side[of] != 1) * np.count_nonzero(side[of] != 0))
