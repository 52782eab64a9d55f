"""Keys of the n-gram join: unrelated sets share none, linked ones always do."""

import numpy as np
import pytest

from tidemark.llm import ngrams


@pytest.mark.parametrize("percent", [80, 90])
def test_unrelated_sets_share_no_keys(percent):
    rng, classes = np.random.default_rng(7), ngrams.Classes(percent)
    keys = [classes.keys(np.unique(rng.integers(0, 2**64, int(n), dtype=np.uint64))) for n in np.linspace(250, 2_000, 120)]
    _, held = np.unique(np.concatenate(keys), return_counts=True)
    assert (held == 1).all()


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key_wherever_they_differ(percent):
    """The n-grams in which they differ are spread so that each spoils a fragment of its own, and the
    others crowd into few fragments or all, so that those alike may be empty ones."""
    rng, classes, linked = np.random.default_rng(8), ngrams.Classes(percent), 0
    for _ in range(600):
        size, crowd = int(rng.integers(2, 300)), int(rng.integers(0, 60))
        own = int(rng.integers(0, size * (100 - percent) // 100 + 1))
        spread = (np.linspace(0, 1, own, endpoint=False) * 2.0**64).astype(np.uint64)
        rest = rng.integers(0, 2**64, size - own, dtype=np.uint64) >> np.uint64(crowd)
        a = np.unique(np.concatenate([rest, spread[::2]]))
        b = np.unique(np.concatenate([rest, spread[1::2]]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            linked += 1
            assert len(np.intersect1d(classes.keys(a), classes.keys(b)))
    assert linked > 300
