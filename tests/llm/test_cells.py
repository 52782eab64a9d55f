"""The grid of the embedding join: no cell within reach is left out."""

import numpy as np
import pytest

from tidemark.llm import neighbours


def test_reach_holds_the_own_cell_of_a_vector_at_its_centre():
    space = neighbours.Space(64, 0.95)
    width = 2 * np.sqrt(space.budgets[0])
    y = np.zeros((5, 64))
    y[:, 0] = (np.array([-1, 0, 1, 0, 1]) + 0.5) * width + [0, 5e-7, -5e-7, 0.3 * width, 0]
    y[:, 1] = [0.5 * width, 0.1 * width, 0, -0.5 * width, 1.5 * width + 5e-7]
    own, reach = space.cells(y, 0)
    held = np.array(reach)
    assert (held == own).any(0).all()
    side = int(np.ceil(1 / width)) * 2 + 3
    for i in range(len(y)):
        want = {-1}
        for a, b in [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
            c = y[i, :2] + np.array([a, b]) * (width / 2 + 1e-6)
            want.add(int(np.dot(np.floor(c / width) + side // 2, [side, 1])))
        assert set(held[:, i].tolist()) | {-1} == want and len(set(held[:, i][held[:, i] >= 0])) == (held[:, i] >= 0).sum()


@pytest.mark.parametrize("cosine", [0.95, 0.8])
def test_links_of_vectors_at_the_centre_of_a_cell(spark, cosine):
    space = neighbours.Space(64, cosine)
    rng = np.random.default_rng(3)
    y = np.zeros((40, 64))
    for j in (0, 1):
        for s in space.blocks:
            width = 2 * np.sqrt(space.budgets[space.blocks.index(s)])
            y[:, s.start + j] = 0.5 * width + rng.uniform(-5e-7, 5e-7, 40)
        y[:, 40] = np.sqrt(1 - (y[0, [0, 1, 16, 17, 32, 33, 48, 49]] ** 2).sum())
    x = y @ space.turn.T
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {r["n_links"] for r in neighbours.near_duplicates(df, cosine).collect()} == {39}
