"""op4: repeated ids with different vectors, against brute force; recall at 64 and 768 dimensions."""

import numpy as np
import pytest

from cuelake.llm import embeddings


def by_definition(rows, threshold=0.95):
    """(id, n_links, component) of each row, rows being (id, vector): every pair of rows is compared, and a row is a vector of its own."""
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    least = {g: min(i for (i, _), c in zip(rows, label, strict=True) if c == g) for g in set(label.tolist())}
    return sorted((i, int(n.sum()), least[c]) for (i, _), n, c in zip(rows, near, label.tolist(), strict=True))


def test_repeated_ids(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    rows = [(int(k % 12), (base[k % 25] + rng.normal(scale=0.02, size=8)).tolist()) for k in range(80)]
    rows += [(5, [1.0] + [0.0] * 7), (5, [1.0, 0.1] + [0.0] * 6), (7, [0.0, 1.0] + [0.0] * 6), (8, [0.0, 1.0, 0.1] + [0.0] * 5), (8, [0.0] * 7 + [1.0]), (8, [0.0] * 7 + [1.0])]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == by_definition(rows)


@pytest.mark.parametrize("d, n", [(64, 3000), (768, 1500)])
def test_recall(spark, d, n):
    """Groups of near copies around the threshold among unrelated vectors, over many cells: of all true links nine in ten at least, and none that is false."""
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(n // 5, d))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = centres[rng.integers(len(centres), size=n)] + rng.normal(scale=0.2 / np.sqrt(d), size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    found = embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), per_cell=64)
    got = {r.vec_id: r.n_links for r in found.collect()}
    assert near.sum() > n and all(got[i] <= near[i].sum() for i in range(n))
    assert sum(got.values()) >= 0.9 * near.sum()
