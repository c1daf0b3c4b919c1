"""Planted near vectors: every row's links and group against brute force, by dimension."""

import numpy as np
import pytest
from tripleloom.llm import vectors


def planted(dim: int, n: int, seed: int = 0, labels: int = 3):
    """Lone vectors, pairs near the threshold, large groups, exact copies, null labels."""
    rng = np.random.default_rng(seed + dim)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    # a few directions carry most of the spread, as in learned embeddings
    centers = unit(rng.standard_normal((30, dim)))
    base = unit(centers[rng.integers(0, 30, n)] + rng.standard_normal((n, dim)) * 0.9 / dim**0.5 * 3)
    k = n // 5
    cos = rng.uniform(0.90, 0.99, k)
    side = rng.standard_normal((k, dim))
    side = unit(side - (side * base[:k]).sum(1, keepdims=True) * base[:k])
    base[k : 2 * k] = base[:k] * cos[:, None] + side * np.sqrt(1 - cos**2)[:, None]
    base[2 * k : 2 * k + 300] = unit(base[0] + rng.standard_normal((300, dim)) * 0.15 / dim**0.5)
    base[2 * k + 300 : 2 * k + 400] = base[1]
    label = rng.integers(0, labels, n)
    label[k : 2 * k] = label[:k]
    label[2 * k : 2 * k + 300] = label[0]
    label[2 * k + 300 : 2 * k + 400] = label[1]
    null = rng.random(n) < 0.01
    order = rng.permutation(n)
    return base[order] * rng.uniform(0.5, 2, (n, 1)), [None if null[i] else int(label[i]) for i in order]


def brute(x: np.ndarray, label: list, threshold: float = 0.93):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    group = np.array([-1 - i if v is None else v for i, v in enumerate(label)])
    links, root = np.zeros(len(x), int), np.arange(len(x))
    pairs = []
    for lo in range(0, len(x), 1000):
        hit = (x[lo : lo + 1000] @ x.T >= threshold) & (group[lo : lo + 1000, None] == group[None])
        i, j = np.nonzero(hit)
        i += lo
        i, j = i[i != j], j[i != j]
        links += np.bincount(i, minlength=len(x))
        pairs.append((i, j))
    i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
    while True:
        least = np.minimum(root[i], root[j])
        if (least == root[i]).all():
            break
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
    return links, root


@pytest.mark.parametrize(("dim", "deviations"), [(4, 6.0), (8, 6.0), (16, 6.0), (64, 6.0), (64, None), (256, 6.0)])
def test_recall_of_planted_links(spark, dim, deviations):
    n = 10_000
    x, label = planted(dim, n)
    want, root = brute(x, label)
    assert want.sum() > 80_000  # there is something to find
    rows = spark.createDataFrame([(i, v.tolist(), s) for i, (v, s) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int").repartition(6)
    got = {r.vec_id: r for r in vectors.near_vectors(rows, deviations=deviations).collect()}
    found = np.array([got[i].n_links for i in range(n)])
    assert (found <= want).all()
    assert found.sum() >= (1.0 if deviations is None or dim <= 36 else 0.999) * want.sum()
    if found.sum() == want.sum():
        assert [got[i].component_id for i in range(n)] == root.tolist()
    assert found.sum() % 2 == 0  # a link counts for both ends


def test_probes_shrink_with_the_dimension():
    share = {}
    for dim in (16, 64, 256):
        x, _ = planted(dim, 6000)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        share[dim] = vectors.Quantiser(x, 38).encode(x)[1].mean()
    assert share[256] < share[64] and share[256] < 0.6
