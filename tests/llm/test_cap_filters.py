"""Cap filters against brute force: recall at the threshold, dense groups, cells of every size, and rows of every kind."""

import numpy as np
import pytest

from foliosmith.llm import capfilters


def turned(rng, x, cosine):
    """Unit vectors at that cosine to the rows of x."""
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine * cosine) * z


@pytest.mark.parametrize("n", [10_000, 50_000_000])
def test_recall_at_the_threshold(n):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coder = capfilters.CapFilters(64, code=capfilters.code_size(n, 4, 24))
    rows, found = coder.decode(x)
    other, met = coder.decode(turned(rng, x, 0.931))
    both = np.intersect1d(rows * 2**31 + found, other * 2**31 + met) // 2**31
    assert len(np.unique(both)) >= (0.985 if n < 1e6 else 0.95) * len(x)


def brute(rows, least=0.93):
    ids, vecs, labels = zip(*rows)
    unit = np.array(vecs, float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    labels = np.array(labels)
    near = (unit @ unit.T >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    root = np.array(ids)
    while True:
        new = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == root).all():
            return {i: (int(near[k].sum()), int(root[k]), bool(root[k] == i)) for k, i in enumerate(ids)}
        root = new


def vectors(seed=5):
    """Far vectors, pairs of near ones, one dense group, exact copies."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(300, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    every = np.concatenate([base, turned(rng, base[:80], 0.97), turned(rng, np.repeat(base[:1], 150, axis=0), 0.985), np.repeat(base[5:6], 40, axis=0)])
    order = rng.permutation(len(every))
    return [(int(k) * 3, [float(x) for x in every[at]], int(at) % 2 if at < 380 else 0) for k, at in enumerate(order)]


@pytest.mark.parametrize("cell,few", [(None, 16), (40, 16), (40, 2)])
def test_links_and_components(spark, monkeypatch, cell, few):
    monkeypatch.setattr(capfilters, "FEW", few)
    monkeypatch.setattr(capfilters, "TILE", 64)
    rows = vectors()
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in capfilters.near_duplicates(made, cell=cell).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    links, found = sum(w[0] for w in want.values()), sum(g[0] for g in got.values())
    assert all(got[k][0] <= want[k][0] for k in want) and found >= 0.99 * links
    assert sum(got[k][1:] == want[k][1:] for k in want) >= 0.98 * len(want)


def test_rows_of_every_kind(spark):
    one, other = [1.0, 0.5, 0.25, 0.0], [1.0, 0.5, 0.25, 0.01]
    rows = [(1, one, 0), (1, one, 0), (2, other, 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [0.0] * 4, 0), (7, [float("inf"), 1.0, 0.0, 0.0], 0), (8, [None, 1.0, 0.0, 0.0], 0),
            (9, [], 0), (10, one + [0.0], 0), (None, one, 0), (11, one, 0), (11, one, 0), (12, [-x for x in one], 0), (13, [x * 1e-200 for x in one], 0), (14, [x * 1e200 for x in one], 0)]
    made = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, label int, content int, vec string, members int").repartition(4)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in capfilters.near_duplicates(made).collect() if r["vec_id"] is not None)
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 12)]
    linked = [(k, n, 1, k == 1) for k, n in ((1, 6), (1, 6), (2, 6), (11, 6), (11, 6), (13, 6), (14, 6))]
    assert got == sorted(alone + linked)
    assert [r["n_links"] for r in capfilters.near_duplicates(made.filter("vec_id is null")).collect()] == [0]
