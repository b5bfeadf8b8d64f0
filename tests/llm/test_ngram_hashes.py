"""Sets are counted on whole hashes, and blocks give the components of all their links."""

import numpy as np
import pyarrow as pa
import pytest

from foliosmith.llm import ngramjoin


def test_hashes_that_agree_in_their_upper_bits_are_different():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(1 << 39, size=300).astype(np.uint64) << np.uint64(24))
    other = np.sort(np.concatenate([base[:150] + np.uint64(1), base[150:]]))
    assert ngramjoin.shared(base, other) == len(base) - 150
    batch = pa.record_batch([pa.array([1]), pa.array([2]), pa.array([base.tobytes()]), pa.array([other.tobytes()])], names=list("abxy"))
    assert not next(ngramjoin._verify_pairs(90)([batch])).num_rows
    x, y = np.array([1 << 30, (1 << 30) + 1, 7 << 40], np.uint64), np.array([1 << 30, (1 << 30) + 2, 9 << 40], np.uint64)
    assert ngramjoin.shared(x, y) == 1
    assert ngramjoin.intersections([x, y], np.array([0]), np.array([1])).tolist() == [[1]]


@pytest.mark.parametrize("bulk", [0, 7])
def test_cells(bulk):
    rng = np.random.default_rng(bulk)
    sets = [np.unique(rng.integers(1, 30, size=20)).astype(np.uint64) for _ in range(24)]
    joined = np.arange(24) < bulk
    table = pa.record_batch([pa.array([5] * 24), pa.array(np.arange(24)), pa.array(joined), pa.array([s.tobytes() for s in sets])], names=["cell", "class_id", "joined", "shingles"])
    found = [(a, b) for part in ngramjoin._verify_blocks(60)([table.slice(0, 10), table.slice(10)]) for a, b in zip(*(c.to_pylist() for c in part.columns))]
    links = {(a, b) for a in range(24) for b in range(24) if a != b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))}
    assert set(found) <= links

    def roots(edges):
        parent = list(range(24))
        for a, b in [*edges, *([(0, k) for k in range(bulk)])]:
            ra, rb = parent[a], parent[b]
            parent = [ra if p == rb else p for p in parent]
        return [parent.index(p) for p in parent]

    assert roots(found) == roots([(a, b) for a, b in links if not bulk or joined[a] != joined[b]])
