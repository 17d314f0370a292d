import numpy as np
import pytest

from webgleaner.llm import simhash


def near_values(n, seed):
    """Values around a few centres, some of them equal."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 2**63, (4, 4), dtype=np.uint64)[rng.integers(0, 4, n)].copy()
    for row in values:
        for bit in rng.integers(0, 256, rng.integers(0, 45)).tolist():
            row[bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
    return values


def reached(n, links):
    root = list(range(n))
    for a, b in links:
        a, b = root[a], root[b]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("first", [0, 1, 60])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_block_trees_find_all_pairs(first, seed):
    values, radius = near_values(120, seed), 42
    sizes = np.random.default_rng(seed).integers(80, 130, 120)
    far = np.bitwise_count(values[:, None] ^ values[None]).sum(axis=2)
    upto = first or 120
    expected = {(i, j) for i in range(upto) for j in range(max(first, i + 1), 120) if far[i, j] <= radius}
    found = [(i, j) for i, near in simhash.tree_pairs(values, radius, first) for j in near.tolist()]
    assert len(found) == len(set(found)) and set(found) == expected and expected
    fitting = [(i, j) for i, j in expected if min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j])]
    links = simhash.block_links(values, sizes, radius, 0.8, first)
    assert set(links) <= set(fitting) and reached(120, links) == reached(120, fitting)


def test_block_trees_skip_what_lies_too_far():
    """Only the first node meets values of the other centre."""
    values = np.zeros((20, 4), dtype=np.uint64)
    values[10:] = np.uint64(2**64 - 1)
    values[np.arange(20), 0] ^= np.uint64(1) << np.arange(20, dtype=np.uint64)
    assert all(near.max() < 10 or i >= 10 for i, near in simhash.tree_pairs(values, 4, 0))
