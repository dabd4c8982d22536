"""Near dedup compares every pair of different components of a bucket."""

from math import comb

import numpy as np
import pytest

from leakfree.llm import near_dedup
from tests.llm.test_dedup_and_rules import as_classes, brute_classes


def changed(rng, words, at):
    w = list(words)
    for k in at:
        w[k] = f"x{rng.integers(1 << 40)}"
    return w


def chains(rng):
    """Copies of copies, each changed further than the one before."""
    base = [f"w{i}" for i in range(200)]
    out = []
    for _ in range(40):
        w = list(base)
        for _ in range(12):
            w = changed(rng, w, rng.choice(200, 2, replace=False))
            out.append(" ".join(w))
    return out


def many_components(rng):
    """Copies around similarity 0.7 to each other, with a few links between them."""
    base = [f"w{i}" for i in range(200)]
    out = []
    for _ in range(700):
        out.append(" ".join(changed(rng, base, rng.choice(200, int(rng.integers(3, 6)), replace=False))))
    return out


@pytest.mark.parametrize("make", [chains, many_components])
@pytest.mark.parametrize("block", [512, 16])
def test_classes_equal_all_pairs(spark, monkeypatch, make, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block, raising=False)
    rows = list(enumerate(make(np.random.default_rng(11))))
    want = brute_classes(rows)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert as_classes(got) == want


def test_cells_bound_the_overlap():
    rng = np.random.default_rng(3)
    for size in (20, 400, 300_000):
        a = np.unique(rng.integers(0, 2 ** 62, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(size * 0.8)], rng.integers(0, 2 ** 62, size // 7).astype(np.uint64)]))
        x, y = (np.frombuffer(near_dedup.cells(v), np.uint8).astype(np.int64) for v in (a, b))
        assert np.minimum(x, y).sum() + min(len(a) - x.sum(), len(b) - y.sum()) >= len(np.intersect1d(a, b))


def test_the_sketch_loses_less_than_the_bands():
    bands = (1 - near_dedup.SIMILAR ** near_dedup.ROWS) ** near_dedup.BANDS
    m, equal = near_dedup.BANDS * near_dedup.ROWS, (1 + near_dedup.SIMILAR) / 2
    sketch = sum(comb(m, k) * equal ** k * (1 - equal) ** (m - k) for k in range(near_dedup.AGREE))
    assert sketch < bands / 10
