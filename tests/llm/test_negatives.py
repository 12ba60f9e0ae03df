"""Hard negatives against brute force, and the Hilbert curve's steps."""

import numpy as np
import pytest

from claimloom.llm import negatives
from claimloom.llm.negatives import bounds, hard_negatives, hilbert_keys

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("d,bits", [(2, 4), (3, 3), (5, 2)])
def test_curve_visits_every_cell_by_single_steps(d, bits):
    cells = np.indices((1 << bits,) * d).reshape(d, -1).T
    keys = hilbert_keys(cells, bits)
    assert len(set(keys)) == len(keys)
    path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(1)
    block, anchors = rng.integers(-50, 50, (40, 7)), rng.integers(-50, 50, (9, 7))
    low, high = bounds(anchors, block.min(0)[None], block.max(0)[None])
    scores = anchors @ block.T
    assert (low[:, 0] <= scores.min(1)).all() and (scores.max(1) <= high[:, 0]).all()


def brute(rows, is_anchor):
    x = {k: [int(np.floor(256.0 * np.float64(np.float32(c)))) for c in v] for k, _, v in rows}
    label = {k: one for k, one, _ in rows}
    score = lambda a, b: sum(p * q for p, q in zip(x[a], x[b], strict=True))
    out = []
    for a in filter(is_anchor, x):
        near = sorted((-score(a, b), b) for b in x if b != a and label[b] == label[a])[:5]
        for minus, p in near:
            other = sorted((-score(a, b), b) for b in x if b != a and label[b] != label[a] and 50 * -minus <= 100 * score(a, b) <= 95 * -minus)
            out += [(a, p, n + 1, b, -minus, -m) for n, (m, b) in enumerate(other[:3])]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 64])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GROUP", 5)
    monkeypatch.setattr(negatives, "PAGE", 3)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(k, int(rng.integers(0, 4)), (centres[rng.integers(0, 6)] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for k in range(240)]
    hot = rows[0][2]
    rows += [(k, k % 3, hot) for k in range(240, 320)]  # equal vectors, ties by key
    odd = [(1000, None, hot), (None, 1, hot), (1050, 1, None), (1100, 1, [None] * 8), (1150, 1, [float("inf")] * 8), (1200, 1, [1.0])]
    df = spark.createDataFrame([(*r, "y", 1) for r in rows + odd], "vec_id long, label int, embedding array<float>, id string, block int").repartition(4)
    got = hard_negatives(df, lambda key: key % 10 == 0)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda k: k % 10 == 0)


def test_few_and_no_rows(spark):
    schema = "vec_id long, label int, embedding array<double>"
    anchor = lambda key: key == 0
    assert hard_negatives(spark.createDataFrame([], schema), anchor).collect() == []
    alone = spark.createDataFrame([(0, 1, [1.0, 0.0])], schema)
    assert hard_negatives(alone, anchor).collect() == []
    few = spark.createDataFrame([(0, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, 2, [0.75, 0.0]), (4, 2, [0.75, 0.0]), (4, 2, [0.75, 0.0]), (5, 2, [-1.0, 0.0])], schema)
    got = sorted(map(tuple, hard_negatives(few, anchor).collect()))
    assert got == [(0, 2, 1, 3, 65536, 49152), (0, 2, 2, 4, 65536, 49152), (0, 2, 3, 4, 65536, 49152)]  # a repeated key stands for two rows
    nobody = hard_negatives(few, lambda key: key < 0)
    assert nobody.collect() == [] and nobody.columns == COLUMNS


def test_shares_no_long_products(spark):
    """Entries whose products leave 2^53 are multiplied in longs."""
    rows = [(k, k % 2, [3e5 + k, 1.0]) for k in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(map(tuple, hard_negatives(df, lambda key: key == 0, window=(1, 200)).collect()))
    x = {k: int(256 * (3e5 + k)) for k in range(8)}
    assert {(r[1], r[4]) for r in got} == {(p, x[0] * x[p] + 256 * 256) for p in (2, 4, 6)}
