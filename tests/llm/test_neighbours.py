"""Nearest neighbours: recall against brute force, ties, copies and odd rows."""

import numpy as np
import pytest

from claimloom.llm import neighbours
from claimloom.llm.neighbours import Table, near_neighbours

QUERY = lambda key: key % 20 == 0


def brute(rows, k=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = np.einsum("ij,ij->i", np.repeat(x[i:i + 1], len(x), 0), x)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(df, **more):
    out: dict = {}
    for r in sorted(near_neighbours(df, QUERY, **more).collect()):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, true):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in true.items()) / sum(map(len, true.values()))


@pytest.mark.parametrize("long", [False, True])
def test_recall_and_scores(spark, monkeypatch, long):
    monkeypatch.setattr(neighbours, "FULL", 60)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 1500)] + 0.4 * rng.normal(size=(1500, 16))) * (rng.uniform(0.2, 3, (1500, 1)) if long else 1)
    rows = [(k, v) for k, v in enumerate(x.astype(np.float32).tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, q int")
    true, got = brute(rows), found(df)
    assert got.keys() == true.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, true) >= 0.9
    vectors = {k: np.array(v, np.float32).astype(float) for k, v in rows}
    for q, near in got.items():
        assert near == sorted(near, key=lambda r: (-r[1], r[0]))
        assert all(s == pytest.approx(vectors[q] @ vectors[i], abs=1e-12) for i, s in near)


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=4).round(1).tolist()) for k in range(100)] + [(k, [2.0, 0.0, 0.0, -0.0]) for k in range(100, 180)]
    odd = [(1000, None), (1020, [0.0] * 4), (1040, [float("nan")] * 4), (1060, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (1080, [1.0])]
    df = spark.createDataFrame(rows + rows[95:105] + odd, "vec_id long, embedding array<double>").repartition(3)
    true, got = brute(rows), found(df)
    assert got.keys() == true.keys()
    for q in (100, 120, 160):  # their nearest are copies, the least keys first
        assert [i for i, _ in got[q]] == [i for i, _ in true[q]]
    assert recall(got, true) >= 0.9


def test_small_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert found(spark.createDataFrame([], schema)) == {}
    assert found(spark.createDataFrame([(20, [1.0, 0.0])], schema)) == {}
    assert found(spark.createDataFrame([(21, [1.0, 0.0])], schema)) == {}
    rows = [(k, [1.0, k / 10]) for k in range(15)]
    got = found(spark.createDataFrame(rows, schema))
    assert {q: [i for i, _ in near] for q, near in got.items()} == {0: list(range(1, 15))}


def test_short_lists_are_completed(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FULL", 2)
    rows = [(k, v) for k, v in enumerate(np.random.default_rng(6).normal(size=(200, 3)).tolist())]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), target=0.01)
    assert all(len(v) == 20 for v in got.values())


def test_visits_are_ordered_by_chance():
    """The visits are the best of all perturbations by the product of the hashes' chances."""
    rng = np.random.default_rng(8)
    table = Table(0, rng.normal(size=(6, 4)), rng.uniform(0, 1, 4), np.ones(4), np.full(4, 0.7))
    points = rng.normal(size=(5, 6))
    some, every = table.probes(points, 40), table.probes(points, table.shifts)
    assert every.shape[1] == 5**4 and len({tuple(p) for p in every[0]}) == 5**4
    assert (some == every[:, :40]).all()
