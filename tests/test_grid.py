"""Neighbours in the plane against brute force on data that a plain grid handles badly."""

import numpy as np
import pytest

from tesselar.operators import grid

NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(int(i), x, y) for i, x, y in rows], "id bigint, x double, y double")


def brute(queries, targets, k):
    out = {}
    good = lambda p: p is not None and np.isfinite(p)
    for q, qx, qy in queries:
        rows = []
        for t, x, y in targets:
            if t != q:
                d = round(float(np.sqrt((qx - x) ** 2 + (qy - y) ** 2)), 9) if all(map(good, (qx, qy, x, y))) else None
                rows.append((d is None, d or 0.0, t))
        out[q] = [(t, None if gone else -d) for gone, d, t in sorted(rows)[:k]]
    return out


def answer(spark, queries, targets, k):
    out = {q: [] for q, *_ in queries}
    rows = grid.nearest_in_plane(frame(spark, queries).repartition(3), frame(spark, targets).repartition(5), k).collect()
    for r in sorted(rows, key=lambda r: (r["query"], r["rank"])):
        out[r["query"]].append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query"]])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert all((a is None and b is None) or abs(a - b) < 2e-9 for (_, a), (_, b) in zip(got[q], want[q]))


def clumps(n=600, seed=0):
    """Scattered rows, two tight clumps of different sizes, a line, and a third of all rows at one place."""
    rng = np.random.default_rng(seed)
    xy = np.concatenate([
        rng.random((n // 4, 2)), 0.7 + rng.random((n // 6, 2)) * 1e-4, 0.2 + rng.random((n // 12, 2)) * 1e-9,
        np.column_stack([rng.integers(0, 9, n // 6) / 8, np.zeros(n // 6)]), np.full((n // 3, 2), 0.25), [[1e9, -1e9], [-0.0, 0.0], [0.0, -0.0]],
    ])
    order = rng.permutation(len(xy))
    return [(i, float(x), float(y)) for i, (x, y) in zip(order, xy)]


@pytest.mark.parametrize("leaf", [2, 256])
def test_clumped_rows(spark, monkeypatch, leaf):
    monkeypatch.setattr(grid, "LEAF", leaf)
    rows = clumps() if leaf > 2 else clumps(150)
    same(answer(spark, rows, rows, 8), brute(rows, rows, 8))


@pytest.mark.parametrize("k", [12])
def test_queries_far_from_the_targets(spark, monkeypatch, k):
    monkeypatch.setattr(grid, "LEAF", 8)
    rows = clumps(300, 1)
    targets = [r for r in rows if r[1] > 0.6 and r[1] < 1]
    same(answer(spark, rows, targets, k), brute(rows, targets, k))


def test_missing_coordinates(spark, monkeypatch):
    monkeypatch.setattr(grid, "LEAF", 2)
    rows = [(0, 0.0, 0.0), (1, None, 1.0), (2, NAN, 0.0), (3, 1.0, 0.0), (4, INF, 0.0), (5, 1.0, -INF), (6, 0.0, 0.0)]
    for k in (1, 2, 3, 5, 9):
        same(answer(spark, rows, rows, k), brute(rows, rows, k))
    some = rows[:1] + rows[2:4]
    same(answer(spark, rows, some, 4), brute(rows, some, 4))
    assert answer(spark, rows, [], 2) == {i: [] for i in range(7)} and answer(spark, [], rows, 2) == {}


def test_no_block_meets_every_other(spark):
    """On even data the leaves read per leaf do not grow with the table, and the plan has no cross join."""
    read = []
    for n in (4_000, 16_000):
        rng = np.random.default_rng(2)
        points = frame(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((n, 2)))])
        places = grid.materialise(grid._places(points, points, 9), "places")
        found = grid._Grid(places)
        pairs = grid._candidates(found, 9)
        read.append(pairs.count() / found.blocks().count())
    assert max(read) < 40 and read[1] < 1.5 * read[0]
    plan = grid.nearest_in_plane(points, points, 8)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
