"""Multi-level k-means on the projection, all levels and restarts in shared passes.

Fitting 5 levels × 10 restarts one by one would scan the cells more than a thousand times.  Here the restarts run on a
small weighted coreset, and one job per iteration advances the best model of every level that still moves: tasks return
per-cluster sums, and only those few hundred rows reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tesselar import schemas
from tesselar.functions import scalars
from tesselar.scale import materialise

SPACES = {"umap2": ["umap2_x", "umap2_y"], "umap3": ["umap3_x", "umap3_y", "umap3_z"]}
RESTARTS = 10
MAX_ITERATIONS = 300
TOLERANCE = 1e-4
CORESET = 2000  # weighted places on which the restarts run
SEED_ROUNDS = 3  # passes over all rows in which they are drawn
SLICE_CELLS = 4_000_000  # distances held at once


def space_columns(cells: DataFrame, space: str) -> list[str]:
    dims = SPACES[space]
    missing = [d for d in dims if d not in cells.columns]
    if missing:
        raise ValueError(f"cells lack {missing}; cannot cluster in {space}")
    return dims


def seed_centres(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ starting centres of weighted points."""
    centres = [x[rng.choice(len(x), p=weight / weight.sum())]]
    d = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = (d * weight).sum()
        at = rng.choice(len(x), p=d * weight / total) if total > 0 else rng.integers(len(x))
        centres.append(x[at])
        d = np.minimum(d, ((x - x[at]) ** 2).sum(axis=1))
    return np.array(centres)


def uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A fixed draw in [0, 1) for each id."""
    z = ids.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def draw_candidates(data: DataFrame, dims: list[str], wanted: int) -> np.ndarray:
    """About ``wanted`` places by k-means‖, drawn from all rows.

    Each pass adds every row with a chance in proportion to its squared distance from the places so far, so dense regions,
    small clusters and outliers are all represented.  What reaches the driver depends on ``wanted``, not on the rows.
    """
    width = len(dims)
    one = data.agg(F.min_by(F.struct(*dims), F.struct(scalars.order_hash(F.col("id")), "id")).alias("p")).first()["p"]
    found = np.array([list(one)], dtype=np.float64)
    for turn in range(SEED_ROUNDS):
        now, cost = found, _advance(data, dims, {0: found})[0][:, -1].sum()
        if cost == 0:
            break

        def run(batches):
            for b in batches:
                x = np.column_stack([b.column(j + 1).to_numpy() for j in range(width)])
                hit = uniform(b.column(0).to_numpy(), turn) * cost * SEED_ROUNDS < wanted * _nearest(x, now)[1]
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[hit, j]) for j in range(width)], names=dims)

        new = data.select("id", *dims).mapInArrow(run, ", ".join(f"{d} double" for d in dims)).toPandas()
        found = np.unique(np.concatenate([found, new.to_numpy()]), axis=0)
    return found


def settle(x: np.ndarray, weight: np.ndarray, centres: np.ndarray, tolerance: float) -> np.ndarray:
    """Centres after as many steps over the weighted places as it takes."""
    for _ in range(MAX_ITERATIONS):
        near = _nearest(x, centres)[0]
        n = np.bincount(near, weight, minlength=len(centres))
        total = np.column_stack([np.bincount(near, weight * c, minlength=len(centres)) for c in x.T])
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1e-300)[:, None], centres)
        shift, centres = ((moved - centres) ** 2).sum(), moved
        if shift <= tolerance:
            break
    return centres


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(c)))
    for j in range(x.shape[1]):
        total += (x[:, j, None] - c[None, :, j]) ** 2
    return total


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre and the squared distance to it, in slices of bounded size."""
    near, away = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    step = max(1, SLICE_CELLS // max(1, len(c)))
    for s in range(0, len(x), step):
        d = squared_distances(x[s : s + step], c)
        near[s : s + step] = d.argmin(axis=1)
        away[s : s + step] = d[np.arange(len(d)), near[s : s + step]]
    return near, away


def _advance(data: DataFrame, dims: list[str], models: dict[int, np.ndarray]) -> dict[int, tuple]:
    """One assignment pass: per model the cluster counts, coordinate sums and total cost."""
    width = len(dims)

    def run(batches):
        total = {m: np.zeros((len(c), width + 2)) for m, c in models.items()}
        for b in batches:
            x = np.column_stack([b.column(j).to_numpy() for j in range(width)])
            for m, c in models.items():
                near, away = _nearest(x, c)
                weights = [np.ones(len(x)), *x.T, away]
                total[m] += np.column_stack([np.bincount(near, w, minlength=len(c)) for w in weights])
        rows = [(m, i, *t[i]) for m, t in total.items() for i in range(len(t)) if t[i, 0] > 0]
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:]]],
                names=["model", "cluster", *[f"s{i}" for i in range(width + 2)]],
            )

    names = [f"s{i}" for i in range(width + 2)]
    part = data.select(*dims).mapInArrow(run, "model bigint, cluster bigint, " + ", ".join(f"{n} double" for n in names))
    out = {m: np.zeros((len(c), width + 2)) for m, c in models.items()}
    for r in part.groupBy("model", "cluster").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out[r["model"]][r["cluster"]] = r[2:]
    return out


def fit(data: DataFrame, dims: list[str], ks: dict[int, int], restarts: int) -> dict[int, np.ndarray]:
    """Centres per level, from the cheapest of several restarts.

    The restarts run on a coreset: places drawn from all rows, each weighted by the rows that are nearest to it.  One pass
    over all rows prices them, and the cheapest of each level goes on over all rows until it stands still.
    """
    spread = data.agg(*[F.var_pop(d) for d in dims]).first()
    tolerance = TOLERANCE * float(np.mean([s or 0.0 for s in spread]))
    places = draw_candidates(data, dims, CORESET)
    weight = _advance(data, dims, {0: places})[0][:, 0]
    started = {}
    for m, (level, k) in enumerate((level, k) for level, k in ks.items() for _ in range(restarts)):
        started[level, m] = settle(places, weight, seed_centres(places, weight, k, np.random.default_rng(m)), tolerance)
    cost = {key: t[:, -1].sum() for key, t in _priced(data, dims, started).items()}
    running = {level: started[min((key for key in started if key[0] == level), key=cost.get)] for level in ks}
    done = {}
    for _ in range(MAX_ITERATIONS):
        for level, t in _advance(data, dims, running).items():
            n = t[:, :1]
            moved = np.where(n > 0, t[:, 1:-1] / np.maximum(n, 1), running[level])
            if ((moved - running[level]) ** 2).sum() <= tolerance:
                done[level] = moved
            running[level] = moved
        running = {level: c for level, c in running.items() if level not in done}
        if not running:
            return done
    raise RuntimeError(f"levels {sorted(running)} still move after {MAX_ITERATIONS} passes over all rows")


def _priced(data: DataFrame, dims: list[str], models: dict) -> dict:
    """``_advance`` for models under any keys."""
    keys = list(models)
    found = _advance(data, dims, {i: models[key] for i, key in enumerate(keys)})
    return {key: found[i] for i, key in enumerate(keys)}


def nearest_centre(dims: list[str], centres: np.ndarray):
    """Index of the nearest centre as a column; no join and no shuffle."""

    @arrow_udf(T.IntegerType())
    def run(*cols: pa.Array) -> pa.Array:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in cols])
        return pa.array(_nearest(x, centres)[0] if len(x) else [], pa.int32())

    return run(*dims)


def multilevel_kmeans(
    cells: DataFrame, space: str = "umap2", level_k: dict[int, int] | None = None, restarts: int = RESTARTS
) -> DataFrame:
    """Add ``cluster_L<level>``: independent k-means per level, the cheapest of several restarts.

    Level 0 is one cluster.
    """
    level_k = dict(level_k or schemas.LEVEL_K)
    if level_k.get(0) != 1:
        raise ValueError("level 0 must be configured with k = 1")
    dims = space_columns(cells, space)
    data = materialise(cells.select("id", *[F.col(d).cast("double").alias(d) for d in dims]), "vectors")
    best = fit(data, dims, {lvl: k for lvl, k in sorted(level_k.items()) if lvl > 0}, restarts)
    labels = {"cluster_L0": F.lit(0)}
    labels |= {f"cluster_L{lvl}": nearest_centre(dims, c) for lvl, c in best.items()}
    return cells.drop(*[c for c in cells.columns if c.startswith("cluster_L")]).withColumns(labels)
