"""Level-of-detail operators: grid thinning, display subset, overlap suppression, budget sampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions import scalars
from tesselar.operators.selection import difference
from tesselar.scale import first_by_hash, materialise, one_row, ranked

SUBSET_THRESHOLD = 200_000
DISPLAY_CAP = 200_000
OVERLAP_RATIO = 0.8
BLOCK_CELLS = 128  # block edge, in cells of one radius
CELL_LIST = 32  # items of a cell that a round looks at
GONE, OPEN, DOUBTFUL, KEPT = range(4)


def grid_shape(cap: int) -> tuple[int, int]:
    """Grid with at least ``cap`` bins, a little wider than high."""
    gx = max(1, math.ceil(math.sqrt(cap * 1.25)))
    return gx, math.ceil(cap / gx)


def thinned(points: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """At most one point per grid bin, the first in hash order, and at most ``cap`` points in all."""
    gx, gy = grid_shape(cap)
    ok = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) < double('infinity') and abs(y) < double('infinity')")
    box = one_row(ok.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))

    def slot(c: str, n: int):
        span = F.greatest(box[f"{c}1"] - box[f"{c}0"], F.lit(1e-12))
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - box[f"{c}0"]) / span * (n - 1e-9))))

    h = scalars.order_hash(F.col("id"), seed)
    firsts = ok.groupBy(slot("x", gx).alias("bx"), slot("y", gy).alias("by")).agg(F.min(F.struct(h.alias("h"), "id")).alias("m"))
    return _first_ids(firsts.select("m.id"), cap, seed)


def _first_ids(ids: DataFrame, count: int, seed: int) -> DataFrame:
    """The first ``count`` ids in hash order."""
    quota = ids.agg(F.lit(count).cast("bigint").alias("quota"), F.count("*").alias("size"))
    return first_by_hash(ids.select("id"), [], quota, scalars.order_hash(F.col("id"), seed) / F.lit(2.0 ** 32), ["id"])


def display_subset(points: DataFrame, threshold: int = SUBSET_THRESHOLD, cap: int = DISPLAY_CAP, seed: int = 42) -> DataFrame:
    """Displayed ids with their dense position: everything up to the threshold, else exactly ``cap``.

    Above it, grid-thinned points come first and a uniform (hash-ordered) draw fills up.
    """
    n = points.count()
    if n <= threshold:
        return ranked(points.select("id"), [], ["id"], "position")
    picked = materialise(thinned(points, min(cap, n), seed), "thinned")
    need = min(cap, n) - picked.count()
    fill = _first_ids(difference(points.select("id"), picked), need, seed)
    return ranked(picked.unionByName(fill), [], ["id"], "position")


def overlap_radius(tile_size: float, base_zoom: float) -> float:
    return OVERLAP_RATIO * max(1e-3, tile_size) * 2.0 ** -base_zoom


def _settle_block(pdf: pd.DataFrame, radius: float) -> pd.DataFrame:
    """Items of one block that are certainly kept, whatever happens outside the block.

    Same outcome as a sweep of the block best first.  ``inner`` marks items the block owns; others, and the last item of a
    cut cell list, only cast doubt on what they touch.  Two items of a cell always conflict, so each step looks at the best
    open item of every cell at once, and decides those whose better neighbours are all decided.
    """
    items = pdf.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
    n = len(items)
    row, col = (items[c].to_numpy() - items[c].min() + 1 for c in ("cx", "cy"))
    shape = int(row.max()) + 2, int(col.max()) + 2
    cell = row * shape[1] + col
    order = np.argsort(cell, kind="stable")
    slot = np.empty(n, dtype=np.int64)
    slot[order] = np.arange(n) - np.searchsorted(cell[order], cell[order])
    shape = (*shape, int(slot.max()) + 1)
    where = row, col, slot
    rank, state = np.full(shape, n), np.full(shape, GONE, dtype=np.int8)
    x, y = np.full(shape, np.inf), np.full(shape, np.inf)
    own, last = np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)
    rank[where], state[where] = np.arange(n), OPEN
    x[where], y[where] = items["x"], items["y"]
    own[where], last[where] = items["inner"], items["cut"]
    around = [(di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1)]
    # Cells whose best open item may be decided now: at first all, then those near a cell that has changed.
    look = np.ones(shape[:2], dtype=bool)
    while True:
        i, j = np.nonzero(look)
        open_ = state[i, j] == OPEN
        some = open_.any(axis=1)
        if not some.any():
            break
        i, j, k = i[some], j[some], open_[some].argmax(axis=1)
        mine, px, py = rank[i, j, k][:, None], x[i, j, k][:, None], y[i, j, k][:, None]
        seen = {s: np.zeros(len(i), dtype=bool) for s in (OPEN, DOUBTFUL, KEPT)}
        for di, dj in around:
            at = i + di, j + dj
            better, now = rank[at] < mine, state[at]
            touches = better & (np.abs(x[at] - px) < radius) & (np.abs(y[at] - py) < radius)
            # Behind the last item of a cut list there may be others that touch.
            matters = touches | (better & last[at])
            seen[KEPT] |= (touches & (now == KEPT)).any(axis=1)
            for s in (OPEN, DOUBTFUL):
                seen[s] |= (matters & (now == s)).any(axis=1)
        fine = own[i, j, k] & ~last[i, j, k] & ~seen[DOUBTFUL]
        state[i, j, k] = np.select([seen[KEPT], seen[OPEN], fine], [GONE, OPEN, KEPT], DOUBTFUL)
        won = ~seen[KEPT] & ~seen[OPEN] & fine
        changed = np.zeros(shape[:2], dtype=bool)
        decided = seen[KEPT] | ~seen[OPEN]
        changed[i[decided], j[decided]] = True
        for di, dj in around:  # what a kept item covers is gone at once
            at = i[won] + di, j[won] + dj
            covered = (state[at] == OPEN) & (np.abs(x[at] - px[won]) < radius) & (np.abs(y[at] - py[won]) < radius)
            r, c = np.nonzero(covered)
            state[at[0][r], at[1][r], c] = GONE
            changed[at[0][r], at[1][r]] = True
        look[:] = False
        i, j = np.nonzero(changed)
        for di, dj in around:
            look[np.clip(i + di, 1, shape[0] - 2), np.clip(j + dj, 1, shape[1] - 2)] = True
    return items.loc[state[where] == KEPT, ["id", "x", "y", "cx", "cy"]]


def suppress_overlaps(items: DataFrame, radius: float, block: int = BLOCK_CELLS, per_cell: int = CELL_LIST) -> DataFrame:
    """Greedy suppression of ``items(id, x, y, score)``: by score descending, id ascending, an item is
    dropped when it lies within Chebyshev ``radius`` of a kept one.

    Same result as the sequential sweep.  Space is cut into cells of one radius, so two items of a
    cell always conflict and a cell keeps at most one.  A round sends the best few items of every cell
    to blocks of cells (with a rim of neighbours), where all decisions that nothing outside can change
    are taken; covered items then leave.  Undecided ones meet the next round on shifted blocks.  Block
    input is bounded by cells × list length however full a cell is, and no pairs are formed.  An item without finite
    coordinates touches nothing, so it stays.
    """
    if not (radius > 0 and math.isfinite(radius)):
        return items.select("id")
    cell = lambda c: F.floor(F.col(c) / radius).alias(f"c{c}")
    finite = F.lit(True)
    for c in ("x", "y"):
        v = F.col(c).cast("double")
        finite = finite & F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    apart, items = items.filter(~finite).select("id"), items.filter(finite)
    active = items.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("score").cast("double").alias("score"), cell("x"), cell("y"))
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    best_first = Window.partitionBy("cx", "cy").orderBy(F.desc("score"), "id")
    settle = lambda pdf: _settle_block(pdf, radius)
    kept, turn = [apart], 0
    while turn == 0 or not active.isEmpty():
        shift = (turn % 2) * (block // 2)
        home = lambda c: F.floor((F.col(c) + shift) / block)

        def homes(c: str) -> Column:
            at = F.pmod(F.col(c) + shift, F.lit(block))
            return F.array_compact(F.array(home(c), F.when(at == 0, home(c) - 1), F.when(at == block - 1, home(c) + 1)))

        lists = active.withColumn("_n", F.row_number().over(best_first)).filter(F.col("_n") <= per_cell + 1)
        sent = (
            lists.select("*", F.explode(homes("cx")).alias("bx"))
            .select("*", F.explode(homes("cy")).alias("by"))
            .withColumn("inner", (F.col("bx") == home("cx")) & (F.col("by") == home("cy")))
            .withColumn("cut", F.col("_n") > per_cell)
            .drop("_n")
        )
        winners = materialise(
            sent.groupBy("bx", "by").applyInPandas(settle, "id bigint, x double, y double, cx bigint, cy bigint"), "winners"
        )
        kept.append(winners.select("id"))
        cover = winners.select("x", "y", "cx", "cy", around.alias("o")).groupBy(
            (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy")
        ).agg(F.collect_list(F.struct("x", "y")).alias("w"))  # at most nine kept items around a cell
        hit = F.exists("w", lambda p: (F.abs(F.col("x") - p["x"]) < radius) & (F.abs(F.col("y") - p["y"]) < radius))
        active = materialise(active.join(cover, ["cx", "cy"], "left").filter(F.col("w").isNull() | ~hit).drop("w"), "active")
        turn += 1
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def budget_sample(points: DataFrame, level: int, lod: float = 1.0) -> DataFrame:
    """Keep points whose display hash is under min(1, budget · lod / pool)."""
    n = points.agg(F.count("*")).scalar()
    threshold = F.least(F.lit(1.0), F.lit(scalars.POINT_BUDGETS[max(1, min(6, level)) - 1] * lod) / F.nullif(n, F.lit(0)))
    return points.filter((threshold >= 1.0) | (scalars.sample_hash(F.col("id")) < threshold))


def hash_capped_groups(members: DataFrame, caps: DataFrame, seed: int = 0) -> DataFrame:
    """``members(group, id)`` cut to the first ids in hash order of each group, as many as ``caps(group, cap)`` says."""
    sizes = members.groupBy("group").agg(F.count("*").alias("size"))
    quota = sizes.join(caps, "group").select("group", F.col("cap").cast("bigint").alias("quota"), "size")
    return first_by_hash(members.select("group", "id"), ["group"], quota, scalars.order_hash(F.col("id"), seed) / F.lit(2.0 ** 32), ["id"])


def hash_capped(ids: DataFrame, cap: int | None, seed: int = 0) -> DataFrame:
    """``cap`` ids in a fixed hash order; None (the default everywhere) keeps all."""
    if cap is None:
        return ids
    return _first_ids(ids, cap, seed)


def group_cap(n: int) -> int:
    """Interactive cap for group analysis by selection size."""
    return 5000 if n > 8000 else 4000 if n > 2500 else 2500


def density_cap(n: int) -> int:
    """Interactive cap for selection densities by selection size."""
    return 800 if n <= 2000 else 400 if n <= 10000 else 200


def scored_items(points: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Candidates with their score; without scores every point stays with score 0."""
    if scores is None:
        return points.select("id", "x", "y", F.lit(0.0).alias("score"))
    return points.join(scores.select("id", F.col("mean_raw").alias("score")), "id").select("id", "x", "y", "score")
