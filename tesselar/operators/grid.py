"""Exact nearest neighbours in the plane by an adaptive grid and an expanding ring.

Rows at one place count as one: a place keeps its k + 1 lowest target ids, which is all that any neighbour list can use.
Squares that hold more than LEAF places are split, so the grid is fine where rows are dense.  The queries of one leaf
search together.  They start with the ring of squares around their own, take from the squares' boxes and counts a radius
that holds k + 1 targets, and widen the ring fourfold while its edge is nearer than that radius.  Squares within the radius
are then opened down to their leaves, the radius shrinking at every step, and only the leaves that are left are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselar.operators.pairwise import SCORE_DECIMALS, gathered, keep_topk, negative_l2
from tesselar.scale import materialise

LEAF = 256
DEEPEST, STEP, RING = 50, 2, 3
# Distances are compared after rounding, so a square a little farther than the radius may hold a tie.
SLACK = 2 * 10.0**-SCORE_DECIMALS
_BOX = ["x0", "x1", "y0", "y1"]


def defined(df: DataFrame) -> DataFrame:
    """Rows with two finite coordinates."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.filter(finite("x") & finite("y"))


def _least_ids(k: int):
    """The ``k`` lowest ids of every place among a task's rows."""

    def run(t: pa.Table) -> pa.Table:
        x, y, i = (t.column(n).to_numpy() for n in ("x", "y", "id"))
        order = np.lexsort((i, y, x))
        x, y = x[order], y[order]
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        start = np.flatnonzero(new)
        place = np.arange(len(x)) - np.repeat(start, np.diff(start, append=len(x)))
        return t.take(pa.array(order[place < k]))

    return run


def _places(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """x, y, ids (the lowest target ids there, at most ``k``), asked (a query stands there)."""
    reduce = _least_ids(k)
    least = targets.select("x", "y", "id").mapInArrow(lambda batches: gathered(batches, reduce), "x double, y double, id bigint")
    rows = least.select("x", "y", "id", F.lit(False).alias("asked")).unionByName(
        queries.select("x", "y").distinct().select("x", "y", F.lit(None).cast("bigint").alias("id"), F.lit(True).alias("asked"))
    )
    ids = F.slice(F.array_sort(F.collect_list("id")), 1, k)
    # Negative zero is the same place as zero.
    return rows.groupBy((F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).agg(ids.alias("ids"), F.max("asked").alias("asked"))


def _up(c: str, levels: int | Column) -> Column:
    return F.call_function("shiftright", F.col(c), F.lit(levels) if isinstance(levels, int) else levels)


class _Grid:
    """Squares of all levels, and the leaf of every place."""

    def __init__(self, places: DataFrame):
        n, x0, x1, y0, y1 = places.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        self.side = max((x1 or 0.0) - (x0 or 0.0), (y1 or 0.0) - (y0 or 0.0)) or 1.0
        cell = lambda c, low: F.least(F.floor((F.col(c) - F.lit(low or 0.0)) / self.side * (1 << DEEPEST)), F.lit((1 << DEEPEST) - 1)).cast("bigint")
        rest = places.select("x", "y", "ids", "asked", cell("x", x0).alias("fx"), cell("y", y0).alias("fy"))
        self.base = STEP * min(DEEPEST // STEP, max(0, round(np.log(max(n, 1) / LEAF) / np.log(4**STEP))))
        split, leaves, level = [], [], self.base
        while True:
            here = rest.withColumns({"cx": _up("fx", DEEPEST - level), "cy": _up("fy", DEEPEST - level)})
            has = F.size("ids") > 0
            counts = here.groupBy("cx", "cy").agg(
                F.count("*").alias("places"), F.sum(F.size("ids")).cast("bigint").alias("ids"),
                *[f(F.when(has, F.col(c))).alias(f"{c}{i}") for c in ("x", "y") for i, f in ((0, F.min), (1, F.max))],
            )
            counts = materialise(counts.withColumn("leaf", (F.col("places") <= LEAF) | F.lit(level >= DEEPEST)).withColumn("level", F.lit(level)), "squares")
            split.append(counts)
            kind = counts.select("cx", "cy", "leaf")
            heavy = not kind.filter("NOT leaf").isEmpty()
            leaves.append((here if not heavy else here.join(kind.filter("leaf"), ["cx", "cy"], "left_semi")).withColumn("level", F.lit(level)))
            if not heavy:
                break
            rest = materialise(here.join(kind.filter("NOT leaf"), ["cx", "cy"], "left_semi").drop("cx", "cy"), "crowded")
            level += STEP
        squares, self.places = split[0], leaves[0]
        for more, at in zip(split[1:], leaves[1:]):
            squares, self.places = squares.unionByName(more), self.places.unionByName(at)
        squares = squares.select("level", "cx", "cy", "ids", *_BOX, "leaf").filter("ids > 0")
        if self.base:
            above = split[0].filter("ids > 0").withColumn("level", F.explode(F.array(*[F.lit(v) for v in range(0, self.base, STEP)])))
            shift = F.lit(self.base) - F.col("level")
            above = above.select("level", _up("cx", shift).alias("cx"), _up("cy", shift).alias("cy"), "ids", *_BOX).groupBy("level", "cx", "cy").agg(
                F.sum("ids").alias("ids"), *[(F.min if c[1] == "0" else F.max)(c).alias(c) for c in _BOX], F.lit(False).alias("leaf"),
            )
            squares = squares.unionByName(above.select(squares.columns))
        self.squares = materialise(squares, "grid")

    def blocks(self) -> DataFrame:
        """The leaves with queries: block (a struct of level, cx, cy), the box of their queries, and their square at ``base``."""
        found = self.places.filter("asked").groupBy("level", "cx", "cy").agg(
            *[f(c).alias(f"q{c}{i}") for c in ("x", "y") for i, f in ((0, F.min), (1, F.max))],
        )
        shift = F.col("level") - self.base
        return found.select(F.struct("level", "cx", "cy").alias("block"), "qx0", "qx1", "qy0", "qy1", _up("cx", shift).alias("bx"), _up("cy", shift).alias("by"))


def _axis(near: bool, c: str) -> Column:
    a0, a1, b0, b1 = (F.col(n) for n in (f"q{c}0", f"q{c}1", f"{c}0", f"{c}1"))
    return F.greatest(a0 - b1, b0 - a1, F.lit(0.0)) if near else F.greatest(a1 - b0, b1 - a0)


def _distance(near: bool) -> Column:
    """Least or greatest distance between a block's queries and a square's targets."""
    x, y = _axis(near, "x"), _axis(near, "y")
    return F.sqrt(x * x + y * y)


def _bounded(front: DataFrame, k: int) -> DataFrame:
    """Adds radius: the least distance within which every query of the block finds ``k`` targets (NULL if there are fewer)."""
    order = Window.partitionBy("block").orderBy("far").rowsBetween(Window.unboundedPreceding, 0)
    within = front.withColumn("far", _distance(False)).withColumn("so_far", F.sum("ids").over(order))
    return within.withColumn("radius", F.min(F.when(F.col("so_far") >= k, F.col("far"))).over(Window.partitionBy("block"))).drop("so_far", "far")


def _pruned(front: DataFrame, k: int) -> DataFrame:
    bounded = _bounded(front, k)
    return bounded.filter(F.col("radius").isNull() | (_distance(True) <= F.col("radius") + SLACK)).drop("radius")


_QUERY = ["block", "qx0", "qx1", "qy0", "qy1"]


def _candidates(grid: _Grid, k: int) -> DataFrame:
    """block and the leaf (level, cx, cy) of every pair that has to be read."""
    open_, level, found = grid.blocks(), grid.base, None
    steps = lambda c: F.explode(F.sequence(F.greatest(F.col(c) - RING, F.lit(0)), F.least(F.col(c) + RING, F.lit((1 << level) - 1))))
    while True:
        at = open_.select("*", steps("bx").alias("cx")).select("*", steps("by").alias("cy"))
        ring = at.join(grid.squares.filter(F.col("level") == level), ["cx", "cy"])
        # Every square beyond the ring is at least RING sides away; a ring as wide as the grid leaves none.
        edge, whole = RING * grid.side / (1 << level), (1 << level) <= RING + 1
        bounded = materialise(_bounded(ring, k).withColumn("closed", F.lit(whole) | F.coalesce(F.col("radius") + SLACK < edge, F.lit(False))), "ring")
        inside = bounded.filter(F.col("closed") & (F.col("radius").isNull() | (_distance(True) <= F.col("radius") + SLACK)))
        inside = inside.select(*_QUERY, "level", "cx", "cy", "ids", *_BOX, "leaf")
        found = inside if found is None else found.unionByName(inside)
        if whole:
            break
        open_ = open_.join(bounded.filter("closed").select("block").distinct(), "block", "left_anti")
        open_ = materialise(open_.withColumns({"bx": _up("bx", STEP), "by": _up("by", STEP)}), "open")
        if open_.isEmpty():
            break
        level -= STEP
    while not (closed := found.filter("NOT leaf")).isEmpty():
        down = lambda c: F.explode(F.sequence(F.col(c) * (1 << STEP), F.col(c) * (1 << STEP) + ((1 << STEP) - 1)))
        opened = closed.select(*_QUERY, (F.col("level") + STEP).alias("level"), "cx", "cy").withColumn("cx", down("cx")).withColumn("cy", down("cy"))
        inner = opened.join(grid.squares, ["level", "cx", "cy"])
        found = materialise(_pruned(found.filter("leaf").unionByName(inner.select(found.columns)), k), "opened")
    return found.select("block", "level", "cx", "cy")


def _block_topk(k: int):
    """(x, y, id, score) of the k best targets of every query place, per pair of packed leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                asked, there = b.column(0)[i].values, b.column(1)[i].values
                q = np.column_stack([asked.field(c).to_numpy() for c in ("x", "y")])
                t = np.column_stack([there.field(c).to_numpy() for c in ("x", "y")])
                ids = there.field("ids")
                size = np.diff(ids.offsets.to_numpy())
                flat = ids.flatten().to_numpy()
                score = np.repeat(negative_l2(q, t), size, axis=1)
                if len(flat) > k:
                    keep = score >= np.partition(score, len(flat) - k, axis=1)[:, len(flat) - k, None]
                else:
                    keep = np.ones(score.shape, dtype=bool)
                row, col = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q[row, 0], q[row, 1], flat[col], score[row, col])], names=["x", "y", "id", "score"])

    return run


def _best_places(k: int):
    """``keep_topk`` with a place instead of a query id."""
    reduce = keep_topk(k)

    def run(t: pa.Table) -> pa.Table:
        _, number = np.unique(t.column("x").to_numpy() + 1j * t.column("y").to_numpy(), return_inverse=True)
        return reduce(t.append_column("query", pa.array(number))).drop_columns(["query"])

    return run


def nearest_in_plane(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Exact top-k per query of ``(id, x, y)`` frames, self excluded: ``(query, id, score, rank)``, ties by id.

    ``score`` is the negative distance.  A target without finite coordinates comes after all others and has a NULL score;
    a query without them has the lowest ids, all with a NULL score.  Ids are unique on either side.
    """
    double = lambda df: df.select(F.col("id").cast("bigint").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y")])
    queries, targets = double(queries), double(targets)
    asking, known = defined(queries), defined(targets)
    grid = _Grid(materialise(_places(asking, known, k + 1), "places"))
    leaf = ["level", "cx", "cy"]
    pairs = _candidates(grid, k + 1)
    asked = grid.places.filter("asked").groupBy(F.struct(*leaf).alias("block")).agg(F.collect_list(F.struct("x", "y")).alias("asked"))
    there = grid.places.filter(F.size("ids") > 0).groupBy(*leaf).agg(F.collect_list(F.struct("x", "y", "ids")).alias("there"))
    read = _block_topk(k + 1)
    reduce = _best_places(k + 1)
    hits = pairs.join(asked, "block").join(there, leaf).select("asked", "there").mapInArrow(
        lambda batches: gathered(read(batches), reduce), "x double, y double, id bigint, score double",
    )
    order = Window.partitionBy("x", "y").orderBy(F.desc("score"), "id")
    best = hits.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).select("x", "y", F.col("id").alias("target"), "score")
    place = asking.select(F.col("id").alias("query"), (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))
    near = place.join(best, ["x", "y"]).select("query", "target", "score").unionByName(_without_place(queries, targets, asking, known, k))
    mine = Window.partitionBy("query").orderBy(F.col("score").desc_nulls_last(), "target")
    near = near.filter(F.col("query") != F.col("target")).withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k)
    return near.select("query", F.col("target").alias("id"), "score", "rank")


def _without_place(queries: DataFrame, targets: DataFrame, asking: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """Pairs without a distance: the lowest ids for queries without coordinates; for the others only if fewer than k + 1 targets have them."""
    lowest = lambda df: [r[0] for r in df.select("id").orderBy("id").limit(k + 1).collect()]
    pairs = lambda df, ids: df.select(
        F.col("id").alias("query"), F.explode(F.array(*[F.lit(i) for i in ids]).cast("array<bigint>")).alias("target"), F.lit(None).cast("double").alias("score"),
    )
    out = pairs(queries.join(asking.select("id"), "id", "left_anti"), lowest(targets))
    if len(known.select("id").limit(k + 1).collect()) <= k:
        out = out.unionByName(pairs(asking, lowest(targets.join(known.select("id"), "id", "left_anti"))))
    return out
