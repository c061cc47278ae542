"""Exact cosine neighbours of large query sets: blocks around pivots, and bounds that skip pairs of blocks.

Vectors are unit length or zero.  Rows are dealt to the pivot they are nearest to and cut, by their distance to it, into
blocks of BLOCK_ROWS.  A block has a centre and a radius, so the triangle inequality bounds the similarity of all pairs of
two blocks from both sides.  Every query block is searched first in the target block that promises most; the k-th score
that each of its queries has then is a floor, and only target blocks whose upper bound reaches the lowest floor are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions import scalars, vectors
from tesselar.functions.vectors import matrix
from tesselar.operators.pairwise import LAST, QUERY_SLICE, SCORE_DECIMALS, _bytes, _measured, cosine_scores, pairwise
from tesselar.scale import materialise, ranked

BLOCK_ROWS, MOST_PIVOTS = 1024, 256
# Lots of query blocks, and parts of the target blocks at least; a part is held by one task and has about so many bytes at most.
LOT, TILE_BYTES = 8, 64 << 20
SLACK = 4 * 10.0**-SCORE_DECIMALS
_HITS = "query bigint, id bigint, score double"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _pivots(targets: DataFrame, rows: int) -> np.ndarray:
    """A bounded, fixed choice of rows; it steers how much is skipped, never the result."""
    wanted = int(min(MOST_PIVOTS, max(1, -(-rows // BLOCK_ROWS))))
    some = targets.select("id", "vec").orderBy(scalars.order_hash(F.col("id"), 0), "id").limit(wanted)
    return matrix(some.toArrow().column("vec"))


def _blocks(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, vec, block: rows of one pivot, about as far from it as each other; zero vectors are apart (block below 2^32)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1))
            d = _distances(v, pivots) if len(v) else np.zeros((0, len(pivots)))
            nearest = d.argmin(axis=1) if len(v) else np.zeros(0, dtype=np.int64)
            zero = ~v.any(axis=1)
            pivot = np.where(zero, 0, nearest + 1)
            away = np.where(zero, 0.0, d[np.arange(len(v)), nearest])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pivot), pa.array(away)], names=["id", "vec", "pivot", "away"])

    dealt = df.select(F.col("id").cast("bigint").alias("id"), "vec").mapInArrow(assign, "id bigint, vec array<double>, pivot bigint, away double")
    placed = ranked(dealt, ["pivot"], ["away", "id"], "place")
    return materialise(placed.select("id", "vec", (F.col("pivot") * (1 << 32) + F.expr(f"place div {BLOCK_ROWS}")).alias("block")), "blocks")


def _summaries(blocked: DataFrame) -> DataFrame:
    """(id, vec) per block: its centre, then its radius, 1 for zero vectors, and its rows."""
    centre = blocked.groupBy("block").agg(vectors.mean_vector(F.col("vec")).alias("centre"), F.count("*").alias("rows"))
    radius = blocked.join(centre, "block").select("block", vectors.l2_distance("vec", "centre").alias("d")).groupBy("block").agg(F.max("d").alias("radius"))
    zero = (F.col("block") < 1 << 32).cast("double")
    return materialise(
        centre.join(radius, "block").select(F.col("block").alias("id"), F.concat("centre", F.array("radius", zero, F.col("rows").cast("double"))).alias("vec")),
        "summaries",
    )


def _between(q: np.ndarray, v: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the similarities between blocks; ``extra`` more numbers follow a query block's summary."""
    at = q.shape[1] - 3 - extra
    d = _distances(q[:, :at], v[:, :at])
    reach = q[:, at, None] + v[None, :, at]
    # Undefined where one side is zero: there every similarity is 0.
    zero = (q[:, at + 1, None] + v[None, :, at + 1]) > 0
    low = np.where(zero, 0.0, 1.0 - 0.5 * (d + reach) ** 2)
    high = np.where(zero, 0.0, 1.0 - 0.5 * np.maximum(d - reach, 0.0) ** 2)
    return low, high


def _home_kernel(k: int):
    """The target block with the best lower bound, by preference one with more than k rows."""

    def run(qid, q, vid, v):
        found = []
        for s in range(0, len(q), QUERY_SLICE):
            low, _ = _between(q[s : s + QUERY_SLICE], v, 0)
            low[:, v[:, -1] <= k] -= 4.0
            best = low.argmax(axis=1)
            found.append((qid[s : s + QUERY_SLICE], vid[best], low[np.arange(len(best)), best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query", "id", "score"])

    return run


def _reach_kernel(qid, q, vid, v):
    """Pairs of blocks whose upper bound reaches the query block's floor (its last number)."""
    pairs = []
    for s in range(0, len(q), QUERY_SLICE):
        some = q[s : s + QUERY_SLICE]
        _, high = _between(some, v, 1)
        row, col = np.nonzero(high >= some[:, -1, None] - SLACK)
        pairs.append((qid[s + row], vid[col]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*pairs)], names=["query", "id"])


def _best(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, ...]:
    """Top-k of each query among the blocks' rows, self excluded, without scores below its floor: (query, id, score).

    A floor rises to the k-th score as soon as there is one, so few scores of the later blocks are looked at.
    """
    floor = floor.copy()
    row, ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    for vid, v in blocks:
        sc = cosine_scores(q, v)
        sc[~np.isfinite(sc)] = LAST
        sc[qid[:, None] == vid[None, :]] = -np.inf
        least = floor
        if len(vid) > k and np.isneginf(floor).any():
            least = np.maximum(floor, np.partition(sc, len(vid) - k, axis=1)[:, len(vid) - k])
        r, c = np.nonzero(sc >= np.maximum(least, LAST)[:, None])
        if not len(r):
            continue
        row, ids, scores = np.concatenate((row, r)), np.concatenate((ids, vid[c])), np.concatenate((scores, sc[r, c]))
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        full = place == k - 1
        floor[row[full]] = np.maximum(floor[row[full]], scores[full])
        row, ids, scores = row[place < k], ids[place < k], scores[place < k]
    return qid[row], ids, scores


def _tiles(targets: DataFrame) -> int:
    """Parts of the targets: LOT, or as many as keep a part near TILE_BYTES."""
    return max(LOT, -(-_bytes(*_measured(targets)) // TILE_BYTES))


def _dealt(pairs: DataFrame, queries: DataFrame, targets: DataFrame, parts: int) -> DataFrame:
    """Rows of all tiles: lists of pairs (side 0), target rows (1), query rows (2).

    Target blocks are dealt into parts and query blocks into LOT lots; a tile is one part and one lot.  So a query row is
    sent to each part and a target row to each lot at most, however many pairs of blocks there are.
    """
    part, lot = (F.pmod(F.xxhash64(c), F.lit(n)) for c, n in (("t_block", parts), ("q_block", LOT)))
    asked = pairs.select("q_block", "t_block", (part * LOT + lot).cast("int").alias("tile"))
    none = lambda kind: F.lit(None).cast(kind)
    lists = asked.groupBy("tile", F.col("q_block").alias("block")).agg(F.sort_array(F.collect_list("t_block")).alias("wanted"))
    lists = lists.select("tile", F.lit(0).alias("side"), "block", none("bigint").alias("id"), none("array<double>").alias("vec"), none("double").alias("floor"), "wanted")

    def rows(side: int, block: str, df: DataFrame) -> DataFrame:
        kept = asked.select("tile", F.col(block).alias("block")).distinct().join(df, "block")
        return kept.select("tile", F.lit(side).alias("side"), "block", "id", "vec", F.col("floor"), none("array<bigint>").alias("wanted"))

    there = rows(1, "t_block", targets.withColumn("floor", none("double")))
    return lists.unionByName(there).unionByName(rows(2, "q_block", queries))


def _search(pairs: DataFrame, queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Top-k of every query among the target blocks its block is paired with, per task: (query, id, score).

    A task holds the targets of a tile and lets its queries stream past.  Scores below the ``floor`` of a query (NULL:
    none) cannot count and are left out.
    """
    parts = _tiles(targets)
    together = _dealt(pairs, queries, targets, parts).repartitionById(parts * LOT, F.col("tile")).sortWithinPartitions("tile", "side", "block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[int, np.ndarray] = {}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            key = np.column_stack([b.column(c).to_numpy() for c in (1, 2)])
            cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                side, block = key[lo].tolist()
                if side == 0:
                    wanted[block] = b.column(6)[lo].values.to_numpy()
                    continue
                ids, v = b.column(3).slice(lo, hi - lo).to_numpy(), matrix(b.column(4).slice(lo, hi - lo))
                if side == 1:
                    held.setdefault(block, []).append((ids, v.copy()))
                    continue
                floor = b.column(5).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                floor = np.where(np.isnan(floor), -np.inf, floor)
                near = [some for t in wanted[block].tolist() for some in held[t]]
                for s in range(0, len(ids), QUERY_SLICE):
                    some = slice(s, s + QUERY_SLICE)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(ids[some], v[some], floor[some], near, k)], names=["query", "id", "score"])

    return together.mapInArrow(work, _HITS)


def block_pairs(queries: DataFrame, targets: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Blocked queries with their floors, blocked targets, the hits of every query block's first target block, and the other pairs to read."""
    pivots = _pivots(targets, targets.count())
    q, t = _blocks(queries, pivots), _blocks(targets, pivots)
    about_q, about_t = _summaries(q), _summaries(t)
    best = pairwise(about_q, about_t, _home_kernel(k), _HITS).groupBy("query").agg(F.max_by("id", "score").alias("t_block"))
    home = materialise(best.withColumnRenamed("query", "q_block"), "home")
    hits = materialise(_search(home, q.withColumn("floor", F.lit(None).cast("double")), t, k), "hits")
    # A query with fewer than k scores so far may need any block.
    kth = hits.groupBy(F.col("query").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k).drop("n")
    q = q.join(kth, "id", "left")
    floor = q.groupBy("block").agg(F.min(F.coalesce("floor", F.lit(-2.0))).alias("floor"))
    asked = about_q.join(floor.withColumnRenamed("block", "id"), "id").select("id", F.concat("vec", F.array("floor")).alias("vec"))
    reached = pairwise(asked, about_t, _reach_kernel, "query bigint, id bigint").select(F.col("query").alias("q_block"), F.col("id").alias("t_block"))
    return q, t, hits, materialise(reached.join(home, ["q_block", "t_block"], "left_anti"), "reached")


def nearest_by_blocks(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(query, id, score) with the top-k of every query among them, self excluded; more rows may be there."""
    if targets.isEmpty():
        return targets.sparkSession.createDataFrame([], _HITS)
    q, t, hits, pairs = block_pairs(queries, targets, k)
    return hits.unionByName(_search(pairs, q, t, k))
