"""Block-wise scoring of query vectors against a vector table, with kernel-side reduction.

Nothing here ever emits all pairs: a kernel sees one (query block, target block) and returns its
local top-k, its bin counts, or the scores of a bounded set of centroids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions.vectors import matrix
from tesselar.scale import numbers, CLOSURE_LIMIT_BYTES

BLOCK_ROWS = 4096
QUERY_SLICE = 512
# A query set of this many bytes at most is searched from the closure: each task that reads targets searches all of it.
SEARCH_LIMIT_BYTES = 2 << 20
HELD_ROWS = 2_000_000  # results a task gathers between reductions
EMIT_ROWS = 65_536
SCORE_DECIMALS = 9  # equal vectors tie, so ids decide
LAST = -np.finfo(np.float64).max  # rank of an undefined score: behind every defined one

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]


def cosine_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.round(np.clip(q @ v.T, -1.0, 1.0), SCORE_DECIMALS)


def negative_l2(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    total = np.zeros((len(q), len(v)))
    for j in range(q.shape[1]):
        total += (q[:, j, None] - v[None, :, j]) ** 2
    return -np.round(np.sqrt(total), SCORE_DECIMALS)


def topk_kernel(k: int, score) -> Kernel:
    def run(qid, q, vid, v):
        parts = []
        for s in range(0, len(q), QUERY_SLICE):
            ids = qid[s:s + QUERY_SLICE]
            sc = score(q[s:s + QUERY_SLICE], v)
            sc[~np.isfinite(sc)] = LAST
            sc[ids[:, None] == vid[None, :]] = -np.inf
            keep = sc > -np.inf
            if len(vid) > k:
                cut = np.partition(sc, len(vid) - k, axis=1)[:, len(vid) - k]
                keep &= sc >= cut[:, None]
            row, col = np.nonzero(keep)
            val = sc[row, col]
            order = np.lexsort((vid[col], -val, row))
            row, col, val = row[order], col[order], val[order]
            first = np.searchsorted(row, row, side="left")
            top = np.arange(len(row)) - first < k
            parts.append((ids[row[top]], vid[col[top]], val[top]))
        cols = [np.concatenate(c) for c in zip(*parts)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "id", "score"])

    return run


def histogram_kernel(bins: int) -> Kernel:
    """Counts of ``(cosine + 1) / 2`` per query over [0, 1]."""

    def run(qid, q, vid, v):
        parts = []
        for s in range(0, len(q), QUERY_SLICE):
            some = q[s:s + QUERY_SLICE]
            y = (cosine_scores(some, v) + 1.0) * 0.5
            b = np.minimum((y * bins).astype(np.int64), bins - 1)
            flat = np.bincount((np.arange(len(some))[:, None] * bins + b).ravel(), minlength=len(some) * bins)
            at = np.nonzero(flat)[0]
            parts.append((qid[s + at // bins], at % bins, flat[at]))
        cols = [np.concatenate(c) for c in zip(*parts)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "bin", "n"])

    return run


def clipped_histogram_kernel(bins: int) -> Kernel:
    """Counts over all queries of the cosine clipped to [0, 1], self-pairs left out."""

    def run(qid, q, vid, v):
        total = np.zeros(bins, np.int64)
        for s in range(0, len(q), QUERY_SLICE):
            sc = np.maximum(cosine_scores(q[s:s + QUERY_SLICE], v), 0.0)
            b = np.minimum((sc * bins).astype(np.int64), bins - 1)
            total += np.bincount(b[qid[s:s + QUERY_SLICE, None] != vid[None, :]], minlength=bins)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(bins)), pa.array(total)], names=["bin", "n"])

    return run


def _codes(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rounded scores as whole numbers from 0 to 2·10^SCORE_DECIMALS."""
    scale = 10**SCORE_DECIMALS
    return np.rint(np.clip(q @ v.T, -1.0, 1.0) * scale).astype(np.int64) + scale


def code_bins_kernel(shift: int) -> Kernel:
    """Counts of score codes per query, without their last ``shift`` bits."""

    def run(qid, q, vid, v):
        parts = []
        for s in range(0, len(q), QUERY_SLICE):
            for i, row in enumerate(_codes(q[s:s + QUERY_SLICE], v) >> shift):
                at, n = np.unique(row, return_counts=True)
                parts.append((np.full(len(at), qid[s + i]), at, n))
        cols = [np.concatenate(c) for c in zip(*parts)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "code", "n"])

    return run


def codes_in_bins_kernel(shift: int) -> Kernel:
    """Counts of whole score codes in the two bins that end a query's vector."""

    def run(qid, q, vid, v):
        parts = []
        for s in range(0, len(q), QUERY_SLICE):
            some = q[s:s + QUERY_SLICE]
            code = _codes(some[:, :-2], v)
            wanted = ((code >> shift)[:, :, None] == some[:, None, -2:].astype(np.int64)).any(axis=2)
            for i, row in enumerate(code):
                at, n = np.unique(row[wanted[i]], return_counts=True)
                parts.append((np.full(len(at), qid[s + i]), at, n))
        cols = [np.concatenate(c) for c in zip(*parts)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query", "code", "n"])

    return run


def add_counts(t: pa.Table) -> pa.Table:
    """Sum a task's counts per query and code."""
    return t.group_by(["query", "code"]).aggregate([("n", "sum")]).rename_columns(["query", "code", "n"])


def keep_topk(k: int) -> Callable[[pa.Table], pa.Table]:
    """Reduce a task's top-k candidates of several batches to its own top-k."""

    def run(t: pa.Table) -> pa.Table:
        q, i, s = (t.column(n).to_numpy() for n in ("query", "id", "score"))
        order = np.lexsort((i, -s, q))
        sorted_q = q[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q, side="left")
        return t.take(pa.array(order[place < k]))

    return run


def gathered(
    results: Iterator[pa.RecordBatch], combine: Callable[[pa.Table], pa.Table] | None
) -> Iterator[pa.RecordBatch]:
    """A task's results, reduced by ``combine`` while they pile up and before they are emitted."""
    if combine is None:
        yield from results
        return
    held: list[pa.RecordBatch] = []
    rows = 0
    for out in results:
        held.append(out)
        rows += out.num_rows
        if rows > HELD_ROWS:
            held = combine(pa.Table.from_batches(held)).combine_chunks().to_batches()
            rows = 0
    if held:
        yield from combine(pa.Table.from_batches(held)).combine_chunks().to_batches(max_chunksize=EMIT_ROWS)


def _measured(queries: DataFrame) -> tuple[int, int]:
    return queries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()


def _bytes(n: int, dim: int) -> int:
    return n * (dim + 1) * 8


def pairwise(
    queries: DataFrame, targets: DataFrame, kernel: Kernel, schema: str, limit: int = CLOSURE_LIMIT_BYTES,
    combine: Callable[[pa.Table], pa.Table] | None = None,
) -> DataFrame:
    """Apply ``kernel`` to all query × target blocks of ``(id, vec)`` frames.

    ``combine`` shrinks the results a task has gathered before they are emitted.

    The query set is measured.  Up to ``limit`` bytes it travels inside the task closure and the
    targets are read in place, unshuffled.  A larger set meets the targets through an equi-join of
    packed blocks, so no task and no driver ever holds more than two blocks.
    """
    n, dim = _measured(queries)
    if _bytes(n, dim) <= limit:
        q = queries.select("id", "vec").toArrow()
        qid = q.column("id").to_numpy().astype(np.int64) if n else np.empty(0, np.int64)
        qv = matrix(q.column("vec"))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows and len(qid):
                    yield kernel(qid, qv, b.column(0).to_numpy().astype(np.int64), matrix(b.column(1)))

        return targets.select("id", "vec").mapInArrow(lambda batches: gathered(scan(batches), combine), schema)

    blocks_t = max(1, -(-targets.count() // BLOCK_ROWS))
    blocks_q = max(1, -(-n // BLOCK_ROWS))

    def packed(df: DataFrame, blocks: int, name: str) -> DataFrame:
        key = F.pmod(F.xxhash64("id"), F.lit(blocks))
        return df.groupBy(key.alias(f"{name}_block")).agg(F.collect_list(F.struct("id", "vec")).alias(name))

    q = packed(queries, blocks_q, "q").withColumn("t_block", numbers(blocks_t))
    pairs = q.join(packed(targets, blocks_t, "t"), "t_block").select("q", "t")

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qs, ts = b.column(0)[i].values, b.column(1)[i].values
                yield kernel(
                    qs.field("id").to_numpy().astype(np.int64), matrix(qs.field("vec")),
                    ts.field("id").to_numpy().astype(np.int64), matrix(ts.field("vec")),
                )

    return pairs.mapInArrow(lambda batches: gathered(of_blocks(batches), combine), schema)


def nearest(
    queries: DataFrame, targets: DataFrame, k: int, space: str = "cosine", limit: int | None = None
) -> DataFrame:
    """Exact top-k per query, self excluded: ``(query, id, score, rank)`` with rank 1..k, ties by id.

    ``score`` is the cosine of unit vectors, or the negative distance in ``l2`` space.  A target without a defined score
    (a missing coordinate) comes after all others and has a NULL score.  A cosine query set over ``limit`` bytes
    (SEARCH_LIMIT_BYTES) is searched by blocks: pairs of blocks are skipped where their bounds allow it.
    """
    if limit is None:
        limit = SEARCH_LIMIT_BYTES if space == "cosine" else CLOSURE_LIMIT_BYTES
    if space == "cosine" and _bytes(*_measured(queries)) > limit:
        from tesselar.operators.blocks import nearest_by_blocks

        local = nearest_by_blocks(queries, targets, k)
    else:
        kernel = topk_kernel(k, cosine_scores if space == "cosine" else negative_l2)
        local = pairwise(queries, targets, kernel, "query bigint, id bigint, score double", limit, keep_topk(k))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumn("score", F.when(F.col("score") > F.lit(float(LAST)), F.col("score")))
