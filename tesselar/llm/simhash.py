"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

The trie is walked by pairs of nodes at once.  Going down, a pair splits by the next bit; a pair whose paths differ in
more bits than the budget is dropped with everything below it.  The top of the trie is walked by Spark: nodes at a depth
chosen from the number of fingerprints are joined with the nodes whose paths are near enough.  Each pair of subtrees is
then walked inside one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.llm.common import cut, unwrapped, words_of, wrapped
from tesselar.llm.graph import components, forest

SHINGLE, SEED, BITS, BUDGET = 3, 42, 64, 2
# Fingerprints per node at the depth where tasks take over; the most that a task holds of its node and of others.
NODE, OWN, OTHERS = 512, 4_096, 65_536
# Node pairs that a task walks at once, and links it keeps before it reduces them to a forest.
FRONTIER, PENDING = 1 << 18, 1 << 20


def fingerprint(text: str | None) -> int:
    """Majority of the shingles' hash bits; zero for a text without words."""
    import xxhash

    w = words_of(text or "")
    if not w:
        return 0
    grams = map(" ".join, zip(*(w[k:] for k in range(SHINGLE)))) if len(w) >= SHINGLE else [" ".join(w)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` → doc_id, fp (the 64 bits as a signed long)."""

    @F.pandas_udf("bigint")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", bits(F.col("text")).alias("fp"))


def _split(ones: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where the ones begin inside sorted stretches that agree on all earlier bits."""
    return hi - (ones[hi] - ones[lo])


def walk(a: np.ndarray, b: np.ndarray | None, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i in a, j in b) of fingerprints within ``budget`` bits; with b None, pairs i < j inside a.

    Both arrays are sorted and without repeats.
    """
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def ones(bit: int) -> tuple[np.ndarray, np.ndarray]:
        if bit not in sums:
            count = lambda x: np.concatenate([[0], np.cumsum(x >> np.uint64(bit) & np.uint64(1), dtype=np.int64)])
            first = count(a)
            sums[bit] = (first, first if own else count(b))
        return sums[bit]

    zero = np.zeros(1, dtype=np.int64)
    stack = [(BITS - 1, zero, zero + len(a), zero, zero + len(b), zero)]
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        # Small stretches are compared directly.
        small = (ahi - alo) * (bhi - blo) <= 16
        if bit < 0:
            small[:] = True
        if small.any():
            n = ((ahi - alo) * (bhi - blo))[small]
            pair = np.repeat(np.flatnonzero(small), n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            wide = (bhi - blo)[pair]
            i, j = alo[pair] + k // wide, blo[pair] + k % wide
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if own:
                near &= i < j
            yield i[near], j[near]
        go = ~small
        if not go.any():
            continue
        alo, ahi, blo, bhi, diff = alo[go], ahi[go], blo[go], bhi[go], diff[go]
        sa, sb = ones(bit)
        am, bm = _split(sa, alo, ahi), _split(sb, blo, bhi)
        same = (alo == blo) & (ahi == bhi) if own else np.zeros(len(alo), dtype=bool)
        children = [(alo, am, blo, bm, diff, None), (am, ahi, bm, bhi, diff, None), (alo, am, bm, bhi, diff + 1, None), (am, ahi, blo, bm, diff + 1, same)]
        parts = []
        for x0, x1, y0, y1, d, skip in children:
            keep = (x1 > x0) & (y1 > y0) & (d <= budget)
            if skip is not None:
                keep &= ~skip
            parts.append([z[keep] for z in (x0, x1, y0, y1, d)])
        joined = [np.concatenate(z) for z in zip(*parts)]
        for at in range(0, len(joined[0]), FRONTIER):
            stack.append((bit - 1, *(z[at : at + FRONTIER] for z in joined)))


def _links(own: np.ndarray, others: np.ndarray, inside: bool) -> pd.DataFrame:
    """Links of one task as a forest: each fingerprint with the smallest one it hangs together with."""
    own, others = np.unique(own), np.unique(others)
    n = len(own) + len(others)
    root, parts, held = np.arange(n), [], 0

    def reduce() -> np.ndarray:
        i = np.concatenate([p[0] for p in parts] + [np.arange(n)])
        j = np.concatenate([p[1] for p in parts] + [root])
        return forest(n, i, j)

    for b, shift in ((None, 0), (others, len(own))):
        if b is None and not inside:
            continue
        for i, j in walk(own, b):
            parts.append((i, j + shift))
            held += len(i)
            if held >= PENDING:
                root, parts, held = reduce(), [], 0
    root = reduce()
    every = np.concatenate([own, others]).view(np.int64)
    hung = np.flatnonzero(root != np.arange(n))
    return pd.DataFrame({"a": every[hung], "b": every[root[hung]]})


def _near_nodes(node: Column, depth: int) -> Column:
    """Nodes of the same depth with a smaller number whose path differs in at most BUDGET bits, and the node itself."""
    masks = [0] + [1 << i for i in range(depth)] + [1 << i | 1 << j for i in range(depth) for j in range(i)]
    return F.filter(F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: node.bitwiseXOR(m)), lambda q: q <= node)


def trie_links(fps: DataFrame) -> DataFrame:
    """``fps(fp)``, different values → (a, b): links that connect exactly what lies within the bit budget.

    A node's fingerprints are cut into pieces and so are those it is compared with, each sized from counts, so no task
    grows with a crowded node.
    """
    fps = cut(fps, "fingerprints")
    depth = max(0, min(24, (max(1, fps.count()) // NODE).bit_length()))
    node = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("bigint")
    at = fps.select("fp", node.alias("node"), F.pmod(F.xxhash64("fp"), F.lit(1 << 30)).alias("h"))
    counts = at.groupBy("node").agg(F.count("*").alias("n"))
    near = counts.select(F.col("node").alias("from"), "n", F.explode(_near_nodes(F.col("node"), depth)).alias("node"))
    load = near.groupBy("node").agg(
        F.sum("n").alias("m"), F.coalesce(F.max(F.when(F.col("from") == F.col("node"), F.col("n"))), F.lit(0)).alias("n"),
    ).filter("n > 0")
    ceil = lambda c, k: F.greatest(F.ceil(F.col(c) / k), F.lit(1)).cast("bigint")
    plan = cut(load.select("node", ceil("n", OWN).alias("pieces"), ceil("m", OTHERS).alias("parts")), "trie-nodes")
    own = at.join(plan, "node").select(
        "fp", "node", (F.col("h") % F.col("pieces")).alias("piece"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"),
        F.lit(True).alias("own"),
    )
    reach = at.select("fp", "h", F.col("node").alias("from"), F.explode(_near_nodes(F.col("node"), depth)).alias("node")).join(plan, "node")
    # Inside its own node a fingerprint meets the pieces before its own.
    last = F.when(F.col("from") == F.col("node"), F.col("h") % F.col("pieces")).otherwise(F.col("pieces")) - 1
    others = reach.filter(last >= 0).select(
        "fp", "node", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"), (F.col("h") % F.col("parts")).alias("part"),
        F.lit(False).alias("own"),
    )

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values, mine = rows["fp"].to_numpy().view(np.uint64), rows["own"].to_numpy()
        return _links(values[mine], values[~mine], key[2] == 0)

    return own.unionByName(others).groupBy("node", "piece", "part").applyInPandas(join, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` → doc_id, fp, component_id (smallest doc_id that links reach, itself included).

    Words end at ASCII white space, A-Z count as a-z.  A text of fewer than three words is one shingle; NULL, empty and
    blank texts have fingerprint zero and link like any other.  Repeated rows give repeated rows.  Rows without doc_id
    link too but name no component; a component of only such rows has a NULL id.  Other columns are not read; an empty
    table gives an empty result.  Equal fingerprints are one vertex, so a large group of copies costs one row.
    """
    prints = cut(fingerprints(docs), "prints")
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    reached = components(trie_links(first.select("fp")), "a", "b")
    rooted = first.join(reached, F.col("fp") == F.col("id"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut(rooted.join(names, "root").select("fp", "component_id"), "components")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, the one of smallest doc_id; all columns stay.

    Repeated rows of the kept document become one row.  Rows without doc_id are no one's copy and stay.
    """
    found = near_duplicates(docs)
    lose = found.filter(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("lost_id")).distinct()
    repeated = cut(found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("twice_id")), "repeated")
    kept = wrapped(docs).join(cut(lose, "copies"), F.col("doc_id") == F.col("lost_id"), "left_anti")
    if repeated.isEmpty():
        return unwrapped(kept, docs.columns)
    twice = F.col("doc_id") == F.col("twice_id")
    once = kept.join(repeated, twice, "left_anti").unionByName(kept.join(repeated, twice, "left_semi").dropDuplicates(["doc_id"]))
    return unwrapped(once, docs.columns)
