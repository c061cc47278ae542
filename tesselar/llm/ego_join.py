"""Near-duplicate vectors by an epsilon grid order join.

For unit vectors a cosine of at least c means a distance of at most sqrt(2 − 2c) = epsilon.  Vectors are projected on the
leading principal dimensions and sorted by their grid cells of width epsilon, first dimension first.  Projection never
enlarges a distance, so two stretches of this sequence whose boxes are more than epsilon apart hold no link.  Blocks of
the sequence are paired by Spark through their boxes; inside a task the two stretches of a pair are halved recursively,
skipping what is provably distant, until small ones are compared vector by vector in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm.common import cut
from tesselar.llm.graph import components, forest
from tesselar.scale import ranked

COSINE = 0.98
# Principal dimensions of the grid, vectors that they are fitted on at most (in expectation), vectors per block, and
# the length from which stretches are compared directly.
DIMENSIONS, SAMPLE, BLOCK, LEAF = 6, 20_000, 1_024, 128
# Leading dimensions by whose cells blocks find each other.
KEYS = 3
SLACK = 1e-9
CELLS = [f"c{k}" for k in range(DIMENSIONS)]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled by the largest component first, so nothing overflows."""
    v = np.asarray(vectors, dtype=np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal leading directions (columns), DIMENSIONS at most."""
    centred = vectors - vectors.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return axes[:, ::-1][:, :DIMENSIONS]


def near_stretches(a: np.ndarray, b: np.ndarray | None, epsilon: float) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of short stretches (a from, a to, b from, b to) that may hold links; with b None, inside a.

    ``a`` and ``b`` hold projections in grid order.
    """
    own = b is None
    b = a if own else b
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 == a1 or b0 == b1:
            continue
        x, y = a[a0:a1], b[b0:b1]
        gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
        if (gap * gap).sum() > (epsilon + SLACK) ** 2:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            yield a0, a1, b0, b1
            continue
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        if own and (a0, a1) == (b0, b1):
            stack += [(a0, am, a0, am), (a0, am, am, a1), (am, a1, am, a1)]
        elif a1 - a0 >= b1 - b0:
            stack += [(a0, am, b0, b1), (am, a1, b0, b1)]
        else:
            stack += [(a0, a1, b0, bm), (a0, a1, bm, b1)]


def join_blocks(a: dict, b: dict | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links of each, a, b): weighted link counts and a forest of links of two blocks, or of one (b None)."""
    other = a if b is None else b
    ids = a["id"] if b is None else np.concatenate([a["id"], b["id"]])
    shift = 0 if b is None else len(a["id"])
    links = np.zeros(len(ids), dtype=np.int64)
    root = np.arange(len(ids))
    left, right, held = [], [], 0
    for a0, a1, b0, b1 in near_stretches(a["place"], None if b is None else b["place"], np.sqrt(2 - 2 * cosine)):
        near = a["unit"][a0:a1] @ other["unit"][b0:b1].T >= cosine
        same = b is None and a0 == b0
        if same:
            np.fill_diagonal(near, False)
        links[a0:a1] += near @ other["n"][b0:b1]
        if not same:
            links[shift + b0 : shift + b1] += near.T @ a["n"][a0:a1]
        i, j = np.nonzero(near)
        left.append(i + a0)
        right.append(j + b0 + shift)
        held += len(i)
        if held > 1 << 20:
            root = forest(len(ids), np.concatenate([*left, np.arange(len(ids))]), np.concatenate([*right, root]))
            left, right, held = [], [], 0
    root = forest(len(ids), np.concatenate([*left, np.arange(len(ids))]), np.concatenate([*right, root]))
    hung = np.flatnonzero(root != np.arange(len(ids)))
    return ids, links, ids[hung], ids[root[hung]]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` → vec_id, n_links, component_id, kept; one row per row.

    Only vectors of one label and one length are compared.  A NULL label, a NULL, empty or zero vector and one with NULL
    or non-finite components link with nothing; nor does a row without vec_id, which names no component and is kept.
    Equal vectors of a label are compared once and count as often as they occur; exactly repeated rows are vectors of
    their own.  Other columns are not read; an empty table gives an empty result.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding").withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = cut(
        rows.filter("sound").groupBy("label", "embedding").agg(F.min("vec_id").cast("bigint").alias("id"), F.count("*").alias("n")), "vectors",
    )
    total = classes.count()
    # Any orthonormal directions give the right links; those of a sample prune well.
    some = classes.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(1, total)) * (1 << 30)))).select("embedding").toPandas()
    axes: dict[int, np.ndarray] = {}
    for size, part in some.groupby(some["embedding"].map(len)):
        axes[int(size)] = principal(unit(np.stack(part["embedding"].to_numpy())))
    epsilon = float(np.sqrt(2 - 2 * cosine)) + SLACK
    label = classes.schema["label"].dataType.simpleString()

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby(batch["embedding"].map(len)):
                u = unit(np.stack(part["embedding"].to_numpy()))
                place = u @ axes.get(int(size), np.eye(int(size), DIMENSIONS))
                place = np.pad(place, ((0, 0), (0, DIMENSIONS - place.shape[1])))
                cells = np.floor(place / epsilon).astype(np.int32)
                yield pd.DataFrame({"label": part["label"].to_numpy(), "size": int(size), "id": part["id"].to_numpy(), "n": part["n"].to_numpy(),
                                    "unit": [x.tobytes() for x in u], "place": [x.tobytes() for x in place]} | {c: cells[:, k] for k, c in enumerate(CELLS)})

    shape = f"label {label}, size int, id bigint, n bigint, unit binary, place binary, {', '.join(f'{c} int' for c in CELLS)}"
    placed = ranked(classes.mapInPandas(project, shape), ["label", "size"], [*CELLS, "id"], "rank").withColumn("block", F.floor(F.col("rank") / BLOCK))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        place = np.frombuffer(b"".join(rows["place"]), dtype=np.float64).reshape(-1, DIMENSIONS)
        one = {c: [rows[c].iloc[0]] for c in ("label", "size", "block")}
        return pd.DataFrame(one | {
            "low": [place.min(axis=0)], "high": [place.max(axis=0)], "id": [rows["id"].to_numpy(np.int64).tobytes()], "n": [rows["n"].to_numpy(np.int64).tobytes()],
            "unit": [b"".join(rows["unit"])], "place": [place.tobytes()],
        })

    shape = f"label {label}, size int, block bigint, low array<double>, high array<double>, id binary, n binary, unit binary, place binary"
    blocks = cut(placed.groupBy("label", "size", "block").applyInPandas(pack, shape), "blocks")
    boxes = blocks.select("label", "size", "block", "low", "high")
    cell = lambda side, k: F.floor(F.col(side)[k] / epsilon).cast("int")

    def by_cells(reach: int, names: list[str]) -> DataFrame:
        out = boxes.select("label", "size", *[F.col(c).alias(n) for c, n in zip(("block", "low", "high"), names)])
        for k in range(KEYS):
            out = out.withColumn(f"k{k}", F.explode(F.sequence(cell(names[1], k) - reach, cell(names[2], k) + reach)))
        return out

    keys = ["label", "size", *[f"k{k}" for k in range(KEYS)]]
    met = by_cells(1, ["a", "alow", "ahigh"]).join(by_cells(0, ["b", "blow", "bhigh"]), keys).filter(F.col("a") <= F.col("b"))
    gaps = F.zip_with(
        F.zip_with("alow", "bhigh", lambda x, y: x - y), F.zip_with("blow", "ahigh", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    close = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x) <= epsilon * epsilon
    pairs = met.filter(close).select("label", "size", "a", "b").distinct()
    side = lambda s: blocks.select("label", "size", F.col("block").alias(s), F.struct("id", "n", "unit", "place").alias(f"{s}_rows"))
    # Both blocks of a pair: a few hundred kilobytes a row, whatever the data.
    both = pairs.join(side("a"), ["label", "size", "a"]).join(side("b"), ["label", "size", "b"]).select("size", "a", "b", "a_rows", "b_rows")

    def opened(size: int, x: dict) -> dict:
        return {
            "id": np.frombuffer(x["id"], np.int64), "n": np.frombuffer(x["n"], np.int64),
            "unit": np.frombuffer(x["unit"]).reshape(-1, size), "place": np.frombuffer(x["place"]).reshape(-1, DIMENSIONS),
        }

    def join(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                a = opened(r["size"], r["a_rows"])
                ids, links, x, y = join_blocks(a, None if r["a"] == r["b"] else opened(r["size"], r["b_rows"]), cosine)
                some = links > 0
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(np.concatenate([ids[some], x]), pa.int64()),
                    "links": pa.array(np.concatenate([links[some], np.zeros(len(x), np.int64)]), pa.int64()),
                    "b": pa.array(np.concatenate([ids[some], y]), pa.int64()),
                })

    found = cut(both.mapInArrow(join, "a bigint, links bigint, b bigint"), "vector-links")
    counted = found.filter("links > 0").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("links = 0"), "a", "b")
    named = classes.join(counted, "id", "left").join(roots, "id", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "id").alias("root"),
    )
    sure = rows.filter("sound").join(named, ["label", "embedding"]).select("vec_id", "links", "root")
    rest = rows.filter("not sound").select("vec_id", F.lit(0).cast("bigint").alias("links"), F.col("vec_id").cast("bigint").alias("root"))
    return sure.unionByName(rest).select(
        "vec_id", F.col("links").alias("n_links"), F.col("root").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("root"), F.lit(True)).alias("kept"),
    )
