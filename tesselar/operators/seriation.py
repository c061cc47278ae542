"""Spectral seriation: members of a group ordered by the Fiedler vector of their similarity graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tesselar.functions import vectors
from tesselar.functions.vectors import matrix
from tesselar.operators.pairwise import BLOCK_ROWS
from tesselar.scale import by_rows, materialise, ranked

DENSE_LIMIT = 32_768  # members up to which one task solves a group
FULL_LIMIT = 1500  # members up to which it solves the whole matrix; beyond, Davidson steps
BLOCK_NUMBERS = 1 << 23  # of the matrix that are held at once
START, WIDTH, MOST, PRODUCTS = 24, 4, 96, 400  # columns at the start, per step and at most, and matrix products at most
STEPS = 40  # Lanczos steps before the process starts again from the best vector so far
CHECK_EVERY = 8  # steps between looks at whether all groups have settled
RESTARTS = 50
RESIDUAL = 1e-9
TINY = 1e-12  # of the largest eigenvalue: a vector this short is rounding
COS_45 = 0.7071067811865476


def _product(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The similarity matrix times the columns of ``t``; each block of the matrix is made once and serves both sides."""
    out = np.zeros_like(t)
    rows = max(64, min(512, BLOCK_NUMBERS // len(x)))
    for i in range(0, len(x), rows):
        s = x[i : i + rows] @ x[i:].T
        np.clip(s, 0.0, 1.0, out=s)
        out[i : i + rows] += s @ t[i:]
        out[i + rows :] += s[:, rows:].T @ t[i : i + rows]
    return out


def _orthonormal(t: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """The columns of ``t`` without the constant, those of the basis and what is left of them only by rounding."""
    t = t / np.maximum(np.linalg.norm(t, axis=0), 1e-300)
    for _ in range(2):
        t = t - t.mean(axis=0)
        if basis is not None:
            t = t - basis @ (basis.T @ t)
        q, r = np.linalg.qr(t)
        t = q[:, np.abs(np.diag(r)) > 1e-10]
    return t


def _davidson(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The Fiedler vector of a group, to RESIDUAL.

    The matrix is the degrees less a product of few strong directions, so residuals divided by the degrees' distance from
    the Ritz value point at what the basis lacks; the basis starts from those directions and a fixed random vector.
    """
    degree = _product(x, np.ones((len(x), 1)))
    top = 2.0 * float(degree.max())
    directions = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :START]
    seed = np.random.default_rng(len(ids)).random((len(ids), 1))
    v = _orthonormal(np.concatenate([x @ directions, seed], axis=1), None)
    w = degree * v - _product(x, v)
    for _ in range(PRODUCTS):
        values, y = np.linalg.eigh((h := v.T @ w) + h.T)
        values = values / 2
        u = v @ y[:, :WIDTH]
        r = w @ y[:, :WIDTH] - u * values[:WIDTH]
        if np.linalg.norm(r[:, 0]) <= RESIDUAL * top:
            return u[:, 0]
        if v.shape[1] + WIDTH > MOST:
            v, w = v @ y[:, :START], w @ y[:, :START]
        away = degree - values[:WIDTH]
        near = 1e-3 * top
        t = _orthonormal(r / np.where(np.abs(away) < near, near, away), v)
        if not t.shape[1]:
            break
        v, w = np.concatenate([v, t], axis=1), np.concatenate([w, degree * t - _product(x, t)], axis=1)
    raise RuntimeError(f"the order of a group of {len(x)} members did not settle in {PRODUCTS} products")


def _dense(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    x = np.stack(pdf["vec"].to_numpy())
    if len(x) > FULL_LIMIT:
        f = _davidson(x, pdf["id"].to_numpy())
    else:
        s = np.clip(x @ x.T, 0.0, 1.0)
        _, v = np.linalg.eigh(np.diag(s.sum(axis=1)) - s)
        f = v[:, 1] if len(x) > 1 else v[:, 0]
    f = -f if f[0] < 0 else f
    return pd.DataFrame({"group": pdf["group"], "id": pdf["id"], "fiedler": f})


def _free_groups(members: DataFrame) -> DataFrame:
    """Groups whose similarities need no clipping: every member within 45 degrees of the group's direction."""
    centre = materialise(members.groupBy("group").agg(vectors.mean_vector(F.col("vec")).alias("mean")).select("group", vectors.unit(F.col("mean")).alias("centre")), "centres")
    inside = members.join(centre, "group").select("group", vectors.dot("vec", "centre").alias("c"))
    return materialise(inside.groupBy("group").agg((F.min("c") >= COS_45).alias("free")), "free")


class _Products:
    """Products of the groups' similarity matrices with one vector per group, all groups in one plan.

    Where nothing is clipped the matrix is X·Xᵀ, and the product is one sum of vectors per group.  Elsewhere the members
    meet block by block inside their group; the packed blocks are written once.
    """

    def __init__(self, members: DataFrame, sizes: DataFrame):
        kind = _free_groups(members)
        self.free = members.join(kind.filter("free"), "group", "left_semi")
        bound = members.join(kind.filter("NOT free"), "group", "left_semi")
        blocks = sizes.select("group", F.ceil(F.col("n") / BLOCK_ROWS).cast("bigint").alias("blocks"))
        placed = bound.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        packed = placed.groupBy("group", "block", "blocks").agg(F.sort_array(F.collect_list(F.struct("id", "vec"))).alias("rows"))
        self.packed = materialise(packed, "packed")
        self.home = materialise(placed.select("group", "id", "block"), "home")

    def times(self, table: DataFrame, column: str) -> DataFrame:
        """(group, id, value) of the product with ``column`` of ``table(group, id, …)``."""
        q = table.select("group", "id", F.col(column).alias("q"))
        own = self.free.join(by_rows(q), ["group", "id"])
        scaled = F.transform("vec", lambda x: x * F.col("q"))
        total = own.groupBy("group").agg(vector_to_array(Summarizer.sum(array_to_vector(scaled))).alias("total"))
        free = self.free.join(total, "group").select("group", "id", vectors.dot("vec", "total").alias("value"))
        # The numbers of a block, in the order of its packed rows.
        entries = q.join(by_rows(self.home), ["group", "id"]).groupBy("group", "block").agg(F.sort_array(F.collect_list(F.struct("id", "q"))).alias("q"))
        theirs = self.packed.join(by_rows(entries), ["group", "block"]).select("group", "block", F.col("rows.vec").alias("there"), F.col("q.q").alias("q"))
        mine = self.packed.select("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.col("rows.id").alias("ids"), F.col("rows.vec").alias("here"))

        def work(batches):
            for b in batches:
                for i in range(b.num_rows):
                    ids = b.column(1)[i].values.to_numpy()
                    x, y, w = matrix(b.column(2)[i].values), matrix(b.column(3)[i].values), b.column(4)[i].values.to_numpy()
                    value = np.concatenate([np.clip(x[s : s + 512] @ y.T, 0.0, 1.0) @ w for s in range(0, len(x), 512)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ids), b.column(0)[i].as_py())), pa.array(ids), pa.array(value)], names=["group", "id", "value"],
                    )

        met = mine.join(by_rows(theirs), ["group", "block"]).select("group", "ids", "here", "there", "q")
        part = met.mapInArrow(work, "group bigint, id bigint, value double").groupBy("group", "id").agg(F.sum("value").alias("value"))
        return free.unionByName(part)


_RITZ = T.StructType([T.StructField("y", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())])


@arrow_udf(_RITZ)
def _ritz(alphas: pa.Array, betas: pa.Array) -> pa.Array:
    """Leading eigenvector of each tridiagonal matrix, and what the last step leaves of it."""
    ys, rests = [], []
    for a, b in zip(alphas.to_pylist(), betas.to_pylist()):
        y = np.linalg.eigh(np.diag(a) + np.diag(b[:-1], 1) + np.diag(b[:-1], -1))[1][:, -1]
        ys.append(y.tolist())
        rests.append(float(b[-1] * abs(y[-1])))
    return pa.StructArray.from_arrays([pa.array(ys, pa.list_(pa.float64())), pa.array(rests, pa.float64())], names=["y", "rest"])


def _in_order(steps: list[DataFrame], name: str) -> DataFrame:
    """One array per group from the numbers ``(group, value, j)`` of all steps."""
    rows = steps[0]
    for more in steps[1:]:
        rows = rows.unionByName(more)
    pairs = F.array_sort(F.collect_list(F.struct("j", F.coalesce("value", F.lit(0.0)).alias("value"))))
    return rows.groupBy("group").agg(F.transform(pairs, lambda x: x["value"]).alias(name))


def _lanczos(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fiedler values ``(group, id, fiedler)`` of all given groups together.

    Lanczos on (2·max degree)·I − L, orthogonal to the constant null vector.  All vectors are columns of a written table,
    the few numbers per group and step are written tables too; the driver sees how many groups have not settled.
    """
    products = _Products(members, sizes)
    base = members.select("group", "id").withColumn("one", F.lit(1.0))
    degree = products.times(base, "one").withColumnRenamed("value", "degree")
    top = materialise(degree.groupBy("group").agg((2.0 * F.max("degree")).alias("c")), "top")
    table = materialise(degree.join(top, "group").join(sizes, "group"), "degree")

    def orthonormal(df: DataFrame, columns: list[str], out: str) -> tuple[DataFrame, DataFrame]:
        """Frees ``w`` of the constant and of earlier columns, twice, and scales it; also the norms per group."""
        norms = None
        for last in (False, True):
            sums = [F.sum("w").alias("m"), *[F.sum(F.col("w") * F.col(q)).alias(f"d_{q}") for q in columns], F.sum(F.col("w") * F.col("w")).alias("w2")]
            dots = materialise(df.groupBy("group", "n").agg(*sums), "dots").withColumn("m", F.col("m") / F.col("n"))
            value = F.col("w") - F.col("m") - sum((F.col(q) * F.col(f"d_{q}") for q in columns), F.lit(0.0))
            if last:
                left = F.col("w2") - F.col("n") * F.col("m") * F.col("m") - sum((F.col(f"d_{q}") * F.col(f"d_{q}") for q in columns), F.lit(0.0))
                dots = dots.withColumn("beta", F.sqrt(F.greatest(F.lit(0.0), left)))
                norms = dots.select("group", "beta")
                value = F.when(F.col("beta") > TINY * F.col("c"), value / F.col("beta")).otherwise(F.lit(0.0))
            kept = [c for c in df.columns if c not in ("w", out)]
            df = df.join(dots.drop("n"), "group").select(*kept, value.alias(out if last else "w"))
            df = materialise(df, "basis")
        return df, norms

    seed = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    table, _ = orthonormal(table.withColumn("w", F.when(F.col("n") > 1, seed).otherwise(F.lit(0.0)) * F.col("c")), [], "q0")
    done = None
    for _ in range(RESTARTS):
        alphas, betas = [], []
        for j in range(STEPS):
            columns = [f"q{i}" for i in range(j + 1)]
            q = F.col(f"q{j}")
            with_s = table.join(by_rows(products.times(table, f"q{j}")), ["group", "id"])
            step = materialise(with_s.withColumn("w", (F.col("c") - F.col("degree")) * q + F.col("value")).drop("value"), "step")
            alphas.append(materialise(step.groupBy("group").agg(F.sum(F.col("w") * q).alias("value")).withColumn("j", F.lit(j)), "alpha"))
            table, beta = orthonormal(step, columns, f"q{j + 1}")
            betas.append(beta.select("group", F.col("beta").alias("value"), F.lit(j).alias("j")))
            if (j + 1) % CHECK_EVERY == 0 or j + 1 == STEPS:
                pairs = _in_order(alphas, "a").join(_in_order(betas, "b"), "group").select("group", _ritz("a", "b").alias("r"))
                found = materialise(pairs.join(top, "group").select("group", "r.y", (F.col("r.rest") <= RESIDUAL * F.col("c")).alias("settled")), "ritz")
                if found.filter("NOT settled").isEmpty():
                    break
        f = sum((F.col(f"q{i}") * F.col("y")[i] for i in range(len(alphas))), F.lit(0.0))
        ritz = materialise(table.join(found, "group").select("group", "id", "degree", "c", "n", f.alias("w"), "settled"), "vectors")
        settled = ritz.filter("settled").select("group", "id", F.col("w").alias("f"))
        done = settled if done is None else done.unionByName(settled)
        rest = ritz.filter("NOT settled").drop("settled")
        if rest.isEmpty():
            break
        table, _ = orthonormal(rest, [], "q0")
    else:
        raise RuntimeError(f"the order of {rest.select('group').distinct().count()} groups did not settle in {RESTARTS} restarts")
    sign = done.groupBy("group").agg(F.min_by("f", "id").alias("first"))
    return done.join(sign, "group").select("group", "id", (F.col("f") * F.when(F.col("first") < 0, -1.0).otherwise(1.0)).alias("fiedler"))


def seriation(group_members: DataFrame, dense_limit: int = DENSE_LIMIT) -> DataFrame:
    """``(group, id, position)`` by Fiedler value, ties by id; sign fixed so the lowest id is not negative.

    Groups up to ``dense_limit`` members fit in a task and are solved there, each in one; larger ones are solved together
    by distributed matrix–vector products, to the same residual whatever their number.
    """
    members = materialise(group_members.select(F.col("group").cast("bigint").alias("group"), "id", "vec"), "members")
    sizes = materialise(members.groupBy("group").agg(F.count("*").alias("n")), "sizes")
    small = members.join(sizes.filter(F.col("n") <= dense_limit), "group", "left_semi")
    # Written, as the ranks read them twice.
    values = materialise(small.groupBy("group").applyInPandas(_dense, "group bigint, id bigint, fiedler double"), "fiedler")
    large = sizes.filter(F.col("n") > dense_limit)
    if not large.isEmpty():
        values = values.unionByName(_lanczos(members.join(large, "group", "left_semi"), large))
    values = values.withColumn("_f", F.round("fiedler", 9))
    return ranked(values, ["group"], ["_f", "id"], "position").drop("_f")


def similarity_field(scores: DataFrame, order: DataFrame) -> DataFrame:
    """Members as points: seriation position and similarity, both on [0, 1]."""
    sizes = materialise(order.groupBy("group").agg(F.max("position").alias("top")), "sizes")
    placed = scores.select(F.col("group").cast("bigint").alias("group"), "id", "similarity").join(by_rows(order.select("group", "id", "position")), ["group", "id"])
    return placed.join(sizes, "group").select(
        "group", "id", (F.col("position") / F.greatest(F.lit(1), F.col("top"))).alias("x"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("similarity") + 1.0) * 0.5)).alias("y"),
    )
