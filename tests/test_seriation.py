"""Seriation: the distributed form against a full solve, all large groups in one plan."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.operators import seriation
from tesselar.scale import materialise


def groups_of(spark, sizes, dim=6):
    """Group 0 is tight (nothing is clipped), the others spread over all directions."""
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for g, n in enumerate(sizes):
        v = rng.normal(size=(n, dim))
        if g == 0:
            v = v * 0.2 + np.ones(dim)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for x in v:
            rows.append((g, i, x.tolist()))
            i += 1
    return spark.createDataFrame(rows, "`group` bigint, id bigint, vec array<double>").repartition(4)


def order(df):
    return {(r["group"], r["id"]): r["position"] for r in df.collect()}


def test_large_groups_equal_the_full_solve(spark, monkeypatch):
    monkeypatch.setattr(seriation, "STEPS", 11)
    monkeypatch.setattr(seriation, "BLOCK_ROWS", 5)
    members = groups_of(spark, [12, 12, 11, 3])
    free = {r["group"]: r["free"] for r in seriation._free_groups(materialise(members, "m")).collect()}
    assert free[0] and not free[1]
    assert order(seriation.seriation(members, dense_limit=4)) == order(seriation.seriation(members))


def test_unsettled_groups_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(seriation, "STEPS", 2)
    monkeypatch.setattr(seriation, "RESTARTS", 1)
    with pytest.raises(RuntimeError):
        seriation.seriation(groups_of(spark, [5, 30]), dense_limit=10)


def test_members_are_not_broadcast(spark):
    """Joins on members or their blocks send nothing through the driver; sides with one row per group may."""
    members = materialise(groups_of(spark, [12, 12, 11]), "m")
    sizes = members.groupBy("group").agg(F.count("*").alias("n"))
    product = seriation._Products(members, sizes).times(members.withColumn("one", F.lit(1.0)), "one")
    scores = members.select("group", "id", F.lit(0.5).alias("similarity"))
    order = materialise(members.select("group", "id", F.col("id").alias("position")), "order")
    for df in (product, seriation.similarity_field(scores, order)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        for keys in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan):
            assert not re.search(r"\b(id|block)#", keys), keys


def test_groups_above_the_full_solve_settle_in_their_task(spark, monkeypatch):
    """1,600 members, tight and spread over all directions: the order of a full solve, without distributed steps."""
    monkeypatch.setattr(seriation, "_lanczos", lambda *_: pytest.fail("distributed steps for a group that fits in a task"))
    members = groups_of(spark, [1600, 1600])
    found = order(seriation.seriation(members))
    for g, rows in members.toPandas().sort_values("id").groupby("group"):
        x = np.stack(rows["vec"].to_numpy())
        s = np.clip(x @ x.T, 0.0, 1.0)
        f = np.linalg.eigh(np.diag(s.sum(axis=1)) - s)[1][:, 1]
        f = np.round(-f if f[0] < 0 else f, 9)
        # Numbers that differ by rounding may change places.
        placed = f[np.argsort([found[g, i] for i in rows["id"]])]
        assert (np.diff(placed) >= -2e-8).all() and sorted(found[g, i] for i in rows["id"]) == list(range(len(f)))
