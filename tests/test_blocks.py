"""Cosine neighbours by blocks, medians by bins and bounded task state, against plain forms."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tesselar.functions import vectors
from tesselar.operators import blocks, groups, histograms, pairwise
from tesselar.operators.pairwise import nearest
from tesselar.workload import tables
from tests.compare import differences, spark_table

SF = "/root/testdata/sf0.001"


def clustered(spark, n=900, dim=8, seed=0):
    """Unit vectors around a few directions, a third of them equal, and some zero vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim)) * 4
    v = centres[rng.integers(0, 9, n)] + rng.normal(size=(n, dim)) * 0.05
    v[: n // 3] = v[0]
    v[-5:] = 0
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    order = rng.permutation(n)
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(order, v)], "id bigint, vec array<double>")


def rows(df):
    return sorted((r["query"], r["rank"], r["id"], r["score"]) for r in df.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 32)
    monkeypatch.setattr(blocks, "LOT", 3)


def test_blocks_give_the_same_neighbours(spark, small_blocks):
    df = clustered(spark).repartition(5)
    some = df.filter("id % 7 = 0")
    for queries, targets, k in ((df, df, 5), (some, df.filter("id % 2 = 0"), 40), (some, df.filter("id < 3"), 5)):
        got, want = rows(nearest(queries, targets, k, limit=0)), rows(nearest(queries, targets, k))
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want))
    assert nearest(df, df.limit(0), 3, limit=0).count() == 0 and nearest(df.limit(0), df, 3, limit=-1).count() == 0


def test_most_pairs_of_blocks_are_skipped(spark, small_blocks):
    df = clustered(spark, 1500)
    q, t, _, pairs = blocks.block_pairs(df, df, 5)
    number = [side.select("block").distinct().count() for side in (q, t)]
    assert min(number) > 40
    # Both the first search (one pair per query block) and the rest.
    assert pairs.count() + number[0] < 0.3 * number[0] * number[1]


@pytest.mark.parametrize("n", [60, 61])
def test_medians_by_bins(spark, n):
    """Even and odd sizes, ties, and a middle that lies between two far bins."""
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 4))
    v[: n // 2] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rep = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "id bigint, vec array<double>").repartition(4)
    centres = np.array([v[0], -v[0], v[-1]])
    c = spark.createDataFrame([(g, row.tolist()) for g, row in enumerate(centres)], "`group` bigint, centroid array<double>")
    got = {r["group"]: r["global_median"] for r in groups.global_medians(rep, c).collect()}
    for g, centre in enumerate(centres):
        assert abs(got[g] - np.median((np.round(np.clip(v @ centre, -1, 1), 9) + 1) / 2)) < 1e-9


def test_task_state_is_handed_over(spark, monkeypatch):
    """With room for a few KB the sums are the same as with room for all of them."""
    rep = vectors.representation(tables.features(spark, SF), "cosine_centered")
    m = groups.members(rep, tables.label_groups(spark, SF).select((F.col("group") * 3 + F.col("id") % 3).alias("group"), "id"))
    scores = groups.member_scores(m, groups.centroids(m)).coalesce(1)
    values = tables.pixels(spark, SF).groupBy("channel", "value").agg(F.count("*").alias("n")).coalesce(1)
    places = scores.select("group", ((F.col("similarity") + 1) / 2).alias("x"), (F.col("id") % 10 / 10).alias("y"))

    def results():
        axis = groups.first_axis_projection(scores).collect()
        curve = histograms.kde(values, ["channel"], 32).collect()
        field = histograms.density_field(places, 20, 10).collect()
        return (
            {(r["group"], r["id"]): r["proj1"] for r in axis}, {(r["channel"], r["i"]): r["y"] for r in curve},
            {(r["group"], r["gy"], r["gx"]): r["v"] for r in field},
        )

    want = results()
    monkeypatch.setattr(groups, "HELD_BYTES", 4096)
    monkeypatch.setattr(histograms, "HELD_BYTES", 1024)
    for got, base in zip(results(), want):
        assert got.keys() == base.keys() and all(abs(got[k] - base[k]) < 1e-8 for k in got)


def test_rows_sent_do_not_follow_the_pairs_of_blocks(spark, small_blocks):
    """All pairs of 28 blocks are wanted, yet a row is sent to three tiles and not to every block."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(900, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vec array<double>")
    q, t, _, pairs = blocks.block_pairs(df, df, 5)
    n = t.select("block").distinct().count()
    assert pairs.count() > 0.9 * n * (n - 1)
    sent = {r["side"]: r["count"] for r in blocks._dealt(pairs, q, t, blocks._tiles(t)).groupBy("side").count().collect()}
    assert sent[1] <= 3 * 900 and sent[2] <= 3 * 900
    got, want = rows(nearest(df, df, 5)), rows(nearest(df, df, 5, limit=1 << 30))
    assert [g[:3] for g in got] == [w[:3] for w in want]


def test_queries_of_middle_size_do_not_pass_the_driver(spark, monkeypatch):
    """10,000 vectors of 64 numbers are searched by blocks, not from the closure of every task."""
    seen = []
    monkeypatch.setattr(blocks, "nearest_by_blocks", lambda q, t, k: seen.append(k) or spark.createDataFrame([], blocks._HITS))
    wide = spark.range(10_000).select("id", F.array_repeat(F.lit(0.125), 64).alias("vec"))
    assert nearest(wide, wide, 8).count() == 0 and seen == [8]


BY_BLOCKS = [
    "single_cell_analysis",
    "knn_cosine_centred",
    "similarity_ranks",
    "knn_cosine",
    "displayable_neighbours",
    "knn_within_allow_list",
    "similarity01",
    "local_histogram",
]


@pytest.fixture(scope="module")
def vector_table(spark, tmp_path_factory):
    """600 vectors of 16 numbers without groups, so bounds skip few pairs of blocks."""
    folder = tmp_path_factory.mktemp("vectors")
    v = np.random.default_rng(7).normal(size=(600, 16))
    made = spark.createDataFrame([(i, x.tolist(), i % 5) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>, label int")
    made.write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", BY_BLOCKS)
def test_queries_send_a_row_to_each_lot_and_part_at_most(spark, small_blocks, vector_table, monkeypatch, name):
    """The whole query set goes by blocks, into searches of 3 x 600 target and 3 x 600 query rows at most, with the same result."""
    build, frame, sent = entry.queries()[name], type(spark.range(1)), []
    want = spark_table(build(spark, vector_table))
    plain = frame.mapInArrow

    def counted(df, work, schema, *more, **options):
        if schema == blocks._HITS and "side" in df.columns:
            sent.append(Observation())
            df = df.observe(sent[-1], F.count_if(F.col("side") == 1).alias("targets"), F.count_if(F.col("side") == 2).alias("queries"))
        return plain(df, work, schema, *more, **options)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    monkeypatch.setattr(pairwise, "SEARCH_LIMIT_BYTES", 32 << 10)
    got = spark_table(build(spark, vector_table))
    assert differences(got, want) == ""
    # The search in one target block per query block, then that in all others.
    home, rest = (o.get for o in sent)
    assert home["queries"] == 600 and 0 < home["targets"] <= 3 * 600
    assert rest["queries"] <= 3 * 600 and 0 < rest["targets"] <= 3 * 600
