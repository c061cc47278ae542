"""Brute-force and invariant checks of the distributed algorithms."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tesselar.functions import vectors
from tesselar.operators import clusters, detail, groups, histograms, intensity, kmeans, neighbours, outlines, seriation
from tesselar.operators.pairwise import nearest
from tesselar.scale import exact_percentiles, first_by_hash, ranked
from tesselar.streaming import incremental
from tesselar.workload import tables

SF = "/root/testdata/sf0.001"


def skewed_points(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    hot = n // 3
    x = np.concatenate([rng.random(n - hot), 0.5 + rng.random(hot) * 0.004])
    y = np.concatenate([rng.random(n - hot), 0.5 + rng.random(hot) * 0.004])
    score = rng.integers(0, 50, n).astype(float)
    return spark.createDataFrame([(i, float(x[i]), float(y[i]), float(score[i])) for i in range(n)], "id long, x double, y double, score double")


def sequential(items, radius):
    kept = []
    for r in sorted(items, key=lambda r: (-r["score"], r["id"])):
        if not any(abs(r["x"] - k["x"]) < radius and abs(r["y"] - k["y"]) < radius for k in kept):
            kept.append(r)
    return {r["id"] for r in kept}


@pytest.mark.parametrize("block,per_cell", [(64, 32), (4, 1), (3, 2)])
def test_suppression_equals_the_sweep(spark, block, per_cell):
    pts = skewed_points(spark)
    got = [r[0] for r in detail.suppress_overlaps(pts, 0.02, block, per_cell).collect()]
    assert len(got) == len(set(got)) and set(got) == sequential(pts.collect(), 0.02)


def test_suppression_of_a_monotone_chain(spark):
    pts = spark.createDataFrame([(i, i * 0.6, 0.0, float(i)) for i in range(120)], "id long, x double, y double, score double")
    got = {r[0] for r in detail.suppress_overlaps(pts, 1.0, 8, 4).collect()}
    assert got == sequential(pts.collect(), 1.0)


def test_suppression_without_radius_keeps_all(spark):
    assert detail.suppress_overlaps(skewed_points(spark, 30), 0.0).count() == 30


def test_ranked_with_one_hot_key(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5).alias("k"), (F.col("id") * 7919 % 100).alias("v"))
    got = ranked(df, ["k"], ["v", "id"]).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r["k"], []).append((r["v"], r["id"], r["rank"]))
    assert len(got) == 5000
    for rows in by_key.values():
        assert [r[2] for r in sorted(rows)] == list(range(len(rows)))


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partitioning_does_not_matter(spark, parts):
    df = spark.range(997).repartition(parts).select("id", (F.col("id") * 31 % 97).alias("v"))
    ranks = {r["id"]: r["rank"] for r in ranked(df, [], ["v", "id"]).collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((i * 31 % 97, i) for i in range(997)))}
    assert ranks == want
    px = tables.pixels(spark, SF).repartition(parts)
    m = clusters.cluster_channel_means(px, tables.cells(spark, SF)).agg(F.round(F.sum("avg"), 6)).first()[0]
    base = clusters.cluster_channel_means(tables.pixels(spark, SF), tables.cells(spark, SF)).agg(F.round(F.sum("avg"), 6)).first()[0]
    assert m == base


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    v = np.where(rng.random(2001) < 0.4, 0.25, rng.random(2001))
    df = spark.createDataFrame([(int(i % 2), i, float(x)) for i, x in enumerate(v)], "g long, id long, v double")
    for r in exact_percentiles(df, ["g"], "v", "id", {"a": 0.5, "b": 0.95, "c": 0.0}).collect():
        want = np.percentile(v[r["g"]::2], [50, 95, 0])
        assert [r["a"], r["b"], r["c"]] == pytest.approx(list(want))
    whole = exact_percentiles(df, [], "v", "id", {"m": 0.5}).first()[0]
    assert whole == pytest.approx(np.median(v))


def test_block_join_equals_closure(spark):
    f = tables.features(spark, SF)
    rep = vectors.representation(f)
    key = lambda d: sorted((r["query"], r["rank"], r["id"]) for r in d.collect())
    assert key(nearest(rep, rep, 5)) == key(nearest(rep, rep, 5, limit=0))


def test_all_equal_vectors_stay_bounded_and_ordered(spark):
    df = spark.range(4000).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    got = nearest(df.filter("id in (0, 3999)"), df, 3).orderBy("query", "rank").collect()
    assert [(r["query"], r["id"]) for r in got] == [(0, 1), (0, 2), (0, 3), (3999, 0), (3999, 1), (3999, 2)]


def test_fraction_at_most(spark):
    ref = spark.range(100).select((F.col("id") % 10).cast("double").alias("value"))
    probes = spark.createDataFrame([(1, -1.0), (2, 0.0), (3, 4.0), (4, 4.5), (5, 9.0), (6, 4.0)], "key long, value double")
    got = {r["key"]: r["fraction"] for r in neighbours.fraction_at_most(probes, ref).collect()}
    assert got == {1: 0.0, 2: 0.1, 3: 0.5, 4: 0.5, 5: 1.0, 6: 0.5}


def test_first_by_hash_is_exact_when_hashes_cluster(spark):
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("k"))
    quota = spark.createDataFrame([(0, 40, 1500), (1, 9, 1500)], "k long, quota long, size long")
    spread = (F.col("id") * 37 % 1000) / 1000.0
    for hash01, place in ((F.lit(0.999), lambda i: 0), (spread, lambda i: i * 37 % 1000)):
        got = first_by_hash(df, ["k"], quota, hash01, ["id"]).collect()
        want = []
        for k, n in ((0, 40), (1, 9)):
            want += sorted(range(k, 3000, 2), key=lambda i: (place(i), i))[:n]
        assert sorted(r["id"] for r in got) == sorted(want)


def test_hulls_contain_all_points(spark):
    pts = skewed_points(spark).select((F.col("id") % 3).alias("label"), "x", "y")
    hulls = {}
    for r in outlines.cluster_hulls(pts).orderBy("label", "ord").collect():
        hulls.setdefault(r["label"], []).append((r["x"], r["y"]))
    for r in pts.collect():
        h = hulls[r["label"]]
        for (ax, ay), (bx, by) in zip(h, h[1:] + h[:1]):
            assert (bx - ax) * (r["y"] - ay) - (by - ay) * (r["x"] - ax) >= -1e-12


def test_collinear_points_make_no_outline(spark):
    pts = spark.createDataFrame([(1, float(i), float(i)) for i in range(9)], "label long, x double, y double")
    assert outlines.cluster_hulls(pts).count() == 0


def test_display_subset_size_and_bins(spark):
    pts = skewed_points(spark)
    sub = detail.display_subset(pts, 500, 500).orderBy("position").collect()
    ids = [r["id"] for r in sub]
    assert len(ids) == len(set(ids)) == 500 and ids == sorted(ids) and [r["position"] for r in sub] == list(range(500))
    thin = detail.thinned(pts, 500).join(pts, "id").collect()
    gx, gy = detail.grid_shape(500)
    assert gx * gy >= 500
    xs, ys = [r["x"] for r in pts.collect()], [r["y"] for r in pts.collect()]
    cell = lambda v, all_v, n: min(n - 1, int((v - min(all_v)) / (max(all_v) - min(all_v)) * (n - 1e-9)))
    bins = [(cell(r["x"], xs, gx), cell(r["y"], ys, gy)) for r in thin]
    assert len(bins) == len(set(bins))


def test_kmeans_cost_and_labels(spark):
    c = tables.cells(spark, SF)
    labelled = kmeans.multilevel_kmeans(c, level_k={0: 1, 1: 3, 2: 8}, restarts=4).cache()
    dims = kmeans.SPACES["umap2"]
    cost = {}
    for level in (0, 1, 2):
        lv = clusters.unpivot_levels(labelled.select("id", *dims, f"cluster_L{level}"), ["id", *dims])
        cost[level] = clusters.centroid_distances(lv, dims).agg(F.sum(F.col("distance") ** 2)).first()[0]
    assert cost[2] < cost[1] < cost[0]
    data = c.select(array_to_vector(F.array(*dims)).alias("features"))
    library = min(KMeans(k=3, seed=s).fit(data).summary.trainingCost for s in range(4))
    assert cost[1] <= library * 1.01
    assert labelled.select("cluster_L0").distinct().count() == 1
    labelled.unpersist()


def test_kmeans_configuration(spark):
    c = tables.cells(spark, SF)
    with pytest.raises(ValueError):
        kmeans.multilevel_kmeans(c, level_k={1: 3})
    with pytest.raises(ValueError):
        kmeans.multilevel_kmeans(c.drop("umap3_z"), space="umap3")


def test_first_axis_matches_svd(spark):
    rep = vectors.representation(tables.features(spark, SF), "cosine_centered")
    m = groups.members(rep, tables.label_groups(spark, SF))
    s = groups.member_scores(m, groups.centroids(m)).filter("group = 3").cache()
    got = {r["id"]: r["proj1"] for r in groups.first_axis_projection(s).collect()}
    rows = s.orderBy("id").collect()
    x = np.array([r["vec"] for r in rows]) - np.array(rows[0]["centroid"])
    want = x @ np.linalg.svd(x, full_matrices=False)[2][0]
    have = np.array([got[r["id"]] for r in rows])
    assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8


def test_seriation_orders_a_path(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.random(60)) * 1.5
    order = rng.permutation(60)
    df = spark.createDataFrame([(1, int(i), [float(np.cos(t[j])), float(np.sin(t[j]))]) for i, j in enumerate(order)], "group long, id long, vec array<double>")

    def positions(limit):
        return {r["id"]: r["position"] for r in seriation.seriation(df, limit).collect()}

    dense = positions(1000)
    assert sorted(dense.values()) == list(range(60))
    along = [dense[i] for i in np.argsort(order)]
    assert along == list(range(60)) or along == list(range(59, -1, -1))
    assert positions(0) == dense  # the distributed solver finds the same order


def test_density_integrates_to_one(spark):
    counts = intensity.value_counts(tables.pixels(spark, SF), ["channel"])
    out = histograms.kde(counts, ["channel"], 400)
    for r in out.groupBy("channel").agg((F.sum("y") * F.max((F.col("hi") - F.col("lo")) / 399)).alias("mass")).collect():
        assert 0.85 < r["mass"] < 1.01


def test_sketch_window_close_to_exact(spark):
    px = tables.pixels(spark, SF)
    exact = {r["channel"]: r for r in intensity.channel_ranges(intensity.value_counts(px, ["channel"]), ["channel"]).collect()}
    state = intensity.range_sketches(px, ["channel", "chunk_id"]).drop("chunk_id")
    for r in intensity.finalise_sketches(state, ["channel"]).collect():
        assert r["data_min"] == exact[r["channel"]]["data_min"]
        assert abs(r["auto_max"] - exact[r["channel"]]["auto_max"]) < 3000


def test_sample_quota_is_per_chunk(spark):
    px = tables.pixels(spark, SF).filter("channel = 1")
    total = px.count()
    want = {r["chunk_id"]: round(300 * r["count"] / total) for r in px.groupBy("chunk_id").count().collect()}
    got = {r["chunk_id"]: r["count"] for r in intensity.proportional_sample(px, ["channel"], 300).groupBy("chunk_id").count().collect()}
    assert {k: v for k, v in want.items() if v} == got


@pytest.fixture()
def pixel_files(spark, tmp_path):
    px = tables.pixels(spark, SF)
    for i in range(3):
        px.filter(F.col("id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    return px, stream, str(tmp_path)


def test_streams_equal_batch(spark, pixel_files, tmp_path_factory):
    px, stream, _ = pixel_files
    out = str(tmp_path_factory.mktemp("out"))
    key = lambda df, cols: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())
    cols = ["channel", "data_min", "data_max", "auto_min", "auto_max"]
    batch = intensity.channel_ranges(intensity.value_counts(px, ["channel"]), ["channel"])
    assert key(incremental.intensity_ranges(stream, out + "/a"), cols) == key(batch, cols)
    cols = ["channel", "id", "mean01"]
    assert key(incremental.tile_sums(stream, out + "/b"), cols) == key(intensity.tile_signal(px), cols)
    cols = ["level", "cluster", "channel", "avg"]
    c = tables.cells(spark, SF)
    assert key(incremental.cluster_means(stream, c, out + "/c"), cols) == key(clusters.cluster_channel_means(px, c), cols)


def test_review_stream_keeps_the_last(spark, tmp_path):
    r = tables.reviews(spark, SF)
    for i in range(3):
        r.filter(F.col("event_id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    from tesselar.operators.composition import latest_reviews

    got = incremental.review_snapshot(stream, str(tmp_path) + "-out", "event_id").select("level", "cluster_id", "model", "event_id")
    want = latest_reviews(r, "event_id").select("level", "cluster_id", "model", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_refresh_publishes_only_complete_versions(spark, tmp_path):
    root = str(tmp_path / "ds")
    incremental.refresh_dataset(spark, root, {"t": lambda: spark.range(3)})
    first = incremental.current_version(spark, root)

    def broken():
        raise RuntimeError("no input")

    with pytest.raises(RuntimeError):
        incremental.refresh_dataset(spark, root, {"t": lambda: spark.range(9), "u": broken})
    assert incremental.current_version(spark, root) == first
    assert spark.read.parquet(first + "/t").count() == 3
