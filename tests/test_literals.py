"""Hand-computed edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from tesselar.functions import scalars, text, vectors
from tesselar.operators import clusters, composition, histograms, intensity, neighbours, selection
from tesselar.operators.pairwise import nearest
from tesselar.plans import display
from tesselar.sources import annotations, cells, channels, documents


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_safe_int_and_label_zero(spark):
    df = spark.createDataFrame([(0, "0"), (1, None), (2, "1.0"), (3, "NA"), (4, "-2.7"), (5, "inf")], "id long, label string")
    assert [r[1] for r in rows(df.select("id", scalars.safe_int(F.col("label"))).orderBy("id"))] == [0, None, 1, None, -2, None]
    kept = dict(rows(df.select("id", scalars.resolve_label(df.columns, fallback="mod"))))
    assert kept == {0: 0, 1: 1, 2: 1, 3: 3, 4: -2, 5: 5}
    hashed = dict(rows(df.select("id", scalars.resolve_label(df.columns, zero_as_missing=True))))
    assert hashed[0] == dict(rows(df.select("id", scalars.stable_label(F.col("id")))))[0]


def test_label_falls_back_only_without_column(spark):
    df = spark.createDataFrame([(7, None, "3")], "id long, label string, clustering string")
    assert rows(df.select(scalars.resolve_label(df.columns, fallback="mod"))) == [(7,)]
    assert rows(df.drop("label").select(scalars.resolve_label(["id", "clustering"]))) == [(3,)]


def test_stable_label_known_value(spark):
    import hashlib

    want = int(hashlib.sha1(b"12345").hexdigest()[:8], 16) % 11
    assert spark.range(12345, 12346).select(scalars.stable_label(F.col("id"))).first()[0] == want


def test_zero_and_non_finite_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [float("nan"), 2.0]), (2, [float("inf"), 0.0])], "id long, embedding array<float>")
    got = {r["id"]: r["vec"] for r in vectors.representation(df).collect()}
    assert got == {0: [0.0, 0.0], 1: [0.0, 1.0], 2: [0.0, 0.0]}


def test_equal_vectors_rank_by_id(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, vec array<double>")
    got = nearest(df.filter("id = 5"), df, 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 9]


def test_fewer_targets_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "id long, vec array<double>")
    assert nearest(df, df, 10, space="l2").count() == 2


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.0 + 1e-9,), (-0.1,), (0.5,)], "v double")
    got = dict(rows(histograms.fixed_bins(df, [], "v", 4).select("bin", "n")))
    assert got == {0: 1, 1: 0, 2: 1, 3: 1}


def test_kde_flat_single_and_empty(spark):
    counts = spark.createDataFrame([(0, 5, 10), (1, 7, 1)], "channel long, value long, n long")
    expected = spark.createDataFrame([(0,), (1,), (2,)], "channel long")
    out = histograms.kde(counts, ["channel"], 8, expected)
    bw = dict(rows(out.select("channel", "bw").distinct()))
    assert bw[0] == pytest.approx(10 ** -0.2) and bw[1] == pytest.approx(1.0) and bw[2] == 0.0
    assert rows(out.filter("channel = 2").agg(F.max("y"), F.min("x"), F.max("x"))) == [(0.0, 0.0, 1.0)]
    peak = out.filter("channel = 1").agg(F.max("y")).first()[0]
    assert peak == pytest.approx(1 / math.sqrt(2 * math.pi))


@pytest.mark.parametrize("bright,kept", [(99, 199), (100, 100)])
def test_foreground_small_counts(spark, bright, kept):
    counts = spark.createDataFrame([(0, 10, 100), (0, 1000, bright)], "channel long, value long, n long")
    out = intensity.foreground(counts, ["channel"], 99.0, 0.0)
    assert out.agg(F.sum("n")).first()[0] == kept


def test_percentile_is_linear(spark):
    counts = spark.createDataFrame([(0, v, 1) for v in range(1, 101)], "channel long, value long, n long")
    r = intensity.channel_ranges(counts, ["channel"]).first()
    assert (r["auto_min"], r["auto_max"]) == (pytest.approx(1.99), pytest.approx(99.01))


def test_range_without_positive_values(spark):
    counts = spark.createDataFrame([(0, 0, 4)], "channel long, value long, n long")
    r = intensity.channel_ranges(counts, ["channel"]).first()
    assert (r["data_min"], r["data_max"], r["auto_min"], r["auto_max"]) == (0.0, 0.0, 0.0, 0.0)


def test_lasso_rules(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 0.5, 0.9), (4, 0.2, 0.2)], "id long, x double, y double")
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert sorted(r[0] for r in rows(selection.lasso_select(pts, square))) == [1, 3, 4]
    notch = [(0, 0), (1, 0), (1, 1), (0.5, 0.6), (0, 1)]
    assert sorted(r[0] for r in rows(selection.lasso_select(pts, notch))) == [1, 4]
    assert rows(selection.lasso_select(pts, square[:2])) == []


def test_expression_filter_safety(spark):
    df = spark.createDataFrame([(1, 3, "a b"), (2, None, "x"), (3, 5, None)], "id long, `Age (years)` int, kind string")
    names = {"age": "Age (years)", "kind": "kind"}
    run = lambda e: sorted(r[0] for r in rows(selection.filter_expression(df, names, e)))
    assert run("age >= 3 && !(kind == 'a b')") == []
    assert run("age === 3 || age > 4") == [1, 3]
    assert run("kind in ['x', 'a b']") == [1, 2]
    for bad in ("", "age > 1; drop", "age > {1}"):
        with pytest.raises(ValueError):
            run(bad)


def test_descriptor_and_choices(spark):
    df = spark.createDataFrame([("CD3 (low: 0, high: 1)",), ("Age (years)",), ("plain",), ("a (b) (c)",), (")(",)], "n string")
    d = rows(df.select(text.descriptor(F.col("n"))["base"], text.descriptor(F.col("n"))["description"]))
    assert d == [("CD3", "low: 0, high: 1"), ("Age", "years"), ("plain", None), ("a (b)", "c"), (")(", None)]
    c = df.limit(1).select(text.choices(text.descriptor(F.col("n"))["description"])).first()[0]
    assert [(x["label"], x["number"]) for x in c] == [("low", 0.0), ("high", 1.0)]


def test_channel_list_messy(spark):
    df = spark.createDataFrame(
        [(0, "0", "DNA", "0"), (1, "3", "CD4", ""), (2, "1", " ", "2"), (3, "3", "CD8", "NA"), (4, "x", "bad", "1"), (5, "1", "nan", "4")],
        "line long, ID string, Marker string, zarr_c string",
    )
    info = channels.channel_info(channels.channel_entries(df, "line"))
    assert rows(info.orderBy("id")) == [(0, "DNA", 0, 0), (1, "ch_1", 1, None), (2, "ch_2", 2, None), (3, "CD8", 3, None)]
    legacy = channels.channel_info(channels.channel_entries(df.drop("zarr_c"), "line"))
    assert [r[3] for r in rows(legacy.orderBy("id"))] == [0, 1, 2, 3]


def test_channel_source_precedence(spark, tmp_path):
    (tmp_path / "channels.csv").write_text("name\nA\n\nB\n")
    wide = spark.createDataFrame([tuple(range(11))], [f"c{i}" for i in range(9)] + ["CD3", "CD4"])
    assert [r["name"] for r in channels.load_channels(spark, str(tmp_path / "channels.csv"), wide).orderBy("id").collect()] == ["A", "B"]
    assert rows(channels.load_channels(spark, cells=wide).orderBy("id")) == [(0, "CD3", 9), (1, "CD4", 10)]
    assert channels.load_channels(spark) is None


def test_cells_csv_without_ids(spark, tmp_path):
    (tmp_path / "cells.csv").write_text("CellID,x_centroid,clustering\na,1.5,0\nb,2.5,NA\n")
    c = cells.scan_cells(spark, str(tmp_path / "cells.csv"))
    assert rows(c.select("id", "cellid", "X_centroid").orderBy("id")) == [(0, "a", 1.5), (1, "b", 2.5)]


def test_annotations_scan(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("celltype,Age (years),Grade (low: 0, high: 1)\nT,3,0\nB,,1\n".replace("Grade (low: 0, high: 1)", '"Grade (low: 0, high: 1)"'))
    df = annotations.scan_annotations(spark, str(tmp_path / "raw.csv"))
    schema = {r["alias"]: r["type"] for r in annotations.annotation_schema(df.drop("_row")).collect()}
    assert schema == {"celltype": "categorical", "age": "numeric", "grade": "categorical"}
    got = {r["id"]: r["raw"] for r in annotations.annotation_rows(df).collect()}
    assert got[1]["celltype"] == "B" and got[1]["Age (years)"] is None
    assert rows(annotations.present_annotation_columns(annotations.annotation_schema(df.drop("_row")))) == [(1, 0)]


def test_alias_repeats_are_numbered(spark):
    names = spark.createDataFrame([(0, "CD 3", True), (1, "CD-3 (x)", True), (2, "!!", False)], "ordinal int, raw_name string, is_number boolean")
    assert [r["alias"] for r in annotations.describe_columns(names).orderBy("ordinal").collect()] == ["cd_3", "cd_3_2", "col"]


def test_core_fit(spark):
    def placed(points):
        df = spark.createDataFrame([(i, x, y, {"t": "v"}) for i, (x, y) in enumerate(points)], "id long, x double, y double, values map<string,string>")
        return [(r["x"], r["y"]) for r in composition.core_labels(df, ["t"], 100.0, 100.0).orderBy("id").collect()]

    assert placed([(10.0, 10.0), (100.0, 103.0)]) == [(10.0, 10.0), (100.0, 103.0)]
    out = placed([(0.0, 0.0), (1000.0, 500.0)])
    assert out[0] == (pytest.approx(4.0), pytest.approx(4.0)) and out[1][0] == pytest.approx(96.0)
    assert placed([(500.0, 500.0)])[0] == (pytest.approx(4.0), pytest.approx(4.0))


def test_core_metadata_needs_its_header(spark):
    with pytest.raises(ValueError):
        annotations.core_metadata(spark.createDataFrame([(1, 2.0, 3.0)], "CORE_ID long, global_X double, global_Y double"))


def test_review_documents_and_scores(spark):
    doc = (
        '{"version":1,"levels":{"2":{"7":{"status":"accepted","user_title":"B","llm_accuracy":2.5,"confidence":9},'
        '"8":{"m1":{"status":"unsure","llm_accuracy":null},"x":{"note":1}}}}}'
    )
    got = {(r["cluster_id"], r["model"]): r for r in documents.review_documents(spark.createDataFrame([(doc,)], "doc string")).collect()}
    assert set(got) == {("7", "_legacy"), ("8", "m1")}
    assert (got["7", "_legacy"]["llm_accuracy"], got["7", "_legacy"]["confidence"]) == (2, 5)
    shown = composition.review_display(spark.createDataFrame([("T", "accepted", "B"), ("T", "rejected", None), ("T", None, None)], "title string, status string, user_title string"))
    assert [(r["display_title"], r["display_status"]) for r in shown.collect()] == [("B", "corrected"), ("T", "rejected"), ("T", None)]


@pytest.mark.parametrize(
    "answer,title,description,retry",
    [
        ('{"title": "Title A", "description": "Some text"}', "Title A", "Some text", False),
        ('Sure! {"title": "Title B", "description": "More"} bye', "Title B", "More", False),
        ('"First line"\nrest of it\nend', "First line", "rest of it\nend", True),
        ("one line only", "one line only", "one line only", True),
        ("...", text.DEFAULT_TITLE, text.DEFAULT_DESCRIPTION, True),
        ("", text.DEFAULT_TITLE, text.DEFAULT_DESCRIPTION, False),
        ('{"title": "Ti", "description": "Long enough"}', text.DEFAULT_TITLE, "Long enough", True),
    ],
)
def test_model_responses(spark, answer, title, description, retry):
    r = spark.createDataFrame([(answer,)], "t string").select(text.response_fields(F.col("t")).alias("f")).select("f.*").first()
    assert (r["title"], r["description"], r["needs_retry"]) == (title, description, retry)


def test_small_clusters_and_parent_ties(spark):
    df = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 0, 2)], "id long, cluster_L0 long, cluster_L1 long")
    p = {(r["level"], r["cluster"]): (r["parent_level"], r["parent_cluster"]) for r in clusters.cluster_parents(df, {0: 2, 1: 4}).collect()}
    assert p[1, 1] == (0, 0) and p[1, 0] == (0, 1) and p[1, 3] == (0, -1) and p[0, 0] == (-1, -1)


def test_single_cluster_level_has_no_z(spark):
    a = spark.createDataFrame([(0, 0, 1, 5.0), (1, 0, 1, 5.0), (1, 1, 1, 5.0)], "level int, cluster long, channel long, avg double")
    z = {(r["level"], r["cluster"]): r["z"] for r in clusters.marker_scores(a).collect()}
    assert z[0, 0] is None and z[1, 0] == 0.0


def test_dominant_annotation_tie_and_missing(spark):
    c = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 1)], "id long, clustering long")
    a = spark.createDataFrame([(0, " B "), (1, "A"), (2, "nan"), (3, "")], "id long, celltype string")
    assert rows(clusters.dominant_annotation(c, a, ["celltype"]).select("value", "n")) == [("B", 1)]


def test_regions_keep_the_last_two(spark):
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "id long")
    r = selection.add_region(spark.createDataFrame([], "region long, id long"), ids(1))
    r = selection.add_region(r, ids(2))
    r = selection.add_region(r, ids(2, 3))
    assert sorted(rows(r)) == [(0, 2), (1, 2), (1, 3)]
    assert dict(rows(selection.region_of(ids(1, 2, 3), r).select("id", "region"))) == {1: -1, 2: 1, 3: 1}


def test_coordinate_fallbacks(spark):
    c = spark.createDataFrame([(4, 1.0, None)], "id long, X_centroid double, Y_centroid double")
    r = display.coordinates(c, None, 3).first()
    assert (r["chunk_id"], r["local_index"], r["umap3d"]["x"], r["raw"]["y"]) == (1, 1, 1.0, 0.0)


def test_empty_allow_list_changes_nothing(spark):
    pool = spark.range(5)
    assert neighbours.display_filter(pool, spark.range(0)).count() == 5
    assert selection.within_filter(pool, spark.range(0)).count() == 5


def test_user_window_beats_automatic_range(spark):
    df = spark.createDataFrame(
        [(0, 0.0, 65535.0, False), (1, 0.0, 65535.0, True), (2, 5.0, 9.0, False), (3, None, None, False)], "channel long, min double, max double, user boolean"
    )
    r = spark.createDataFrame([(i, 10.0, 20.0) for i in range(3)], "channel long, auto_min double, auto_max double")
    got = {x["channel"]: (x["min"], x["max"]) for x in intensity.windows_for(df, df, r).collect()}
    assert got == {0: (10.0, 20.0), 1: (0.0, 65535.0), 2: (5.0, 9.0), 3: (0.0, 65535.0)}
