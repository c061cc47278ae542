"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselar.functions import scalars
from tesselar.workload.registry import query
from tesselar.workload.tables import cells, pixels, points, raw, rounded

_MESSY = """CASE id % 8 WHEN 0 THEN id::VARCHAR WHEN 1 THEN id || '.0' WHEN 2 THEN 'NA' WHEN 3 THEN '' WHEN 4 THEN '-' || id || '.9' WHEN 5 THEN 'nan' WHEN 6 THEN NULL ELSE ' ' || id || ' ' END"""
_SAFE = "CASE id % 8 WHEN 0 THEN id WHEN 1 THEN id WHEN 4 THEN -id WHEN 7 THEN id END"
_SHA = "(('0x' || substr(sha1(id::VARCHAR), 1, 8))::BIGINT % 11)"


def _messy(df):
    i, s = F.col("id"), F.col("id").cast("string")
    k = i % 8
    return (
        F.when(k == 0, s).when(k == 1, F.concat(s, F.lit(".0"))).when(k == 2, "NA").when(k == 3, "").when(k == 4, F.concat(F.lit("-"), s, F.lit(".9")))
        .when(k == 5, "nan").when(k == 6, F.lit(None)).otherwise(F.concat(F.lit(" "), s, F.lit(" ")))
    )


@query("safe_int", f"SELECT id, {_SAFE} AS v FROM points", "points")
def _(spark, sf):
    p = points(spark, sf).select("id")
    return p.withColumn("v", scalars.safe_int(_messy(p)))


@query("stable_labels", f"SELECT id, {_SHA} AS label FROM points", "points")
def _(spark, sf):
    return points(spark, sf).select("id", scalars.stable_label(F.col("id")).alias("label"))


@query(
    "label_resolution",
    f"SELECT id, coalesce({_SAFE}, {_SHA}) AS by_hash, coalesce({_SAFE}, id % 11) AS by_mod, coalesce(nullif({_SAFE}, 0), {_SHA}) AS zero_missing FROM points",
    "points",
)
def _(spark, sf):
    p = points(spark, sf).select("id")
    p = p.withColumn("label", _messy(p))
    cols = p.columns
    return p.select(
        "id", scalars.resolve_label(cols).alias("by_hash"), scalars.resolve_label(cols, fallback="mod").alias("by_mod"),
        scalars.resolve_label(cols, zero_as_missing=True).alias("zero_missing"),
    )


@query("label_column", "SELECT id, cluster_L4 AS label FROM cells", "cells")
def _(spark, sf):
    c = cells(spark, sf)
    return c.select("id", scalars.resolve_label(c.columns, key="cluster_L4").alias("label"))


@query("label_column_default", "SELECT id, clustering AS label FROM cells", "cells")
def _(spark, sf):
    c = cells(spark, sf)
    return c.select("id", scalars.resolve_label(c.columns, key="other").alias("label"))


@query("chunk_addresses", "SELECT id, id // 2025 AS chunk_id, id % 2025 AS local_index FROM points", "points")
def _(spark, sf):
    i = F.col("id")
    return points(spark, sf).select("id", scalars.chunk_id(i, 2025).alias("chunk_id"), scalars.local_index(i, 2025).alias("local_index"))


@query("flipped_points", "SELECT id, round(x * 1000, 6) AS x, round(1 - y, 6) + 0.0 AS y FROM points", "points")
def _(spark, sf):
    return rounded(points(spark, sf).select("id", (F.col("x") * 1000).alias("x"), scalars.flip_y(F.col("y"), 1.0).alias("y")))


@query(
    "flipped_paths",
    "SELECT id, round(y / 7, 6) AS x0, round(10 - y, 6) AS y0, round(y, 6) AS x1, round(10 - y / 7, 6) AS y1 FROM points",
    "points",
)
def _(spark, sf):
    u = F.col("y") / 7
    path = F.array(F.struct(u.alias("x"), "y"), F.struct(F.col("y").alias("x"), u.alias("y")))
    p = points(spark, sf).select("id", scalars.flip_path(path, 10.0).alias("p"))
    v = lambda i, c: F.col("p")[i][c]
    return rounded(p.select("id", v(0, "x").alias("x0"), v(0, "y").alias("y0"), v(1, "x").alias("x1"), v(1, "y").alias("y1")))


@query(
    "normalised_intensity",
    """SELECT channel, id, value, count(*) AS n, round(max(greatest(0, least(1, (value - 500) / 40000))), 6) AS linear,
       round(max(pow(greatest(0, least(1, (value - 500) / 40000)), 1 / 2.2)), 6) AS curved FROM pixels GROUP BY channel, id, value""",
    "pixels",
)
def _(spark, sf):
    v = F.col("value").cast("double")
    t = lambda g: F.max(scalars.norm01(v, F.lit(500.0), F.lit(40500.0), g))
    return rounded(pixels(spark, sf).groupBy("channel", "id", "value").agg(F.count("*").alias("n"), t(1.0).alias("linear"), t(2.2).alias("curved")))


@query(
    "window_application",
    """SELECT value, round(CASE WHEN g <= 0.2 THEN 0 WHEN g >= 0.8 THEN 1 ELSE (g - 0.2) / greatest(0.8 - 0.2, 1e-6) END, 6) AS w, count(*) AS n FROM
       (SELECT value, value / 65535 AS g FROM pixels) GROUP BY ALL""",
    "pixels",
)
def _(spark, sf):
    g = F.col("value") / scalars.FULL_RANGE
    w = pixels(spark, sf).select("value", scalars.apply_window(g, F.lit(0.2), F.lit(0.8)).alias("w"))
    return rounded(w).groupBy("value", "w").agg(F.count("*").alias("n"))


@query(
    "normalised_ranges",
    """SELECT p_partkey AS id, least(a, b)::DOUBLE AS data_min, greatest(a, b)::DOUBLE AS data_max, round(least(coalesce(c, least(a, b)), coalesce(d, greatest(a, b))), 6) AS auto_min,
       round(greatest(coalesce(c, least(a, b)), coalesce(d, greatest(a, b))), 6) AS auto_max FROM (SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END, 0) AS a,
       coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_size * 50.0 END, 65535) AS b, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice / 2 END AS c, CASE WHEN p_partkey % 7 > 0 THEN p_size * 20.0 END AS d FROM part)""",
)
def _(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    r = scalars.normalise_range(
        F.when(k % 3 > 0, F.col("p_retailprice")), F.when(k % 4 > 0, s * 50.0), F.when(k % 5 > 0, F.col("p_retailprice") / 2), F.when(k % 7 > 0, s * 20.0), 0.0, scalars.FULL_RANGE
    )
    return rounded(raw(spark, sf, "part").select(k.alias("id"), r.alias("r")).select("id", "r.*"))


@query(
    "palette_colours",
    "SELECT id, ['228,26,28', '55,126,184', '77,175,74', '152,78,163', '255,127,0'][(id % 5) + 1] AS first_five, "
    "['255,0,0', '0,255,0', '0,128,255', '255,255,0', '255,0,255', '0,255,255', '255,128,0', '128,0,255', '0,255,128', '255,0,128'][(id % 10) + 1] AS channel_color FROM points",
    "points",
)
def _(spark, sf):
    return points(spark, sf).select(
        "id", scalars.palette_color(F.col("id"), scalars.CLUSTER_PALETTE[:5]).alias("first_five"),
        scalars.palette_color(F.col("id"), scalars.CHANNEL_PALETTE).alias("channel_color"),
    )


@query(
    "review_scores",
    "SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN least(5, greatest(0, round_even(CASE WHEN event_id % 4 = 0 THEN 2.5 WHEN event_id % 4 = 1 THEN -value ELSE value / 7 END, 0)))::INT END AS score FROM events",
)
def _(spark, sf):
    i = F.col("event_id")
    s = F.when(i % 6 == 0, "n/a").when(i % 4 == 0, "2.5").when(i % 4 == 1, (-F.col("value")).cast("string")).otherwise((F.col("value") / 7).cast("string"))
    return raw(spark, sf, "events").select("event_id", scalars.review_score(s).alias("score"))


@query(
    "grid_shapes",
    "SELECT id, CASE WHEN id > 0 THEN ceil(sqrt(id)) ELSE 1 END::BIGINT AS cols, CASE WHEN id > 0 THEN ceil(id / ceil(sqrt(id))) ELSE 1 END::BIGINT AS rows FROM points",
    "points",
)
def _(spark, sf):
    i = F.col("id")
    return points(spark, sf).select("id", scalars.grid_columns(i).alias("cols"), scalars.grid_rows(i).alias("rows"))
