"""Level of detail, display subset and coordinate records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselar.operators import detail, intensity
from tesselar.plans import display
from tesselar.sources.cells import dataset_meta
from tesselar.workload.density_queries import _PARAMS, _SCORES, _params
from tesselar.workload.registry import query
from tesselar.workload.tables import cells, pixels, points, raw, rounded

CAP = 1000
RADIUS = 0.01


def _thin(cap: int) -> str:
    gx, gy = detail.grid_shape(cap)
    return f"""b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points),
      g AS (SELECT id, (id + 42) * 2654435761 % 4294967296 AS h, greatest(0, least({gx - 1}, floor((x - x0) / greatest(x1 - x0, 1e-12) * ({gx} - 1e-9::DOUBLE)))) AS bx,
        greatest(0, least({gy - 1}, floor((y - y0) / greatest(y1 - y0, 1e-12) * ({gy} - 1e-9::DOUBLE)))) AS bb FROM points, b),
      f AS (SELECT id, h FROM (SELECT *, row_number() OVER (PARTITION BY bx, bb ORDER BY h, id) AS r FROM g) WHERE r = 1),
      th AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY h, id) AS r FROM f) WHERE r <= {cap})"""


@query("grid_thinning", f"WITH {_thin(CAP)} SELECT id FROM th", "points")
def _(spark, sf):
    return detail.thinned(points(spark, sf), CAP)


@query(
    "display_subset",
    f"""WITH {_thin(CAP)}, pool AS (SELECT id, row_number() OVER (ORDER BY (id + 42) * 2654435761 % 4294967296, id) AS r FROM points WHERE id NOT IN (SELECT id FROM th)),
        al AS (SELECT id FROM th UNION ALL SELECT id FROM pool WHERE r <= {CAP} - (SELECT count(*) FROM th)) SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM al""",
    "points",
)
def _(spark, sf):
    return detail.display_subset(points(spark, sf), CAP, CAP).select("id", "position")


@query("display_subset_identity", "SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM points", "points")
def _(spark, sf):
    return detail.display_subset(points(spark, sf)).select("id", "position")


def _greedy(items: str, radius: float) -> str:
    """SQL for the greedy suppression of ``items(id, x, y, score)``: statuses 0 open, 1 kept, 2 dropped, advanced
    until none is open."""
    return f"""it AS ({items}),
      gr AS (SELECT *, floor(x / {radius})::BIGINT AS cx, floor(y / {radius})::BIGINT AS cy FROM it),
      nb AS (SELECT id, x, y, score, cx + dx AS cx, cy + dy AS cy FROM gr, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
      ed AS (SELECT a.id AS lo, b.id AS hi FROM gr a JOIN nb b ON a.cx = b.cx AND a.cy = b.cy WHERE abs(a.x - b.x) < {radius} AND abs(a.y - b.y) < {radius}
        AND (b.score > a.score OR (b.score = a.score AND b.id < a.id))),
      st(t, id, s) AS (SELECT 0, id, 0 FROM it UNION ALL SELECT t + 1, id, s FROM (SELECT max(c.t) AS t, c.id, CASE WHEN max(c.s) > 0 THEN max(c.s)
        WHEN coalesce(bool_or(h.s = 1), false) THEN 2 WHEN coalesce(bool_or(h.s = 0), false) THEN 0 ELSE 1 END AS s
        FROM st c LEFT JOIN ed ON ed.lo = c.id LEFT JOIN st h ON h.id = ed.hi GROUP BY c.id) WHERE EXISTS (SELECT 1 FROM st WHERE s = 0)),
      kp AS (SELECT id FROM st WHERE s = 1 AND t = (SELECT max(t) FROM st))"""


@query("overlap_suppression", f"WITH RECURSIVE {_greedy('SELECT id, x, y, score FROM points', RADIUS)} SELECT id FROM kp", "points")
def _(spark, sf):
    return detail.suppress_overlaps(points(spark, sf), RADIUS)


@query(
    "overlap_suppression_missing",
    "WITH RECURSIVE " + _greedy("SELECT id, x, y, score FROM points WHERE id % 7 <> 0", RADIUS) + """ SELECT id FROM kp
       UNION ALL SELECT id FROM points WHERE id % 7 = 0""",
    "points",
)
def _(spark, sf):
    # Items without finite coordinates touch nothing and stay.
    k = F.col("id")
    x = F.when(k % 21 == 0, F.lit(None)).when(k % 21 == 7, F.lit(float("nan"))).when(k % 21 == 14, F.lit(float("inf"))).otherwise(F.col("x"))
    return detail.suppress_overlaps(points(spark, sf).withColumn("x", x), RADIUS)


@query(
    "overlap_suppression_conflicts",
    "SELECT 0 AS conflicts, 0 AS uncovered",
)
def _(spark, sf):
    """Invariants of the suppression: kept points never overlap and every dropped point is covered by a better kept one."""
    return suppression_violations(points(spark, sf), RADIUS)


def suppression_violations(items, radius):
    kept = items.join(detail.suppress_overlaps(items, radius), "id", "left_semi")
    grid = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = kept.select(F.col("id").alias("kid"), F.col("x").alias("kx"), F.col("y").alias("ky"), F.col("score").alias("ks"), grid("x").alias("cx"), grid("y").alias("cy"), around.alias("o")).select(
        "kid", "kx", "ky", "ks", (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy")
    )
    placed = items.select("id", "x", "y", "score", grid("x").alias("cx"), grid("y").alias("cy"))
    hit = (F.abs(F.col("x") - F.col("kx")) < radius) & (F.abs(F.col("y") - F.col("ky")) < radius) & (F.col("id") != F.col("kid"))
    better = (F.col("ks") > F.col("score")) | ((F.col("ks") == F.col("score")) & (F.col("kid") < F.col("id")))
    j = placed.join(near, ["cx", "cy"], "left").groupBy("id").agg(
        F.max(F.coalesce(hit, F.lit(False)).cast("int")).alias("hit"), F.max(F.coalesce(hit & better, F.lit(False)).cast("int")).alias("covered")
    ).join(kept.select("id", F.lit(1).alias("kept")), "id", "left")
    return j.agg(
        F.sum(F.when(F.col("kept") == 1, F.col("hit")).otherwise(0)).alias("conflicts"),
        F.sum(F.when(F.col("kept").isNull(), 1 - F.col("covered")).otherwise(0)).alias("uncovered"),
    )


@query(
    "scored_items",
    "SELECT id, round(any_value(p.x) * 1000, 6) AS x, round(any_value(p.y), 6) AS y, round(avg(value), 6) AS score FROM points p JOIN pixels USING (id) GROUP BY id",
    "points pixels",
)
def _(spark, sf):
    s = pixels(spark, sf).groupBy("id").agg(F.avg("value").alias("mean_raw"))
    return rounded(detail.scored_items(points(spark, sf).drop("score").withColumn("x", F.col("x") * 1000), s))


@query(
    "visible_set",
    f"WITH RECURSIVE {_PARAMS}, {_SCORES}, "
    + _greedy("SELECT c.id, umap2_x AS x, umap2_y AS y, mean_raw AS score FROM cells c JOIN sc ON sc.id = c.id WHERE mean_raw > 1900 AND windowed > 0.02", detail.overlap_radius(8.0, 7.0))
    + " SELECT id FROM kp WHERE (id * 0.6180339887::DOUBLE) % 1 < least(1, 5000 / (SELECT count(*) FROM kp)) UNION SELECT vec_id FROM embeddings WHERE label = 2",
    "pixels cells",
)
def _(spark, sf):
    c = cells(spark, sf).select("id", F.col("umap2_x").alias("x"), F.col("umap2_y").alias("y"))
    pins = raw(spark, sf, "embeddings").filter("label = 2").select(F.col("vec_id").alias("id"))
    return display.visible_set(c, pixels(spark, sf), _params(spark, sf), 7, detail.overlap_radius(8.0, 7.0), 1, 1.0, pins)


_COORDS = """id, round(X_centroid, 6) + 0.0 AS raw_x, round(Y_centroid, 6) + 0.0 AS raw_y, round(umap2_x, 6) + 0.0 AS u2x, round(umap2_y, 6) + 0.0 AS u2y,
  round(umap3_x, 6) + 0.0 AS u3x, round(umap3_y, 6) + 0.0 AS u3y, round(umap3_z, 6) + 0.0 AS u3z"""
_HASHLABEL = "(('0x' || substr(sha1(id::VARCHAR), 1, 8))::BIGINT % 11)"


def _flat(df):
    return df.withColumns(
        {"raw_x": F.col("raw.x"), "raw_y": F.col("raw.y"), "u2x": F.col("umap2d.x"), "u2y": F.col("umap2d.y"), "u3x": F.col("umap3d.x"),
         "u3y": F.col("umap3d.y"), "u3z": F.col("umap3d.z")}
    ).drop("raw", "umap2d", "umap3d")


@query(
    "coordinate_records",
    f"""SELECT {_COORDS}, position // 64 AS chunk_id, position % 64 AS local_index, CASE WHEN clustering = 0 THEN {_HASHLABEL} ELSE clustering END AS label,
        {', '.join(f'cluster_L{i}' for i in range(6))} FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS position FROM cells WHERE clustering <> 9)""",
    "cells",
)
def _(spark, sf):
    c = cells(spark, sf)
    subset = detail.display_subset(c.filter("clustering <> 9").select("id", F.col("umap2_x").alias("x"), F.col("umap2_y").alias("y")))
    return rounded(_flat(display.coordinates(c, subset.select("id", "position"), 64)))


@query("spatial_coordinates", f"SELECT {_COORDS} FROM cells", "cells")
def _(spark, sf):
    return rounded(_flat(display.spatial_coordinates(cells(spark, sf))))


@query(
    "coordinates_with_fallback",
    "SELECT id, round(X_centroid, 6) + 0.0 AS raw_x, round(Y_centroid, 6) + 0.0 AS raw_y, round(CASE WHEN id % 3 = 0 THEN X_centroid ELSE umap2_x END, 6) + 0.0 AS u2x, "
    "round(Y_centroid, 6) + 0.0 AS u2y, round(X_centroid, 6) + 0.0 AS u3x, round(Y_centroid, 6) + 0.0 AS u3y, 0.0::DOUBLE AS u3z FROM cells",
    "cells",
)
def _(spark, sf):
    c = cells(spark, sf).select("id", "X_centroid", "Y_centroid", F.when(F.col("id") % 3 != 0, F.col("umap2_x")).alias("umap2_x"))
    return rounded(_flat(display.spatial_coordinates(c)))


@query(
    "first_coordinates",
    f"SELECT {_COORDS}, position // 64 AS chunk_id, position % 64 AS local_index, clustering AS label, {', '.join(f'cluster_L{i}' for i in range(6))} FROM (SELECT *, id AS position FROM cells) WHERE position < 100",
    "cells",
)
def _(spark, sf):
    c = cells(spark, sf)
    subset = c.select("id", F.col("id").alias("position"))
    shown = display.first_coordinates(c, subset, 64, 100)
    return rounded(_flat(shown.withColumn("label", F.col("cluster_L3"))))


@query(
    "slot_geometry",
    """SELECT o_orderkey AS position, o_orderkey // 50 AS chunk_id, o_orderkey % 50 AS local_index, (o_orderkey % 50 % 8) * 16 AS px, (o_orderkey % 50 // 8) * 16 AS py,
       round((o_orderkey % 50 % 8) / 8, 6) AS u0, round((o_orderkey % 50 // 8) / 7, 6) AS v0, round((o_orderkey % 50 % 8 + 1) / 8, 6) AS u1, round((o_orderkey % 50 // 8 + 1) / 7, 6) AS v1 FROM orders""",
)
def _(spark, sf):
    return rounded(display.slot_geometry(points(spark, sf).select(F.col("id").alias("position")), 50, 16))


@query(
    "display_addresses",
    """SELECT p_partkey AS id, coalesce(c.id // 64, -1) AS chunk_id, coalesce(c.id % 64, p_size) AS local_index FROM part LEFT JOIN cells c ON c.id = p_partkey""",
    "cells",
)
def _(spark, sf):
    p = raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit(-1).cast("bigint").alias("chunk_id"), F.col("p_size").cast("bigint").alias("local_index"))
    shown = cells(spark, sf).select("id", F.floor(F.col("id") / 64).alias("chunk_id"), (F.col("id") % 64).alias("local_index"))
    return display.display_address(p, shown)


@query(
    "dataset_meta",
    """SELECT count(DISTINCT channel) AS n_channels, max(id) + 1 AS n_cells, (SELECT count(*) FROM cells WHERE clustering < 5) AS n_display,
       ceil((SELECT count(*) FROM cells WHERE clustering < 5) / 64)::BIGINT AS n_chunks, 64 AS n_per_chunk, 8 AS grid_cols, 8 AS grid_rows FROM pixels""",
    "pixels cells",
)
def _(spark, sf):
    return dataset_meta(pixels(spark, sf), 64, cells(spark, sf).filter("clustering < 5"))


@query(
    "selected_pixel_counts",
    "SELECT channel, chunk_id, count(*) AS n, sum(value)::BIGINT AS total FROM pixels WHERE id IN (SELECT id FROM regions) GROUP BY ALL",
    "pixels regions",
)
def _(spark, sf):
    from tesselar.workload.tables import regions

    sel = intensity.selected_pixels(pixels(spark, sf), regions(spark, sf), 64)
    return sel.groupBy("channel", "chunk_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
