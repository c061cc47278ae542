"""Neighbours, groups and regions in embedding space."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselar.functions import scalars, vectors
from tesselar.operators import groups, histograms, neighbours, seriation
from tesselar.operators.pairwise import nearest
from tesselar.plans import similarity
from tesselar.scale import by_rows, materialise
from tesselar.workload.registry import query
from tesselar.workload.tables import cells, features, label_groups, regions, rounded


@query(
    "feature_shape",
    "SELECT count(*) AS n, min(len(e))::BIGINT AS min_dim, max(len(e))::BIGINT AS max_dim, 1 AS valid FROM feat",
    "feat",
)
def _(spark, sf):
    from tesselar.sources.cells import feature_shape

    return feature_shape(features(spark, sf))


@query(
    "features_sanitised",
    """SELECT id, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: CASE WHEN (i = 1 AND id % 7 = 0)
       OR (i = 2 AND id % 5 = 0) THEN 0 ELSE e[i] END)), 6) AS total FROM feat""",
    "feat",
)
def _(spark, sf):
    f = features(spark, sf)
    dirty = F.transform(
        "embedding",
        lambda x, i: F.when((i == 0) & (F.col("id") % 7 == 0), F.lit(float("nan")))
        .when((i == 1) & (F.col("id") % 5 == 0), F.lit(float("inf")))
        .otherwise(x.cast("double")),
    )
    clean = f.select("id", vectors.sanitise(dirty).alias("e"))
    return rounded(clean.select("id", F.aggregate("e", F.lit(0.0), lambda a, x: a + x).alias("total")))


_REP = "SELECT id, round(v[1], 6) + 0.0 AS first, round(v[len(v)], 6) + 0.0 AS last, round(list_dot_product(v, v), 6) AS norm2 FROM {}"


def _rep(spark, sf, metric):
    v = F.col("vec")
    return rounded(
        vectors.representation(features(spark, sf), metric).select(
            "id", v[0].alias("first"), F.element_at(v, -1).alias("last"), vectors.dot("vec", "vec").alias("norm2")
        )
    )


query("unit_vectors", _REP.format("units"), "units")(lambda spark, sf: _rep(spark, sf, "cosine"))
query("centred_vectors", _REP.format("centred"), "centred")(lambda spark, sf: _rep(spark, sf, "cosine_centered"))


@query("knn_cosine", "SELECT query, id, round(similarity, 6) + 0.0 AS similarity, rank FROM nn", "nn")
def _(spark, sf):
    f = features(spark, sf)
    return rounded(neighbours.neighbours_of(f, None, f, 8).select("query", "id", "similarity", "rank"))


@query("knn_cosine_blocks", "SELECT query, id, round(similarity, 6) + 0.0 AS similarity, rank FROM nn", "nn")
def _(spark, sf):
    """The form for query sets of any size: blocks, their bounds, and only the pairs of blocks that can matter."""
    units = vectors.representation(features(spark, sf))
    return rounded(nearest(units, units, 8, limit=0).select("query", "id", F.col("score").alias("similarity"), "rank"))


@query(
    "knn_cosine_centred",
    """SELECT query, id, round(similarity, 6) + 0.0 AS similarity, rank FROM (SELECT *, row_number() OVER
       (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM (SELECT q.id AS query, t.id AS id,
       round(greatest(-1, least(1, list_dot_product(q.v, t.v))), 9) AS similarity FROM centred q JOIN centred t ON q.id <> t.id))
       WHERE rank <= 8""",
    "centred",
)
def _(spark, sf):
    f = features(spark, sf)
    return rounded(neighbours.neighbours_of(f, None, f, 8, metric="cosine_centered").select("query", "id", "similarity", "rank"))


@query(
    "knn_projection",
    """SELECT query, n.id, round(greatest(-1, least(1, list_dot_product(a.v, b.v))), 6) + 0.0 AS similarity, rank FROM
       (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM (SELECT q.id AS query, t.id AS id,
       round(sqrt((q.umap2_x - t.umap2_x) * (q.umap2_x - t.umap2_x) + (q.umap2_y - t.umap2_y) * (q.umap2_y - t.umap2_y)), 9) AS d
       FROM cells q JOIN cells t ON q.id <> t.id)) n JOIN units a ON a.id = n.query JOIN units b ON b.id = n.id WHERE rank <= 8""",
    "cells units",
)
def _(spark, sf):
    f = features(spark, sf)
    return rounded(neighbours.neighbours_of(f, cells(spark, sf), f, 8, space="umap").select("query", "id", "similarity", "rank"))


@query(
    "knn_projection_missing",
    """SELECT query, n.id, round(greatest(-1, least(1, list_dot_product(a.v, b.v))), 6) + 0.0 AS similarity, rank FROM
       (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d NULLS LAST, id) AS rank FROM (SELECT q.id AS query, t.id AS id,
       CASE WHEN q.id % 5 = 0 OR t.id % 5 = 0 THEN NULL ELSE
       round(sqrt((q.umap2_x - t.umap2_x) * (q.umap2_x - t.umap2_x) + (q.umap2_y - t.umap2_y) * (q.umap2_y - t.umap2_y)), 9) END AS d
       FROM cells q JOIN cells t ON q.id <> t.id)) n JOIN units a ON a.id = n.query JOIN units b ON b.id = n.id WHERE rank <= 8""",
    "cells units",
)
def _(spark, sf):
    f = features(spark, sf)
    c = cells(spark, sf)
    gone = c.withColumn("umap2_x", F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("umap2_x")))
    return rounded(neighbours.neighbours_of(f, gone, f, 8, space="umap").select("query", "id", "similarity", "rank"))


@query(
    "knn_within_allow_list",
    """SELECT query, id, round(similarity, 6) + 0.0 AS similarity, rank FROM (SELECT *, row_number() OVER
       (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM (SELECT q.id AS query, t.id AS id,
       round(greatest(-1, least(1, list_dot_product(q.v, t.v))), 9) AS similarity FROM units q JOIN units t ON q.id <> t.id
       JOIN cells c ON c.id = t.id AND c.umap2_x > 0)) WHERE rank <= 8""",
    "units cells",
)
def _(spark, sf):
    f = features(spark, sf)
    allowed = cells(spark, sf).filter("umap2_x > 0").select("id")
    return rounded(neighbours.neighbours_of(f, None, f, 8, allowed=allowed).select("query", "id", "similarity", "rank"))


@query("local_structure", "SELECT query, round(compactness, 6) AS compactness, round(difference, 6) AS difference FROM local", "local")
def _(spark, sf):
    f = features(spark, sf)
    return rounded(neighbours.local_structure(neighbours.neighbours_of(f, None, f, 8), f))


_SINGLE_CELL = """WITH ref AS (SELECT l.* FROM {local} l JOIN (SELECT id FROM feat ORDER BY (id * 2654435761) % 4294967296, id LIMIT 200) s ON s.id = l.query),
pct AS (SELECT l.query, max(l.compactness) AS compactness, max(l.difference) AS difference,
  sum(CASE WHEN round(r.compactness, 9) <= round(l.compactness, 9) THEN 1 ELSE 0 END) / count(*) AS compactness_pct,
  sum(CASE WHEN round(r.difference, 9) <= round(l.difference, 9) THEN 1 ELSE 0 END) / count(*) AS difference_pct
  FROM {local} l, ref r GROUP BY l.query)
SELECT n.query, n.id, round(similarity, 6) + 0.0 AS similarity, rank, round(X_centroid, 6) AS raw_x,
       round(Y_centroid, 6) AS raw_y, round(umap2_x, 6) + 0.0 AS umap2_x, round(umap2_y, 6) + 0.0 AS umap2_y, clustering AS label,
       round(compactness, 6) AS compactness, round(difference, 6) AS difference, round(compactness_pct, 6) AS compactness_pct,
       round(difference_pct, 6) AS difference_pct FROM {near} n JOIN cells c ON c.id = n.id JOIN pct ON pct.query = n.query"""


@query("single_cell_analysis", _SINGLE_CELL.format(local="local", near="nn"), "feat local nn cells")
def _(spark, sf):
    f = features(spark, sf)
    return rounded(similarity.single_cell(f, cells(spark, sf), f, space="embedding"))


@query("single_cell_analysis_projection", _SINGLE_CELL.format(local="local_plane", near="nn_plane"), "feat local_plane nn_plane cells")
def _(spark, sf):
    """The default space: neighbours on the projection, percentiles among the projection neighbourhoods of the sample."""
    f = features(spark, sf)
    return rounded(similarity.single_cell(f, cells(spark, sf), f))


@query(
    "percentile_reference",
    """SELECT l.query, round(compactness, 6) AS compactness, round(difference, 6) AS difference FROM local l
       JOIN (SELECT id FROM feat ORDER BY (id * 2654435761) % 4294967296, id LIMIT 200) s ON s.id = l.query""",
    "feat local",
)
def _(spark, sf):
    return rounded(neighbours.percentile_reference(features(spark, sf), None, 8))


@query(
    "displayable_neighbours",
    """SELECT query, id, round(similarity, 6) + 0.0 AS similarity, shown FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, id)
       AS shown FROM nn WHERE id IN (SELECT id FROM cells WHERE clustering <> 3)) WHERE shown <= 4""",
    "nn cells",
)
def _(spark, sf):
    f = features(spark, sf)
    shown = cells(spark, sf).filter("clustering <> 3")
    return rounded(neighbours.displayable(neighbours.neighbours_of(f, None, f, 8), shown, 4).select("query", "id", "similarity", "shown"))


@query(
    "similarity_ranks",
    "SELECT query, query AS id, 0 AS position FROM (SELECT DISTINCT query FROM nn) UNION ALL SELECT query, id, rank FROM nn",
    "nn",
)
def _(spark, sf):
    f = features(spark, sf)
    return neighbours.similarity_ranks(materialise(neighbours.neighbours_of(f, None, f, 8), "near"))


@query(
    "coordinates_for_ids",
    """SELECT p.id, round(X_centroid, 6) AS raw_x, round(Y_centroid, 6) AS raw_y, round(umap2_x, 6) + 0.0 AS umap2_x,
       round(umap2_y, 6) + 0.0 AS umap2_y, clustering AS label FROM (SELECT p_partkey AS id FROM part) p LEFT JOIN cells c ON c.id = p.id""",
    "cells",
)
def _(spark, sf):
    from tesselar.workload.tables import annotations

    return rounded(neighbours.coordinates_for(annotations(spark, sf).select("id"), cells(spark, sf)))


@query(
    "feature_validation",
    """SELECT count(*) AS n, max(len(e))::BIGINT AS dim, round(min(sqrt(list_dot_product(e, e))), 6) AS norm_min,
       round(avg(sqrt(list_dot_product(e, e))), 6) AS norm_mean, round(max(sqrt(list_dot_product(e, e))), 6) AS norm_max,
       0 AS num_zero, 0 AS num_nan, (SELECT round(list_dot_product(v, v), 6) FROM units WHERE id = 0) AS self_similarity,
       (SELECT round(similarity, 6) FROM nn WHERE query = 0 AND rank = 1) AS top1_similarity,
       (SELECT string_agg(id::VARCHAR, ',' ORDER BY rank) FROM nn WHERE query = 0 AND rank <= 5) AS top_ids FROM feat""",
    "feat nn",
)
def _(spark, sf):
    return rounded(neighbours.validation_report(features(spark, sf), 0))


def _scores(spark, sf, metric="cosine_centered"):
    rep = vectors.representation(features(spark, sf), metric)
    m = groups.members(by_rows(rep), label_groups(spark, sf))
    c = groups.centroids(m)
    return rep, c, groups.member_scores(m, c)


@query(
    "group_members",
    'SELECT "group", id, round(distance, 6) AS distance, round(similarity, 6) + 0.0 AS similarity FROM gscore',
    "gscore",
)
def _(spark, sf):
    return rounded(_scores(spark, sf)[2].select("group", "id", "distance", "similarity"))


_BEST = 'SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(distance, 9), id) AS r FROM gscore'


@query(
    "group_summary",
    f"""SELECT g."group", size, round(compactness, 6) AS compactness, b.id AS representative, round(b.similarity, 6) AS representative_similarity,
        round(difference, 6) AS difference, round((SELECT avg(CASE WHEN round(1 - list_dot_product(v, c), 9) <= round(difference, 9) THEN 1 ELSE 0 END)
        FROM units, centre), 6) AS difference_percentile
        FROM (SELECT "group", count(*) AS size, avg(distance) AS compactness FROM gscore GROUP BY ALL) g
        JOIN ({_BEST}) b ON b."group" = g."group" AND b.r = 1
        JOIN (SELECT "group", 1 - list_dot_product(gcent.c, centre.c) AS difference FROM gcent, centre) d ON d."group" = g."group" """,
    "gscore gcent centre units",
)
def _(spark, sf):
    return rounded(similarity.GroupAnalysis(features(spark, sf), cells(spark, sf), label_groups(spark, sf)).summary())


@query(
    "group_exemplars",
    'SELECT "group", id, round(similarity, 6) + 0.0 AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(similarity, 9) DESC, id) AS place FROM gscore) WHERE place <= 6',
    "gscore",
)
def _(spark, sf):
    return rounded(groups.exemplars(_scores(spark, sf)[2]))


@query(
    "group_centroid_histogram",
    """SELECT "group", bin, round((bin + 0.5) / 60, 6) AS center, coalesce(n, 0) AS n FROM (SELECT "group", unnest(range(60)) AS bin FROM gcent)
       LEFT JOIN (SELECT "group", least(59, floor((round(greatest(-1, least(1, list_dot_product(v, c))), 9) + 1) * 0.5 * 60))::BIGINT AS bin, count(*) AS n
       FROM centred, gcent GROUP BY ALL) USING ("group", bin)""",
    "centred gcent",
)
def _(spark, sf):
    rep, c, _s = _scores(spark, sf)
    return rounded(groups.centroid_histogram(rep, c))


@query(
    "group_similarity_medians",
    """SELECT g."group", group_median, global_median FROM (SELECT "group", round(quantile_cont((round(similarity, 9) + 1) * 0.5, 0.5), 6) AS group_median FROM gscore GROUP BY ALL) g
       JOIN (SELECT "group", round(quantile_cont((round(greatest(-1, least(1, list_dot_product(v, c))), 9) + 1) * 0.5, 0.5), 6) AS global_median
       FROM centred, gcent GROUP BY ALL) a USING ("group")""",
    "gscore centred gcent",
)
def _(spark, sf):
    rep, c, s = _scores(spark, sf)
    return rounded(groups.similarity_medians(rep, s, c))


def _leading(power: str, steps: int) -> str:
    """SQL that squares the matrices ``power("group", i, j, g)`` until only the leading axis is left.

    The column of the largest diagonal entry is that axis, with a positive largest component.
    """
    scaled = 'g / sum(CASE WHEN i = j THEN g ELSE 0 END) OVER (PARTITION BY "group")'
    return f"""pw(k, "group", i, j, g) AS (SELECT 0, "group", i, j, {scaled} FROM {power} UNION ALL SELECT k + 1, "group", i, j, {scaled} FROM
      (SELECT a.k, a."group", a.i, b.j, sum(a.g * b.g) AS g FROM pw a JOIN pw b ON a."group" = b."group" AND a.j = b.i WHERE a.k < {steps} GROUP BY ALL)),
      pk AS (SELECT * FROM pw WHERE k = {steps}),
      pv AS (SELECT "group", arg_max(i, round(g, 9)) AS p FROM pk WHERE i = j GROUP BY ALL),
      ax AS (SELECT "group", pk.j AS i, g / sqrt(sum(g * g) OVER (PARTITION BY "group")) AS u FROM pk JOIN pv USING ("group") WHERE pk.i = p)"""


@query(
    "group_first_axis",
    """WITH RECURSIVE dx AS (SELECT "group", id, unnest(list_transform(range(1, len(v) + 1), lambda i: v[i] - c[i])) AS x, unnest(range(1, len(v) + 1)) AS i
       FROM grp JOIN centred USING (id) JOIN gcent USING ("group")),
       gm AS (SELECT a."group", a.i, b.i AS j, sum(a.x * b.x) AS g FROM dx a JOIN dx b ON a."group" = b."group" AND a.id = b.id GROUP BY ALL), """
    + _leading("gm", 14)
    + ' SELECT "group", id, round(sum(x * u), 6) + 0.0 AS proj1 FROM dx JOIN ax USING ("group", i) GROUP BY ALL',
    "grp centred gcent",
)
def _(spark, sf):
    return rounded(groups.first_axis_projection(_scores(spark, sf)[2]))


@query(
    "group_projection_centre",
    'SELECT clustering AS "group", round(avg(umap2_x), 6) + 0.0 AS center_x, round(avg(umap2_y), 6) + 0.0 AS center_y FROM cells GROUP BY ALL',
    "cells",
)
def _(spark, sf):
    return rounded(similarity.GroupAnalysis(features(spark, sf), cells(spark, sf), label_groups(spark, sf)).projection_centre())


@query(
    "global_centre_distances",
    "SELECT id, round(1 - greatest(-1, least(1, list_dot_product(v, c))), 6) AS value FROM units, centre",
    "units centre",
)
def _(spark, sf):
    return rounded(groups.centre_distances(features(spark, sf)))


@query(
    "centre_histogram",
    """SELECT bin, round((bin + 0.5) / 40, 6) AS center, coalesce(n, 0) AS n FROM (SELECT unnest(range(40)) AS bin) LEFT JOIN
       (SELECT least(39, floor(round((greatest(-1, least(1, list_dot_product(v, c))) + 1) * 0.5, 9) * 40))::BIGINT AS bin, count(*) AS n
       FROM centred, centre GROUP BY ALL) USING (bin)""",
    "centred centre",
)
def _(spark, sf):
    return rounded(similarity.GroupAnalysis(features(spark, sf), cells(spark, sf), label_groups(spark, sf)).centre_histogram())


@query(
    "region_representatives",
    """WITH g AS (SELECT region AS "group", id FROM regions), gm AS (SELECT "group", list(m ORDER BY i) AS m FROM (SELECT "group", i, avg(x) AS m FROM
       (SELECT "group", unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM g JOIN centred USING (id)) GROUP BY ALL) GROUP BY "group"),
       gc AS (SELECT "group", list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM gm),
       s AS (SELECT "group", id, list_distance(v, c) AS distance, list_dot_product(v, c) AS similarity FROM g JOIN centred USING (id) JOIN gc USING ("group")),
       b AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(distance, 9), id) AS r FROM s),
       a AS (SELECT "group", count(*) AS size, round(avg(distance), 6) AS compactness FROM s GROUP BY ALL)
       SELECT l."group", coalesce(size, 0) AS size, compactness, b.id AS representative, round(b.similarity, 6) AS representative_similarity
       FROM (SELECT DISTINCT label::BIGINT AS "group" FROM embeddings) l LEFT JOIN a USING ("group") LEFT JOIN b ON b."group" = l."group" AND r = 1""",
    "regions centred",
)
def _(spark, sf):
    rep = vectors.representation(features(spark, sf), "cosine_centered")
    reg = regions(spark, sf).select(F.col("region").alias("group"), "id")
    wanted = label_groups(spark, sf).select("group").distinct()
    return rounded(groups.region_representatives(rep, reg, wanted))


@query(
    "similarity01",
    "SELECT query, id, round(greatest(0, least(1, (similarity + 1) * 0.5)), 6) AS y FROM nn",
    "nn",
)
def _(spark, sf):
    f = features(spark, sf)
    near = neighbours.neighbours_of(f, None, f, 8)
    return rounded(near.select("query", "id", scalars.similarity01(F.col("similarity")).alias("y")))


_SERIATION = (
    """WITH RECURSIVE sm AS (SELECT a."group", a.id AS i, b.id AS j, greatest(0, least(1, list_dot_product(x.v, y.v))) AS s FROM grp a JOIN grp b ON a."group" = b."group"
       JOIN centred x ON x.id = a.id JOIN centred y ON y.id = b.id),
       dg AS (SELECT "group", i, sum(s) AS d FROM sm GROUP BY ALL), gc AS (SELECT "group", 2 * max(d) AS c, count(*) AS n FROM dg GROUP BY ALL),
       mx AS (SELECT "group", i, j, s + CASE WHEN i = j THEN c - d ELSE 0 END - c / n AS g FROM sm JOIN dg USING ("group", i) JOIN gc USING ("group")), """
    + _leading("mx", 20)
    + """, sg AS (SELECT "group", arg_min(u, i) AS s FROM ax GROUP BY ALL),
       ps AS (SELECT "group", i AS id, row_number() OVER (PARTITION BY "group" ORDER BY round(CASE WHEN s < 0 THEN -u ELSE u END, 9), i) - 1 AS position FROM ax JOIN sg USING ("group"))"""
)


@query("group_seriation", _SERIATION + ' SELECT "group", id, position FROM ps', "grp centred")
def _(spark, sf):
    rep = vectors.representation(features(spark, sf), "cosine_centered")
    return seriation.seriation(groups.members(by_rows(rep), label_groups(spark, sf))).select("group", "id", "position")


@query(
    "similarity_field",
    _SERIATION
    + """, s AS (SELECT "group", position / greatest(1, max(position) OVER (PARTITION BY "group")) AS x, greatest(0, least(1, (similarity + 1) / 2)) AS y FROM ps JOIN gscore USING ("group", id)),
    f AS (SELECT "group", gy, gx, sum(exp(-((gx / 159.0::DOUBLE - x) * (gx / 159.0::DOUBLE - x) + (gy / 99.0::DOUBLE - (1 - y)) * (gy / 99.0::DOUBLE - (1 - y))) / (2 * 0.055::DOUBLE * 0.055::DOUBLE))) AS v
    FROM s, (SELECT unnest(range(160)) AS gx), (SELECT unnest(range(100)) AS gy) WHERE abs(gx - floor(x * 159 + 0.5)) <= 27 AND abs(gy - floor((1 - y) * 99 + 0.5)) <= 27 GROUP BY ALL)
    SELECT "group", gy, gx, round(v / max(v) OVER (PARTITION BY "group"), 6) AS v FROM f""",
    "grp centred gscore",
)
def _(spark, sf):
    rep, _c, scores = _scores(spark, sf)
    order = seriation.seriation(groups.members(by_rows(rep), label_groups(spark, sf)))
    return rounded(histograms.density_field(seriation.similarity_field(scores, order)))
