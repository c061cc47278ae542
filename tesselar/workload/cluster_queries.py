"""Hierarchy, profiles and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselar import schemas
from tesselar.functions import scalars
from tesselar.operators import clusters, kmeans
from tesselar.plans import profiles
from tesselar.scale import materialise
from tesselar.workload.registry import query
from tesselar.workload.tables import CHANNELS, annotations, cells, channels, pixels, rounded

DIMS = ["umap2_x", "umap2_y"]


def _levels(spark, sf):
    return clusters.unpivot_levels(cells(spark, sf), ["id", *schemas.COORDINATES])


@query("cluster_channel_means", "SELECT level, cluster, channel, round(avg, 6) AS avg FROM means", "means")
def _(spark, sf):
    return rounded(clusters.cluster_channel_means(pixels(spark, sf), cells(spark, sf)))


@query(
    "cluster_channel_means_single_level",
    "SELECT 0 AS level, clustering AS cluster, channel, round(avg(value), 6) AS avg FROM cells JOIN pixels USING (id) GROUP BY ALL",
    "cells pixels",
)
def _(spark, sf):
    return rounded(clusters.cluster_channel_means(pixels(spark, sf), cells(spark, sf).select("id", "clustering")))


@query(
    "cluster_averages_wide",
    "SELECT level AS level_id, cluster AS cluster_id, "
    + ", ".join(f"round(max(CASE WHEN channel = {c} THEN avg END), 6) AS ch_{c}" for c in CHANNELS)
    + " FROM means GROUP BY ALL",
    "means",
)
def _(spark, sf):
    m = clusters.cluster_channel_means(pixels(spark, sf), cells(spark, sf))
    return rounded(clusters.wide_averages(m, {c: f"ch_{c}" for c in CHANNELS}))


@query(
    "cluster_context",
    "SELECT level, cluster, count(*) AS n, round(avg(umap2_x), 6) + 0.0 AS center_x, round(avg(umap2_y), 6) + 0.0 AS center_y, "
    "round(count(*) / (SELECT count(*) FROM cells) * 100.0, 6) AS percent FROM levels GROUP BY ALL",
    "levels cells",
)
def _(spark, sf):
    return rounded(clusters.cluster_context(_levels(spark, sf), cells(spark, sf)))


@query("cluster_parents", "SELECT level, cluster, parent_level, parent_cluster FROM parents", "parents")
def _(spark, sf):
    return clusters.cluster_parents(cells(spark, sf))


@query(
    "cluster_ranks",
    "SELECT id, level, cluster, round(distance, 6) AS distance, rank FROM lranks",
    "lranks",
)
def _(spark, sf):
    return rounded(clusters.ranks_within_clusters(_levels(spark, sf), DIMS).select("id", "level", "cluster", "distance", "rank"))


_CHILDREN = (
    "(SELECT parent_level AS level, parent_cluster AS cluster, string_agg(cluster::VARCHAR, ',' ORDER BY cluster) AS ch "
    "FROM parents WHERE parent_cluster >= 0 GROUP BY ALL)"
)


@query(
    "hierarchy_given_labels",
    f"""SELECT s.level, s.cluster AS cluster_id, size, r.id AS rep_index, parent_level, parent_cluster AS parent_cluster_id,
        coalesce(ch, '') AS children_cluster_ids, {', '.join(f'round({c}, 6) + 0.0 AS rep_{c}' for c in schemas.COORDINATES)}
        FROM (SELECT level, cluster, count(*) AS size FROM levels GROUP BY ALL) s
        JOIN lranks r ON r.level = s.level AND r.cluster = s.cluster AND r.rank = 0
        LEFT JOIN parents p ON p.level = s.level AND p.cluster = s.cluster
        LEFT JOIN {_CHILDREN} c ON c.level = s.level AND c.cluster = s.cluster""",
    "levels lranks parents",
)
def _(spark, sf):
    _cells, summary = profiles.hierarchy(cells(spark, sf), fit=False)
    return rounded(clusters.hierarchy_export(summary))


@query(
    "cells_with_ranks",
    "SELECT id, " + ", ".join(f"max(CASE WHEN level = {i} THEN rank END) AS rank_L{i}" for i in range(6)) + " FROM lranks GROUP BY id",
    "lranks",
)
def _(spark, sf):
    labelled, _summary = profiles.hierarchy(cells(spark, sf), fit=False)
    return labelled.select("id", *[f"rank_L{i}" for i in range(6)])


@query("multilevel_kmeans")
def _(spark, sf):
    labelled = kmeans.multilevel_kmeans(cells(spark, sf))
    levels = clusters.unpivot_levels(labelled, ["id"])
    return levels.groupBy("level", "cluster").agg(F.count("*").alias("size"))


@query(
    "multilevel_kmeans_checks",
    """SELECT l.level, CASE l.level WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 10 WHEN 4 THEN 15 ELSE 20 END AS clusters,
       (SELECT count(*) FROM cells) AS cells, 0 AS misplaced, 0 AS costlier FROM range(6) l(level)""",
    "cells",
)
def _(spark, sf):
    """Per level: clusters, cells, cells clearly nearer to another cluster's mean, and whether it costs more than the level above."""
    dims = kmeans.SPACES["umap2"]
    labelled = materialise(kmeans.multilevel_kmeans(cells(spark, sf)), "labelled")
    levels = clusters.unpivot_levels(labelled, ["id", *dims])
    means = levels.groupBy("level", "cluster").agg(*[F.avg(d).alias(f"m{i}") for i, d in enumerate(dims)])
    every = means.groupBy("level").agg(F.collect_list(F.struct("cluster", *[f"m{i}" for i in range(len(dims))])).alias("means"))
    away = lambda m: sum(((F.col(d) - m[f"m{i}"]) * (F.col(d) - m[f"m{i}"]) for i, d in enumerate(dims)), F.lit(0.0))
    own = F.filter("means", lambda m: m["cluster"] == F.col("cluster"))[0]
    seen = levels.join(every, "level").select(
        "level", "cluster", F.sqrt(away(own)).alias("own"), F.sqrt(F.array_min(F.transform("means", away))).alias("near"),
    )
    per_level = seen.groupBy("level").agg(
        F.count_distinct("cluster").alias("clusters"), F.count("*").alias("cells"),
        F.sum((F.col("own") > F.col("near") * 1.01 + 1e-3).cast("bigint")).alias("misplaced"), F.sum(F.col("own") * F.col("own")).alias("cost"),
    )
    above = F.lag("cost").over(Window.orderBy("level"))
    return per_level.select("level", "clusters", "cells", "misplaced", F.coalesce((F.col("cost") > above).cast("int"), F.lit(0)).alias("costlier"))


@query("requested_levels", "SELECT level, cluster, channel, round(avg, 6) AS avg, round(z, 6) + 0.0 AS z FROM zscores WHERE level IN (1, 4)", "zscores")
def _(spark, sf):
    some = profiles.cluster_profile(pixels(spark, sf), cells(spark, sf), channels(spark), only_levels=[1, 4, 9])
    return rounded(some.select("level", "cluster", "channel", "avg", "z"))


@query(
    "cluster_previews",
    "SELECT level, cluster, id, rank FROM lranks WHERE rank = 0 AND level < 5",
    "lranks",
)
def _(spark, sf):
    return clusters.preview_points(clusters.ranks_within_clusters(_levels(spark, sf), DIMS))


def _profile(spark, sf):
    return profiles.cluster_profile(pixels(spark, sf), cells(spark, sf), channels(spark))


@query("marker_scores", "SELECT level, cluster, channel, round(avg, 6) AS avg, round(z, 6) + 0.0 AS z FROM zscores", "zscores")
def _(spark, sf):
    return rounded(_profile(spark, sf).select("level", "cluster", "channel", "avg", "z"))


_MARKERS = """SELECT *, (place <= 3)::INT AS is_high, (place > n - 3)::INT AS is_low FROM (SELECT *, row_number() OVER (PARTITION BY level, cluster
  ORDER BY round(z, 9) DESC NULLS LAST, channel) AS place, count(*) OVER (PARTITION BY level, cluster) AS n FROM zscores)"""


@query(
    "markers",
    f"SELECT level, cluster, channel, round(avg, 6) AS avg, round(z, 6) + 0.0 AS z, place, is_high, is_low, "
    f"CASE WHEN z IS NULL THEN 'ch_' || channel || ':nanσ' ELSE 'ch_' || channel || ':' || printf('%.2f', z) || 'σ' END AS text FROM ({_MARKERS})",
    "zscores",
)
def _(spark, sf):
    return rounded(clusters.markers(_profile(spark, sf), 3))


@query(
    "cluster_prompts",
    f"""WITH m AS ({_MARKERS.replace('- 3', '- 6').replace('<= 3', '<= 6')}),
        t AS (SELECT *, 'ch_' || channel || ':' || CASE WHEN z IS NULL THEN 'nan' ELSE printf('%.2f', z) END || 'σ' AS text FROM m),
        b AS (SELECT level, cluster, string_agg(CASE WHEN is_high = 1 THEN text END, ', ' ORDER BY place) AS top,
          string_agg(CASE WHEN is_low = 1 THEN text END, ', ' ORDER BY place) AS low, string_agg('ch_' || channel, ', ' ORDER BY channel) AS chs,
          string_agg('ch_' || channel || '=' || printf('%.4f', avg), '; ' ORDER BY channel) AS avgs FROM t GROUP BY ALL),
        c AS (SELECT level, cluster, count(*) AS n, avg(umap2_x) AS x, avg(umap2_y) AS y, count(*) / (SELECT count(*) FROM cells) * 100.0 AS p FROM levels GROUP BY ALL)
        SELECT b.level, b.cluster, 'Cluster ' || b.cluster || ' at level ' || b.level || chr(10) || 'High markers: ' || top || chr(10) || 'Low markers: ' || low
        || chr(10) || 'Channels: ' || chs || chr(10) || 'Mean intensities: ' || avgs || chr(10) || 'Return strict JSON with the keys title and description.'
        || chr(10) || 'Additional context:' || chr(10) || '- number of cells: ' || n || chr(10) || '- percentage: ' || printf('%.2f', p) || '%' || chr(10)
        || '- UMAP centroid: (' || printf('%.2f', x) || ', ' || printf('%.2f', y) || ')' AS prompt FROM b JOIN c USING (level, cluster)""",
    "zscores levels cells",
)
def _(spark, sf):
    ctx = clusters.cluster_context(_levels(spark, sf), cells(spark, sf))
    return profiles.cluster_prompts(_profile(spark, sf), ctx)


def _dominant_sql(where: str = "") -> str:
    return f"""SELECT level, cluster, kind, value, n FROM (SELECT *, row_number() OVER (PARTITION BY level, cluster, kind ORDER BY n DESC, f) AS r FROM
      (SELECT level, cluster, kind, value, count(*) AS n, min(id) AS f FROM (SELECT level, cluster, l.id, 'celltype' AS kind, celltype AS value FROM levels l
      JOIN annotations a USING (id) {where} UNION ALL SELECT level, cluster, l.id, 'neigh_names', neigh_names FROM levels l JOIN annotations a USING (id) {where})
      GROUP BY ALL)) WHERE r = 1"""


@query("dominant_annotations", _dominant_sql(), "levels annotations")
def _(spark, sf):
    return clusters.dominant_annotation(cells(spark, sf), annotations(spark, sf), ["celltype", "neigh_names"])


@query("dominant_annotations_filtered", _dominant_sql("WHERE p_size > 25"), "levels annotations")
def _(spark, sf):
    ann = annotations(spark, sf)
    return clusters.dominant_annotation(cells(spark, sf), ann, ["celltype", "neigh_names"], ann.filter("p_size > 25").select("id"))


@query(
    "channel_count_check",
    "SELECT channel AS zarr_c, 'unnamed' AS problem FROM (SELECT DISTINCT channel FROM pixels) WHERE channel NOT IN (SELECT c_nationkey FROM customer) "
    "UNION ALL SELECT DISTINCT c_nationkey::BIGINT, 'no tiles' FROM customer WHERE c_nationkey NOT IN (SELECT channel FROM pixels)",
    "pixels",
)
def _(spark, sf):
    from tesselar.sources.channels import check_channel_count
    from tesselar.workload.tables import raw

    info = raw(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("zarr_c"))
    return check_channel_count(pixels(spark, sf), info)


@query(
    "semantic_levels",
    """SELECT id, CASE WHEN z < 6 THEN 1 WHEN z < 7 THEN 2 WHEN z < 8 THEN 3 WHEN z < 9 THEN 4 WHEN z < 10 THEN 5 ELSE 6 END AS level,
       CASE WHEN z < 6 THEN 5000 WHEN z < 7 THEN 20000 WHEN z < 8 THEN 35000 WHEN z < 9 THEN 50000 WHEN z < 10 THEN 65000 ELSE 80000 END AS budget,
       round(CASE WHEN floor(z * 4 + 0.5) / 4 < 8 THEN greatest(0.02, pow(2, floor(z * 4 + 0.5) / 4 - 8)) ELSE 1 END, 6) AS lod
       FROM (SELECT id, score / 40000 AS z FROM points)""",
    "points",
)
def _(spark, sf):
    from tesselar.workload.tables import points

    z = F.col("z")
    return rounded(
        points(spark, sf).select("id", (F.col("score") / 40000).alias("z")).select(
            "id", scalars.semantic_level(z).alias("level"), scalars.point_budget(scalars.semantic_level(z)).alias("budget"),
            scalars.level_of_detail(z, 8.0).alias("lod"),
        )
    )
