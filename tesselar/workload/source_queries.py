"""Readers and writers exercised through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesselar import schemas
from tesselar.functions import scalars
from tesselar.operators import clusters, intensity
from tesselar.plans import profiles
from tesselar.scale import shared_dir
from tesselar.sources import annotations as ann_source
from tesselar.sources import cells as cell_source
from tesselar.sources import channels as channel_source
from tesselar.sources import documents
from tesselar.workload.registry import query
from tesselar.workload.tables import CHANNELS, annotations, cells, pixels, raw, rounded


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query(
    "cells_csv_scan",
    "SELECT id, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in schemas.COORDINATES) + ", clustering FROM cells",
    "cells",
)
def _(spark, sf):
    path = _folder(spark, "cells-csv")
    documents.write_csv(cells(spark, sf).withColumnRenamed("X_centroid", "x_centroid"), path)
    c = cell_source.scan_cells(spark, path)
    return rounded(c.select("id", *schemas.COORDINATES, scalars.safe_int(F.col("clustering")).alias("clustering")))


@query(
    "cells_csv_scan_numbered",
    "SELECT row_number() OVER (ORDER BY id) - 1 AS id, id AS cellid FROM cells",
    "cells",
)
def _(spark, sf):
    path = _folder(spark, "cells-csv")
    ordered = cells(spark, sf).select(F.col("id").alias("cellid"), "clustering").orderBy("cellid")
    documents.write_csv(ordered, path)
    return cell_source.scan_cells(spark, path).select("id", F.col("cellid").cast("bigint").alias("cellid"))


@query(
    "tile_stack_scan",
    "SELECT channel, chunk_id, count(*) AS n, sum(value)::BIGINT AS total FROM pixels WHERE channel IN (1, 3) AND chunk_id IN (0, 2, 5) GROUP BY ALL",
    "pixels",
)
def _(spark, sf):
    path = _folder(spark, "tiles")
    cell_source.write_tiles(pixels(spark, sf), path, 64)
    t = cell_source.scan_tiles(spark, path, 8, channels=[1, 3], chunks=[0, 2, 5])
    return t.groupBy(F.col("channel").cast("bigint").alias("channel"), F.col("chunk_id").cast("bigint").alias("chunk_id")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )


def _tiles(spark, sf):
    path = _folder(spark, "tiles")
    cell_source.write_tiles(pixels(spark, sf), path, 64)
    return cell_source.packed_tiles(spark, path)


@query("packed_tile_signal", "SELECT channel, id, round(avg(value) / 65535, 6) AS mean01 FROM pixels GROUP BY ALL", "pixels")
def _(spark, sf):
    return rounded(intensity.packed_signal(_tiles(spark, sf)))


@query("packed_cell_p95", "SELECT channel, id, round(quantile_cont(value, 0.95), 6) AS value FROM pixels GROUP BY ALL", "pixels")
def _(spark, sf):
    return rounded(intensity.packed_percentile(_tiles(spark, sf)))


def _channel_rows(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    ident = F.floor(k / 2).cast("bigint").cast("string")
    return raw(spark, sf, "part").select(
        F.when(k % 11 == 0, "NA").when(k % 5 == 0, F.concat(ident, F.lit(".0"))).otherwise(ident).alias("Channel_ID"),
        F.when(size % 9 == 0, " ").when(size % 10 == 1, "NaN").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("marker"),
        F.when(size % 4 == 0, "-").when(size % 4 == 1, "NA").when(size % 4 == 2, size.cast("string")).otherwise("-3").alias("zarr_index"),
        k.alias("line"),
    )


_ENTRIES = """r AS (SELECT p_partkey AS line, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey // 2 END AS id,
  CASE WHEN p_size % 9 = 0 OR p_size % 10 = 1 THEN NULL ELSE trim(p_name) END AS name, CASE WHEN p_size % 4 = 2 THEN p_size END AS z FROM part),
l AS (SELECT id, name, z FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line DESC) AS k FROM r WHERE id IS NOT NULL AND name IS NOT NULL) WHERE k = 1),
e AS (SELECT s.id, coalesce(name, 'ch_' || s.id) AS name, z AS tile_index FROM (SELECT unnest(range((SELECT max(id) + 1 FROM l))) AS id) s LEFT JOIN l USING (id))"""


@query("channel_list_entries", f"WITH {_ENTRIES} SELECT id, name, tile_index::BIGINT AS tile_index, 1 AS has_index FROM e")
def _(spark, sf):
    e = channel_source.channel_entries(_channel_rows(spark, sf), "line")
    return e.withColumn("has_index", F.col("has_index").cast("int"))


@query("channel_info", f"WITH {_ENTRIES} SELECT id, name, id AS ome_c, tile_index::BIGINT AS zarr_c FROM e")
def _(spark, sf):
    return channel_source.channel_info(channel_source.channel_entries(_channel_rows(spark, sf), "line"))


@query(
    "channel_list_without_ids",
    "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, trim(p_name) AS name, row_number() OVER (ORDER BY p_partkey) - 1 AS ome_c, "
    "row_number() OVER (ORDER BY p_partkey) - 1 AS zarr_c FROM part WHERE p_size % 9 <> 0 AND p_size % 10 <> 1",
)
def _(spark, sf):
    rows = _channel_rows(spark, sf).select("marker", "line")
    return channel_source.channel_info(channel_source.channel_entries(rows, "line"))


@query("available_channels", f"WITH {_ENTRIES} SELECT id, name, tile_index::BIGINT AS zarr_c FROM e WHERE tile_index >= 0")
def _(spark, sf):
    info = channel_source.channel_info(channel_source.channel_entries(_channel_rows(spark, sf), "line"))
    return channel_source.available_channels(info).select("id", "name", "zarr_c")


@query("selected_channels", f"WITH {_ENTRIES} SELECT id, name FROM e WHERE id IN (3, 5, 8)")
def _(spark, sf):
    info = channel_source.channel_info(channel_source.channel_entries(_channel_rows(spark, sf), "line"))
    return channel_source.select_channels(info, [5, 3, 3, 8, -4, 10_000_000]).select("id", "name")


@query(
    "channel_to_tile_map",
    f"WITH {_ENTRIES} SELECT l_orderkey % 40 AS channel, tile_index::BIGINT AS tile, count(*) AS n FROM lineitem JOIN e ON e.id = l_orderkey % 40 WHERE tile_index >= 0 GROUP BY ALL",
)
def _(spark, sf):
    info = channel_source.channel_info(channel_source.channel_entries(_channel_rows(spark, sf), "line"))
    ids = raw(spark, sf, "lineitem").select((F.col("l_orderkey") % 40).alias("channel"))
    return channel_source.map_channels(ids, info).groupBy("channel", "tile").agg(F.count("*").alias("n"))


@query(
    "tile_to_channel_map",
    f"WITH {_ENTRIES} SELECT p_size::BIGINT AS channel, coalesce((SELECT min(id) FROM e WHERE tile_index = p_size), p_size)::BIGINT AS logical, count(*) AS n FROM part GROUP BY ALL",
)
def _(spark, sf):
    info = channel_source.channel_info(channel_source.channel_entries(_channel_rows(spark, sf), "line"))
    ids = raw(spark, sf, "part").select(F.col("p_size").cast("bigint").alias("channel"))
    return channel_source.map_channels(ids, info, to_tiles=False).groupBy("channel", "logical").agg(F.count("*").alias("n"))


@query(
    "hierarchy_csv",
    "SELECT level::BIGINT AS level, cluster AS cluster_id, count(*) AS size FROM levels GROUP BY ALL",
    "levels",
)
def _(spark, sf):
    _cells, summary = profiles.hierarchy(cells(spark, sf), fit=False)
    path = _folder(spark, "hierarchy")
    documents.write_csv(clusters.hierarchy_export(summary), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(*[F.col(c).cast("bigint").alias(c) for c in ("level", "cluster_id", "size")])


@query(
    "cluster_averages_csv",
    "SELECT level::BIGINT AS level_id, cluster AS cluster_id, " + ", ".join(f"round(max(CASE WHEN channel = {c} THEN avg END), 6) AS ch_{c}" for c in CHANNELS) + " FROM means GROUP BY ALL",
    "means",
)
def _(spark, sf):
    path = _folder(spark, "averages")
    m = clusters.cluster_channel_means(pixels(spark, sf), cells(spark, sf))
    documents.write_csv(clusters.wide_averages(m, {c: f"ch_{c}" for c in CHANNELS}), path)
    back = documents.read_cluster_averages(spark, path)
    return rounded(back.withColumns({c: F.col(c).cast("bigint") for c in ("level_id", "cluster_id")}))


@query(
    "coordinates_json",
    "SELECT id, round(X_centroid, 6) + 0.0 AS x, round(umap2_y, 6) + 0.0 AS uy FROM cells",
    "cells",
)
def _(spark, sf):
    from tesselar.plans import display

    path = _folder(spark, "coords")
    c = display.spatial_coordinates(cells(spark, sf))
    c.write.json(path)
    return rounded(spark.read.schema(c.schema).json(path).select("id", F.col("raw.x").alias("x"), F.col("umap2d.y").alias("uy")))


_SLOTS = "['255,0,0', '0,255,0', '0,128,255', '255,255,0', '255,0,255', '0,255,255', '255,128,0', '128,0,255', '0,255,128', '255,0,128']"


@query(
    "picked_colours",
    f"""WITH t AS (SELECT c_custkey AS channel, {_SLOTS}[(c_custkey % 6) + 1] AS colour FROM customer WHERE c_custkey % 10 < 6),
        u AS (SELECT colour, min(channel) AS lo, max(channel) AS hi FROM t GROUP BY colour),
        s AS (SELECT channel, slot, {_SLOTS}[slot + 1] AS colour FROM (SELECT DISTINCT o_custkey AS channel FROM orders), (SELECT unnest(range(10)) AS slot)),
        f AS (SELECT channel, s.colour, row_number() OVER (PARTITION BY channel ORDER BY (slot <> channel % 10)::INT, slot) AS r FROM s LEFT JOIN u USING (colour)
          WHERE lo IS NULL OR (lo = channel AND hi = channel)) SELECT channel, colour FROM f WHERE r = 1""",
)
def _(spark, sf):
    from tesselar.functions.scalars import CHANNEL_PALETTE, palette_color

    wanted = raw(spark, sf, "orders").select(F.col("o_custkey").alias("channel")).distinct()
    c = F.col("c_custkey")
    taken = raw(spark, sf, "customer").filter(c % 10 < 6).select(c.alias("channel"), palette_color(c % 6, CHANNEL_PALETTE).alias("colour"))
    return channel_source.pick_colours(wanted, taken)


@query(
    "channels_from_cells",
    """SELECT id, name, id + 9 AS column_index, (SELECT count(*) FROM cells) AS cells FROM (VALUES (0, 'cluster_L0'), (1, 'cluster_L1'),
       (2, 'cluster_L2'), (3, 'cluster_L3'), (4, 'cluster_L4'), (5, 'cluster_L5')) t(id, name)""",
    "cells",
)
def _(spark, sf):
    path = _folder(spark, "cells-csv")
    documents.write_csv(cells(spark, sf), path)
    back = spark.read.option("header", True).csv(path)
    return channel_source.load_channels(spark, cells=back).withColumn("cells", back.agg(F.count("*")).scalar())


@query(
    "channels_by_precedence",
    "SELECT p_partkey AS id, 'ch ' || p_brand AS name, p_partkey AS ome_c, p_partkey AS zarr_c FROM part",
)
def _(spark, sf):
    # A list file goes before the columns of the cell table.
    path = _folder(spark, "channel-list")
    p = raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("ch "), "p_brand").alias("name"), F.col("p_partkey").alias("tile_index"))
    documents.write_csv(p, path)
    return channel_source.load_channels(spark, path, cells(spark, sf))


@query(
    "annotation_csv_scan",
    "SELECT id, celltype, neigh_names, p_size::BIGINT AS p_size, round(p_retailprice * 100)::BIGINT AS cents FROM annotations",
    "annotations",
)
def _(spark, sf):
    path = _folder(spark, "annotations")
    documents.write_csv(annotations(spark, sf), path)
    r = ann_source.annotation_rows(ann_source.scan_annotations(spark, path))
    field = lambda name: F.element_at("raw", name)
    return r.select("id", field("celltype").alias("celltype"), field("neigh_names").alias("neigh_names"), field("p_size").cast("bigint").alias("p_size"), F.round(field("p_retailprice").cast("double") * 100).cast("bigint").alias("cents"))


@query(
    "review_store_saved",
    """SELECT level, cluster_id, model, arg_max(status, reviewed_at) AS status, count(*) AS versions FROM
       (SELECT c_nationkey::VARCHAR AS level, c_mktsegment AS cluster_id, 'm' || c_custkey % 3 AS model, CASE WHEN c_custkey % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS status, c_custkey AS reviewed_at FROM customer) GROUP BY ALL""",
)
def _(spark, sf):
    c = F.col("c_custkey")
    rows = raw(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("level"), F.col("c_mktsegment").alias("cluster_id"), F.concat(F.lit("m"), (c % 3).cast("string")).alias("model"),
        F.when(c % 2 == 0, "accepted").otherwise("rejected").alias("status"), F.lit("t").alias("llm_title"), F.lit("u").alias("user_title"),
        F.lit(0.5).alias("llm_accuracy"), F.lit(1.0).alias("confidence"), F.timestamp_seconds(c).alias("reviewed_at"),
    )
    path = _folder(spark, "reviews")
    documents.review_document(rows, F.lit("2025-01-02 03:04:05").cast("timestamp")).write.json(path)
    back = documents.review_documents(spark.read.schema("doc string").json(path))
    versions = rows.groupBy("level", "cluster_id", "model").agg(F.count("*").alias("versions"))
    return back.select("level", "cluster_id", "model", "status").join(versions, ["level", "cluster_id", "model"])
