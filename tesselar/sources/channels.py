"""Channel catalogue: header aliases, cleaning, gap filling, tile-stack indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar import schemas
from tesselar.functions import scalars
from tesselar.scale import ranked


def channel_entries(rows: DataFrame, order_col: str) -> DataFrame:
    """``(id, name, tile_index, has_index)`` from the raw rows of a channel list.

    With an id column: blank names and bad ids are dropped, the last row of an id wins and gaps up
    to the largest id become ``ch_<i>``.  Without one, named rows are numbered in file order.
    """
    columns = [c for c in rows.columns if c != order_col]
    name_col = schemas.first_header(columns, schemas.NAME_HEADERS) or columns[-1]
    id_col = schemas.first_header(columns, schemas.ID_HEADERS)
    index_col = schemas.first_header(columns, schemas.TILE_INDEX_HEADERS)
    has_index = index_col is not None
    name = F.trim(F.col(name_col).cast("string"))
    index = scalars.tile_index(F.col(index_col)) if has_index else F.lit(None).cast("bigint")
    named = rows.select(
        F.col(order_col).alias("_order"),
        (scalars.safe_int(F.col(id_col)) if id_col else F.lit(0).cast("bigint")).alias("id"),
        F.when(F.lower(name) != "nan", name).alias("name"),
        index.alias("tile_index"),
    ).filter("id is not null and coalesce(name, '') <> ''")
    if id_col is None:
        out = ranked(named.drop("id"), [], ["_order"], "id").drop("_order")
    else:
        last = (
            named.filter("id >= 0")
            .groupBy("id")
            .agg(F.max_by(F.struct("name", "tile_index"), "_order").alias("e"))
            .select("id", "e.name", "e.tile_index")
        )
        top = last.agg(F.max("id")).first()[0]
        slots = rows.sparkSession.range(0 if top is None else top + 1)
        out = slots.join(last, "id", "left").withColumn(
            "name", F.coalesce("name", F.concat(F.lit("ch_"), F.col("id").cast("string")))
        )
    return out.select("id", "name", "tile_index", F.lit(has_index).alias("has_index"))


def channel_info(entries: DataFrame) -> DataFrame:
    """``(id, name, ome_c, zarr_c)``: explicit tile index, or the id when the list has no such column."""
    index = F.when(F.col("has_index"), F.when(F.col("tile_index") >= 0, F.col("tile_index"))).otherwise(F.col("id"))
    return entries.select(
        "id",
        F.when(F.trim("name") != "", F.trim("name"))
        .otherwise(F.concat(F.lit("ch_"), F.col("id").cast("string")))
        .alias("name"),
        F.col("id").alias("ome_c"),
        index.alias("zarr_c"),
    )


def channels_from_cells(cells: DataFrame) -> DataFrame:
    """Channels named by the cell-table columns after the ninth."""
    names = cells.columns[schemas.LEADING_CELL_COLUMNS:]
    rows = [(i, n, i + schemas.LEADING_CELL_COLUMNS) for i, n in enumerate(names)]
    return cells.sparkSession.createDataFrame(rows, "id bigint, name string, column_index bigint")


def load_channels(spark: SparkSession, list_path: str | None = None, cells: DataFrame | None = None) -> DataFrame | None:
    """Channel list file first, cell-table columns second, None when neither is given."""
    if list_path is not None:
        raw = spark.read.option("header", True).csv(list_path).withColumn("_line", F.monotonically_increasing_id())
        return channel_info(channel_entries(raw, "_line"))
    if cells is not None:
        return channels_from_cells(cells)
    return None


def available_channels(info: DataFrame) -> DataFrame:
    """Channels that have tiles, ordered by their tile index."""
    return info.filter("zarr_c is not null and zarr_c >= 0").orderBy("zarr_c")


def select_channels(info: DataFrame, wanted: list[int] | None) -> DataFrame:
    """Channels in ``wanted`` (duplicates and unknown ids ignored); an empty list means all."""
    return info.filter(F.col("id").isin(sorted(set(wanted)))) if wanted else info


def map_channels(ids: DataFrame, info: DataFrame, to_tiles: bool = True) -> DataFrame:
    """Logical channel ↔ tile-stack index; unmapped logical ids drop, unmapped indices stay themselves."""
    pairs = info.filter("zarr_c is not null and zarr_c >= 0").select(
        F.col("id").alias("logical"), F.col("zarr_c").alias("tile")
    )
    if to_tiles:
        return ids.join(pairs, ids["channel"] == pairs["logical"]).select(ids["*"], "tile")
    first = pairs.groupBy("tile").agg(F.min("logical").alias("logical"))
    return ids.join(first, ids["channel"] == first["tile"], "left").select(
        ids["*"], F.coalesce("logical", ids["channel"]).alias("logical")
    )


def check_channel_count(averages: DataFrame, info: DataFrame) -> DataFrame:
    """Tile channels without a name and named channels without tiles; an empty result means complete."""
    tiles = averages.select(F.col("channel").cast("bigint").alias("zarr_c")).distinct()
    named = info.filter("zarr_c is not null").select("zarr_c").distinct()
    return (
        tiles.join(named, "zarr_c", "left_anti").withColumn("problem", F.lit("unnamed"))
        .unionByName(named.join(tiles, "zarr_c", "left_anti").withColumn("problem", F.lit("no tiles")))
    )


def pick_colours(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """Colour per wanted channel: its own palette slot, or the first slot no other channel uses.

    ``taken(channel, colour)`` holds the colours in use; at most one row per palette slot is joined.
    """
    palette = ["%d,%d,%d" % rgb for rgb in scalars.CHANNEL_PALETTE]
    used = taken.filter(F.col("colour").isin(palette)).groupBy("colour").agg(
        F.min("channel").alias("_lo"), F.max("channel").alias("_hi")
    )
    slots = F.posexplode(F.array(*[F.lit(c) for c in palette])).alias("_slot", "colour")
    own = F.pmod("channel", F.lit(len(palette)))
    tried = wanted.select("channel", slots).join(used, "colour", "left")
    other = (F.col("_lo") != F.col("channel")) | (F.col("_hi") != F.col("channel"))
    free = F.col("_lo").isNull() | ~other
    first = F.min(F.when(free, F.struct((F.col("_slot") != own).cast("int").alias("later"), "_slot", "colour")))
    return tried.groupBy("channel").agg(first.alias("_p")).select(
        "channel", F.coalesce("_p.colour", scalars.palette_color(F.col("channel"), scalars.CHANNEL_PALETTE)).alias("colour")
    )
