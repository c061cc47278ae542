"""Column lists and types of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: header spellings accepted in input files ----------------------------------
NAME_HEADERS = ("channel_name", "name", "channel", "marker", "label")
ID_HEADERS = ("channel_id", "id", "index")
TILE_INDEX_HEADERS = ("zarr_index", "zarr_c", "index_in_zarr", "zarr")
ANNOTATION_ID_HEADERS = ("id", "ID", "CORE_ID")
CORE_HEADERS = ("CORE_ID", "global_X", "global_Y")
LEADING_CELL_COLUMNS = 9
COORDINATES = ("umap2_x", "umap2_y", "umap3_x", "umap3_y", "umap3_z", "X_centroid", "Y_centroid")
LEVELS = 6
LEVEL_K = {0: 1, 1: 3, 2: 6, 3: 10, 4: 15, 5: 20}
# -----------------------------------------------------------------------------------------------

CELL_TYPES = {
    "id": "bigint",
    "cellid": "string",
    **{c: "double" for c in COORDINATES},
    "label": "string",
    "clustering": "string",
    **{f"cluster_L{i}": "int" for i in range(LEVELS)},
    **{f"rank_L{i}": "bigint" for i in range(LEVELS)},
}

REVIEW = T.StructType(
    [
        T.StructField("level", T.StringType()),
        T.StructField("cluster_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("llm_title", T.StringType()),
        T.StructField("user_title", T.StringType()),
        T.StructField("llm_accuracy", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("reviewed_at", T.TimestampType()),
    ]
)

LABEL_DOCUMENT = (
    "struct<levels: map<string, map<string, struct<models: map<string, struct<title: string, description: string>>>>>>"
)


def first_header(columns: list[str], wanted: tuple[str, ...]) -> str | None:
    """The actual column whose trimmed, lower-cased header comes first in ``wanted``."""
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[w] for w in wanted if w in by_name), None)

# Fixed value: layout version of a stored review document.
REVIEW_VERSION = 2
