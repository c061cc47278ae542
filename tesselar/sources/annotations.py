"""Annotation tables, their inferred schema, and core metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselar import schemas
from tesselar.functions import scalars, text
from tesselar.sources.cells import with_row_ids


def id_column(columns: list[str]) -> str | None:
    return next((c for c in schemas.ANNOTATION_ID_HEADERS if c in columns), None)


def describe_columns(names: DataFrame) -> DataFrame:
    """Schema rows from ``(ordinal, raw_name, is_number)``.

    A description with a colon makes a column categorical; otherwise the data type decides.  The
    alias is unique: the n-th repeat gets the suffix ``_n``.
    """
    d = names.withColumn("_d", text.descriptor(F.col("raw_name")))
    d = d.select(
        "ordinal",
        F.col("_d.base").alias("name"),
        "raw_name",
        F.when(F.col("_d.description").contains(":"), F.lit("categorical"))
        .when(F.col("is_number"), F.lit("numeric"))
        .otherwise(F.lit("categorical"))
        .alias("type"),
        F.coalesce("_d.description", F.lit("")).alias("description"),
        text.alias_of(F.col("_d.base")).alias("_alias"),
    )
    nth = F.row_number().over(Window.partitionBy("_alias").orderBy("ordinal"))
    return d.withColumn("_n", nth).select(
        "ordinal", "name", "raw_name", "type", "description",
        F.when(F.col("_n") > 1, F.concat_ws("_", "_alias", F.col("_n").cast("string"))).otherwise(F.col("_alias")).alias("alias"),
    )


def annotation_schema(df: DataFrame) -> DataFrame:
    """One row per annotation column, taken from the frame's own schema."""
    key = id_column(df.columns)
    rows = [
        (i, f.name, isinstance(f.dataType, T.NumericType))
        for i, f in enumerate(df.schema.fields)
        if f.name != key
    ]
    return describe_columns(df.sparkSession.createDataFrame(rows, "ordinal int, raw_name string, is_number boolean"))


def infer_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(raw_name, is_number)`` from the data: every non-null text converts to a number."""
    bad = [F.sum((F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).cast("bigint")).alias(c) for c in columns]
    return df.agg(*bad).unpivot([], columns, "raw_name", "_bad").select(
        "raw_name", (F.coalesce("_bad", F.lit(0)) == 0).alias("is_number")
    )


def annotation_rows(df: DataFrame) -> DataFrame:
    """``(id, raw)`` with every non-id column in a text map; NaN counts as missing."""
    key = id_column(df.columns)
    pairs = []
    for f in df.schema.fields:
        if f.name == key or f.name == "_row":
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        pairs += [F.lit(f.name), c.cast("string")]
    row_no = F.col("_row") if "_row" in df.columns else F.lit(None).cast("bigint")
    ident = F.coalesce(scalars.safe_int(F.col(key)), row_no) if key else row_no
    return df.select(ident.alias("id"), F.create_map(*pairs).alias("raw"))


def scan_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation CSV with inferred types; ``_row`` is added when the file has no id column."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if id_column(df.columns) is None:
        df = with_row_ids(df).withColumnRenamed("id", "_row")
    return df


def present_annotation_columns(schema_rows: DataFrame, wanted=("celltype", "neigh_names")) -> DataFrame:
    """Which of the known annotation columns exist."""
    names = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.trim("raw_name"))
    return schema_rows.agg(*[F.coalesce(F.bool_or(names == w), F.lit(False)).cast("int").alias(w) for w in wanted])


def is_core_metadata(columns: list[str]) -> bool:
    return len(columns) >= 4 and tuple(columns[:3]) == schemas.CORE_HEADERS


def core_metadata(df: DataFrame) -> DataFrame:
    """``(id, x, y, values)``; rows without an integer id or finite position are dropped."""
    if not is_core_metadata(df.columns):
        raise ValueError("core metadata needs CORE_ID, global_X, global_Y and at least one more column")
    pairs = []
    for c in df.columns[3:]:
        pairs += [F.lit(c), F.col(f"`{c}`").cast("string")]
    rows = df.select(
        scalars.safe_int(F.col("CORE_ID")).alias("id"),
        F.col("global_X").try_cast("double").alias("x"),
        F.col("global_Y").try_cast("double").alias("y"),
        F.create_map(*pairs).alias("values"),
    )
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return rows.filter(F.col("id").isNotNull() & finite("x") & finite("y"))
