"""Predicate, box, lasso and cluster selection; region algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.functions import scalars
from tesselar.operators.predicates import column_value, predicate

MAX_REGIONS = 2


def filter_expression(annotations: DataFrame, aliases: dict[str, str], expression: str) -> DataFrame:
    """Ids whose annotations satisfy the expression; ``aliases`` maps identifier → column name.

    The expression becomes a plain Catalyst predicate, so it is analysed, pruned and pushed down like any other.  A row
    on which it is undefined (text where a number is needed, a remainder by zero) does not match.
    """
    fields = {f.name: f.dataType for f in annotations.schema.fields}
    names = {a: column_value(F.col(f"`{c}`"), fields[c]) for a, c in aliases.items()}
    return annotations.filter(predicate(expression, names)).select("id")


def box_select(points: DataFrame, bounds: tuple[float, float, float, float], x: Column | None = None, y: Column | None = None) -> DataFrame:
    """Ids inside inclusive bounds ``(x0, y0, x1, y1)``; pass x/y columns to select in another space."""
    x0, y0, x1, y1 = bounds
    px, py = (F.col("x") if x is None else x), (F.col("y") if y is None else y)
    return points.filter(px.between(min(x0, x1), max(x0, x1)) & py.between(min(y0, y1), max(y0, y1))).select("id")


def lasso_select(points: DataFrame, polygon: list[tuple[float, float]], x: Column | None = None, y: Column | None = None) -> DataFrame:
    """Ids inside a drawn polygon by the even-odd rule; fewer than three vertices select nothing."""
    px, py = (F.col("x") if x is None else x), (F.col("y") if y is None else y)
    if len(polygon) < 3:
        return points.filter(F.lit(False)).select("id")
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    near = px.between(min(xs), max(xs)) & py.between(min(ys), max(ys))
    edges = F.array(*[
        F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("xi", "yi", "xj", "yj"), (*polygon[i], *polygon[i - 1]))])
        for i in range(len(polygon))
    ])

    def crosses(e: Column) -> Column:
        dy = e["yj"] - e["yi"]
        at = (e["xj"] - e["xi"]) * (py - e["yi"]) / F.when(dy == 0, F.lit(1e-12)).otherwise(dy) + e["xi"]
        return ((e["yi"] > py) != (e["yj"] > py)) & (px < at)

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return points.filter(near & odd).select("id")


def within_filter(selection: DataFrame, active: DataFrame | None) -> DataFrame:
    """Selection ∩ active filter; an empty or absent filter changes nothing."""
    if active is None or active.isEmpty():
        return selection
    return selection.join(active.select("id"), "id", "left_semi")


def valid_ids(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Unique ids that exist in ``table``."""
    return ids.select("id").distinct().join(table.select("id"), "id", "left_semi")


def select_cluster(cells: DataFrame, label: Column, value: int) -> DataFrame:
    return cells.filter(label == value).select("id")


def highlighted(cells: DataFrame, clusters: list[int], override: str | None = None) -> DataFrame:
    """Cells whose override column, else label, is among ``clusters``."""
    label = scalars.resolve_label(cells.columns)
    if override is not None and override in cells.columns:
        label = F.coalesce(scalars.safe_int(F.col(override)), label)
    return cells.withColumn("shown_label", label).filter(F.col("shown_label").isin(list(clusters)))


def region_of(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Region index per point; the later region wins on overlap and −1 means none."""
    last = regions.groupBy("id").agg(F.max("region").alias("region"))
    return points.join(last, "id", "left").withColumn("region", F.coalesce("region", F.lit(-1)))


def selection_of(regions: DataFrame) -> DataFrame:
    return regions.select("id").distinct()


def add_region(regions: DataFrame, ids: DataFrame, additive: bool = True, keep: int = MAX_REGIONS) -> DataFrame:
    """Replace all regions, or append one and keep the last ``keep``, renumbered from 0."""
    fresh = ids.select("id").distinct()
    if not additive:
        return fresh.select(F.lit(0).cast("bigint").alias("region"), "id")
    top = F.coalesce(regions.agg(F.max("region")).scalar(), F.lit(-1)) + 1
    both = regions.select(F.col("region").cast("bigint").alias("region"), "id").unionByName(fresh.select(top.cast("bigint").alias("region"), "id"))
    shift = F.greatest(F.lit(0), top - (keep - 1))
    return both.select((F.col("region") - shift).alias("region"), "id").filter("region >= 0")


def difference(pool: DataFrame, picked: DataFrame) -> DataFrame:
    return pool.join(picked.select("id"), "id", "left_anti")


def with_pins(visible: DataFrame, points: DataFrame, pins: DataFrame) -> DataFrame:
    """Visible points plus every pinned point that is not already among them."""
    extra = points.join(pins.select("id").distinct(), "id", "left_semi").join(visible.select("id"), "id", "left_anti")
    return visible.unionByName(extra.select(*visible.columns))
