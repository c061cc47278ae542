"""Scalar expressions: lenient casts, labels, addresses, geometry transforms, intensity windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
FULL_RANGE = 65535.0
SAMPLE_HASH_RATIO = 0.6180339887
FALLBACK_CLASSES = 11
ZOOM_BOUNDARIES = (6, 7, 8, 9, 10)
POINT_BUDGETS = (5000, 20000, 35000, 50000, 65000, 80000)
FIT_MARGIN = 0.04
MISSING_WORDS = ("", "na", "nan", "none", "-", "null")
REVIEW_STATUSES = ("accepted", "rejected", "unsure", "corrected")
LABEL_KEYS = (
    "label", "clustering", "cluster_L0", "cluster_L1", "cluster_L2", "cluster_L3", "cluster_L4", "cluster_L5",
)
# Colours that equal the viewer's defaults (RGB, in display order).
CLUSTER_PALETTE = (
    (228, 26, 28), (55, 126, 184), (77, 175, 74), (152, 78, 163), (255, 127, 0),
    (204, 204, 0), (166, 86, 40), (247, 129, 191), (153, 153, 153), (102, 194, 165),
    (31, 120, 180), (51, 160, 44), (251, 154, 153), (227, 26, 28),
    (204, 140, 0), (166, 206, 227), (178, 223, 138), (202, 178, 214), (106, 61, 154),
    (255, 127, 80), (0, 191, 255), (0, 255, 127), (255, 105, 180), (210, 105, 30), (64, 224, 208),
    (184, 134, 11), (135, 206, 250), (70, 130, 180), (0, 206, 209), (124, 252, 0),
)
CHANNEL_PALETTE = (
    (255, 0, 0), (0, 255, 0), (0, 128, 255), (255, 255, 0), (255, 0, 255),
    (0, 255, 255), (255, 128, 0), (128, 0, 255), (0, 255, 128), (255, 0, 128),
)
# -------------------------------------------------------------------------------------------


def safe_int(c: Column) -> Column:
    """Lenient integer: ``"1.0"`` → 1, truncation toward zero, anything unusable → NULL."""
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))


def stable_label(id_col: Column, classes: int = FALLBACK_CLASSES) -> Column:
    """Class from the first 32 bits of the SHA-1 of the decimal id."""
    head = F.substring(F.sha1(id_col.cast("string")), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % F.lit(classes)


def resolve_label(
    columns: list[str],
    id_col: str = "id",
    key: str = "label",
    fallback: str = "sha1",
    zero_as_missing: bool = False,
) -> Column:
    """Integer label of a cell.

    ``label`` falls back to ``clustering`` only when the table has no ``label`` column; a missing
    value takes the fallback class (``sha1`` or ``mod``).  ``zero_as_missing`` sends label 0 to the
    fallback as well, as the coordinate export does.
    """
    if key not in LABEL_KEYS:
        key = "label"
    if key not in columns and key == "label" and "clustering" in columns:
        key = "clustering"
    default = stable_label(F.col(id_col)) if fallback == "sha1" else F.col(id_col) % F.lit(FALLBACK_CLASSES)
    if key not in columns:
        return default
    value = safe_int(F.col(key))
    if zero_as_missing:
        value = F.nullif(value, F.lit(0).cast("bigint"))
    return F.coalesce(value, default)


def chunk_id(position: Column, per_chunk: int) -> Column:
    return F.floor(position / F.lit(per_chunk)).cast("bigint")


def local_index(position: Column, per_chunk: int) -> Column:
    return position % F.lit(per_chunk)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), c))


def min_max_scale(v: Column, lo: Column, hi: Column) -> Column:
    """[-1, 1] over a bounding box, 0 where the box has no extent."""
    return F.when(hi - lo == 0, F.lit(0.0)).otherwise(F.lit(2.0) * (v - lo) / F.nullif(hi - lo, F.lit(0.0)) - 1.0)


def flip_y(y: Column, height: float | None) -> Column:
    return y if height is None else F.lit(float(height)) - y


def flip_path(path: Column, height: float | None) -> Column:
    """Flip every ``struct(x, y)`` vertex of an array path."""
    if height is None:
        return path
    return F.transform(path, lambda p: F.struct(p["x"].alias("x"), (F.lit(float(height)) - p["y"]).alias("y")))


def norm01(x: Column, lo: Column, hi: Column, gamma: float = 1.0) -> Column:
    t = clip((x - lo) / F.greatest(hi - lo, F.lit(1e-8)), 0.0, 1.0)
    return t if gamma == 1.0 else F.pow(t, F.lit(1.0 / gamma))


def apply_window(gray: Column, lo: Column, hi: Column) -> Column:
    """0 at or below ``lo``, 1 at or above ``hi``, linear between."""
    return (
        F.when(gray <= lo, F.lit(0.0))
        .when(gray >= hi, F.lit(1.0))
        .otherwise((gray - lo) / F.greatest(hi - lo, F.lit(1e-6)))
    )


def normalise_range(data_min: Column, data_max: Column, auto_min: Column, auto_max: Column, lo: float, hi: float) -> Column:
    """Order and fill a (data, auto) range pair; missing auto sides take the data side."""
    d0 = F.coalesce(data_min, F.lit(float(lo)))
    d1 = F.coalesce(data_max, F.lit(float(hi)))
    dmin, dmax = F.least(d0, d1), F.greatest(d0, d1)
    a0, a1 = F.coalesce(auto_min, dmin), F.coalesce(auto_max, dmax)
    return F.struct(
        dmin.alias("data_min"),
        dmax.alias("data_max"),
        F.least(a0, a1).alias("auto_min"),
        F.greatest(a0, a1).alias("auto_max"),
    )


def resolve_window(
    win_min: Column, win_max: Column, is_user: Column, auto_min: Column, auto_max: Column
) -> Column:
    """User window > automatic range > full scale; an untouched 0–65535 window counts as unset."""
    placeholder = (
        win_min.isNull() | win_max.isNull() | ((F.abs(win_min) < 1e-6) & (F.abs(win_max - FULL_RANGE) < 1e-6))
    ) & ~F.coalesce(is_user, F.lit(False))
    has_auto = auto_min.isNotNull() & auto_max.isNotNull()
    use_auto = has_auto & placeholder
    fallback_min = F.when(has_auto, F.least(auto_min, auto_max)).otherwise(F.lit(0.0))
    fallback_max = F.when(has_auto, F.greatest(auto_min, auto_max)).otherwise(F.lit(FULL_RANGE))
    return F.struct(
        F.when(use_auto, fallback_min).otherwise(F.coalesce(win_min, fallback_min)).alias("min"),
        F.when(use_auto, fallback_max).otherwise(F.coalesce(win_max, fallback_max)).alias("max"),
    )


def window01(raw: Column) -> Column:
    """Raw-unit bound as a fraction of the full range."""
    return clip(raw / FULL_RANGE, 0.0, 1.0)


def sample_hash(id_col: Column) -> Column:
    return (id_col.cast("double") * F.lit(SAMPLE_HASH_RATIO)) % F.lit(1.0)


def order_hash(id_col: Column, seed: int = 0) -> Column:
    """Portable multiplicative hash in [0, 2^32): a fixed shuffle order for sampling operators.

    The low 32 bits of the id are multiplied in two halves, so no id overflows.
    """
    key = (F.pmod(id_col.cast("bigint"), F.lit(1 << 32)) + F.lit(seed % (1 << 32))) % F.lit(1 << 32)
    high, low = F.shiftright(key, 16), key.bitwiseAND(F.lit(0xFFFF))
    return ((high * F.lit(2654435761)) % F.lit(1 << 16) * F.lit(1 << 16) + low * F.lit(2654435761)) % F.lit(1 << 32)


def similarity01(s: Column) -> Column:
    return clip((s + 1.0) * 0.5, 0.0, 1.0)


def palette_color(key: Column, palette=CLUSTER_PALETTE) -> Column:
    """``"r,g,b"`` chosen by key modulo the palette."""
    names = F.array(*[F.lit("%d,%d,%d" % rgb) for rgb in palette])
    return F.element_at(names, (F.pmod(key, F.lit(len(palette))) + 1).cast("int"))


def semantic_level(zoom: Column) -> Column:
    out = F.when(zoom < ZOOM_BOUNDARIES[0], F.lit(1))
    for i, bound in enumerate(ZOOM_BOUNDARIES[1:], start=2):
        out = out.when(zoom < bound, F.lit(i))
    return out.otherwise(F.lit(len(ZOOM_BOUNDARIES) + 1))


def point_budget(level: Column) -> Column:
    slot = F.greatest(F.lit(1), F.least(F.lit(len(POINT_BUDGETS)), level)).cast("int")
    return F.element_at(F.array(*[F.lit(b) for b in POINT_BUDGETS]), slot)


def level_of_detail(zoom: Column, base_zoom: float) -> Column:
    """Budget factor below the base zoom: halves per zoom step, never under 2 %; zoom in quarters."""
    z = F.floor(zoom * 4 + 0.5) / 4
    return F.when(z < base_zoom, F.greatest(F.lit(0.02), F.pow(F.lit(2.0), z - base_zoom))).otherwise(F.lit(1.0))


def review_score(c: Column) -> Column:
    """0–5 score, halves to even, NULL when not a number."""
    v = c.try_cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) < 1e18), v)
    return F.when(v.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(5), F.bround(v, 0).cast("bigint")))).cast("int")


def present_word(c: Column) -> Column:
    """True unless the text is blank or a spelled-out missing value."""
    return c.isNotNull() & ~F.lower(F.trim(c)).isin(*MISSING_WORDS)


def tile_index(c: Column) -> Column:
    """Non-negative tile-stack index of a channel, or NULL."""
    v = F.when(present_word(c.cast("string")), safe_int(c))
    return F.when(v >= 0, v)


def grid_columns(n: Column) -> Column:
    return F.when(n > 0, F.ceil(F.sqrt(n.cast("double")))).otherwise(F.lit(1)).cast("bigint")


def grid_rows(n: Column) -> Column:
    return F.when(n > 0, F.ceil(n / grid_columns(n))).otherwise(F.lit(1)).cast("bigint")
