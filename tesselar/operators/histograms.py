"""Histograms, density curves and density fields."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions import scalars, vectors
from tesselar.operators.pairwise import clipped_histogram_kernel, pairwise
from tesselar.scale import materialise, numbers, one_row

KDE_GRID = 256
RADIAL_SAMPLES = 192
FIELD_WIDTH, FIELD_HEIGHT, FIELD_SIGMA = 160, 100, 0.055
RESAMPLE_STEPS = 200
RAMP_THRESHOLD = 0.02
HELD_BYTES = 64 * 1024 * 1024  # partial sums that a task holds before it hands them over


def fixed_bins(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Counts over ``bins`` equal bins of [0, 1]; the last bin is closed, values outside drop."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("bigint")
    counts = df.filter(F.col(value).between(0.0, 1.0)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    every = numbers(bins).alias("bin")
    if keys:
        slots = df.select(*keys).distinct().select(*keys, every)
    else:
        slots = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return slots.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", ((F.col("bin") + 0.5) / bins).alias("center"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def pair_histogram(features: DataFrame, pairs: DataFrame, bins: int = 60) -> DataFrame:
    """Cosine histogram of the given id pairs ``(a, b)``; self-pairs drop, values clip to [0, 1]."""
    units = vectors.representation(features)
    sims = (
        pairs.filter("a <> b")
        .join(units.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a")
        .join(units.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")
        .select(scalars.clip(vectors.dot("va", "vb"), 0.0, 1.0).alias("v"))
    )
    return fixed_bins(sims.select(F.round("v", 9).alias("v")), [], "v", max(8, min(400, bins)))


def all_pairs_histogram(features: DataFrame, bins: int = 60) -> DataFrame:
    """Exact counterpart of the pair histogram over every unordered pair.

    Pairs only exist inside a kernel, which returns bin counts per query.
    """
    units = vectors.representation(features)
    part = pairwise(units, units, clipped_histogram_kernel(bins), "bin bigint, n bigint")
    counts = part.groupBy("bin").agg((F.sum("n") / 2).cast("bigint").alias("n"))
    slots = features.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return slots.join(counts, "bin", "left").select(
        "bin", ((F.col("bin") + 0.5) / bins).alias("center"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def random_pairs(positions: DataFrame, pairs: int, seed: int = 0) -> DataFrame:
    """A fixed pseudo-random pair list over dense positions: ``positions(position, id)`` → ``(a, b)``."""
    n = positions.agg(F.count("*")).scalar()
    draw = positions.sparkSession.range(pairs).select(
        (scalars.order_hash(F.col("id"), seed) % n).alias("i"),
        (scalars.order_hash(F.col("id") * 7 + 3, seed) % n).alias("j"),
    )
    left = positions.select(F.col("position").alias("i"), F.col("id").alias("a"))
    right = positions.select(F.col("position").alias("j"), F.col("id").alias("b"))
    return draw.join(left, "i").join(right, "j").select("a", "b")


def anchor_histogram(features: DataFrame, anchor_id: int, bins: int = 60) -> DataFrame:
    """Cosine of one row to all others over [0, 1]."""
    units = vectors.representation(features)
    anchor = np.array(units.filter(F.col("id") == anchor_id).select("vec").first()[0])
    s = units.filter(F.col("id") != anchor_id).select(
        F.round(scalars.clip(vectors.dot_with("vec", anchor), 0.0, 1.0), 9).alias("v")
    )
    return fixed_bins(s, [], "v", bins)


def local_histogram(neighbours: DataFrame) -> DataFrame:
    """Similarity histogram per query with a bin count that follows √n (8 to 16 bins)."""
    size = Window.partitionBy("query")
    t = neighbours.select("query", ((F.col("similarity") + 1.0) * 0.5).alias("t")).withColumn("m", F.count("*").over(size))
    bins = F.least(F.lit(16), F.greatest(F.lit(8), F.floor(F.sqrt(F.col("m").cast("double")) * 2 + 0.5))).cast("bigint")
    slot = F.floor(scalars.clip(F.col("t"), 0.0, 0.9999) * (bins - 1)).cast("bigint")
    return t.groupBy("query", bins.alias("bins"), slot.alias("bin")).agg(F.count("*").alias("n"))


def smoothed(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Three-bin moving mean with clamped edges, divided by the largest raw count."""
    w = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    mean = (F.coalesce(F.lag("n").over(w), F.col("n")) + F.col("n") + F.coalesce(F.lead("n").over(w), F.col("n"))) / 3.0
    return hist.select(*keys, "bin", (mean / F.greatest(F.lit(1), F.max("n").over(whole))).alias("level"))


def max_normalised(curves: DataFrame, keys: list[str], y: str = "y", floor: float = 1e-6) -> DataFrame:
    """Each value of a curve divided by the largest of its key; a curve has as many rows as its grid."""
    return curves.withColumn(y, F.col(y) / F.greatest(F.lit(floor), F.max(y).over(Window.partitionBy(*keys))))


def max_normalised_rows(rows: DataFrame, keys: list[str], y: str = "y", floor: float = 1e-6) -> DataFrame:
    """The same for keys of any size: the largest values are aggregated first and joined, no key meets in one task."""
    rows = materialise(rows, "rows")
    top = materialise(rows.groupBy(*keys).agg(F.max(y).alias("_top")), "tops")
    matched = [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    joined = rows.alias("c").join(top.alias("t"), matched)
    return joined.select(*[(F.col(f"c.{c}") / F.greatest(F.lit(floor), F.col("t._top"))).alias(c) if c == y else F.col(f"c.{c}") for c in rows.columns])


def curve_stats(counts: DataFrame, keys: list[str]) -> DataFrame:
    """n, lo, hi and Scott bandwidth per key from ``(keys, value, n)`` counts."""
    base = counts.groupBy(*keys).agg(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"))
    off = F.col("value") - F.col("lo")
    m = (
        counts.join(base, keys)
        .groupBy(*keys, "lo", "hi")
        .agg(F.sum("n").alias("n"), F.sum(off * F.col("n")).alias("_s"), F.sum(off * off * F.col("n")).alias("_q"))
    )
    var = F.col("_q") / F.col("n") - (F.col("_s") / F.col("n")) * (F.col("_s") / F.col("n"))
    sd = F.when(F.col("hi") > F.col("lo"), F.sqrt(F.greatest(F.lit(0.0), var))).otherwise(F.lit(0.0))
    span = F.col("hi") - F.col("lo")
    sd = F.when(sd > 0, sd).when(span > 0, span / 6.0).otherwise(F.lit(1.0))
    h = sd * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    h = F.when(h > 1e-12, h).when(span > 0, F.greatest(F.lit(1e-6), span * 1e-3)).otherwise(F.lit(1e-3))
    return m.select(*keys, "n", "lo", "hi", h.alias("bw"))


def _kernel_sums(points: DataFrame, keys: list[str], grid: int) -> DataFrame:
    """Sum of n · exp(−½((x_i − value) / bw)²) per key and grid index.

    Tasks add up their rows on the grid with array maths; one curve per key and task is shuffled, or a few where a task
    has more keys than it may hold.
    """
    steps = np.arange(grid)
    limit = HELD_BYTES

    def rows(total: dict) -> pd.DataFrame:
        out = pd.DataFrame(np.repeat(np.array(list(total), dtype=object), grid, axis=0), columns=keys)
        return out.assign(i=np.tile(steps, len(total)), k=np.concatenate(list(total.values())))

    def run(batches):
        total: dict = {}
        for pdf in batches:
            for key, g in pdf.groupby(keys):
                lo, hi, bw = g["lo"].iat[0], g["hi"].iat[0], g["bw"].iat[0]
                x = lo + (hi - lo) / (grid - 1) * steps
                value, weight = g["value"].to_numpy(), g["n"].to_numpy(dtype=np.float64)
                for s in range(0, len(value), 2048):
                    u = (x[None, :] - value[s:s + 2048, None]) / bw
                    total[key] = total.get(key, 0.0) + weight[s:s + 2048] @ np.exp(-0.5 * u * u)
                if len(total) * grid * 8 > limit:
                    yield rows(total)
                    total = {}
        if total:
            yield rows(total)

    types = dict(points.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", i bigint, k double"
    part = points.select(*keys, "value", "n", "lo", "hi", "bw").mapInPandas(run, schema)
    return part.groupBy(*keys, "i").agg(F.sum("k").alias("k"))


def kde(counts: DataFrame, keys: list[str], grid: int = KDE_GRID, expected: DataFrame | None = None) -> DataFrame:
    """Gaussian density curves ``(keys, i, x, y, n, lo, hi, bw)`` from value counts.

    Work is distinct values × grid, so 16-bit pixels cost at most 65536 × grid per key however many
    pixels there are.  Keys of ``expected`` without values get a flat zero curve on [0, 1].
    """
    grid = max(8, grid)
    stats = materialise(curve_stats(counts, keys), "stats")
    dens = _kernel_sums(counts.select(*keys, F.col("value").cast("double").alias("value"), "n").join(stats.drop("n"), keys), keys, grid)
    out = dens.join(stats, keys).select(
        *keys, "i", (F.col("lo") + (F.col("hi") - F.col("lo")) / (grid - 1) * F.col("i")).alias("x"),
        (F.col("k") / (F.lit(math.sqrt(2.0 * math.pi)) * F.col("n") * F.col("bw"))).alias("y"), "n", "lo", "hi", "bw",
    )
    if expected is None:
        return out
    empty = expected.select(*keys).distinct().join(stats, keys, "left_anti")
    zero = F.lit(0.0)
    return out.unionByName(
        empty.select(*keys, numbers(grid).alias("i")).select(
            *keys, "i", (F.col("i") / (grid - 1)).alias("x"), zero.alias("y"), F.lit(0).cast("bigint").alias("n"),
            zero.alias("lo"), F.lit(1.0).alias("hi"), zero.alias("bw"),
        )
    )


def unit_interval_kde(values: DataFrame, keys: list[str], bandwidth: Column, samples: int = RADIAL_SAMPLES) -> DataFrame:
    """Density on an even grid of [0, 1] with a given bandwidth per key, largest value 1.

    ``values`` holds ``(keys, value, n, size)``: counted values and the group size.
    """
    h = F.col("bw")
    placed = values.withColumn("bw", bandwidth).withColumn("n", F.col("n") / (F.lit(math.sqrt(2.0 * math.pi)) * h * F.col("size")))
    placed = placed.withColumns({"lo": F.lit(0.0), "hi": F.lit(1.0)})
    dens = _kernel_sums(placed, keys, samples).withColumnRenamed("k", "y")
    return max_normalised(dens, keys).withColumn("x", F.col("i") / F.lit(samples - 1))


def radial_density(scores: DataFrame, samples: int = RADIAL_SAMPLES) -> DataFrame:
    """Group curve of ``1 − similarity``, min–max scaled, bandwidth 1/√n within [0.05, 0.15]."""
    r = scores.select("group", F.round(1.0 - F.col("similarity"), 9).alias("r")).groupBy("group", "r").agg(F.count("*").alias("n"))
    ext = r.groupBy("group").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.sum("n").alias("size"))
    v = r.join(ext, "group").select("group", ((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6)).alias("value"), "n", "size")
    h = scalars.clip(1.0 / F.sqrt(F.greatest(F.lit(8), F.col("size")).cast("double")), 0.05, 0.15)
    return unit_interval_kde(v, ["group"], h, samples)


def density_field(points: DataFrame, width: int = FIELD_WIDTH, height: int = FIELD_HEIGHT, sigma: float = FIELD_SIGMA) -> DataFrame:
    """Radius-limited Gaussian field of ``points(group, x, y)`` in [0, 1]², largest value 1.

    Every task turns its points into width × height sums with two small matrices; only those sums are shuffled, one per
    group and task or a few where a task has more groups than it may hold.  Row 0 is the top (y = 1).
    """
    reach = max(2, math.ceil(3 * sigma * width))
    limit = HELD_BYTES

    def rows(total: dict):
        for key, t in total.items():
            row, col = np.nonzero(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), key, np.int64)), pa.array(row), pa.array(col), pa.array(t[row, col])],
                names=["group", "gy", "gx", "v"],
            )

    def run(batches):
        total: dict = {}
        gx, gy = np.arange(width), np.arange(height)
        for b in batches:
            g = b.column(0).to_numpy(zero_copy_only=False)
            x, y = b.column(1).to_numpy(), 1.0 - b.column(2).to_numpy()
            cx, cy = np.floor(x * (width - 1) + 0.5), np.floor(y * (height - 1) + 0.5)
            wx = np.exp(-((gx / (width - 1) - x[:, None]) ** 2) / (2 * sigma * sigma)) * (np.abs(gx - cx[:, None]) <= reach)
            wy = np.exp(-((gy / (height - 1) - y[:, None]) ** 2) / (2 * sigma * sigma)) * (np.abs(gy - cy[:, None]) <= reach)
            for key in np.unique(g):
                at = g == key
                total[key] = total.get(key, 0) + wy[at].T @ wx[at]
                if len(total) * total[key].nbytes > limit:
                    yield from rows(total)
                    total = {}
        yield from rows(total)

    part = points.select(F.col("group").cast("bigint"), "x", "y").mapInArrow(run, "group bigint, gy bigint, gx bigint, v double")
    return max_normalised(part.groupBy("group", "gy", "gx").agg(F.sum("v").alias("v")), ["group"], "v", 1e-300)


def resampled(curves: DataFrame, keys: list[str], upper: float = scalars.FULL_RANGE, steps: int = RESAMPLE_STEPS) -> DataFrame:
    """Curves put on an even axis 0..upper, weighted by (x + 1), max-normalised, low tail ramped.

    A curve segment knows which axis points it covers, so no range join is needed.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    seg = curves.select(
        *keys, "i", F.col("x").alias("x0"), F.col("y").alias("y0"),
        F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"),
    ).filter("x1 is not null")
    first = F.greatest(F.lit(0), F.floor(F.col("x0") / upper * steps))
    last = F.least(F.lit(steps), F.ceil(F.col("x1") / upper * steps))
    axis = F.col("k") / F.lit(steps) * upper
    part = (axis - F.col("x0")) / (F.col("x1") - F.col("x0") + 1e-12)
    hit = (
        seg.filter(first <= last)
        .select("*", F.explode(F.sequence(first, last)).alias("k"))
        .filter((axis >= F.col("x0")) & (axis <= F.col("x1")))
        .groupBy(*keys, "k")
        .agg(F.min_by(F.col("y0") * (1 - part) + F.col("y1") * part, "i").alias("d"))
    )
    slots = curves.select(*keys).distinct().select(*keys, numbers(steps + 1).alias("k"))
    dens = slots.join(hit, [*keys, "k"], "left").select(*keys, "k", axis.alias("x"), (F.coalesce("d", F.lit(0.0)) * (axis + 1)).alias("y"))
    dens = max_normalised(dens, keys, "y", 1e-12)
    whole = Window.partitionBy(*keys)
    start = F.min(F.when(F.col("y") >= RAMP_THRESHOLD, F.col("k"))).over(whole)
    dens = dens.withColumn("_k0", start)
    lift = F.max(F.when(F.col("k") == F.col("_k0"), F.col("y"))).over(whole)
    return dens.withColumn("_lift", lift).select(
        *keys, "k", "x",
        F.when((F.col("_k0") > 0) & (F.col("k") <= F.col("_k0")), F.col("k") / F.nullif(F.col("_k0"), F.lit(0)) * F.col("_lift"))
        .otherwise(F.col("y")).alias("y"),
    )


def violin_pack(global_curves: DataFrame, selection_curves: DataFrame, keys: list[str]) -> DataFrame:
    """Both curves, each max-normalised, plus the selection's share of the global count."""
    join = [*keys, "i"]
    g = max_normalised(global_curves, keys).select(*join, F.col("x").alias("global_x"), F.col("y").alias("global_y"), F.col("n").alias("global_n"))
    s = max_normalised(selection_curves, keys).select(*join, F.col("x").alias("selection_x"), F.col("y").alias("selection_y"), F.col("n").alias("selection_n"))
    scale = scalars.clip(F.coalesce("selection_n", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("global_n", F.lit(0))), 0.0, 1.0)
    return g.join(s, join, "full").withColumn("scale", scale)


def bounding_box(points: DataFrame, columns: list[str]) -> DataFrame:
    """min, max and centre of every column in one row."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), ((F.min(c) + F.max(c)) / 2).alias(f"mid_{c}")]
    return points.agg(*aggs)


def scaled_points(points: DataFrame, columns: dict[str, str], negate: tuple[str, ...] = ("y",)) -> DataFrame:
    """Columns scaled to [-1, 1] over their shared box; ``columns`` maps output names to inputs."""
    box = one_row(bounding_box(points, list(columns.values())))
    out = {}
    for name, src in columns.items():
        v = scalars.min_max_scale(F.col(src), box[f"min_{src}"], box[f"max_{src}"])
        out[name] = -v if name in negate else v
    return points.withColumns(out)
