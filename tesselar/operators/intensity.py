"""Pixel intensity operators, built on per-value counts.

Pixels are 16-bit, so ``(key, value) → count`` is bounded by 65536 rows per key.  One map-side
combined aggregation of the pixel table therefore feeds exact percentiles, foreground filters,
ranges and densities, and a channel that owns a third of all pixels is no hotter than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.functions import scalars
from tesselar.scale import first_by_hash

FOREGROUND_FLOOR = 0.01 * scalars.FULL_RANGE
FOREGROUND_MINIMUM = 100
SKETCH_ERROR = 0.02  # rank error that a default quantile sketch stays below, merged or not
TILE_MIN_RAW = 1900.0
TILE_MIN_WINDOWED = 0.02


def value_counts(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys, "value").agg(F.count("*").alias("n"))


def merge_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Merge two count tables (the mergeable form of every statistic in this module)."""
    return a.unionByName(b).groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def percentile_of_counts(value, p: float):
    """Exact linear-interpolated percentile from counts, as an aggregate."""
    return F.percentile(value, F.lit(p), F.col("n"))


def foreground(counts: DataFrame, keys: list[str], percentile: float = 99.0, factor: float = 0.1) -> DataFrame:
    """Two-stage background removal on counts.

    Stage 1 drops values under 1 % of full range if at least 100 remain; stage 2 keeps values above
    factor × percentile of what is left if at least 100 remain; otherwise the previous stage stands.
    """
    floor = F.col("value") >= FOREGROUND_FLOOR
    s1 = counts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(floor, F.col("n"))), F.lit(0)).alias("_above"))
    one = counts.join(s1, keys).filter((F.col("_above") < FOREGROUND_MINIMUM) | floor).drop("_above")
    thr = one.groupBy(*keys).agg((percentile_of_counts(F.col("value").cast("double"), percentile / 100.0) * factor).alias("_thr"))
    two = one.join(thr, keys)
    n2 = two.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("value") > F.col("_thr"), F.col("n"))), F.lit(0)).alias("_kept"))
    return (
        two.join(n2, keys)
        .filter((F.col("_kept") < FOREGROUND_MINIMUM) | (F.col("value") > F.col("_thr")))
        .select(*keys, "value", "n")
    )


def proportional_sample(pixels: DataFrame, keys: list[str], max_samples: int, seed: int = 0) -> DataFrame:
    """Each chunk contributes round(max · share) pixels in a fixed hash order (samples by design).

    Pass pixels already restricted to a selection to sample within it.
    """
    per = [*keys, "chunk_id"]
    sizes = pixels.groupBy(*per).agg(F.count("*").alias("size"))
    totals = sizes.groupBy(*keys).agg(F.sum("size").alias("_total"))
    share = F.bround(F.lit(float(max_samples)) * F.col("size") / F.col("_total")).cast("bigint")
    quota = sizes.join(totals, keys).select(*per, share.alias("quota"), "size")
    h01 = F.xxhash64("id", "y", "x", F.lit(seed)) / F.lit(2.0 ** 64) + 0.5
    return first_by_hash(pixels, per, quota.filter("quota > 0"), h01, ["id", "y", "x"])


def selected_pixels(pixels: DataFrame, ids: DataFrame, per_chunk: int | None = None) -> DataFrame:
    """Pixels of a selection; with a chunked layout the chunk ids join first so folders are pruned."""
    wanted = ids.select("id").distinct()
    if per_chunk is not None and "chunk_id" in pixels.columns:
        wanted = wanted.withColumn("chunk_id", scalars.chunk_id(F.col("id"), per_chunk))
        return pixels.join(wanted, ["chunk_id", "id"], "left_semi")
    return pixels.join(wanted, "id", "left_semi")


def cell_intensity(pixels: DataFrame, stat: str = "p95") -> DataFrame:
    """One summary per (channel, id): 95th percentile by default, or the mean."""
    agg = F.percentile("value", F.lit(0.95)) if stat == "p95" else F.avg("value")
    return pixels.groupBy("channel", "id").agg(agg.cast("double").alias("value"))


def channel_ranges(counts: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Data range with zeros and the automatic window from the non-zero percentiles."""
    nz = F.when(F.col("value") > 0, F.col("value").cast("double"))
    nzn = F.when(F.col("value") > 0, F.col("n")).otherwise(F.lit(0))
    raw = counts.groupBy(*keys).agg(
        F.min("value").cast("double").alias("_a"), F.max("value").cast("double").alias("_b"),
        F.percentile(nz, F.lit(low), nzn).alias("_c"), F.percentile(nz, F.lit(high), nzn).alias("_d"),
    )
    r = scalars.normalise_range(F.col("_a"), F.col("_b"), F.col("_c"), F.col("_d"), 0.0, scalars.FULL_RANGE)
    return raw.select(*keys, r.alias("r")).select(*keys, "r.*")


def range_sketches(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable range state with a quantile sketch, for values without a bounded domain."""
    return pixels.groupBy(*keys).agg(
        F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"),
        F.kll_sketch_agg_double(F.when(F.col("value") > 0, F.col("value").cast("double"))).alias("sketch"),
    )


def finalise_sketches(states: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Merge sketch states per key and read the window."""
    merged = states.groupBy(*keys).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    q = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    r = scalars.normalise_range(F.col("lo"), F.col("hi"), q(low), q(high), 0.0, scalars.FULL_RANGE)
    return merged.select(*keys, r.alias("r")).select(*keys, "r.*")


def sketch_rank_errors(windows: DataFrame, counts: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """How far the ranks of a sketched window lie from the asked ones, as shares of the non-zero values.

    ``counts`` are exact.  A value that occurs often covers a range of ranks; any rank of it is right.
    """
    some = counts.filter("value > 0").join(windows.select(*keys, "auto_min", "auto_max"), keys)
    share = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)) / F.sum("n")
    error = lambda c, p: F.greatest(F.lit(0.0), F.lit(p) - share(F.col("value") <= F.col(c)), share(F.col("value") < F.col(c)) - F.lit(p))
    return some.groupBy(*keys).agg(F.sum("n").alias("n"), error("auto_min", low).alias("low_error"), error("auto_max", high).alias("high_error"))


def windows_for(channels: DataFrame, windows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Display window per channel: user window, else automatic range, else full scale."""
    w = windows.select("channel", F.col("min").cast("double").alias("_wmin"), F.col("max").cast("double").alias("_wmax"), F.col("user").alias("_user"))
    r = ranges.select("channel", F.col("auto_min").alias("_amin"), F.col("auto_max").alias("_amax"))
    win = scalars.resolve_window(F.col("_wmin"), F.col("_wmax"), F.col("_user"), F.col("_amin"), F.col("_amax"))
    return channels.select("channel").join(w, "channel", "left").join(r, "channel", "left").select("channel", win.alias("w")).select("channel", "w.min", "w.max")


def combined_window(windows: DataFrame) -> DataFrame:
    return windows.agg(F.min("min").alias("min"), F.max("max").alias("max"))


def tile_signal(pixels: DataFrame) -> DataFrame:
    """Mean intensity per (channel, id) on the 0–1 scale."""
    return pixels.groupBy("channel", "id").agg((F.avg("value") / scalars.FULL_RANGE).alias("mean01"))


def composite_scores(signal: DataFrame, params: DataFrame, n_channels: int) -> DataFrame:
    """Summed raw and windowed signal over the active channels; a cell missing any channel drops.

    ``params(channel, min, max, alpha)`` has one row per active channel.
    """
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("alpha", F.lit(1.0))))
    win = scalars.apply_window(F.col("mean01"), scalars.window01(F.col("min")), scalars.window01(F.col("max")))
    return (
        signal.join(params, "channel")
        .groupBy("id")
        .agg(
            F.sum(F.col("mean01") * scalars.FULL_RANGE * a).alias("mean_raw"),
            F.sum(win * a).alias("windowed"),
            F.count("*").alias("_seen"),
        )
        .filter(F.col("_seen") == n_channels)
        .drop("_seen")
    )


def signal_filter(scores: DataFrame) -> DataFrame:
    return scores.filter((F.col("mean_raw") > TILE_MIN_RAW) & (F.col("windowed") > TILE_MIN_WINDOWED))


def missing_signals(points: DataFrame, signal: DataFrame, channels: DataFrame, per_chunk: int) -> DataFrame:
    """(channel, chunk) pairs that the points need but no tile has delivered; empty means ready."""
    chunks = points.select(scalars.chunk_id(F.col("id"), per_chunk).alias("chunk_id")).distinct()
    have = signal.select("channel", scalars.chunk_id(F.col("id"), per_chunk).alias("chunk_id")).distinct()
    listed = channels.agg(F.collect_set("channel").alias("c")).scalar()  # a tile stack has few channels
    return chunks.select(F.explode(listed).alias("channel"), "chunk_id").join(have, ["channel", "chunk_id"], "left_anti")


def composite_pixels(pixels: DataFrame, params: DataFrame) -> DataFrame:
    """RGBA composite ``(id, y, x, r, g, b, a)`` on the 0–255 scale.

    ``params(channel, min, max, alpha, red, green, blue)``.  Sums are rounded to six decimals before
    they are cut to bytes, so the order of addition cannot flip a byte.
    """
    t = scalars.norm01(F.col("value").cast("double"), F.col("min"), F.col("max"))
    v = t * scalars.clip(F.coalesce("alpha", F.lit(1.0)), 0.0, 1.0)
    px = pixels.join(params, "channel").select("id", "y", "x", v.alias("v"), "red", "green", "blue")
    tone = lambda c: F.floor(F.round(F.least(F.lit(255.0), F.sum(scalars.clip(F.col(c) * F.col("v"), 0.0, 255.0))), 6)).cast("int")
    return px.groupBy("id", "y", "x").agg(
        tone("red").alias("r"), tone("green").alias("g"), tone("blue").alias("b"),
        F.floor(F.round(F.least(F.lit(255.0), F.max("v") * 255.0), 6)).cast("int").alias("a"),
    )


def packed_signal(tiles: DataFrame) -> DataFrame:
    """``tile_signal`` of packed tiles; a row needs nothing but itself."""
    total = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return tiles.select("channel", "id", (total / F.nullif(F.size("pixels"), F.lit(0)) / scalars.FULL_RANGE).alias("mean01"))


def packed_percentile(tiles: DataFrame, p: float = 0.95) -> DataFrame:
    """``cell_intensity`` of packed tiles, by linear interpolation between sorted pixels; no shuffle."""
    at = (F.size("pixels") - 1) * F.lit(p)
    sorted_ = tiles.filter(F.size("pixels") > 0).select("channel", "id", F.array_sort("pixels").alias("s"), F.floor(at).cast("int").alias("lo"), at.alias("at"))
    low, high = F.get("s", F.col("lo")), F.get("s", F.ceil("at").cast("int"))
    return sorted_.select("channel", "id", (low + (high - low) * (F.col("at") - F.col("lo"))).cast("double").alias("value"))


def packed_composite(tiles: DataFrame, params: DataFrame) -> DataFrame:
    """``composite_pixels`` of packed tiles: ``(id, pixels)`` with one ``(r, g, b, a)`` per pixel place.

    Only packed tiles are shuffled, one row per channel and cell; a cell's channels meet by id and are blended as arrays.
    """
    settings = params.agg(
        F.map_from_entries(F.collect_list(F.struct("channel", F.struct("min", "max", "alpha", "red", "green", "blue")))).alias("m")
    ).scalar()  # a tile stack has few channels
    known = tiles.withColumn("set", settings[F.col("channel")]).filter("set IS NOT NULL")
    cells = known.groupBy("id").agg(F.collect_list(F.struct("set", "pixels")).alias("parts"))

    def coloured(part):
        def one(value):
            t = scalars.norm01(value.cast("double"), part["set"]["min"], part["set"]["max"])
            v = t * scalars.clip(F.coalesce(part["set"]["alpha"], F.lit(1.0)), 0.0, 1.0)
            tone = lambda c: scalars.clip(part["set"][c] * v, 0.0, 255.0)
            return F.struct(tone("red").alias("r"), tone("green").alias("g"), tone("blue").alias("b"), (v * 255.0).alias("a"))

        return F.transform(part["pixels"], one)

    zero = F.lit(0.0)
    had = lambda x, c: F.coalesce(x[c], zero)
    added = lambda x, y: F.struct(*[(had(x, c) + had(y, c)).alias(c) for c in "rgb"], F.greatest(had(x, "a"), had(y, "a")).alias("a"))
    none = F.array().cast("array<struct<r:double,g:double,b:double,a:double>>")
    blended = F.aggregate(F.transform("parts", coloured), none, lambda acc, part: F.zip_with(acc, part, added))
    byte = lambda x, c: F.floor(F.round(F.least(F.lit(255.0), x[c]), 6)).cast("int").alias(c)
    return cells.select("id", F.transform(blended, lambda x: F.struct(*[byte(x, c) for c in "rgba"])).alias("pixels"))
