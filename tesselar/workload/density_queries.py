"""Intensity statistics, histograms and density curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselar.functions import vectors
from tesselar.operators import groups, histograms, intensity, neighbours
from tesselar.plans import densities
from tesselar.scale import materialise, ranked
from tesselar.workload.embedding_queries import _scores
from tesselar.workload.registry import query
from tesselar.workload.tables import cells, features, pixels, points, raw, regions, rounded


@query("pixel_value_counts", "SELECT channel, value, n FROM counts", "counts")
def _(spark, sf):
    return intensity.value_counts(pixels(spark, sf), ["channel"])


_FOREGROUND = """s1 AS (SELECT channel, value, n FROM (SELECT *, sum(CASE WHEN value >= 655.35 THEN n ELSE 0 END) OVER (PARTITION BY channel) AS above FROM src)
  WHERE above < 100 OR value >= 655.35),
thr AS (SELECT channel, quantile_cont(value::DOUBLE, 0.99) * 0.1 AS t FROM (SELECT channel, value, unnest(range(n)) FROM s1) GROUP BY channel),
fg AS (SELECT channel, value, n FROM (SELECT s1.*, t, sum(CASE WHEN value > t THEN n ELSE 0 END) OVER (PARTITION BY channel) AS kept FROM s1 JOIN thr USING (channel))
  WHERE kept < 100 OR value > t)"""


@query(
    "foreground_values",
    "WITH src AS (SELECT * FROM counts), " + _FOREGROUND + " SELECT channel, value, n FROM fg",
    "counts",
)
def _(spark, sf):
    return densities.intensity_values(pixels(spark, sf))


@query(
    "foreground_values_dark",
    "WITH src AS (SELECT channel, value // 60 AS value, sum(n)::BIGINT AS n FROM counts GROUP BY ALL), " + _FOREGROUND + " SELECT channel, value, n FROM fg",
    "counts",
)
def _(spark, sf):
    dark = pixels(spark, sf).withColumn("value", F.floor(F.col("value") / 60).cast("bigint"))
    return densities.intensity_values(dark)


@query(
    "channel_ranges",
    """SELECT channel, min(value)::DOUBLE AS data_min, max(value)::DOUBLE AS data_max,
       round(quantile_cont(value::DOUBLE, 0.01) FILTER (WHERE value > 0), 6) AS auto_min,
       round(quantile_cont(value::DOUBLE, 0.99) FILTER (WHERE value > 0), 6) AS auto_max FROM pixels GROUP BY channel""",
    "pixels",
)
def _(spark, sf):
    counts = materialise(intensity.value_counts(pixels(spark, sf), ["channel"]), "counts")
    return rounded(intensity.channel_ranges(counts, ["channel"]))


@query(
    "channel_ranges_merged",
    """SELECT channel, min(value)::DOUBLE AS data_min, max(value)::DOUBLE AS data_max,
       round(quantile_cont(value::DOUBLE, 0.01) FILTER (WHERE value > 0), 6) AS auto_min,
       round(quantile_cont(value::DOUBLE, 0.99) FILTER (WHERE value > 0), 6) AS auto_max FROM pixels GROUP BY channel""",
    "pixels",
)
def _(spark, sf):
    px = pixels(spark, sf)
    half = lambda odd: intensity.value_counts(px.filter(F.col("chunk_id") % 2 == odd), ["channel"])
    return rounded(intensity.channel_ranges(intensity.merge_counts(half(0), half(1), ["channel"]), ["channel"]))


@query("channel_range_sketch")
def _(spark, sf):
    px = pixels(spark, sf)
    return rounded(intensity.finalise_sketches(intensity.range_sketches(px, ["channel", "chunk_id"]).drop("chunk_id"), ["channel"]))


@query(
    "channel_range_sketch_errors",
    "SELECT channel, count(*) AS n, 1 AS low_within, 1 AS high_within FROM pixels WHERE value > 0 GROUP BY channel",
    "pixels",
)
def _(spark, sf):
    """Whether the merged sketches' windows have the ranks that exact counts give, within the sketch's error."""
    px = pixels(spark, sf)
    windows = intensity.finalise_sketches(intensity.range_sketches(px, ["channel", "chunk_id"]).drop("chunk_id"), ["channel"])
    found = intensity.sketch_rank_errors(materialise(windows, "windows"), intensity.value_counts(px, ["channel"]), ["channel"])
    within = lambda c: (F.col(f"{c}_error") <= intensity.SKETCH_ERROR).cast("int").alias(f"{c}_within")
    return found.select("channel", "n", within("low"), within("high"))


@query(
    "cell_p95",
    "SELECT channel, id, round(quantile_cont(value, 0.95), 6) AS value FROM pixels GROUP BY ALL",
    "pixels",
)
def _(spark, sf):
    return rounded(intensity.cell_intensity(pixels(spark, sf)))


@query("tile_signal", "SELECT channel, id, round(avg(value) / 65535, 6) AS mean01 FROM pixels GROUP BY ALL", "pixels")
def _(spark, sf):
    return rounded(intensity.tile_signal(pixels(spark, sf)))


def _params(spark, sf, colours: bool = False):
    """Window and blend settings per channel, taken from the data's own automatic ranges."""
    counts = intensity.value_counts(pixels(spark, sf), ["channel"])
    r = materialise(intensity.channel_ranges(counts, ["channel"]), "ranges")
    out = r.select("channel", F.col("auto_min").alias("min"), F.col("auto_max").alias("max"), (1.0 - F.col("channel") * 0.1).alias("alpha"))
    if colours:
        out = out.select("*", (F.col("channel") * 40 % 256).cast("double").alias("red"), F.lit(128.0).alias("green"), (255.0 - F.col("channel") * 30).alias("blue"))
    return out


_PARAMS = """pr AS (SELECT channel, quantile_cont(value::DOUBLE, 0.01) FILTER (WHERE value > 0) AS lo, quantile_cont(value::DOUBLE, 0.99) FILTER (WHERE value > 0) AS hi,
  1.0::DOUBLE - channel * 0.1::DOUBLE AS a FROM pixels GROUP BY channel)"""
_SCORES = """sg AS (SELECT channel, id, avg(value) / 65535 AS m FROM pixels GROUP BY ALL),
sc AS (SELECT id, sum(m * 65535 * a) AS mean_raw, sum(CASE WHEN m <= lo / 65535 THEN 0 WHEN m >= hi / 65535 THEN 1 ELSE (m - lo / 65535) / greatest(hi / 65535 - lo / 65535, 1e-6) END * a) AS windowed
  FROM sg JOIN pr USING (channel) GROUP BY id HAVING count(*) = 7)"""


@query(
    "composite_scores",
    f"WITH {_PARAMS}, {_SCORES} SELECT id, round(mean_raw, 6) AS mean_raw, round(windowed, 6) AS windowed FROM sc",
    "pixels",
)
def _(spark, sf):
    return rounded(intensity.composite_scores(intensity.tile_signal(pixels(spark, sf)), _params(spark, sf), 7))


@query(
    "signal_filter",
    f"WITH {_PARAMS}, {_SCORES} SELECT id, round(mean_raw, 6) AS mean_raw, round(windowed, 6) AS windowed FROM sc WHERE mean_raw > 1900 AND windowed > 0.02",
    "pixels",
)
def _(spark, sf):
    s = intensity.composite_scores(intensity.tile_signal(pixels(spark, sf)), _params(spark, sf), 7)
    return rounded(intensity.signal_filter(s))


@query(
    "missing_signals",
    """SELECT channel, chunk_id FROM (SELECT DISTINCT channel FROM pixels) c, (SELECT DISTINCT id // 64 AS chunk_id FROM annotations) k
       WHERE NOT EXISTS (SELECT 1 FROM pixels p WHERE p.channel = c.channel AND p.chunk_id = k.chunk_id)""",
    "pixels annotations",
)
def _(spark, sf):
    from tesselar.workload.tables import annotations

    px = pixels(spark, sf)
    return intensity.missing_signals(annotations(spark, sf), intensity.tile_signal(px), px.select("channel").distinct(), 64)


@query(
    "composite_pixels",
    f"""WITH {_PARAMS}, v AS (SELECT id, y, x, channel, greatest(0, least(1, (value - lo) / greatest(hi - lo, 1e-8))) * a AS v FROM pixels JOIN pr USING (channel))
        SELECT id, y, x, floor(round(least(255, sum(greatest(0, least(255, ((channel * 40) % 256) * v)))), 6))::INT AS r,
        floor(round(least(255, sum(greatest(0, least(255, 128 * v)))), 6))::INT AS g, floor(round(least(255, sum(greatest(0, least(255, (255 - channel * 30) * v)))), 6))::INT AS b,
        floor(round(least(255, max(v) * 255), 6))::INT AS a FROM v GROUP BY ALL""",
    "pixels",
)
def _(spark, sf):
    return intensity.composite_pixels(pixels(spark, sf), _params(spark, sf, True))


@query(
    "packed_composite",
    f"""WITH {_PARAMS}, t AS (SELECT channel, id, value, row_number() OVER (PARTITION BY channel, id ORDER BY y, x, value) - 1 AS i FROM pixels),
        v AS (SELECT id, i, channel, greatest(0, least(1, (value - lo) / greatest(hi - lo, 1e-8))) * a AS v FROM t JOIN pr USING (channel))
        SELECT id, i, floor(round(least(255, sum(greatest(0, least(255, ((channel * 40) % 256) * v)))), 6))::INT AS r,
        floor(round(least(255, sum(greatest(0, least(255, 128 * v)))), 6))::INT AS g, floor(round(least(255, sum(greatest(0, least(255, (255 - channel * 30) * v)))), 6))::INT AS b,
        floor(round(least(255, max(v) * 255), 6))::INT AS a FROM v GROUP BY ALL""",
    "pixels",
)
def _(spark, sf):
    from tesselar.workload.source_queries import _tiles

    blended = intensity.packed_composite(_tiles(spark, sf), materialise(_params(spark, sf, True), "params"))
    return blended.select("id", F.posexplode("pixels").alias("i", "p")).select("id", "i", "p.*")


@query(
    "display_windows",
    """WITH r AS (SELECT channel, quantile_cont(value::DOUBLE, 0.01) FILTER (WHERE value > 0) AS a, quantile_cont(value::DOUBLE, 0.99) FILTER (WHERE value > 0) AS b FROM pixels WHERE channel < 6 GROUP BY channel),
       w AS (SELECT channel, CASE channel % 3 WHEN 0 THEN 0 WHEN 1 THEN min(value) + 100 END AS lo, CASE channel % 3 WHEN 0 THEN 65535 WHEN 1 THEN max(value) / 2 END AS hi, channel = 3 AS u FROM pixels GROUP BY channel)
       SELECT channel, round(CASE WHEN NOT u AND (lo IS NULL OR lo = 0) THEN coalesce(a, 0) ELSE coalesce(lo, a, 0) END, 6) AS min,
       round(CASE WHEN NOT u AND (lo IS NULL OR lo = 0) THEN coalesce(b, 65535) ELSE coalesce(hi, b, 65535) END, 6) AS max FROM w LEFT JOIN r USING (channel)""",
    "pixels",
)
def _(spark, sf):
    return rounded(_windows(spark, sf))


def _windows(spark, sf):
    px = pixels(spark, sf)
    c = F.col("channel") % 3
    w = px.groupBy("channel").agg(F.min("value").alias("a"), F.max("value").alias("b")).select(
        "channel",
        F.when(c == 0, F.lit(0)).when(c == 1, F.col("a") + 100).alias("min"),
        F.when(c == 0, F.lit(65535.0)).when(c == 1, F.col("b") / 2).alias("max"),
        (F.col("channel") == 3).alias("user"),
    )
    r = intensity.channel_ranges(intensity.value_counts(px.filter("channel < 6"), ["channel"]), ["channel"])
    return intensity.windows_for(px.select("channel").distinct(), w, r)


@query(
    "combined_window",
    """WITH r AS (SELECT channel, quantile_cont(value::DOUBLE, 0.01) FILTER (WHERE value > 0) AS a, quantile_cont(value::DOUBLE, 0.99) FILTER (WHERE value > 0) AS b FROM pixels GROUP BY channel)
       SELECT round(min(a), 6) AS min, round(max(b), 6) AS max FROM r""",
    "pixels",
)
def _(spark, sf):
    return rounded(intensity.combined_window(_params(spark, sf)))


@query(
    "proportional_sample",
    """WITH t AS (SELECT channel, chunk_id, count(*) AS c FROM pixels GROUP BY ALL)
       SELECT channel, chunk_id, n FROM (SELECT channel, chunk_id, least(c, round_even(1000.0::DOUBLE * c / sum(c) OVER (PARTITION BY channel), 0))::BIGINT AS n FROM t) WHERE n > 0""",
    "pixels",
)
def _(spark, sf):
    s = intensity.proportional_sample(pixels(spark, sf), ["channel"], 1000)
    return s.groupBy("channel", "chunk_id").agg(F.count("*").alias("n"))


_KDE = """st AS (SELECT {k}, sum(n) AS n, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM src GROUP BY {k}),
sm AS (SELECT {k}, any_value(st.n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, sum((value - lo) * src.n) AS m1, sum((value - lo) * (value - lo) * src.n) AS m2
  FROM src JOIN st USING ({k}) GROUP BY {k}),
sd AS (SELECT *, sqrt(greatest(0, m2 / n - (m1 / n) * (m1 / n))) AS s0 FROM sm),
bw AS (SELECT {k}, n, lo, hi, CASE WHEN hi > lo AND s0 > 0 THEN s0 WHEN hi > lo THEN (hi - lo) / 6 ELSE 1 END * pow(n, -0.2) AS h FROM sd),
kd AS (SELECT {k}, i, bw.lo + (bw.hi - bw.lo) / ({g} - 1) * i AS x, sum(src.n * exp(-0.5 * ((lo + (hi - lo) / ({g} - 1) * i - value) / h) * ((lo + (hi - lo) / ({g} - 1) * i - value) / h)))
  / (sqrt(2 * pi()) * any_value(bw.n) * any_value(h)) AS y, any_value(bw.n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, any_value(h) AS bw
  FROM src JOIN bw USING ({k}), (SELECT unnest(range({g})) AS i) GROUP BY {k}, i, bw.lo, bw.hi)"""
_CURVE = "i, round(x, 6) AS x, round(y * 1000, 6) AS y, n::BIGINT AS n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(bw, 6) AS bw FROM kd"


def _curve(df):
    return rounded(df.withColumn("y", F.col("y") * 1000))


@query(
    "pixel_density",
    "WITH fs AS (SELECT 1), src0 AS (SELECT * FROM counts), " + _FOREGROUND.replace("FROM src)", "FROM src0)") + ", src AS (SELECT * FROM fg), "
    + _KDE.format(k="channel", g=256) + f" SELECT channel, {_CURVE}",
    "counts",
)
def _(spark, sf):
    return _curve(densities.pixel_density(pixels(spark, sf)))


@query(
    "selection_pixel_density",
    "WITH src0 AS (SELECT channel, value, count(*) AS n FROM pixels WHERE id IN (SELECT id FROM regions) GROUP BY ALL), " + _FOREGROUND.replace("FROM src)", "FROM src0)")
    + ", src AS (SELECT * FROM fg), " + _KDE.format(k="channel", g=192) + f" SELECT channel, {_CURVE}",
    "pixels regions",
)
def _(spark, sf):
    sel = intensity.selected_pixels(pixels(spark, sf), regions(spark, sf), 64)
    return _curve(densities.pixel_density(sel, grid=192))


_CELLKDE = (
    "p AS (SELECT channel, id, quantile_cont(value, 0.95) AS value FROM pixels GROUP BY ALL), "
    "src AS (SELECT region, channel, value, count(*) AS n FROM p JOIN regions USING (id) GROUP BY ALL), "
)


@query(
    "region_cell_density",
    "WITH " + _CELLKDE + _KDE.format(k="region, channel", g=192) + f" SELECT region, channel, {_CURVE}",
    "pixels regions",
)
def _(spark, sf):
    return _curve(densities.cell_density(pixels(spark, sf), densities.last_two_regions(regions(spark, sf))))


@query(
    "region_comparison",
    "WITH " + _CELLKDE + _KDE.format(k="region, channel", g=192) + """,
       gm AS (SELECT "group", list(m ORDER BY i) AS m FROM (SELECT "group", i, avg(x) AS m FROM
       (SELECT region AS "group", unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM regions JOIN centred USING (id)) GROUP BY ALL) GROUP BY "group"),
       gc AS (SELECT "group", list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM gm),
       s AS (SELECT "group", id, list_distance(v, c) AS distance, list_dot_product(v, c) AS similarity FROM regions JOIN centred USING (id) JOIN gc ON gc."group" = region),
       b AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(distance, 9), id) AS r FROM s),
       a AS (SELECT "group", count(*) AS size, round(avg(distance), 6) AS compactness FROM s GROUP BY ALL)
       SELECT region, channel, size, compactness, b.id AS representative, round(b.similarity, 6) AS representative_similarity, """
    + _CURVE + ' JOIN a ON a."group" = region JOIN b ON b."group" = region AND r = 1',
    "pixels regions centred",
)
def _(spark, sf):
    return _curve(densities.compare_regions(pixels(spark, sf), features(spark, sf), regions(spark, sf)))


@query(
    "resampled_curves",
    "WITH src AS (SELECT * FROM counts), " + _KDE.format(k="channel", g=256) + """,
    nk AS (SELECT channel, i, x, y / greatest(1e-6, max(y) OVER (PARTITION BY channel)) AS y FROM kd),
    sg AS (SELECT channel, i, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM nk WINDOW w AS (PARTITION BY channel ORDER BY i)),
    ax AS (SELECT channel, k, k / 200.0::DOUBLE * 65535 AS x FROM (SELECT DISTINCT channel FROM kd), (SELECT unnest(range(201)) AS k)),
    ht AS (SELECT ax.channel, k, ax.x, y0 * (1 - (ax.x - x0) / (x1 - x0 + 1e-12)) + y1 * ((ax.x - x0) / (x1 - x0 + 1e-12)) AS d,
      row_number() OVER (PARTITION BY ax.channel, k ORDER BY i) AS r FROM ax JOIN sg ON sg.channel = ax.channel AND ax.x >= x0 AND ax.x <= x1),
    dn AS (SELECT ax.channel, ax.k, ax.x, coalesce(d, 0) * (ax.x + 1) AS y FROM ax LEFT JOIN ht ON ht.channel = ax.channel AND ht.k = ax.k AND r = 1),
    nm AS (SELECT channel, k, x, y / greatest(1e-12, max(y) OVER (PARTITION BY channel)) AS y FROM dn),
    k0 AS (SELECT channel, min(k) AS k0 FROM nm WHERE y >= 0.02 GROUP BY channel)
    SELECT nm.channel, nm.k, round(nm.x, 6) AS x, round(CASE WHEN k0 > 0 AND nm.k <= k0 THEN nm.k / k0 * l.y ELSE nm.y END, 6) AS y
    FROM nm JOIN k0 USING (channel) JOIN nm l ON l.channel = nm.channel AND l.k = k0""",
    "counts",
)
def _(spark, sf):
    counts = materialise(intensity.value_counts(pixels(spark, sf), ["channel"]), "counts")
    curves = materialise(histograms.kde(counts, ["channel"], 256), "curves")
    return rounded(histograms.resampled(histograms.max_normalised(curves, ["channel"]), ["channel"]))


@query(
    "violin_pack",
    "WITH src AS (SELECT region, channel, value, n FROM (SELECT 0 AS region, channel, value, n FROM counts) UNION ALL SELECT 1, channel, value, count(*) FROM pixels WHERE id IN (SELECT id FROM regions) GROUP BY ALL), "
    + _KDE.format(k="region, channel", g=64)
    + """, nk AS (SELECT *, y / greatest(1e-6, max(y) OVER (PARTITION BY region, channel)) AS u FROM kd)
    SELECT g.channel, g.i, round(g.x, 6) AS global_x, round(g.u, 6) AS global_y, g.n::BIGINT AS global_n, round(s.x, 6) AS selection_x, round(s.u, 6) AS selection_y,
    s.n::BIGINT AS selection_n, round(s.n / g.n, 6) AS scale FROM nk g JOIN nk s ON s.region = 1 AND s.channel = g.channel AND s.i = g.i WHERE g.region = 0""",
    "counts pixels regions",
)
def _(spark, sf):
    px = pixels(spark, sf)
    sel = intensity.selected_pixels(px, regions(spark, sf))
    curve = lambda p: histograms.kde(materialise(intensity.value_counts(p, ["channel"]), "counts"), ["channel"], 64)
    return rounded(histograms.violin_pack(curve(px), curve(sel), ["channel"]))


@query(
    "anchor_histogram",
    """SELECT bin, round((bin + 0.5) / 60, 6) AS center, coalesce(n, 0) AS n FROM (SELECT unnest(range(60)) AS bin) LEFT JOIN
       (SELECT least(59, floor(round(greatest(0, least(1, list_dot_product(a.v, u.v))), 9) * 60))::BIGINT AS bin, count(*) AS n FROM units u, units a
       WHERE a.id = 7 AND u.id <> 7 GROUP BY ALL) USING (bin)""",
    "units",
)
def _(spark, sf):
    return rounded(histograms.anchor_histogram(features(spark, sf), 7))


@query(
    "pair_histogram",
    """WITH n AS (SELECT count(*) AS n FROM units), d AS (SELECT i, ((i * 2654435761) % 4294967296) % n AS a, (((i * 7 + 3) * 2654435761) % 4294967296) % n AS b
       FROM (SELECT unnest(range(50000)) AS i), n), s AS (SELECT round(greatest(0, least(1, list_dot_product(x.v, y.v))), 9) AS v FROM d JOIN units x ON x.id = a JOIN units y ON y.id = b WHERE a <> b)
       SELECT bin, round((bin + 0.5) / 60, 6) AS center, coalesce(n, 0) AS n FROM (SELECT unnest(range(60)) AS bin) LEFT JOIN
       (SELECT least(59, floor(v * 60))::BIGINT AS bin, count(*) AS n FROM s GROUP BY ALL) USING (bin)""",
    "units",
)
def _(spark, sf):
    f = features(spark, sf)
    pos = ranked(f.select("id"), [], ["id"], "position")
    return rounded(histograms.pair_histogram(f, histograms.random_pairs(pos, 50_000)))


@query(
    "all_pairs_histogram",
    """SELECT bin, round((bin + 0.5) / 60, 6) AS center, coalesce(n, 0) AS n FROM (SELECT unnest(range(60)) AS bin) LEFT JOIN
       (SELECT least(59, floor(round(greatest(0, least(1, list_dot_product(a.v, b.v))), 9) * 60))::BIGINT AS bin, count(*) AS n FROM units a JOIN units b ON a.id < b.id GROUP BY ALL) USING (bin)""",
    "units",
)
def _(spark, sf):
    return rounded(histograms.all_pairs_histogram(features(spark, sf)))


@query(
    "local_histogram",
    "SELECT query, 8 AS bins, floor(greatest(0, least(0.9999, (similarity + 1) * 0.5)) * 7)::BIGINT AS bin, count(*) AS n FROM nn GROUP BY ALL",
    "nn",
)
def _(spark, sf):
    f = features(spark, sf)
    return histograms.local_histogram(neighbours.neighbours_of(f, None, f, 8))


@query(
    "smoothed_histogram",
    """WITH h AS (SELECT clustering AS "group", bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT clustering, unnest(range(40)) AS bin FROM cells) LEFT JOIN
       (SELECT clustering, least(39, floor((umap2_x + 1) / 2 * 40))::BIGINT AS bin, count(*) AS n FROM cells GROUP BY ALL) USING (clustering, bin))
       SELECT "group", bin, round((coalesce(lag(n) OVER w, n) + n + coalesce(lead(n) OVER w, n)) / 3 / greatest(1, max(n) OVER (PARTITION BY "group")), 6) AS level
       FROM h WINDOW w AS (PARTITION BY "group" ORDER BY bin)""",
    "cells",
)
def _(spark, sf):
    v = cells(spark, sf).select(F.col("clustering").alias("group"), ((F.col("umap2_x") + 1) / 2).alias("v"))
    return rounded(histograms.smoothed(histograms.fixed_bins(v, ["group"], "v", 40), ["group"]))


@query(
    "radial_density",
    """WITH r AS (SELECT "group", round(1 - similarity, 9) AS r FROM gscore), e AS (SELECT "group", min(r) AS lo, max(r) AS hi, count(*) AS n FROM r GROUP BY ALL),
       v AS (SELECT "group", (r - lo) / (hi - lo + 1e-6) AS v, n, greatest(0.05, least(0.15, 1 / sqrt(greatest(8, n)))) AS h FROM r JOIN e USING ("group")),
       d AS (SELECT "group", i, sum(exp(-(i / 191.0::DOUBLE - v) * (i / 191.0::DOUBLE - v) / (2 * h * h)) / (sqrt(pi() * 2 * h * h) * n)) AS y FROM v, (SELECT unnest(range(192)) AS i) GROUP BY ALL)
       SELECT "group", i, round(y / greatest(1e-6, max(y) OVER (PARTITION BY "group")), 6) AS y, round(i / 191.0::DOUBLE, 6) AS x FROM d""",
    "gscore",
)
def _(spark, sf):
    return rounded(histograms.radial_density(_scores(spark, sf)[2]))


_FIELD = """WITH s AS (SELECT "group", (row_number() OVER (PARTITION BY "group" ORDER BY id) - 1) / greatest(1, count(*) OVER (PARTITION BY "group") - 1) AS x, (similarity + 1) / 2 AS y FROM gscore),
  f AS (SELECT "group", gy, gx, sum(exp(-((gx / 159.0::DOUBLE - x) * (gx / 159.0::DOUBLE - x) + (gy / 99.0::DOUBLE - (1 - y)) * (gy / 99.0::DOUBLE - (1 - y))) / (2 * 0.055 * 0.055))) AS v
  FROM s, (SELECT unnest(range(160)) AS gx), (SELECT unnest(range(100)) AS gy) WHERE abs(gx - floor(x * 159 + 0.5)) <= 27 AND abs(gy - floor((1 - y) * 99 + 0.5)) <= 27 GROUP BY ALL)
  SELECT "group", gy, gx, round(v / max(v) OVER (PARTITION BY "group"), 6) AS v FROM f"""


@query("density_field", _FIELD, "gscore")
def _(spark, sf):
    s = ranked(_scores(spark, sf)[2].select("group", "id", "similarity"), ["group"], ["id"], "pos")
    sizes = materialise(s.groupBy("group").agg(F.count("*").alias("n")), "sizes")
    pts = s.join(sizes, "group").select("group", (F.col("pos") / F.greatest(F.lit(1), F.col("n") - 1)).alias("x"), ((F.col("similarity") + 1) / 2).alias("y"))
    return rounded(histograms.density_field(pts))


@query(
    "bounding_box",
    """SELECT round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round((min(x) + max(x)) / 2, 6) AS mid_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y,
       round((min(y) + max(y)) / 2, 6) AS mid_y FROM points""",
    "points",
)
def _(spark, sf):
    return rounded(histograms.bounding_box(points(spark, sf), ["x", "y"]))


@query(
    "scaled_points",
    """SELECT id, round(2 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) - 1, 6) + 0.0 AS x,
       round(-(2 * (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) - 1), 6) + 0.0 AS y FROM points""",
    "points",
)
def _(spark, sf):
    return rounded(histograms.scaled_points(points(spark, sf), {"x": "x", "y": "y"}).select("id", "x", "y"))


@query(
    "fraction_at_most",
    "SELECT o_orderkey AS key, round((SELECT count(*) FROM points p WHERE round(p.y, 9) <= v) / (SELECT count(*) FROM points), 6) AS fraction "
    "FROM (SELECT o_orderkey, round(o_totalprice / 500000, 9) AS v FROM orders WHERE o_orderstatus = 'P') ",
    "points",
)
def _(spark, sf):
    p = raw(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") / 500000).alias("value"))
    return rounded(neighbours.fraction_at_most(p, points(spark, sf).select(F.col("y").alias("value"))).drop("value"))


@query(
    "max_normalised_values",
    "SELECT channel, id, round(avg(value) / max(avg(value)) OVER (PARTITION BY channel), 6) AS y FROM pixels GROUP BY channel, id",
    "pixels",
)
def _(spark, sf):
    return rounded(histograms.max_normalised_rows(pixels(spark, sf).groupBy("channel", "id").agg(F.avg("value").alias("y")), ["channel"]))
