"""Filters, selections and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselar.functions import scalars
from tesselar.operators import detail, selection
from tesselar.workload.registry import query
from tesselar.workload.tables import annotations, cells, label_groups, points, raw, regions, rounded

LASSO = [(0.1, 0.1), (0.9, 0.2), (0.55, 0.5), (0.8, 0.9), (0.2, 0.8), (0.45, 0.45)]
BOX = (0.25, 0.1, 0.75, 0.6)


def _edges() -> str:
    return ", ".join(f"({LASSO[i][0]}::DOUBLE, {LASSO[i][1]}::DOUBLE, {LASSO[i - 1][0]}::DOUBLE, {LASSO[i - 1][1]}::DOUBLE)" for i in range(len(LASSO)))


@query(
    "expression_filter",
    "SELECT id FROM annotations WHERE (p_size > 20 AND celltype = 'STANDARD') OR (NOT (p_retailprice < 1500) AND celltype IN ('ECONOMY', 'PROMO')) OR p_size <> 7 AND p_size % 11 = 0",
    "annotations",
)
def _(spark, sf):
    text = "(size > 20 && kind == 'STANDARD') || (!(price < 1500) && kind in ['ECONOMY', \"PROMO\"]) || size != 7 && size % 11 === 0"
    names = {"size": "p_size", "price": "p_retailprice", "kind": "celltype"}
    return selection.filter_expression(annotations(spark, sf), names, text)


@query(
    "expression_filter_row_errors",
    """SELECT id FROM annotations WHERE (p_size % 10 <> 0 AND 100.0 / (p_size % 10) > 20) OR p_size % 10 = 0
       OR (p_size % 3 <> 0 AND p_size % (p_size % 3) = 1)""",
    "annotations",
)
def _(spark, sf):
    # A zero divisor gives infinity, a remainder by zero and text against a number are undefined; no row fails the job.
    names = {"size": "p_size", "kind": "celltype"}
    return selection.filter_expression(annotations(spark, sf), names, "100 / (size % 10) > 20 || kind > 3 || size % (size % 3) == 1")


@query("box_selection", "SELECT id FROM points WHERE x BETWEEN 0.25 AND 0.75 AND y BETWEEN 0.1 AND 0.6", "points")
def _(spark, sf):
    return selection.box_select(points(spark, sf), BOX)


@query(
    "box_selection_mapped",
    "SELECT id FROM cells WHERE 2 * X_centroid BETWEEN 50 AND 300 AND 500 - Y_centroid BETWEEN 350 AND 480",
    "cells",
)
def _(spark, sf):
    return selection.box_select(cells(spark, sf), (300.0, 480.0, 50.0, 350.0), F.col("X_centroid") * 2, 500 - F.col("Y_centroid"))


_LASSO_SQL = f"""WITH e AS (SELECT * FROM (VALUES {_edges()}) t(xi, yi, xj, yj))
  SELECT id FROM points, e GROUP BY id HAVING sum(CASE WHEN (yi > y) <> (yj > y) AND x < (xj - xi) * (y - yi) / CASE WHEN yj = yi THEN 1e-12 ELSE yj - yi END + xi THEN 1 ELSE 0 END) % 2 = 1"""


@query("lasso_selection", _LASSO_SQL, "points")
def _(spark, sf):
    return selection.lasso_select(points(spark, sf), LASSO)


@query(
    "selection_within_filter",
    "SELECT id FROM points WHERE x BETWEEN 0.25 AND 0.75 AND y BETWEEN 0.1 AND 0.6 AND id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "points",
)
def _(spark, sf):
    active = raw(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return selection.within_filter(selection.box_select(points(spark, sf), BOX), active)


@query("cluster_selection", "SELECT id FROM cells WHERE clustering = 4", "cells")
def _(spark, sf):
    c = cells(spark, sf)
    return selection.select_cluster(c, scalars.resolve_label(c.columns), 4)


@query("highlighted_cells", "SELECT id, cluster_L4 AS shown_label FROM cells WHERE cluster_L4 IN (1, 5, 9)", "cells")
def _(spark, sf):
    return selection.highlighted(cells(spark, sf), [1, 5, 9], "cluster_L4").select("id", "shown_label")


@query("valid_ids", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM cells)", "cells")
def _(spark, sf):
    return selection.valid_ids(raw(spark, sf, "orders").select(F.col("o_custkey").alias("id")), cells(spark, sf))


@query(
    "allow_list_filter",
    "SELECT id, clustering FROM cells WHERE id IN (SELECT p_partkey FROM part WHERE p_size > 10)",
    "cells",
)
def _(spark, sf):
    from tesselar.operators.neighbours import display_filter

    allowed = raw(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id"))
    return display_filter(cells(spark, sf).select("id", "clustering"), allowed)


@query(
    "region_of_point",
    "SELECT c.id, coalesce(max(region), -1) AS region FROM cells c LEFT JOIN regions r ON r.id = c.id GROUP BY c.id",
    "cells regions",
)
def _(spark, sf):
    return selection.region_of(cells(spark, sf).select("id"), regions(spark, sf))


@query("region_union", "SELECT DISTINCT id FROM regions", "regions")
def _(spark, sf):
    return selection.selection_of(regions(spark, sf))


@query(
    "region_append",
    "SELECT 0 AS region, id FROM regions WHERE region = 1 UNION ALL SELECT 1, id FROM cells WHERE clustering = 5",
    "regions cells",
)
def _(spark, sf):
    return selection.add_region(regions(spark, sf), cells(spark, sf).filter("clustering = 5").select("id"))


@query("region_replace", "SELECT 0 AS region, id FROM cells WHERE clustering = 5", "cells")
def _(spark, sf):
    return selection.add_region(regions(spark, sf), cells(spark, sf).filter("clustering = 5").select("id"), additive=False)


@query(
    "region_intersection",
    "SELECT id FROM regions WHERE region = 0 INTERSECT SELECT id FROM regions WHERE region = 1",
    "regions",
)
def _(spark, sf):
    r = regions(spark, sf)
    part = lambda i: r.filter(F.col("region") == i).select("id")
    return part(0).intersect(part(1))


@query("set_difference", "SELECT id FROM cells WHERE id NOT IN (SELECT id FROM regions)", "cells regions")
def _(spark, sf):
    return selection.difference(cells(spark, sf).select("id"), regions(spark, sf))


@query(
    "pinned_points",
    "SELECT id FROM points WHERE (id * 0.6180339887::DOUBLE) % 1 < 0.1 UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "points",
)
def _(spark, sf):
    p = points(spark, sf).select("id")
    visible = p.filter(scalars.sample_hash(F.col("id")) < 0.1)
    pins = raw(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return selection.with_pins(visible, p, pins)


@query(
    "available_labels",
    "SELECT DISTINCT clustering FROM cells WHERE clustering IS NOT NULL",
    "cells",
)
def _(spark, sf):
    return cells(spark, sf).select("clustering").filter("clustering is not null").distinct().orderBy("clustering")


@query("display_hash", "SELECT id, round((id * 0.6180339887::DOUBLE) % 1, 6) AS h FROM points", "points")
def _(spark, sf):
    return rounded(points(spark, sf).select("id", scalars.sample_hash(F.col("id")).alias("h")))


@query(
    "budget_sample",
    "SELECT id FROM points WHERE (id * 0.6180339887::DOUBLE) % 1 < least(1, 5000 * 0.25 / (SELECT count(*) FROM points))",
    "points",
)
def _(spark, sf):
    return detail.budget_sample(points(spark, sf).select("id"), 1, 0.25)


@query(
    "hash_capped_ids",
    "SELECT id FROM points ORDER BY (id * 2654435761) % 4294967296, id LIMIT 800",
    "points",
)
def _(spark, sf):
    return detail.hash_capped(points(spark, sf), detail.density_cap(2000))


_GROUP_CAPS = """g AS (SELECT label::BIGINT AS "group", vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 2654435761) % 4294967296, vec_id) AS r,
       count(*) OVER (PARTITION BY label) AS n FROM embeddings)"""


@query(
    "group_sizes_after_cap",
    f"""WITH {_GROUP_CAPS} SELECT "group", count(*) AS n FROM g WHERE r <= CASE WHEN n > 8000 THEN 5000 WHEN n > 2500 THEN 4000 ELSE 2500 END GROUP BY "group\"""",
)
def _(spark, sf):
    members = label_groups(spark, sf)
    n = F.col("n")
    cap = F.when(n > 8000, detail.group_cap(8001)).when(n > 2500, detail.group_cap(2501)).otherwise(detail.group_cap(1))
    caps = members.groupBy("group").agg(F.count("*").alias("n")).select("group", cap.alias("cap"))
    return detail.hash_capped_groups(members, caps).groupBy("group").agg(F.count("*").alias("n"))


@query("group_ids_after_cap", f"""WITH {_GROUP_CAPS} SELECT "group", id FROM g WHERE r <= n // 3""")
def _(spark, sf):
    members = label_groups(spark, sf)
    caps = members.groupBy("group").agg(F.floor(F.count("*") / 3).alias("cap"))
    return detail.hash_capped_groups(members, caps)


@query(
    "hash_capped_large_ids",
    "SELECT id + 4000000000 AS id FROM points ORDER BY ((id + 4000000000)::HUGEINT * 2654435761) % 4294967296, id LIMIT 800",
    "points",
)
def _(spark, sf):
    shifted = points(spark, sf).select((F.col("id") + 4_000_000_000).alias("id"))
    return detail.hash_capped(shifted, detail.density_cap(2000))
