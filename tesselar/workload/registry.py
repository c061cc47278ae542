"""Query registry and the SQL form of the logical tables."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: str = ""):
    """Register ``fn(spark, sf_dir)``; ``tables`` names the logical tables the SQL uses."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_tables(tables, sql)
        return fn

    return add


# Each entry: (tables it builds on, body).
LOGICAL: dict[str, tuple[str, str]] = {
    "feat": ("", "SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings"),
    "units": (
        "feat",
        "SELECT id, list_transform(e, lambda x: x / CASE WHEN sqrt(list_dot_product(e, e)) = 0 THEN 1 "
        "ELSE sqrt(list_dot_product(e, e)) END) AS v FROM feat",
    ),
    "mean_vec": (
        "units",
        "SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM "
        "(SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM units) GROUP BY i)",
    ),
    "diffs": (
        "units mean_vec",
        "SELECT id, list_transform(range(1, len(v) + 1), lambda i: v[i] - m[i]) AS d FROM units, mean_vec",
    ),
    "centred": (
        "diffs",
        "SELECT id, list_transform(d, lambda x: x / CASE WHEN sqrt(list_dot_product(d, d)) = 0 THEN 1 "
        "ELSE sqrt(list_dot_product(d, d)) END) AS v FROM diffs",
    ),
    "centre": (
        "mean_vec",
        "SELECT list_transform(m, lambda x: x / CASE WHEN sqrt(list_dot_product(m, m)) = 0 THEN 1 "
        "ELSE sqrt(list_dot_product(m, m)) END) AS c FROM mean_vec",
    ),
    "cells": (
        "",
        "SELECT vec_id AS id, label::BIGINT AS clustering, embedding[1]::DOUBLE AS umap2_x, embedding[2]::DOUBLE AS umap2_y, "
        "embedding[3]::DOUBLE AS umap3_x, embedding[4]::DOUBLE AS umap3_y, embedding[5]::DOUBLE AS umap3_z, "
        "(vec_id % 25) * 10 + embedding[6]::DOUBLE AS X_centroid, (vec_id // 25) * 10 + embedding[7]::DOUBLE AS Y_centroid, "
        "0::BIGINT AS cluster_L0, (label % 3)::BIGINT AS cluster_L1, ((label + vec_id) % 6)::BIGINT AS cluster_L2, "
        "label::BIGINT AS cluster_L3, ((label * 7 + vec_id) % 15)::BIGINT AS cluster_L4, "
        "((label * 3 + vec_id) % 20)::BIGINT AS cluster_L5 FROM embeddings",
    ),
    "levels": (
        "cells",
        " UNION ALL ".join(f"SELECT *, {i}::BIGINT AS level, cluster_L{i} AS cluster FROM cells" for i in range(6)),
    ),
    "pixels": (
        "",
        "SELECT (l_linenumber - 1)::BIGINT AS channel, l_partkey % (SELECT count(*) FROM embeddings) AS id, "
        "(l_partkey % (SELECT count(*) FROM embeddings)) // 64 AS chunk_id, (l_suppkey % 8) AS y, (l_orderkey % 8) AS x, "
        "floor(l_extendedprice)::BIGINT % 65536 AS value FROM lineitem",
    ),
    "annotations": (
        "",
        "SELECT p_partkey AS id, p_type AS celltype, p_brand AS neigh_names, p_size, p_retailprice FROM part",
    ),
    "regions": (
        "",
        "SELECT 0::BIGINT AS region, vec_id AS id FROM embeddings WHERE label IN (0, 1) "
        "UNION ALL SELECT 1::BIGINT, vec_id FROM embeddings WHERE label IN (1, 2)",
    ),
    "points": (
        "",
        "SELECT o_orderkey AS id, o_totalprice / 500000 AS x, (o_custkey % 997) / 997.0::DOUBLE AS y, o_totalprice AS score FROM orders",
    ),
    "reviews": (
        "",
        "SELECT event_id, (user_id % 6)::VARCHAR AS level, (user_id % 20)::VARCHAR AS cluster_id, event_type AS model, "
        "CASE event_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'unsure' ELSE 'corrected' END AS status, "
        "'title ' || event_id AS llm_title, CASE WHEN event_id % 5 = 0 THEN 'user ' || event_id ELSE '' END AS user_title, "
        "value / 10 AS llm_accuracy, floor(value) / 2 AS confidence, ts AS reviewed_at FROM events",
    ),
    "nn": (
        "units",
        "SELECT query, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank "
        "FROM (SELECT q.id AS query, t.id AS id, round(greatest(-1, least(1, list_dot_product(q.v, t.v))), 9) AS similarity "
        "FROM units q JOIN units t ON q.id <> t.id)) WHERE rank <= 8",
    ),
    "near_mean": (
        "nn units",
        "SELECT query, list(m ORDER BY i) AS m FROM (SELECT query, i, avg(x) AS m FROM (SELECT nn.query, unnest(v) AS x, "
        "unnest(range(1, len(v) + 1)) AS i FROM nn JOIN units USING (id)) GROUP BY query, i) GROUP BY query",
    ),
    "local": (
        "near_mean nn units",
        "SELECT nn.query, avg(list_distance(u.v, m)) AS compactness, max(list_distance(q.v, m)) AS difference "
        "FROM nn JOIN units u USING (id) JOIN near_mean nm ON nm.query = nn.query JOIN units q ON q.id = nn.query GROUP BY nn.query",
    ),
    # Neighbours on the 2-D projection, and the local structure that follows.
    "nn_plane": (
        "cells units",
        "SELECT query, n.id AS id, greatest(-1, least(1, list_dot_product(a.v, b.v))) AS similarity, rank FROM "
        "(SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM (SELECT q.id AS query, t.id AS id, "
        "round(sqrt((q.umap2_x - t.umap2_x) * (q.umap2_x - t.umap2_x) + (q.umap2_y - t.umap2_y) * (q.umap2_y - t.umap2_y)), 9) AS d "
        "FROM cells q JOIN cells t ON q.id <> t.id)) n JOIN units a ON a.id = n.query JOIN units b ON b.id = n.id WHERE rank <= 8",
    ),
    "plane_mean": (
        "nn_plane units",
        "SELECT query, list(m ORDER BY i) AS m FROM (SELECT query, i, avg(x) AS m FROM (SELECT n.query, unnest(v) AS x, "
        "unnest(range(1, len(v) + 1)) AS i FROM nn_plane n JOIN units USING (id)) GROUP BY query, i) GROUP BY query",
    ),
    "local_plane": (
        "plane_mean nn_plane units",
        "SELECT n.query, avg(list_distance(u.v, m)) AS compactness, max(list_distance(q.v, m)) AS difference "
        "FROM nn_plane n JOIN units u USING (id) JOIN plane_mean p ON p.query = n.query JOIN units q ON q.id = n.query GROUP BY n.query",
    ),
    # Label groups in the centred space: members, unit centroids, member scores.
    "grp": ("", "SELECT label::BIGINT AS \"group\", vec_id AS id FROM embeddings"),
    "gmean": (
        "grp centred",
        "SELECT \"group\", list(m ORDER BY i) AS m FROM (SELECT \"group\", i, avg(x) AS m FROM (SELECT \"group\", unnest(v) AS x, "
        "unnest(range(1, len(v) + 1)) AS i FROM grp JOIN centred USING (id)) GROUP BY ALL) GROUP BY \"group\"",
    ),
    "gcent": (
        "gmean",
        "SELECT \"group\", list_transform(m, lambda x: x / CASE WHEN sqrt(list_dot_product(m, m)) = 0 THEN 1 "
        "ELSE sqrt(list_dot_product(m, m)) END) AS c FROM gmean",
    ),
    "gscore": (
        "grp centred gcent",
        "SELECT \"group\", id, list_distance(v, c) AS distance, greatest(-1, least(1, list_dot_product(v, c))) AS similarity "
        "FROM grp JOIN centred USING (id) JOIN gcent USING (\"group\")",
    ),
    "lmeans": ("levels", "SELECT level, cluster, avg(umap2_x) AS mx, avg(umap2_y) AS my FROM levels GROUP BY ALL"),
    "lranks": (
        "levels lmeans",
        "SELECT *, row_number() OVER (PARTITION BY level, cluster ORDER BY distance, id) - 1 AS rank FROM "
        "(SELECT l.*, round(sqrt((umap2_x - mx) * (umap2_x - mx) + (umap2_y - my) * (umap2_y - my)), 9) AS distance "
        "FROM levels l JOIN lmeans USING (level, cluster))",
    ),
    "votes": (
        "cells",
        " UNION ALL ".join(
            f"SELECT {i}::BIGINT AS level, cluster_L{i} AS cluster, cluster_L{i - 1} AS parent, count(*) AS n, min(id) AS f "
            f"FROM cells GROUP BY ALL" for i in range(1, 6)
        ),
    ),
    "parents": (
        "votes",
        "SELECT level, cluster, level - 1 AS parent_level, parent AS parent_cluster FROM (SELECT *, row_number() OVER "
        "(PARTITION BY level, cluster ORDER BY n DESC, f) AS r FROM votes) WHERE r = 1 UNION ALL SELECT 0, 0, -1, -1",
    ),
    "means": (
        "levels pixels",
        "SELECT level, cluster, channel, avg(value) AS avg FROM levels JOIN pixels USING (id) GROUP BY ALL",
    ),
    "zscores": (
        "means",
        "SELECT *, (avg - avg(avg) OVER w) / CASE WHEN stddev_samp(avg) OVER w = 0 THEN 1 ELSE stddev_samp(avg) OVER w END AS z "
        "FROM means WINDOW w AS (PARTITION BY level, channel)",
    ),
    "counts": ("pixels", "SELECT channel, value, count(*) AS n FROM pixels GROUP BY ALL"),
}


def with_tables(names: str, sql: str) -> str:
    """Prefix ``sql`` with the CTEs of the named logical tables and what they build on."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in LOGICAL[n][0].split():
            visit(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        visit(n)
    sql = sql.strip()
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS (SELECT * FROM ({LOGICAL[n][1]}))" for n in order)
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{sql[15:]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"
