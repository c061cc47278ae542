"""Annotation composition, labels and reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselar.functions import text
from tesselar.operators import clusters, composition, outlines
from tesselar.plans import profiles
from tesselar.sources import annotations as ann_source
from tesselar.sources import documents
from tesselar.workload.registry import query
from tesselar.workload.tables import annotations, cells, raw, regions, reviews, rounded

_KEYS = "k AS (SELECT id, 'celltype' AS kind, celltype AS key FROM annotations WHERE lower(celltype) <> 'unknown' UNION ALL SELECT id, 'neigh_names', neigh_names FROM annotations)"


def _pct(c: str) -> str:
    return f"round(CASE WHEN sum({c}) OVER (PARTITION BY kind) > 0 THEN {c} / sum({c}) OVER (PARTITION BY kind) * 100.0 ELSE 0 END, 6) AS {c}_pct"


@query(
    "annotation_composition",
    f"""WITH {_KEYS}, c AS (SELECT kind, key, count(*) AS everything, count(s.id) AS selected FROM k LEFT JOIN (SELECT DISTINCT id FROM regions) s ON s.id = k.id GROUP BY ALL)
        SELECT *, {_pct('everything')}, {_pct('selected')} FROM c""",
    "annotations regions",
)
def _(spark, sf):
    return rounded(composition.composition(annotations(spark, sf), regions(spark, sf)))


@query(
    "region_composition",
    f"""WITH {_KEYS}, c AS (SELECT kind, key, count(*) AS everything, count(a.id) AS region1, count(b.id) AS region2 FROM k
        LEFT JOIN (SELECT id FROM regions WHERE region = 0) a ON a.id = k.id LEFT JOIN (SELECT id FROM regions WHERE region = 1) b ON b.id = k.id GROUP BY ALL
        HAVING count(a.id) > 0 OR count(b.id) > 0)
        SELECT *, {_pct('everything')}, {_pct('region1')}, {_pct('region2')} FROM c""",
    "annotations regions",
)
def _(spark, sf):
    return rounded(composition.region_composition(annotations(spark, sf), regions(spark, sf)))


_SCORE = "least(5, greatest(0, round_even({}, 0)))::INT"


@query(
    "review_validation",
    f"""SELECT event_id, status, {_SCORE.format('llm_accuracy')} AS llm_accuracy, {_SCORE.format('confidence')} AS confidence FROM
        (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN 'maybe' ELSE status END AS status, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE model END AS model) FROM reviews)
        WHERE status <> 'maybe' AND trim(model) <> ''""",
    "reviews",
)
def _(spark, sf):
    i = F.col("event_id")
    r = reviews(spark, sf).withColumns(
        {"status": F.when(i % 7 == 0, "maybe").otherwise(F.col("status")), "model": F.when(i % 9 == 0, " ").otherwise(F.col("model"))}
    )
    good, _bad = composition.valid_reviews(r)
    return good.select("event_id", "status", "llm_accuracy", "confidence")


_LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, cluster_id, model ORDER BY reviewed_at DESC, event_id DESC) AS r FROM reviews) WHERE r = 1"""


@query("latest_reviews", f"SELECT level, cluster_id, model, event_id, status, llm_title, user_title FROM ({_LATEST})", "reviews")
def _(spark, sf):
    r = composition.latest_reviews(reviews(spark, sf), "event_id")
    return r.select("level", "cluster_id", "model", "event_id", "status", "llm_title", "user_title")


@query(
    "review_display",
    f"""SELECT level, cluster_id, model, ds AS display_status, CASE WHEN ds = 'corrected' AND user_title <> '' THEN user_title ELSE llm_title END AS display_title,
        (ds = 'rejected')::INT AS strikethrough, (ds IN ('accepted', 'corrected'))::INT AS is_confirmed FROM
        (SELECT *, CASE WHEN status = 'accepted' AND trim(user_title) <> '' THEN 'corrected' ELSE status END AS ds FROM ({_LATEST}))""",
    "reviews",
)
def _(spark, sf):
    r = composition.latest_reviews(reviews(spark, sf), "event_id").withColumnRenamed("llm_title", "title")
    return composition.review_display(r).select("level", "cluster_id", "model", "display_status", "display_title", "strikethrough", "is_confirmed")


@query(
    "label_documents",
    """SELECT (event_id % 6)::VARCHAR AS level, (user_id % 20)::VARCHAR AS cluster_id, event_type AS model, 'title ' || event_id AS title, 'seen "' || value || '"' AS description
       FROM events WHERE event_id % 10 <> 0""",
)
def _(spark, sf):
    e = raw(spark, sf, "events")
    entry = F.struct(F.concat(F.lit("title "), F.col("event_id").cast("string")).alias("title"), F.concat(F.lit('seen "'), F.col("value").cast("string"), F.lit('"')).alias("description"))
    doc = F.to_json(F.struct(F.create_map(
        (F.col("event_id") % 6).cast("string"),
        F.create_map((F.col("user_id") % 20).cast("string"), F.struct(F.create_map("event_type", entry).alias("models"))),
    ).alias("levels")))
    docs = e.select(F.when(F.col("event_id") % 20 == 0, "not json").when(F.col("event_id") % 10 == 0, '{"labels": 1}').otherwise(doc).alias("doc"))
    return documents.label_documents(docs)[0]


@query(
    "label_documents_rejected",
    "SELECT event_id, CASE WHEN event_id % 20 = 0 THEN 'not json' ELSE '{\"labels\": 1}' END AS doc FROM events WHERE event_id % 10 = 0",
)
def _(spark, sf):
    docs = raw(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 20 == 0, "not json").when(F.col("event_id") % 10 == 0, '{"labels": 1}').otherwise('{"levels": {}}').alias("doc"),
    )
    return documents.label_documents(docs)[1]


@query(
    "label_document_roundtrip",
    "SELECT level, cluster_id, model, llm_title AS title, user_title AS description FROM (" + _LATEST + ")",
    "reviews",
)
def _(spark, sf):
    r = composition.latest_reviews(reviews(spark, sf), "event_id").select("level", "cluster_id", "model", F.col("llm_title").alias("title"), F.col("user_title").alias("description"))
    return documents.label_documents(documents.label_document(r))[0]


@query(
    "review_documents",
    f"""SELECT level, cluster_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN event_type ELSE '_legacy' END ELSE event_type END AS model, status, llm_title, user_title,
        {_SCORE.format('llm_accuracy')} AS llm_accuracy FROM (SELECT r.*, model AS event_type FROM reviews r)""",
    "reviews",
)
def _(spark, sf):
    r = reviews(spark, sf)
    i = F.col("event_id")
    legacy_model = F.when((i % 3 == 0) & (i % 2 == 1), F.lit(None)).otherwise(F.col("model"))
    entry = F.struct("status", "llm_title", legacy_model.alias("llm_model"), "user_title", "llm_accuracy", "confidence")
    flat = F.to_json(F.create_map("level", F.create_map("cluster_id", entry)))
    nested = F.to_json(F.create_map("level", F.create_map("cluster_id", F.create_map("model", entry))))
    docs = r.select(F.concat(F.lit('{"version":1,"levels":'), F.when(i % 3 == 0, flat).otherwise(nested), F.lit("}")).alias("doc"))
    return documents.review_documents(docs).select("level", "cluster_id", "model", "status", "llm_title", "user_title", "llm_accuracy")


@query(
    "cluster_names_export",
    """SELECT clustering, name, clustering || ',' || CASE WHEN regexp_matches(name, '[",]') THEN '"' || replace(name, '"', '""') || '"' ELSE name END AS line FROM
       (SELECT c.clustering, trim(coalesce(CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_name || ', "' || p_type || '" ' ELSE p_name END, '')) AS name
       FROM (SELECT DISTINCT p_partkey // 2 AS clustering FROM part) c LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p ON p.p_partkey = c.clustering)""",
)
def _(spark, sf):
    p = raw(spark, sf, "part")
    labels = p.select(F.floor(F.col("p_partkey") / 2).cast("bigint").alias("clustering"))
    named = p.filter("p_size > 5").select(
        F.col("p_partkey").alias("clustering"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_name", F.lit(', "'), "p_type", F.lit('" '))).otherwise(F.col("p_name")).alias("name"),
    )
    return documents.cluster_names(labels, named)


_DESC = """d AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_name || ' (low: 0, high: ' || p_size || ')' WHEN 1 THEN p_name || ' (' || p_type || ')'
  WHEN 2 THEN ' ' || p_brand || ' (a) (x: "q", y: ' || p_size || ')' WHEN 3 THEN '(' || p_brand || ')' WHEN 4 THEN p_name || ') (' ELSE p_name || ' ( )' END AS s FROM part),
b AS (SELECT id, trim(s) AS s, regexp_matches(trim(s), '(?s)^(.*)\\(([^(]*)\\)[^()]*$') AS hit FROM d),
r AS (SELECT id, CASE WHEN hit AND trim(regexp_extract(s, '(?s)^(.*)\\(([^(]*)\\)[^()]*$', 1)) <> '' THEN trim(regexp_extract(s, '(?s)^(.*)\\(([^(]*)\\)[^()]*$', 1)) ELSE s END AS base,
  CASE WHEN hit THEN nullif(trim(regexp_extract(s, '(?s)^(.*)\\(([^(]*)\\)[^()]*$', 2)), '') END AS description FROM b)"""


def _described(spark, sf):
    i = F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    s = (
        F.when(i == 0, F.concat("p_name", F.lit(" (low: 0, high: "), size, F.lit(")")))
        .when(i == 1, F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")))
        .when(i == 2, F.concat(F.lit(" "), "p_brand", F.lit(' (a) (x: "q", y: '), size, F.lit(")")))
        .when(i == 3, F.concat(F.lit("("), "p_brand", F.lit(")")))
        .when(i == 4, F.concat("p_name", F.lit(") (")))
        .otherwise(F.concat("p_name", F.lit(" ( )")))
    )
    return raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), s.alias("s"))


@query("column_descriptors", f"WITH {_DESC} SELECT id, base, description FROM r")
def _(spark, sf):
    return _described(spark, sf).select("id", text.descriptor(F.col("s")).alias("d")).select("id", "d.base", "d.description")


@query(
    "description_choices",
    f"""WITH {_DESC}, p AS (SELECT id, unnest(string_split_regex(description, '\\s*,\\s*')) AS part, list_bool_and(list_transform(string_split_regex(description, '\\s*,\\s*'), lambda x: contains(x, ':'))) AS ok FROM r WHERE description IS NOT NULL)
        SELECT id, trim(regexp_extract(part, '(?s)^(.*?):\\s*(.*)$', 1)) AS label, CASE WHEN TRY_CAST(trim(regexp_extract(part, '(?s)^(.*?):\\s*(.*)$', 2)) AS DOUBLE) IS NULL
        THEN regexp_replace(trim(regexp_extract(part, '(?s)^(.*?):\\s*(.*)$', 2)), '^["'']|["'']$', '', 'g') END AS text,
        TRY_CAST(trim(regexp_extract(part, '(?s)^(.*?):\\s*(.*)$', 2)) AS DOUBLE) AS number FROM p WHERE ok""",
)
def _(spark, sf):
    d = _described(spark, sf).select("id", text.descriptor(F.col("s"))["description"].alias("d"))
    return d.select("id", F.explode(text.choices(F.col("d"))).alias("c")).select("id", "c.label", "c.text", "c.number")


@query(
    "annotation_schema",
    f"""WITH {_DESC}, a AS (SELECT id, base, description, id % 3 = 0 AS num, trim(regexp_replace(regexp_replace(lower(CASE WHEN trim(regexp_extract(base, '^([^(]*)', 1)) <> '' THEN trim(regexp_extract(base, '^([^(]*)', 1)) ELSE trim(base) END), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS al FROM r),
        n AS (SELECT *, CASE WHEN al = '' THEN 'col' ELSE al END AS alias0, row_number() OVER (PARTITION BY CASE WHEN al = '' THEN 'col' ELSE al END ORDER BY id) AS k FROM a)
        SELECT id AS ordinal, base AS name, CASE WHEN contains(description, ':') THEN 'categorical' WHEN num THEN 'numeric' ELSE 'categorical' END AS type, coalesce(description, '') AS description,
        CASE WHEN k > 1 THEN alias0 || '_' || k ELSE alias0 END AS alias FROM n""",
)
def _(spark, sf):
    names = _described(spark, sf).select(F.col("id").alias("ordinal"), F.col("s").alias("raw_name"), (F.col("id") % 3 == 0).alias("is_number"))
    return ann_source.describe_columns(names).drop("raw_name")


@query(
    "annotation_columns_inferred",
    """SELECT 'celltype' AS raw_name, 0 AS is_number UNION ALL SELECT 'neigh_names', 0 UNION ALL SELECT 'p_size', 1 UNION ALL SELECT 'p_retailprice', 1""",
)
def _(spark, sf):
    a = annotations(spark, sf)
    texts = a.select(*[F.col(c).cast("string").alias(c) for c in a.columns if c != "id"])
    return ann_source.infer_numeric(texts, texts.columns).select("raw_name", F.col("is_number").cast("int").alias("is_number"))


@query("annotation_presence", "SELECT 1 AS celltype, 1 AS neigh_names FROM annotations LIMIT 1", "annotations")
def _(spark, sf):
    a = annotations(spark, sf)
    texts = a.select(*[F.col(c).cast("string").alias(c) for c in a.columns if c != "id"])
    kinds = ann_source.infer_numeric(texts, texts.columns)
    names = kinds.select(F.row_number().over(Window.orderBy("raw_name")).alias("ordinal"), "raw_name", "is_number")
    return ann_source.present_annotation_columns(ann_source.describe_columns(names))


@query(
    "annotation_rows",
    """SELECT id, 'celltype' AS key, celltype AS value FROM annotations UNION ALL SELECT id, 'neigh_names', neigh_names FROM annotations
       UNION ALL SELECT id, 'p_size', p_size::VARCHAR FROM annotations
       UNION ALL SELECT id, 'p_retailprice', round(p_retailprice * 100)::BIGINT::VARCHAR FROM annotations""",
    "annotations",
)
def _(spark, sf):
    rows = ann_source.annotation_rows(annotations(spark, sf)).select("id", F.explode("raw").alias("key", "value"))
    # Engines spell decimals differently, so the price is compared in cents.
    cents = F.round(F.col("value").try_cast("double") * 100).cast("bigint").cast("string")
    return rows.withColumn("value", F.when(F.col("key") == "p_retailprice", cents).otherwise(F.col("value")))


@query(
    "core_metadata",
    """SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 10.0::DOUBLE AS y, c_name, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0""",
)
def _(spark, sf):
    r = ann_source.core_metadata(_core_raw(spark, sf))
    return r.select("id", "x", "y", F.element_at("values", "c_name").alias("c_name"), F.element_at("values", "c_mktsegment").alias("c_mktsegment"))


def _core_raw(spark, sf):
    k = F.col("c_custkey")
    return raw(spark, sf, "customer").select(
        F.when(k % 11 == 0, "core").otherwise(k.cast("string")).alias("CORE_ID"),
        F.when(k % 13 == 0, "NaN").otherwise(F.col("c_acctbal").cast("string")).alias("global_X"),
        F.when(k % 17 == 0, "").otherwise((F.col("c_nationkey") * 10).cast("string")).alias("global_Y"),
        "c_name",
        "c_mktsegment",
    )


_CORE = """k AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 10.0::DOUBLE AS y, c_name, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0),
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM k),
f AS (SELECT *, least({w} * 0.92 / greatest(1, x1 - x0), {h} * 0.92 / greatest(1, y1 - y0)) AS s, x1 <= {w} * 1.04 AND x0 >= -{w} * 0.04 AND y1 <= {h} * 1.04 AND y0 >= -{h} * 0.04 AS fits FROM b)
SELECT id, round(CASE WHEN fits THEN x ELSE x * s + ({w} * 0.04 - x0 * s) END, 6) AS x, round(CASE WHEN fits THEN y ELSE y * s + ({h} * 0.04 - y0 * s) END, 6) AS y,
round({h} - CASE WHEN fits THEN y ELSE y * s + ({h} * 0.04 - y0 * s) END, 6) AS world_y, c_name || chr(10) || c_mktsegment AS text FROM k, f"""


@query("core_labels_scaled", "WITH " + _CORE.format(w="640.0::DOUBLE", h="480.0::DOUBLE"))
def _(spark, sf):
    return rounded(composition.core_labels(ann_source.core_metadata(_core_raw(spark, sf)), ["c_name", "c_mktsegment"], 640.0, 480.0, 480.0))


@query("core_labels_fitting", "WITH " + _CORE.format(w="60000.0::DOUBLE", h="40000.0::DOUBLE"))
def _(spark, sf):
    return rounded(composition.core_labels(ann_source.core_metadata(_core_raw(spark, sf)), ["c_name", "c_mktsegment"], 60000.0, 40000.0, 40000.0))


@query(
    "model_responses",
    """WITH d AS (SELECT conv_id, turn, conv_id * 100 + turn AS k, replace(replace(text, '"', ' '), '\\', ' ') AS t, text FROM conversations),
       e AS (SELECT conv_id, turn, k, text, replace(replace(substr(t, 1, 5), chr(10), ' '), chr(13), ' ') AS s5 FROM d)
       SELECT conv_id, turn, CASE k % 4 WHEN 0 THEN 'Title ' || k WHEN 1 THEN 'Title ' || k WHEN 2 THEN 'Phenotype-enriched cluster' ELSE 'Line ' || k END AS title,
       CASE k % 4 WHEN 0 THEN 'About ' || k WHEN 1 THEN 'Near ' || k WHEN 2 THEN 'This cluster likely represents a coherent cell population with distinctive phenotypic patterns in imaging-derived embeddings. Please validate with spatial context and additional markers.'
       ELSE CASE WHEN body = '' THEN 'Line ' || k WHEN length(trim(body)) < 3 OR trim(body) = '...' THEN 'This cluster likely represents a coherent cell population with distinctive phenotypic patterns in imaging-derived embeddings. Please validate with spatial context and additional markers.' ELSE body END END AS description,
       (k % 4 >= 2)::INT AS needs_retry FROM (SELECT *, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS body FROM e)""",
)
def _(spark, sf):
    k = F.col("conv_id") * 100 + F.col("turn")
    ks = k.cast("string")
    strict = F.concat(F.lit('{"title": "Title '), ks, F.lit('", "description": "About '), ks, F.lit('"}'))
    prose = F.concat(F.lit('Here is the answer: {"title": "Title '), ks, F.lit('", "description": "Near '), ks, F.lit('"} as asked.'))
    answer = F.when(k % 4 == 0, strict).when(k % 4 == 1, prose).when(k % 4 == 2, F.lit("...")).otherwise(F.concat(F.lit("Line "), ks, F.lit("\n"), F.trim("text", F.lit(" \n\t\r"))))
    r = raw(spark, sf, "conversations").select(
        F.col("conv_id").alias("level"), F.col("turn").alias("cluster_id"), F.lit("m").alias("model"), answer.alias("text")
    )
    out = profiles.labels_from_responses(r)
    return out.select(F.col("level").alias("conv_id"), F.col("cluster_id").alias("turn"), "title", "description", F.col("needs_retry").cast("int").alias("needs_retry"))


_HULL = """p AS (SELECT clustering AS label, umap2_x AS x, umap2_y AS y, id FROM cells),
  e AS (SELECT a.label, a.id, a.x, a.y FROM p a JOIN p b ON a.label = b.label AND a.id <> b.id JOIN p c ON c.label = a.label
    GROUP BY a.label, a.id, a.x, a.y, b.id HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= 0)"""


@query("cluster_hulls", f"WITH {_HULL} SELECT DISTINCT label, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM e", "cells")
def _(spark, sf):
    pts = cells(spark, sf).select(F.col("clustering").alias("label"), F.col("umap2_x").alias("x"), F.col("umap2_y").alias("y"))
    return rounded(outlines.cluster_hulls(pts).select("label", "x", "y"))


@query(
    "cluster_outlines",
    f"WITH {_HULL} SELECT p.label, count(*) AS n, round(avg(x), 6) + 0.0 AS center_x, round(avg(y), 6) + 0.0 AS center_y, any_value(v) + 1 AS vertices FROM p JOIN (SELECT label, count(DISTINCT id) AS v FROM e GROUP BY label) USING (label) GROUP BY p.label",
    "cells",
)
def _(spark, sf):
    pts = cells(spark, sf).select(F.col("clustering").alias("label"), F.col("umap2_x").alias("x"), F.col("umap2_y").alias("y"))
    o = outlines.cluster_outlines(pts)
    return rounded(o.select("label", "n", "center_x", "center_y", F.size("path").cast("bigint").alias("vertices")))


@query(
    "annotated_cluster_labels",
    f"""WITH lt AS ({_LATEST}), o AS (SELECT cluster_L5 AS label, count(*) AS n, avg(umap2_x) AS x, avg(umap2_y) AS y FROM cells GROUP BY ALL HAVING count(*) >= 3),
        v AS (SELECT l.cluster_L5 AS label, kind, value, count(*) AS n, min(l.id) AS f FROM cells l JOIN (SELECT id, 'celltype' AS kind, celltype AS value FROM annotations UNION ALL SELECT id, 'neigh_names', neigh_names FROM annotations) a USING (id) GROUP BY ALL),
        d AS (SELECT label, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY label, kind ORDER BY n DESC, f) AS r FROM v) WHERE r = 1)
        SELECT o.label, n, round(x, 6) + 0.0 AS center_x, round(100 - y, 6) AS center_y, lt.llm_title AS title, c.value AS dominant_celltype, g.value AS dominant_neigh_names,
        CASE WHEN status = 'accepted' AND trim(user_title) <> '' THEN 'corrected' ELSE status END AS display_status
        FROM o JOIN lt ON lt.level = '5' AND lt.model = 'click' AND lt.cluster_id = o.label::VARCHAR LEFT JOIN d c ON c.label = o.label AND c.kind = 'celltype' LEFT JOIN d g ON g.label = o.label AND g.kind = 'neigh_names'""",
    "reviews cells annotations",
)
def _(spark, sf):
    c = cells(spark, sf)
    pts = c.select(F.col("cluster_L5").alias("label"), F.col("umap2_x").alias("x"), F.col("umap2_y").alias("y"))
    r = composition.latest_reviews(reviews(spark, sf), "event_id")
    labels = r.select("level", "cluster_id", "model", F.col("llm_title").alias("title"), F.lit("").alias("description"))
    dom = clusters.dominant_annotation(c, annotations(spark, sf), ["celltype", "neigh_names"])
    view = profiles.label_view(pts, labels, dom, r, 5, "click", 100.0)
    return rounded(view.select("label", "n", "center_x", "center_y", "title", "dominant_celltype", "dominant_neigh_names", "display_status"))
