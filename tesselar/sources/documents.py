"""JSON stores: cluster labels and reviews; CSV exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar import schemas
from tesselar.functions import scalars


def label_documents(docs: DataFrame, text_col: str = "doc") -> tuple[DataFrame, DataFrame]:
    """Rows ``(level, cluster_id, model, title, description)`` and the rejected documents.

    A document is valid when it is an object with a ``levels`` object.
    """
    parsed = docs.withColumn("_p", F.from_json(text_col, schemas.LABEL_DOCUMENT))
    ok = F.col("_p.levels").isNotNull()
    rows = (
        parsed.filter(ok)
        .select(F.explode("_p.levels").alias("level", "_clusters"))
        .select("level", F.explode("_clusters").alias("cluster_id", "_c"))
        .select("level", "cluster_id", F.explode("_c.models").alias("model", "_m"))
        .select("level", "cluster_id", "model", "_m.title", "_m.description")
    )
    return rows, parsed.filter(~F.coalesce(ok, F.lit(False))).drop("_p")


def label_document(labels: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Label rows as one document per group (a hierarchy has few clusters, so a document is small)."""
    g = list(group_cols or [])
    as_map = lambda key, value: F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), value))))
    models = labels.groupBy(*g, "level", "cluster_id").agg(as_map("model", F.struct("title", "description")).alias("models"))
    # A sorted list needs comparable elements, so the inner maps enter it as text and are parsed once more at the end.
    inner = "struct<models: map<string, struct<title: string, description: string>>>"
    clusters = models.groupBy(*g, "level").agg(as_map("cluster_id", F.to_json(F.struct("models"))).alias("c"))
    parsed = clusters.withColumn("c", F.transform_values("c", lambda _, v: F.from_json(v, inner))).withColumn("c", F.to_json("c"))
    levels = parsed.groupBy(*g).agg(as_map("level", F.col("c")).alias("l"))
    whole = F.transform_values("l", lambda _, v: F.from_json(v, f"map<string, {inner}>"))
    return levels.select(*g, F.to_json(F.struct(whole.alias("levels"))).alias("doc"))


def review_documents(docs: DataFrame, text_col: str = "doc") -> DataFrame:
    """Review rows from stored documents; an entry kept directly under its cluster moves under its model."""
    parsed = docs.select(
        F.explode(F.from_json(text_col, "struct<levels: map<string, map<string, string>>>")["levels"]).alias("level", "_c")
    ).select("level", F.explode("_c").alias("cluster_id", "_raw"))
    status = F.get_json_object("_raw", "$.status")
    model = F.coalesce(F.nullif(F.get_json_object("_raw", "$.llm_model"), F.lit("")), F.lit("_legacy"))
    per_model = F.when(status.isNotNull(), F.create_map(model, F.col("_raw"))).otherwise(
        F.from_json("_raw", "map<string,string>")
    )
    entry = parsed.select("level", "cluster_id", F.explode(per_model).alias("model", "_e"))
    field = lambda name: F.get_json_object("_e", f"$.{name}")
    return entry.filter(field("status").isNotNull()).select(
        "level",
        "cluster_id",
        "model",
        field("status").alias("status"),
        field("llm_title").alias("llm_title"),
        field("user_title").alias("user_title"),
        scalars.review_score(field("llm_accuracy")).alias("llm_accuracy"),
        scalars.review_score(field("confidence")).alias("confidence"),
        field("reviewed_at").try_cast("timestamp").alias("reviewed_at"),
    )


def csv_field(c: Column) -> Column:
    """Quote a value only when it holds a quote, comma or line break."""
    v = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(v.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def cluster_names(labels: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct labels with their trimmed display names and the rendered CSV line, in label order."""
    d = labels.select("clustering").filter("clustering is not null").distinct()
    out = d.join(names.select("clustering", "name"), "clustering", "left").select(
        "clustering", F.trim(F.coalesce("name", F.lit(""))).alias("name")
    )
    return out.withColumn(
        "line", F.concat_ws(",", F.col("clustering").cast("string"), csv_field(F.col("name")))
    ).orderBy("clustering")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_cluster_averages(spark, path: str) -> DataFrame:
    """Wide cluster averages; raises when the key columns are missing."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    missing = {"level_id", "cluster_id"} - set(df.columns)
    if missing:
        raise ValueError(f"cluster averages lack the columns {sorted(missing)}")
    return df


def review_document(reviews: DataFrame, updated_at: Column, version: int = schemas.REVIEW_VERSION) -> DataFrame:
    """Review rows as one stored document: version, update stamp and entries by level, cluster and model.

    The latest review of an entry wins.  ``updated_at`` is a timestamp column or literal, written in UTC.
    """
    fields = ["status", "llm_title", "user_title", "llm_accuracy", "confidence", "reviewed_at"]
    newest = reviews.groupBy("level", "cluster_id", "model").agg(
        F.max_by(F.to_json(F.struct(*[F.col(c).alias(c) for c in fields])), F.struct(F.col("reviewed_at").isNotNull(), F.col("reviewed_at"), "status")).alias("e")
    )
    text_map = lambda key, value: F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))))))
    per_cluster = newest.groupBy("level", "cluster_id").agg(text_map("model", "e").alias("m"))
    per_level = per_cluster.groupBy("level").agg(text_map("cluster_id", "m").alias("c"))
    levels = per_level.agg(F.coalesce(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("level").cast("string").alias("k"), F.col("c").alias("v"))))), F.create_map().cast("map<string,string>")).alias("l"))
    entry = "struct<status: string, llm_title: string, user_title: string, llm_accuracy: double, confidence: double, reviewed_at: string>"
    model = F.transform_values("l", lambda _, c: F.transform_values(
        F.from_json(c, "map<string,string>"), lambda _, m: F.transform_values(F.from_json(m, "map<string,string>"), lambda _, e: F.from_json(e, entry)),
    ))
    stamp = F.date_format(updated_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return levels.select(F.to_json(F.struct(F.lit(version).alias("version"), stamp.alias("updated_at"), model.alias("levels"))).alias("doc"))
