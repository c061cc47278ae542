"""Column-name descriptors, aliases, prompt text and model-response text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# ---- fixed values -------------------------------------------------------------------------
DEFAULT_TITLE = "Phenotype-enriched cluster"
DEFAULT_DESCRIPTION = (
    "This cluster likely represents a coherent cell population with distinctive phenotypic patterns "
    "in imaging-derived embeddings. Please validate with spatial context and additional markers."
)
TITLE_LENGTH = 80
# Patterns that column names and choice lists must match.
DESCRIPTOR = r"(?s)^(.*)\(([^(]*)\)[^()]*$"
CHOICE_GAP, CHOICE = r"\s*,\s*", r"(?s)^(.*?):\s*(.*)$"
ALIAS_HEAD, ALIAS_GAP, ALIAS_EDGE = r"(?s)^([^(]*)", "[^a-z0-9]+", "^_+|_+$"
# -------------------------------------------------------------------------------------------


def fixed_text(c: Column | str, digits: int) -> Column:
    """Number text with fixed decimals, rounded on the exact binary value (halves to even).

    JVM formatting rounds the shortest decimal text instead; used for small prompt tables only.
    """

    @arrow_udf(T.StringType())
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f"{x:.{digits}f}" for x in v.to_pylist()], pa.string())

    return run(c)


def descriptor(name: Column) -> Column:
    """Split ``"base (description)"`` at the last bracket pair into ``struct(base, description)``."""
    s = F.trim(F.coalesce(name, F.lit("")))
    hit = s.rlike(DESCRIPTOR)
    base = F.when(hit, F.trim(F.regexp_extract(s, DESCRIPTOR, 1))).otherwise(s)
    desc = F.when(hit, F.trim(F.regexp_extract(s, DESCRIPTOR, 2)))
    return F.struct(
        F.when(base != "", base).otherwise(s).alias("base"),
        F.when(desc != "", desc).alias("description"),
    )


def choices(description: Column) -> Column:
    """``"low: 0, high: 1"`` as an array of ``struct(label, text, number)``; NULL unless every part fits."""
    parts = F.split(description, CHOICE_GAP)

    def entry(p: Column) -> Column:
        raw = F.trim(F.regexp_extract(p, CHOICE, 2))
        number = F.when(raw == "", F.lit(0.0)).otherwise(raw.try_cast("double"))
        number = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
        text = F.when(number.isNull(), F.regexp_replace(raw, "^['\"]|['\"]$", ""))
        return F.struct(
            F.trim(F.regexp_extract(p, CHOICE, 1)).alias("label"), text.alias("text"), number.alias("number")
        )

    ok = F.forall(parts, lambda p: p.contains(":"))
    return F.when(description.isNotNull() & (description != "") & ok, F.transform(parts, entry))


def alias_of(name: Column) -> Column:
    """Lower-case identifier of a column name, without its bracketed tail."""
    s = F.coalesce(name, F.lit(""))
    head = F.trim(F.regexp_extract(s, ALIAS_HEAD, 1))
    base = F.lower(F.when(head != "", head).otherwise(F.trim(s)))
    a = F.regexp_replace(base, ALIAS_GAP, "_")
    a = F.regexp_replace(a, ALIAS_EDGE, "")
    return F.when(a != "", a).otherwise(F.lit("col"))


def is_placeholder(s: Column) -> Column:
    """True for NULL, dots and anything under three characters, ignoring surrounding quotes."""
    t = F.regexp_replace(F.trim(F.coalesce(s, F.lit(""))), "^['\"]+|['\"]+$", "")
    return (F.length(t) < 3) | (t == "...")


def response_fields(text: Column) -> Column:
    """``struct(title, description, needs_retry)`` of one model response.

    Order of attempts: the whole text as JSON, the outermost brace span as JSON, then first line as
    title and the rest as description, then fixed default wording.
    """
    schema = "title string, description string"
    body = F.trim(F.coalesce(text, F.lit("")))
    whole = F.from_json(body, schema)
    span = F.from_json(F.regexp_extract(body, r"(?s)(\{.*\})", 1), schema)
    strict = body.startswith("{") & body.endswith("}")
    title0 = F.trim(F.coalesce(F.when(strict, whole["title"]), F.lit("")))
    desc0 = F.trim(F.coalesce(F.when(strict, whole["description"]), F.lit("")))
    mentions = body.contains("title") & body.contains("description")
    title1 = F.when((title0 == "") & mentions, F.trim(F.coalesce(span["title"], F.lit("")))).otherwise(title0)
    desc1 = F.when((desc0 == "") & mentions, F.trim(F.coalesce(span["description"], F.lit("")))).otherwise(desc0)
    first = F.regexp_replace(F.trim(F.regexp_extract(body, r"^([^\r\n]*)", 1)), "^['\"]+|['\"]+$", "")
    rest = F.trim(F.regexp_replace(body, r"^[^\r\n]*(\r\n|\r|\n)?", ""))
    fallback = desc1 == ""
    title2 = F.when(fallback & (title1 == "") & (first != ""), F.substring(first, 1, TITLE_LENGTH)).otherwise(title1)
    desc2 = F.when(fallback, F.when(rest != "", rest).otherwise(body)).otherwise(desc1)

    def short(s: Column) -> Column:
        return (F.length(F.trim(s)) < 3) | (F.trim(s) == "...")

    return F.struct(
        F.when(short(title2), F.lit(DEFAULT_TITLE)).otherwise(title2).alias("title"),
        F.when(short(desc2), F.lit(DEFAULT_DESCRIPTION)).otherwise(desc2).alias("description"),
        ((body != "") & (is_placeholder(title1) | is_placeholder(desc1))).alias("needs_retry"),
    )


def prompt(
    level: Column, cluster: Column, top: Column, low: Column, channels: Column, averages: Column, context: Column
) -> Column:
    """Prompt for one cluster; ``context`` may be NULL."""
    head = F.concat(
        F.lit("Cluster "), cluster.cast("string"), F.lit(" at level "), level.cast("string"),
        F.lit("\nHigh markers: "), top,
        F.lit("\nLow markers: "), low,
        F.lit("\nChannels: "), channels,
        F.lit("\nMean intensities: "), averages,
        F.lit("\nReturn strict JSON with the keys title and description."),
    )
    return F.when(context.isNull(), head).otherwise(F.concat(head, F.lit("\nAdditional context:\n"), context))
