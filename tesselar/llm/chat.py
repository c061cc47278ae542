"""Chat formatting with typed content parts, with DataFrame functions only.

A turn is written as ``<|turn|>role<|text|>content<|end|>``.  Texts cannot contain these marks: the escape sign is
doubled and put between the two characters of ``<|``.  Undoing goes the other way round and gives back every text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPE = "␛"
# Placeholder of a file of an unknown kind, and code points per page in which spans are looked up.
OTHER, PAGE = "<|other|>", 8192
# Tokens that one unit of an attachment takes: an image tile, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 576, "audio": 25, "document": 768}
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit("<|"), F.lit(f"<{ESCAPE}|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(f"<{ESCAPE}|"), F.lit("<|")), F.lit(ESCAPE * 2), F.lit(ESCAPE))


def text_parts(text: Column) -> Column:
    """A plain text as a list with one text part; NULL is an empty text."""
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"),
    )).cast(PARTS)


def _is_known(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*TOKENS_PER_UNIT), F.lit(False))


def _is_attachment(part: Column) -> Column:
    """A part of a known kind, or one of another kind that names a file."""
    other = (F.coalesce(part["type"], F.lit("text")) != "text") & part["ref"].isNotNull()
    return _is_known(part) | other


def _text(part: Column) -> Column:
    """The text that a part brings besides a placeholder; none for a known attachment."""
    return F.when(_is_known(part), F.lit("")).otherwise(F.coalesce(part["text"], F.lit("")))


def _visit(part: Column, before: Column) -> Column:
    """The placeholder of an attachment, then the escaped text.  ``before`` is the part in front, NULL for the first.

    A text that begins with the second half of a mark, right behind a text that ends with the first half, is parted from it
    as inside one text.
    """
    mark = F.when(_is_known(part), F.concat(F.lit("<|"), part["type"], F.lit("|>"))).when(_is_attachment(part), F.lit(OTHER)).otherwise(F.lit(""))
    meets = ~_is_attachment(part) & F.startswith(_text(part), F.lit("|")) & F.coalesce(F.endswith(_text(before), F.lit("<")), F.lit(False))
    return F.concat(mark, F.when(meets, F.lit(ESCAPE)).otherwise(F.lit("")), escape(_text(part)))


def _tokens(part: Column) -> Column:
    per_unit = F.lit(0)
    for kind, n in TOKENS_PER_UNIT.items():
        per_unit = F.when(part["type"] == kind, F.lit(n)).otherwise(per_unit)
    return F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0)) * per_unit


def format_conversations(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """``turns(conv_id, turn, role, parts)`` → one row per conversation.

    formatted: the string; loss_spans: (start, length) in code points of every content of ``learn_role``; attachments:
    (type, ref, tokens) in the order of their placeholders; expanded_tokens: their sum.  Turns are ordered by turn,
    then role, then parts, so ties and repeated rows have one order; all are kept.  A NULL turn comes first, a NULL role
    is empty, NULL parts and NULL texts are empty, an attachment without units has one.  A part of an unknown type is
    text; if it names a file, the file is recorded under its own type, with the placeholder OTHER and no tokens, and its
    text follows.  Rows without conv_id form one conversation with a NULL id.  Other columns are not read.  An empty
    table gives an empty result.  A conversation is one string by definition, so it is the smallest piece of work; the
    work grows in proportion to it.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    one = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    # Parts that bring nothing would hide which texts meet.
    said = one.withColumn("some", F.filter("parts", lambda p: _is_attachment(p) | (_text(p) != "")))
    written = said.select(
        "conv_id", "turn", "role", "parts",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
        F.array_join(F.transform("some", lambda p, i: _visit(p, F.get("some", i - 1))), "").alias("body"),
        F.transform(
            F.filter("some", _is_attachment), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")),
        ).alias("attachments"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    at = F.coalesce(F.sum(size.cast("bigint")).over(order), F.lit(0))
    # A turn is never empty, so its place orders the turns.
    grouped = written.withColumn("at", at).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "head", "body", "attachments"))).alias("pieces")
    )
    spans = F.filter("pieces", lambda p: p["role"] == learn_role)
    return grouped.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.transform(
            spans, lambda p: F.struct((p["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("bigint").alias("length")),
        ).alias("loss_spans"),
        F.flatten(F.transform("pieces", lambda p: p["attachments"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, p: a + p["tokens"]))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted string; attachments stay as their placeholders."""
    pieces = F.filter(F.split(formatted, re.escape(END)), lambda p: p != "")

    def read(piece: Column) -> Column:
        sides = F.split(F.substring(piece, len(TURN) + 1, 2**31 - 1), re.escape(TEXT), 2)
        return F.struct(unescape(F.get(sides, F.lit(0))).alias("role"), unescape(F.get(sides, F.lit(1))).alias("text"))

    return F.transform(pieces, read)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between.

    A place in a string is found by counting from its start, so the string is cut into pages first.
    """
    last = F.floor(F.length(formatted) / PAGE).cast("int")
    pages = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(formatted, i * PAGE + 1, F.lit(PAGE)))

    def part(pages: Column):
        def read(s: Column) -> Column:
            first, final = F.floor(s["start"] / PAGE).cast("int"), F.floor((s["start"] + s["length"]) / PAGE).cast("int")
            near = F.array_join(F.slice(pages, first + 1, final - first + 1), "")
            return unescape(F.substring(near, (s["start"] - first * PAGE + 1).cast("int"), s["length"].cast("int")))

        return read

    # The inner list is made once and handed to every span.
    held = F.transform(F.array(F.struct(pages.alias("pages"), spans.alias("spans"))), lambda h: F.array_join(F.transform(h["spans"], part(h["pages"])), ""))
    return F.get(held, F.lit(0))
