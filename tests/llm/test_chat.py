"""Chat formatting: texts that meet across parts, unknown kinds, long conversations, attachments against SQL."""

import random
import time

import duckdb
from pyspark.sql import functions as F

from tesselar.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, parts " + chat.PARTS


def formatted(spark, rows):
    return chat.format_conversations(spark.createDataFrame(rows, SCHEMA))


def read_back(out):
    cols = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted")
    return {r.conv_id: r for r in cols.collect()}


def test_texts_that_meet(spark):
    """Random parts of the signs that matter read back exactly, and no mark arises between parts."""
    rng = random.Random(0)
    signs = ["<", "|", "␛", "<|", "|>", "<|end|>", "|end|>", "<|turn|>", "|text|>", "<␛", "a", ""]
    rows, want = [], {}
    for c in range(300):
        want[c] = []
        for t in range(rng.randrange(1, 4)):
            parts, plain = [], ""
            for _ in range(rng.randrange(0, 6)):
                if rng.random() < 0.15:
                    parts.append(("image", "ignored", f"r{c}", 1))
                    plain += "<|image|>"
                else:
                    text = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 4)))
                    parts.append(("text", text, None, None))
                    plain += text
            role = "assistant" if t % 2 else "".join(rng.choice(signs) for _ in range(2))
            rows.append((c, t, role, parts))
            want[c].append((role, plain))
    got = read_back(formatted(spark, rows))
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].t] == turns
        assert got[c].formatted.count(chat.END) == len(turns) == got[c].formatted.count(chat.TURN)
        assert got[c].loss == "".join(text for role, text in turns if role == "assistant")


def test_parts_equal_one_text(spark):
    whole = "x<|end|>␛<␛|y<|" * 3
    rows = [(1, 0, "u", [("text", whole, None, None)]), *[(2 + k, 0, "u", [("text", whole[i : i + k + 1], None, None) for i in range(0, len(whole), k + 1)]) for k in range(5)]]
    assert len({r.formatted for r in formatted(spark, rows).collect()}) == 1


def test_unknown_kinds(spark):
    rows = [(1, 0, "assistant", [("video", "caption <", "v1", 3), ("text", "|end|>", None, None), ("html", "<b>", None, None), (None, "plain", "r", None), ("text", "t", "r2", 1)])]
    out = formatted(spark, rows)
    r = out.collect()[0]
    assert [tuple(a) for a in r.attachments] == [("video", "v1", 0)] and r.expanded_tokens == 0
    back = read_back(out)[1]
    assert [tuple(t) for t in back.t] == [("assistant", chat.OTHER + "caption <|end|><b>plaint")] and r.formatted.count(chat.END) == 1


def test_long_conversation(spark):
    n = 30_000
    turns = spark.range(n).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        chat.text_parts(F.concat(F.lit("turn "), F.col("id").cast("string"))).alias("parts"),
    )
    began = time.time()
    out = chat.format_conversations(turns)
    r = out.select(F.size(chat.read_turns(F.col("formatted"))).alias("n"), F.sha2(chat.loss_text(F.col("formatted"), F.col("loss_spans")), 256).alias("h")).collect()[0]
    import hashlib

    assert r.n == n and r.h == hashlib.sha256("".join(f"turn {i}" for i in range(1, n, 2)).encode()).hexdigest()
    assert time.time() - began < 60


def test_attachments_against_sql(spark, tmp_path):
    """Attachments and expanded counts of the conversations table with parts made from its texts."""
    path = "/root/testdata/sf0.001/conversations.parquet"
    conv = spark.read.parquet(path)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("image", "audio", "document")]), (F.col("turn") % 3 + 1).cast("int"))
    part = lambda t, text, ref, units: F.struct(t.alias("type"), text.alias("text"), ref.alias("ref"), units.alias("units"))
    none = F.lit(None)
    rows = conv.select("conv_id", "turn", "role", F.array(
        part(F.lit("text"), F.col("text"), none.cast("string"), none.cast("bigint")),
        part(kind, none.cast("string"), F.concat(F.lit("f"), F.col("turn").cast("string")), F.when(F.col("turn") % 2 == 0, F.col("turn"))),
    ).cast(chat.PARTS).alias("parts"))
    got = {r.conv_id: ([tuple(a) for a in r.attachments], r.expanded_tokens) for r in chat.format_conversations(rows).collect()}
    want = duckdb.sql(f"""WITH t AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' ELSE 'document' END AS k,
        CASE turn % 3 WHEN 0 THEN 576 WHEN 1 THEN 25 ELSE 768 END * CASE WHEN turn % 2 = 0 THEN turn ELSE 1 END AS n FROM '{path}')
        SELECT conv_id, list((k, 'f' || turn, n) ORDER BY turn, role, text), sum(n)::BIGINT FROM t GROUP BY conv_id""").fetchall()
    assert got == {c: ([tuple(a) for a in some], n) for c, some, n in want}
