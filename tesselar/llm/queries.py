"""Registered queries of the training-data operators and their SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm import alignment, byte_bpe, chat, decontamination, ego_join, language, pitman_yor, prefix_trie, sharding, simhash, suffix_dedup, token_files, toxicity
from tesselar.llm.common import held_out, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
SHARDS = 40
END_ID = 2
GRAFT_GROUP, GRAFT_HEADS = 100, 6


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query("op1_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS_SQL} AS w FROM benchmark),
grams AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS g FROM iw WHERE len(w) > 0),
lengths AS (SELECT DISTINCT len(g) AS n FROM grams),
p AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths),
hits AS (SELECT r, i, n, item FROM (SELECT r, i, n, w[i:i + n - 1] AS g FROM p) JOIN grams USING (g)),
hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long")
    records = table(spark, sf_dir, "documents").withColumn("size", size)
    # Whole rows are placed and written; the digests are of the records read back.
    return sharding.stored(sharding.external_shuffle(records, "size", SHARDS)).select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return byte_bpe.token_digests(byte_bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN))


_LOSS = "string_agg(coalesce(text, ''), '' ORDER BY turn NULLS FIRST, coalesce(role, ''), text NULLS FIRST) FILTER (role = 'assistant')"
_ESCAPED = "length(replace(replace({0}, '␛', '␛␛'), '<|', '<␛|'))"


@query("op8_chat_format", f"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))) AS turns_sha256,
length(coalesce({_LOSS}, ''))::BIGINT AS loss_chars, sha256(coalesce({_LOSS}, '')) AS loss_sha256,
sum(23 + {_ESCAPED.format("coalesce(role, '')")} + {_ESCAPED.format("coalesce(text, '')")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    turns = table(spark, sf_dir, "conversations").select(*columns)
    control = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id bigint, turn bigint, role string, text string")
    parts = turns.unionByName(probe).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    formatted = chat.format_conversations(parts)
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    back = formatted.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), loss.alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", suffix_dedup.removed_bytes(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256",
    )


@query("op4_ego_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op3_pitman_yor")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


@query("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.alignment(table(spark, sf_dir, "documents"), a, b).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared",
    )


@query("op12_token_ids")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_files.stored_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# Checksum of the decimal id, bit by bit: every byte stands with seven zeros, and xor with zero changes nothing.
_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), "
    "lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))))"
)


@query("op13_prefix_trie", f"""
WITH t AS (SELECT conv_id, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x.r, x.t) AS l, ({_CRC32} % 6)::BIGINT AS h FROM t GROUP BY conv_id),
r AS (SELECT a.conv_id, list_concat(coalesce(b.l, [])[:a.h], a.l[a.h + 1:]) AS l FROM o a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 100),
p AS (SELECT conv_id, len(l) AS n, l, unnest(range(0, len(l) + 1)) AS d FROM r),
n AS (SELECT l[:d] AS k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM p GROUP BY ALL),
c AS (SELECT k[:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.k[depth].t) END AS saved FROM n LEFT JOIN c ON c.k = n.k),
s AS (SELECT k[:a] AS k, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM v) GROUP BY 1)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN s ON s.k = v.k LEFT JOIN n u ON v.depth > 0 AND u.k = v.k[:v.depth - 1]""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    members = turns.select("conv_id").distinct()
    head = F.crc32(F.col("conv_id").cast("string")) % GRAFT_HEADS
    return prefix_trie.prefix_trie(prefix_trie.grafted(turns, GRAFT_GROUP, GRAFT_HEADS, head), members)
