"""NULLs, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tesselar.llm import byte_bpe, chat, decontamination, ego_join, language, pitman_yor, sharding, simhash, suffix_dedup, toxicity
from tests.llm.conftest import PASSAGE


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, PASSAGE[4:43]), (None, "w1 w2"), (2, None), (2, ""), (3, "!!!")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.fixture(params=["odd", "none"])
def docs(request, odd_documents, no_documents):
    return odd_documents if request.param == "odd" else no_documents


def test_decontamination(docs, items):
    found = decontamination.contamination(docs, items).collect()
    assert len(found) == docs.count()
    hits = sorted((r.doc_id, r.n_hit, r.n_items) for r in found if r.contaminated)
    big = 9007199254740993
    assert hits == ([(3, 24, 1), (3, 24, 1), (4, 8, 1), (5, 2, 0), (big, 8, 1)] if found else [])
    left = decontamination.remove_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == (docs.count() - 5 if found else 0)
    cut = decontamination.remove_spans(docs, items)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert not found or (texts[5].startswith("w0   w3 w4") and "quick" not in texts[3] and texts[1] == "")
    assert decontamination.contamination(docs, items.limit(0)).filter("contaminated").count() == 0


def test_scores(spark, docs):
    labels = spark.createDataFrame([(3, 1), (None, 1), (4, None), (5, 0)], "doc_id bigint, toxic int")
    for some in (labels, labels.limit(0)):
        got = toxicity.score(docs, toxicity.train(docs, some)).select("toxicity").collect()
        assert len(got) == docs.count() and all(0 <= r.toxicity <= 1 for r in got)
    lm = pitman_yor.score(docs).collect()
    assert len(lm) == docs.count() and all(r.n_tokens >= 1 and r.score < 0 for r in lm)
    assert all(r.held_out for r in lm if r.doc_id is None)
    langs = {r.doc_id: r.lang_pred for r in language.identify(docs, language.train(docs)).collect()}
    assert not langs or {langs[1], langs[2], langs[6], langs[7]} == {"und"}


def test_near_duplicates(docs):
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    kept = [r.doc_id for r in simhash.keep_first(docs).select("doc_id").collect()]
    if found:
        # Texts without words share fingerprint zero.
        assert found[1] == found[2] == found[6] == 1 and found[3] == 3
        assert kept.count(3) == 1 and 2 not in kept and 9007199254740993 in kept and kept.count(None) == 2


def test_suffix_dedup(docs):
    spans = suffix_dedup.repeated_spans(docs).collect()
    left = suffix_dedup.remove_repeats(docs)
    assert len(spans) == docs.count() == left.count() and left.columns == docs.columns
    if spans:
        texts = {r.doc_id: r.text for r in left.collect()}
        # Repeated rows are one document; document 4 loses the passage and keeps its own first letter.  A long run of one
        # letter repeats itself: all but its first place goes.
        assert [r.spans for r in spans if r.doc_id == 3][0] == [r.spans for r in spans if r.doc_id == 3][1]
        assert texts[4] == "x" and texts[2] is None and texts[9007199254740993] == "é"


def test_bpe_and_shards(docs):
    rows = byte_bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    texts = sorted((r.text or "").encode() for r in docs.collect())
    assert sorted(bytes(r.decoded) for r in rows) == texts and all(len(r.ids) == 4 * r.n_tokens for r in rows)
    placed = sharding.external_shuffle(docs.withColumn("size", F.length("text")), "size", 3).collect()
    assert len(placed) == docs.count() and sorted(r.slot * 3 + r.shard for r in placed) == list(range(len(placed)))


def test_write_shards(odd_documents, spark, tmp_path):
    sharding.write_shards(sharding.external_shuffle(odd_documents.withColumn("size", F.lit(1)), "size", 2), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [5, 6]


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [nan, 1.0], 1),
        (6, [0.0, 0.0], 1), (7, [1.0, 0.01], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [1e30, 1e28], 1), (12, [inf, 0.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("size", F.lit(1)).withColumn("id", F.lit(1))
    got = ego_join.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    linked = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.n_links)
    assert linked == [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (7, 4, 1, False), (11, 4, 1, False)]
    assert all(r.kept and r.component_id == r.vec_id for r in got if not r.n_links)
    assert ego_join.near_duplicates(frame.limit(0)).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", [("text", "hi <|end|> ␛ <␛|", None, None), ("image", None, "r1", 2), ("text", None, None, None)]),
        (1, None, None, None), (1, 0, "user", [("audio", None, "a", None)]), (None, 1, "assistant", [("text", "<|turn|>", None, None)]),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, parts " + chat.PARTS).withColumn("pieces", F.lit(1))
    out = chat.format_conversations(turns)
    read = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "attachments", "expanded_tokens")
    got = {r.conv_id: r for r in read.collect()}
    assert [tuple(t) for t in got[1].t] == [("", ""), ("user", "<|audio|>"), ("user", "hi <|end|> ␛ <␛|<|image|>")]
    assert [tuple(a) for a in got[1].attachments] == [("audio", "a", 25), ("image", "r1", 1152)] and got[1].expanded_tokens == 1177
    assert got[None].loss == "<|turn|>" and got[1].loss == ""
    assert chat.format_conversations(turns.limit(0)).count() == 0


@pytest.mark.parametrize("columns", [["doc_id", "text", "lang", "source", "n_chars"], ["doc_id", "text", "hit", "root", "label"]])
def test_pipeline_stages(docs, spark, small_dir, tmp_path, columns):
    """Odd and empty documents through all stages: each keeps the columns, clean rows and ids."""
    import corpus_pipeline

    now = docs.select(*columns)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, small_dir).write.parquet(str(tmp_path / str(n)))
        out = spark.read.parquet(str(tmp_path / str(n)))
        ids = {r.doc_id for r in out.collect()}
        assert ids <= {r.doc_id for r in now.collect()} and (out.columns == columns or name == "byte_bpe")
        if name in ("simhash", "suffix_dedup") and now.count():
            assert {None, 1, 3, 5, 9007199254740993} <= ids
        now = out
    assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
