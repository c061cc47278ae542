"""Queries with a SQL text side by side with it, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from tesselar.llm import byte_bpe, decontamination, simhash, suffix_dedup, toxicity
from tesselar.llm.queries import ORACLE, QUERIES
from tests.compare import connect, differences, spark_table, sql_table


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, small_dir, name):
    assert not differences(spark_table(QUERIES[name](spark, small_dir)), sql_table(connect(small_dir), ORACLE[name]))


def test_pipeline(spark, small_dir, tmp_path):
    """Each stage on all that its predecessor kept, its decision against the operator's own finding."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns = docs.columns
    seen = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small_dir).write.parquet(str(tmp_path / str(n)))
        out = spark.read.parquet(str(tmp_path / str(n)))
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert len(after) == out.count() and set(after) <= set(before) and (out.columns == columns or name == "byte_bpe")
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{small_dir}/labels.parquet"))
            rejected = {r.doc_id for r in toxicity.score(docs, model).filter(f"toxicity >= {toxicity.THRESHOLD}").collect()}
            assert set(after) == set(before) - rejected
        elif name == "simhash":
            assert set(after) == {r.component_id for r in simhash.near_duplicates(docs).collect()}
        elif name == "suffix_dedup":
            assert set(after) == set(before)
            gone = {r.doc_id: r.spans for r in suffix_dedup.repeated_spans(docs).collect()}
            for i, r in after.items():
                body = (before[i].text or "").encode()
                assert (r.text or "") == suffix_dedup.kept_bytes(body, [(s.start, s.end) for s in gone[i]]).decode("utf-8", "ignore")
                assert r.n_chars == len(r.text)
        elif name == "decontamination":
            found = decontamination.contamination(docs, spark.read.parquet(f"{small_dir}/benchmark.parquet")).collect()
            assert set(after) == {r.doc_id for r in found if not r.contaminated}
        else:
            assert all(r.decoded_sha256 == byte_bpe.sha256_hex(before[i].text.encode()) for i, r in after.items())
        seen.append(name)
        docs = out
    assert seen == ["toxicity", "simhash", "suffix_dedup", "decontamination", "byte_bpe"]


def test_broadcast_and_join_agree(spark, small_dir, monkeypatch):
    wide = spark_table(QUERIES["op1_decontamination"](spark, small_dir))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    assert not differences(wide, spark_table(QUERIES["op1_decontamination"](spark, small_dir)))
