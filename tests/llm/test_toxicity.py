"""The factorization machine: pairs that no single term tells, scores against a plain double loop, odd samples."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tesselar.llm import toxicity as tx


def paired(n=2500, seed=1):
    """Labels that depend on two marker words together: both or none; thousands of noise words around."""
    rng = np.random.default_rng(seed)
    noise = ["n" + "".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000)]
    texts, labels = [], []
    for _ in range(n):
        a, b = (rng.random(2) < 0.5).tolist()
        texts.append(" ".join([*rng.choice(noise, 40), *["markone"] * a, *["secondmark"] * b]))
        labels.append(int(a == b))
    return texts, np.array(labels, dtype=float)


def test_pairs_are_learned():
    """With vectors nearly all held-out rows are right, without them half: the stated margin is 0.35."""
    texts, y = paired()
    rows = [tx.Terms()(t) for t in texts]
    right = {}
    for factors in (tx.FACTORS, 0):
        m = tx.fit(rows[:2000], y[:2000], factors)
        place = np.full(tx.BUCKETS, -1, dtype=np.int32)
        place[m.buckets] = np.arange(len(m.buckets))
        z = m.margins([r[r >= 0] for r in (place[x] for x in rows[2000:])])
        right[factors] = ((z > 0) == (y[2000:] > 0)).mean()
    assert right[tx.FACTORS] > 0.95 and right[tx.FACTORS] - right[0] > 0.35


def test_scores_of_a_plain_machine(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"))
    model = tx.train(docs, spark.read.parquet(f"{small_dir}/labels.parquet"))
    at = {int(b): i for i, b in enumerate(model.buckets)}
    for r in tx.score(docs, model).collect():
        terms = sorted({at[b] for w in tx._WORD.findall((r.text or "").translate(tx.AZ_LOWER)) for b in tx.word_buckets(w) if b in at})
        z = model.bias + sum(float(model.weights[i]) for i in terms)
        scale = 1 / max(1, len(terms) / tx.PAIR_TERMS)
        z += scale * sum(float(np.dot(model.vectors[i].astype(float), model.vectors[j])) for i, j in itertools.combinations(terms, 2))
        assert abs(r.toxicity - 1 / (1 + np.exp(-z))) < 1e-4


def test_one_row_per_id_and_every_bucket(spark):
    """A repeated id is one row of the sample; terms of both classes and of none have rows in the model."""
    docs = spark.createDataFrame([(1, "aaa same"), (3, "bbb same"), (3, "zzz same"), (3, "bbb same"), (9, "ccc same")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, 0)], "doc_id bigint, toxic int")
    used = {r.doc_id for r in tx.training_labels(labels, 10).collect()}
    model = tx.train(docs, labels)
    words = {1: "aaa", 3: "bbb", 9: "ccc"}
    want = {b for d in used for w in (words[d], "same") for b in tx.word_buckets(w)}
    assert set(model.buckets.tolist()) == want and model.vectors.shape == (len(want), tx.FACTORS)


def test_samples_without_terms():
    none = np.zeros(0, dtype=np.int32)
    for rows in ([none], [none, none, none], [none, np.array([3, 5], dtype=np.int32), none]):
        m = tx.fit(rows, np.array([1.0, 0.0, 1.0][: len(rows)]))
        assert np.isfinite(m.margins([none, np.arange(len(m.buckets))])).all()


def test_fit_and_margins_hold_no_array_of_all_terms():
    """1,500 rows of 1,000 terms: peaks of the fit and of the margins, in bytes per term and per row."""
    import tracemalloc

    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(20_000, 1000, replace=False)).astype(np.int32) for _ in range(1500)]
    tracemalloc.start()
    try:
        m = tx.fit(rows, (np.arange(1500) % 5 == 0).astype(float))
        fitted = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        whole = m.margins(rows)
        scored = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert fitted < 100e6 and scored < 60e6
    assert np.allclose(whole, np.concatenate([m.margins([r]) for r in rows]), atol=1e-9)
