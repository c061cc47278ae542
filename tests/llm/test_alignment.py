"""Cross-tokenizer alignment against plain loops over bytes."""

import collections
import hashlib
import itertools

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesselar.llm import alignment
from tesselar.llm.queries import QUERIES
from tests.llm.conftest import texts_of

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TOOLS, WHOLE_A, WHOLE_B = alignment.Tokenizers(A, B), Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
WHOLE_A.encode_special_tokens = True


def loops(texts):
    """(groups, overlap links) of every text, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    letters = {v: k for k, v in zip(range(256), alignment_letters())}
    out = []
    for text in texts:
        whole = (" " + text).encode()
        a = a_model.encode(" " + text, add_special_tokens=False)
        raw_a = [bytes(letters[c] for c in t) for t in a.tokens]
        b = b_model.encode(text)
        pieces = [b_model.id_to_piece(i) for i in b]
        raw_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        assert decoders.ByteLevel().decode(a.tokens) == " " + text
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            out.append(([], [], [], [], []))
            continue
        spans = lambda raw: list(zip(itertools.accumulate(map(len, raw[:-1]), initial=0), itertools.accumulate(map(len, raw))))
        at_a, at_b = spans(raw_a), spans(raw_b)
        ends = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, links, shared = [], [], []
        for lo, hi in zip([0, *ends], ends):
            here_a = [(i, s, e) for i, (s, e) in enumerate(at_a) if lo <= s < hi]
            here_b = [(j, s, e) for j, (s, e) in enumerate(at_b) if lo <= s < hi]
            groups.append(([a.ids[i] for i, *_ in here_a], [b[j] for j, *_ in here_b]))
            shared += [(i, j) for i, *_ in here_a for j, *_ in here_b]
            links += [(i, j, min(e, f) - max(s, t)) for i, s, e in here_a for j, t, f in here_b if min(e, f) > max(s, t)]
        out.append((groups, links, a.ids, b, shared))
    return out


def alignment_letters():
    found = alignment._byte_letters()
    return sorted(found, key=found.get)


TEXTS = [
    "Hello world", "naïve café — 日本語テキスト 🙂🙂 emoji", "<|endoftext|> <s> </s> <unk> <0x41>", "  two  spaces\n\nand\ttabs ", "", "x▁y", "a" * 300,
    "zażółć gęślą jaźń", "́́ combining", "1234567890 3.14", "\x00\x01 control", "don't can't", " ", "﻿mark",
]


def test_products():
    """Row products against dense matrices, by blocks of any size."""
    rng = np.random.default_rng(1)
    lengths_a, lengths_b = rng.integers(1, 6, 40), rng.integers(1, 6, 200)
    lengths_b = lengths_b[np.cumsum(lengths_b) <= lengths_a.sum()]
    lengths_b = np.append(lengths_b, [lengths_a.sum() - lengths_b.sum()])
    lengths_b = lengths_b[lengths_b > 0]
    dense = lambda m: np.array([[c in m.columns[m.starts[i] : m.starts[i + 1]] for c in range(m.width)] for i in range(m.height)], dtype=int)
    a, b = alignment.token_bytes(lengths_a), alignment.token_bytes(lengths_b)
    product, values = alignment.gustavson(a, alignment.transposed(b))
    want = dense(a) @ dense(b).T
    assert (dense(product) == (want > 0)).all() and (values == want[want > 0]).all()
    # Columns out of order and repeated paths.
    c = alignment.Csr(np.array([0, 2, 4, 4]), np.array([0, 2, 1, 2]), 3)
    d = alignment.Csr(np.array([0, 1, 2, 4]), np.array([1, 0, 0, 1]), 2)
    square, values = alignment.gustavson(c, d)
    want = dense(c) @ dense(d)
    assert (dense(square) == (want > 0)).all() and (values == want[want > 0]).all()


@pytest.mark.parametrize("block", [1, 1 << 18])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "PRODUCT_BYTES", block)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("shared", F.lit(1))
    want = loops(TEXTS)
    for kind, pick in (("overlap", 1), ("group", 4)):
        got = sorted(tuple(r) for r in alignment.links(docs, A, B, kind).collect())
        assert got == sorted((d, x[0], x[1], w[2][x[0]], w[3][x[1]], x[2] if kind == "overlap" else 1) for d, w in enumerate(want) for x in w[pick])
    assert not want[5][0] and want[2][0]
    with pytest.raises(ValueError):
        alignment.links(docs, A, B, "other")


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'.,<|>aAéÉß12ª×▁–“"))))
@example("don't 'sound x'll ..'s 'S I'M  'd ' re")
@example("  a  b \n\n c\r\n\td   ")
@example(" ")
@example("<|endoftext|> <s> ▁x </s> a ▁")
@settings(max_examples=400, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(text):
    ids_a, ids_b, n_a, n_b = TOOLS.encode([text, "", text])
    a, b = WHOLE_A.encode(" " + text, add_special_tokens=False).ids, WHOLE_B.encode(text)
    if len(ids_a):
        assert ids_a.tolist() == a + a and ids_b.tolist() == b + b and n_a.tolist() == [len(a), 0, len(a)] and n_b.tolist() == [len(b), 0, len(b)]
    else:
        raw = (" " + text).encode()
        assert not text or any(b"".join(side.entries[i] for i in ids) != raw for side, ids in ((TOOLS.a, a), (TOOLS.b, b)))


def expected(texts):
    """Contract columns of {doc: text} by plain loops."""
    found = dict(zip(texts, loops(list(texts.values()))))
    counts = collections.Counter(p for w in found.values() for p in {(w[2][i], w[3][j]) for i, j, _ in w[1]})
    highest = collections.defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    out = {}
    for d, (groups, links, a, b, shared) in found.items():
        linked = [(a[i], b[j]) for i, j, _ in links]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[d] = (
            len(a), len(b), len(groups), len(links), sum(counts[p] == highest[p[0]] for p in linked), sum(counts[p] for p in linked),
            hashlib.sha256(text.encode()).hexdigest() if text else "", len(shared),
        )
    return out


def test_query(spark, small_dir):
    texts = {i: t for i, t in texts_of(spark.read.parquet(f"{small_dir}/documents.parquet")).items() if len(t) < 800}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = alignment.alignment(docs, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared").collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == expected(texts) and len(rows) == len(texts)
    whole = QUERIES["op11_alignment"](spark, small_dir).collect()
    same = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in rows}
    assert len(whole) == spark.read.parquet(f"{small_dir}/documents.parquet").count()
    assert all(same[r.doc_id] == (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in whole if r.doc_id in same)


@pytest.mark.parametrize("small", [True, False])
def test_slices_of_any_size(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(alignment, "SLICE_BYTES", 200)
        monkeypatch.setattr(alignment, "BATCH_BYTES", 60)
        monkeypatch.setattr(alignment, "PRODUCT_BYTES", 7)
    texts = dict(enumerate(TEXTS * 3))
    rows = alignment.alignment(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1), A, B).collect()
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.n_shared) for r in rows} == expected(texts)


def test_odd_input(odd_documents, no_documents):
    rows = alignment.alignment(odd_documents, A, B).collect()
    assert len(rows) == odd_documents.count() and alignment.alignment(no_documents, A, B).count() == 0
    assert {tuple(r)[1:] for r in rows if r.doc_id in (1, 2)} == {(0, 0, 0, 0, 0, "", 0, 0)}
    assert [r.n_links > 0 for r in rows if r.doc_id == 9007199254740993] == [True]
    assert len({tuple(r) for r in rows if r.doc_id == 3}) == 1
