"""Packed token files: code and reader against plain loops, encoder against the library, files under lost tasks."""

import io
import itertools
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesselar.llm import token_files as tf
from tesselar.llm.queries import QUERIES
from tests.llm.conftest import texts_of

PATH = P.path("word_bpe_49k.json")


def plain_decode(p, n, block):
    """The code read word by word with Python integers."""
    out, escapes = [], iter(p.escapes.tolist())
    for b, (lo, hi) in enumerate(itertools.pairwise(p.word_offsets.tolist())):
        left = min(block, n - b * block)
        for word in p.words[lo:hi].tolist():
            s, width = word >> 60, int(tf.WIDTHS[word >> 60])
            for j in range(min(int(tf.COUNTS[s]), left)):
                v = word >> (j * width) & ((1 << width) - 1) if width else 0
                out.append(next(escapes) if width and v == (1 << width) - 1 else v)
            left -= min(int(tf.COUNTS[s]), left)
        assert left == 0
    return out


SEQUENCES = [
    [], [0], [2**32 - 1], [0] * 1000, [1] * 300, list(range(5000)), [3, 2**32 - 1] * 200, [0] * 119 + [1], [7] * 20 + [49407] + [7] * 20,
    [2**k - 1 for k in range(33) if k] * 3, [(2**k - 2) % 2**32 for k in range(1, 33)] * 3,
]


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_code(block):
    rng = np.random.default_rng(0)
    random = [(2 ** rng.uniform(0, 32, n)).astype(np.int64).tolist() for n in (1, 63, 64, 65, 9000)]
    for ids in [*SEQUENCES, *random]:
        p = tf.pack(np.array(ids, dtype=np.uint32), block)
        assert plain_decode(p, len(ids), block) == ids
        sizes = np.array([min(block, len(ids) - i) for i in range(0, len(ids), block)], dtype=np.int64)
        assert tf.unpack(p.words, p.escapes, p.word_offsets, sizes).tolist() == ids
        for b in range(0, len(sizes), 3):
            w, e = p.word_offsets, p.escape_offsets
            part = tf.unpack(p.words[w[b] : w[b + 1]], p.escapes[e[b] : e[b + 1]], w[b : b + 2] - w[b], sizes[b : b + 1])
            assert part.tolist() == ids[b * block : (b + 1) * block]


def test_code_is_small():
    """Small ids take little room, one rare large id costs one escape, and runs of zeros almost nothing."""
    assert len(tf.pack(np.zeros(24_000, dtype=np.uint32)).words) <= 24_000 // 240 + 6
    mixed = tf.pack(np.array(([5] * 19 + [40_000]) * 100, dtype=np.uint32))
    assert 8 * len(mixed.words) + 4 * len(mixed.escapes) < 2000 * 4 / 4 and len(mixed.escapes)


@pytest.mark.parametrize("at_once", [1, 256])
def test_file(monkeypatch, at_once):
    monkeypatch.setattr(tf, "BLOCKS_AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    docs = [(None, 1), (5, 0), (-3, 10_000), (2**63 - 1, 1), (7, 4096), (7, 3)]
    ids = [rng.integers(0, 50_000, n, dtype=np.uint32) for _, n in docs]
    raw = b"".join(tf.file_bytes(np.concatenate(ids), [d for d, _ in docs], [n for _, n in docs]))
    got = list(tf.TokenFile(io.BytesIO(raw), len(raw)).texts())
    assert [d for d, _ in got] == [d for d, _ in docs] and all((x == y).all() for (_, x), y in zip(got, ids))
    for broken in (raw[:-1], raw[:50], b"x" + raw):
        with pytest.raises(ValueError):
            tf.TokenFile(io.BytesIO(broken), len(broken))


LIBRARY, ENCODER = Tokenizer.from_file(PATH), tf.WordEncoder(PATH)


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n'.,<|>aAéÉéß12ſªµ×÷endoftextstartoftext"))))
@example("<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>")
@example("don't 'sound x'll ..'s 'S I'M")
@example("aßb Straße")
@example("Être ÀÞŸ ß é ́ É́ ́a á. 1á ª º µ × ÷ 12³ x²")
@example("a\x1cb\x85c\xa0d e　f\x0bg\x0ch")
@settings(max_examples=400, deadline=None)
def test_encoder_is_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENCODER.encode([text])[0], dtype="<u4").tolist() == want


def expected(texts):
    """Contract columns of {doc: text} in ascending order of id."""
    out, start = {}, 0
    for d in sorted(texts):
        ids = np.array([*LIBRARY.encode(texts[d], add_special_tokens=False).ids, 2], dtype="<u4")
        out[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_query(spark, small_dir):
    texts = texts_of(spark.read.parquet(f"{small_dir}/documents.parquet"))
    rows = QUERIES["op12_token_ids"](spark, small_dir).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == expected(texts) and len(rows) == len(texts)


def test_small_files(spark, small_dir, monkeypatch, tmp_path):
    """Many files, blocks and batches give the same rows; files that no list names are not read."""
    monkeypatch.setattr(tf, "FILE_IDS", 300)
    monkeypatch.setattr(tf, "TEXT_BYTES", 100)
    monkeypatch.setattr(tf, "RUN", 2)
    monkeypatch.setattr(tf, "ROW_IDS", 50)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    texts = texts_of(docs)
    files = tf.write_tokens(docs.repartition(3), PATH, str(tmp_path / "ids"), 2)
    listed = files.count()
    assert listed > 20
    once = {p.name: p.read_bytes() for p in (tmp_path / "ids").iterdir()}
    assert len(once) == listed
    for name, raw in list(once.items())[:3]:  # an earlier attempt of a task
        (tmp_path / "ids" / f"{name[:17]}-other.s8b").write_bytes(raw[:100])
    rows = tf.read_tokens(files, str(tmp_path / "ids")).collect()
    assert {r.doc_id: (r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in rows} == expected(texts)


def test_odd_input(odd_documents, no_documents):
    rows = tf.stored_tokens(odd_documents, PATH, 2).collect()
    assert len(rows) == odd_documents.count() and tf.stored_tokens(no_documents, PATH, 2).count() == 0
    by_start = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in by_start] == [0, *itertools.accumulate(r.n_tokens for r in by_start)][:-1]
    assert [r.doc_id for r in by_start][:2] == [None, None] and [r.doc_id for r in by_start][2:] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (1, 2, 6)) and all(r.ids[-4:] == b"\x02\0\0\0" for r in rows)
    three = [r.ids for r in rows if r.doc_id == 3]
    assert three[0] == three[1]
