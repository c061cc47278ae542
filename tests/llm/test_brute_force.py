"""Every operator without a SQL form against a brute-force version on a small table."""

import base64
import collections
import hashlib
import math
import pathlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesselar.llm import byte_bpe, ego_join, pitman_yor, simhash, suffix_dedup
from tesselar.llm.queries import QUERIES
from tests.llm.conftest import texts_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def docs(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


def reach(near):
    """Smallest index that links reach."""
    label = np.arange(len(near))
    while True:
        new = np.array([min(label[i], label[n].min() if n.any() else label[i]) for i, n in enumerate(near)])
        if (new == label).all():
            return label
        label = new


def test_byte_bpe_is_tiktoken(spark, docs, small_dir):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in texts_of(docs).items():
        ids = own.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    rows = QUERIES["op6_byte_bpe"](spark, small_dir).collect()
    assert len(rows) == docs.count() and {r.doc_id: tuple(r)[1:] for r in rows} == want
    # Every code point once, alone and among others: the pattern splits as the library does.
    codec = byte_bpe.Codec(byte_bpe.serialise_model(ranks), sorted(ranks.values()), P.PATTERN)
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c <= 0xDFFF]
    for text in ["a ".join(points), " ".join(points), "".join(points), "<|endoftext|> it's  \n\n x" + "z" * 5000]:
        ids = codec.encode(text)
        assert list(memoryview(ids).cast("I")) == own.encode_ordinary(text) and codec.decode(ids).decode() == text


def test_simhash(spark, docs, small_dir):
    import xxhash

    def fingerprint(text):
        w = words(text)
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    texts = texts_of(docs)
    ids = sorted(texts)
    fps = np.array([fingerprint(texts[i]) for i in ids], dtype=np.uint64)
    label = reach([np.bitwise_count(fps ^ f) <= 2 for f in fps])
    rows = QUERIES["op9_simhash"](spark, small_dir).collect()
    assert len(rows) == len(ids)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (format(int(f), "016x"), ids[k]) for i, f, k in zip(ids, fps, label)}


def test_trie_walk_finds_every_pair():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [s ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for s in seeds for a, b in rng.integers(0, 64, (30, 2))]
    a, b = np.unique(np.concatenate([seeds, near[: len(near) // 2]])), np.unique(np.array(near[len(near) // 2 :], dtype=np.uint64))
    for other in (None, b):
        found = {(i, j) for x, y in simhash.walk(a, other) for i, j in zip(x.tolist(), y.tolist())}
        near_ = np.bitwise_count(a[:, None] ^ (a if other is None else b)[None]) <= 2
        assert found == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near_))) if other is not None or i < j}


@pytest.mark.parametrize("crowd, group", [(suffix_dedup.CROWD, suffix_dedup.GROUP_BYTES), (2, 20_000)])
def test_suffix_dedup(spark, docs, small_dir, monkeypatch, crowd, group):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    seen, want = set(), {}
    for i, t in sorted(texts_of(docs).items()):
        body, gone = t.encode(), bytearray(len(t.encode()))
        for j in range(len(body) - 99):
            w = body[j : j + 100]
            if w in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for j, x in enumerate(gone) if x and not (j and gone[j - 1]))
        want[i] = (len(body), sum(gone), runs, hashlib.sha256(bytes(c for c, x in zip(body, gone) if not x)).hexdigest())
    rows = QUERIES["op10_suffix_dedup"](spark, small_dir).collect()
    assert len(rows) == len(want) and {r.doc_id: tuple(r)[1:] for r in rows} == want


def test_suffix_sort_orders_and_groups():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 600, dtype=np.uint8)
    data = np.concatenate([data, data[:300]])
    at, n = np.arange(len(data) - 20), 20
    group = np.sort(rng.integers(0, 3, len(at)))
    order, cls = suffix_dedup.classes(data, at, group, n)
    key = lambda i: (group[i], data[at[i] : at[i] + n].tobytes())
    assert [key(i) for i in order] == sorted(map(key, range(len(at))))
    assert all((key(order[i]) == key(order[i + 1])) == (cls[i] == cls[i + 1]) for i in range(len(at) - 1))


def test_ego_join(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    x = np.concatenate([c + rng.normal(scale=s, size=(40, 16)) for c, s in zip(centres, rng.uniform(0.01, 0.3, 60))]).astype(np.float32)
    x = np.concatenate([x, x[:50]])
    labels = rng.integers(0, 3, len(x))
    frame = spark.createDataFrame([(int(i), v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))], "vec_id bigint, embedding array<float>, label int")
    u = ego_join.unit(x)
    near = (u @ u.T >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    root = reach(near)
    rows = ego_join.near_duplicates(frame).collect()
    assert len(rows) == len(x)
    assert {r.vec_id: tuple(r)[1:] for r in rows} == {i: (int(near[i].sum()), int(root[i]), i == root[i]) for i in range(len(x))}


def test_ego_join_on_the_table(spark, small_dir):
    rows = QUERIES["op4_ego_join"](spark, small_dir).collect()
    assert len(rows) == spark.read.parquet(f"{small_dir}/embeddings.parquet").count()


def test_pitman_yor(spark, docs, small_dir):
    texts = texts_of(docs)
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    counts = collections.Counter(w for i, ts in tokens.items() if fold(i, 5) != 1 for w in ts)
    total, types = sum(counts.values()), len(counts)
    rows = QUERIES["op3_pitman_yor"](spark, small_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ts = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id, 5) == 1, len(ts), sum(counts[w] > 0 for w in ts), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ts), rel=1e-9)
        assert r.score < 0
    test = [r for r in rows if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    again = {r.doc_id: r.score for r in QUERIES["op3_pitman_yor"](spark, small_dir).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, rel=1e-6) for r in rows)


def test_pitman_yor_is_a_distribution(spark):
    # All words after one context, the end and one unknown word share the probability of one.
    train = [(i, "a b c a b d a c") for i in range(40)]
    frame = spark.createDataFrame(train, "doc_id bigint, text string")
    probe = spark.createDataFrame([(1000 + i, w) for i, w in enumerate(["", "a", "b", "c", "d", "zz"])], "doc_id bigint, text string")
    held = [i for i in range(1000, 5000) if fold(i, 5) == 1][:6]
    probe = spark.createDataFrame([(i, w) for i, w in zip(held, ["", "a", "b", "c", "d", "zz"])], "doc_id bigint, text string")
    rows = {r.doc_id: 10**r.score for r in pitman_yor.score(frame.unionByName(probe)).collect() if r.doc_id in held}
    # A one-word text is its word at the start, then the end after that word.
    assert 0 < sum(rows.values()) <= 1 + 1e-6


def test_alone_table():
    table = pitman_yor.alone_table(0.5)
    assert table[2, 2] == pytest.approx(1) and table[2, 1] == 0
    # c = 3, t = 2: three ways to leave one customer alone beside a pair; a third of the customers is alone.
    assert table[3, 2] == pytest.approx(1 / 3)


def test_anchors_do_not_depend_on_the_group(monkeypatch):
    # Hashes of 12 bits stand for hashes that agree in their upper bits.
    full = suffix_dedup.gram_hashes
    monkeypatch.setattr(suffix_dedup, "gram_hashes", lambda data, gram: full(data, gram) >> np.uint64(52))
    rng = np.random.default_rng(3)
    for _ in range(20):
        text, other = rng.integers(97, 123, 100, dtype=np.uint8).tobytes(), rng.integers(97, 123, 20_000, dtype=np.uint8).tobytes()
        h = full(np.frombuffer(text, np.uint8), suffix_dedup.GRAM) >> np.uint64(52)
        alone, among = suffix_dedup.anchor_runs([text]), suffix_dedup.anchor_runs([other, text])
        assert alone[3].tolist() == [int(np.argmin(h))] == among[3][among[0] == 1].tolist()


@pytest.mark.parametrize("c,w,d", [(200, 50, 0.5), (2000, 500, 0.5), (2000, 0.8, 0.5), (1000, 20, 0.8), (1500, 5, 0.2), (60, 3, 0.7)])
def test_sweeps_reach_the_stationary_table_counts(c, w, d):
    # Exactly: t has the odds S(c, t) w^t, by the recursion of the Stirling numbers.
    log, t = np.array([0.0]), np.arange(1, c + 1)
    log = np.append(log, np.full(c, -np.inf))
    for n in range(1, c + 1):
        with np.errstate(divide="ignore"):
            stay = log[1:] + np.log(np.where(t < n, np.maximum(n - 1 - d * t, 1e-300), 0.0))
        log = np.append(-np.inf, np.logaddexp(log[:-1], stay))
    odds = log[1:] + t * math.log(w)
    p = np.exp(odds - odds.max())
    p /= p.sum()
    mean = (p * t).sum()
    sd = math.sqrt((p * t * t).sum() - mean**2)
    dishes = pitman_yor.Dishes(np.full(4000, c), d, np.random.default_rng(5))
    dishes.sweep(np.full(4000, float(w)))
    assert abs(dishes.tables.mean() - mean) < 0.2 * sd and dishes.tables.std() == pytest.approx(sd, rel=0.1)


def test_parent_tables_are_sampled():
    # One word in 200 contexts among many others: its parent opens 1 + w / d tables on average, not one.
    words, contexts = 500, 200
    cells = (np.arange(words)[:, None] * pitman_yor.CONTEXTS + np.arange(contexts)).ravel()
    counts = np.full(len(cells), 5)
    kinds = np.bincount(cells % pitman_yor.CONTEXTS, minlength=pitman_yor.CONTEXTS)
    customers = 5.0 * kinds
    shape = pitman_yor.Shape(int(counts.sum()), words, customers, kinds, 0.5, 0.5)
    for tables, seated, parents in pitman_yor.seat(cells, counts, words, shape, 0):
        assert parents.mean() > 1.5 and (parents <= seated).all() and (tables <= counts).all()


def test_sharding(spark, docs, small_dir):
    rows = QUERIES["op5_sharding"](spark, small_dir).collect()
    texts = texts_of(docs)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items())
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))] != sorted(texts)


def test_sharding_writes_whole_records(spark, docs, small_dir):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("shards-*"))
    rows = {r.doc_id: r for r in QUERIES["op5_sharding"](spark, small_dir).collect()}
    (path,) = set(shared.glob("shards-*")) - before
    written = spark.read.parquet(str(path)).collect()
    assert {r.doc_id: r.text or "" for r in written} == texts_of(docs) and len(written) == len(rows)
    assert all((r.shard, r.slot) == (rows[r.doc_id].shard, rows[r.doc_id].slot) for r in written)
    assert {"lang", "source", "n_chars"} <= set(written[0].asDict())
    # The files of a shard, by name, hold its slots in order.
    for shard in path.glob("shard=*"):
        slots = [x for f in sorted(shard.glob("*.parquet")) for x in pq.read_table(f, columns=["slot"], partitioning=None)["slot"].to_pylist()]
        assert slots == list(range(len(slots)))


def test_toxicity_and_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    found = QUERIES["op2_toxicity"](spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    n = found.join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    by = {(r.toxic, r.predicted): r["count"] for r in n}
    assert by.get((0, 1), 0) <= 0.005 * by[0, 0] and by[1, 1] >= 0.8 * (by[1, 1] + by.get((1, 0), 0))
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = QUERIES["op7_language_id"](spark, sf).join(langs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.98
