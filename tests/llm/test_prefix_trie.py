"""Conversation prefix trie against a dictionary of prefixes; its slot table and sums against plain loops."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselar.llm import prefix_trie as pt
from tests.compare import connect, differences, spark_table, sql_table
from tesselar.llm.queries import ORACLE, QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_dictionary(conversations):
    """Rows of the trie of {conv_id: [(role, text), …]}."""
    members = collections.defaultdict(list)
    for c in sorted(conversations):
        for d in range(len(conversations[c]) + 1):
            members[tuple(conversations[c][:d])].append(c)
    children = collections.defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    ends = lambda k: ",".join(str(c) for c in members[k] if len(conversations[c]) == len(k))
    return sorted(
        ((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest())
         for k, m in members.items()), key=repr,
    )


def grafted(conversations):
    out = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = conversations.get(c - c % 100, [])[:h] + own[h:]
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def turns_of(spark, conversations, partitions=3):
    rows = [(c, d + 1, r, t) for c, turns in conversations.items() for d, (r, t) in enumerate(turns)]
    members = spark.createDataFrame([(c,) for c in conversations], "conv_id bigint")
    return spark.createDataFrame(rows, "conv_id bigint, depth bigint, role string, text string").repartition(partitions), members


def test_slots():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 20_000):
        keys = rng.integers(0, 2**63, (2 * n + 3, 2)).astype(np.uint64)
        table = pt.SlotTable(keys[:n])
        assert sorted(table.slots(keys[:n]).tolist()) == list(range(n)) and (table.slots(keys[n:]) == -1).all()
    with pytest.raises(ValueError):
        pt.SlotTable(np.ones((2, 2), dtype=np.uint64))


def test_sums():
    rng = np.random.default_rng(1)
    parent = np.array([-1, *[rng.integers(0, i) for i in range(1, 500)]])
    depth = np.zeros(500, dtype=np.int64)
    for i in range(1, 500):
        depth[i] = depth[parent[i]] + 1
    shuffled = rng.permutation(500)
    back = np.argsort(shuffled)
    value = rng.integers(0, 9, 500)
    want = value.copy()
    for i in range(499, 0, -1):
        want[parent[i]] += want[i]
    got = value[shuffled].copy()
    pt.add_up(np.where(parent[shuffled] < 0, -1, back[parent[shuffled]]), depth[shuffled], [got])
    assert (got == want[shuffled]).all()


def random_conversations(rng, n):
    """Many short ones over a small alphabet, copies of a long one, and conversations without turns."""
    words = [("user", "a"), ("user", "bb"), ("assistant", "a"), ("assistant", "日本"), ("", "")]
    out = {int(c): [words[i] for i in rng.integers(0, len(words) - 2 * (c % 2), rng.integers(0, 7))] for c in rng.choice(10**6, n, replace=False)}
    long = [("user", f"turn {i}") for i in range(120)]
    return out | {10**9 + i: long[: 120 - i % 3] for i in range(40)} | {-5: [], 7 * 10**6: [], 8 * 10**6: [*long, ("x", "y")] * 3}


@pytest.mark.parametrize("span", [2, 5, 1024])
def test_trie(spark, monkeypatch, span):
    monkeypatch.setattr(pt, "SPAN", span)
    if span < 1024:
        monkeypatch.setattr(pt, "SHARD_NODES", 40)
        monkeypatch.setattr(pt, "ENDS_CHARS", 30)
    conversations = random_conversations(np.random.default_rng(span), 400)
    assert rows_of(pt.prefix_trie(*turns_of(spark, conversations))) == by_dictionary(conversations)


def test_colliding_digests(spark, monkeypatch):
    """Equal digests of different prefixes are noticed; other hashes are tried, then the job fails."""
    conversations = {1: [("u", "a"), ("u", "b")], 2: [("u", "c")]}
    paths, seeds = pt._paths, []

    def weak(turns, members, seed):
        seeds.append(seed)
        found = paths(turns, members, seed)
        return found.withColumns({c: F.lit(5).cast("bigint") for c in ("p1", "p2")}) if seed < 2 else found

    monkeypatch.setattr(pt, "_paths", weak)
    assert rows_of(pt.prefix_trie(*turns_of(spark, conversations))) == by_dictionary(conversations) and seeds == [0, 1, 2]
    monkeypatch.setattr(pt, "TRIES", 2)
    with pytest.raises(RuntimeError):
        pt.prefix_trie(*turns_of(spark, conversations))


def test_query(spark):
    for d in ("sf0.001", "sf0.01"):
        got = spark_table(QUERIES["op13_prefix_trie"](spark, f"/root/testdata/{d}"))
        assert not differences(got, sql_table(connect(f"/root/testdata/{d}"), ORACLE["op13_prefix_trie"]))


def test_odd_input(spark, tmp_path):
    """NULLs in any column, ties, repeated rows, empty texts, a long conversation, other columns; SQL agrees."""
    rows = [
        (100, None, "user", "first"), (100, 0, None, None), (100, 0, None, ""), (100, 0, "user", "b"), (100, 0, "user", "a"), (100, 0, "user", "a"),
        (101, 5, "user", "x"), (102, 1, "user", "y" * 100_000), (None, 1, "user", "nobody"), (205, 1, "a", "no source"), (-7, 0, "user", "minus"),
        *[(c, t, "user", f"same {t}") for c in (300, 301, 302, 303) for t in range(8)], *[(400, t, "user", f"t{t % 7}") for t in range(3000)],
    ]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("depth", F.lit(1)).withColumn("p1", F.lit(2))
    frame.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = rows_of(QUERIES["op13_prefix_trie"](spark, str(tmp_path)))
    conversations = collections.defaultdict(list)
    for c, _, r, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        conversations[c].append((r or "", t or ""))
    assert got == by_dictionary(grafted(conversations))
    frame.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert rows_of(QUERIES["op13_prefix_trie"](spark, str(tmp_path / "none"))) == []
