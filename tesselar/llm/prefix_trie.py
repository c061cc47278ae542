"""Trie of conversation prefixes, held as flat arrays behind a minimal perfect hash.

Every prefix of a conversation is a node, named by a 128-bit digest: the exclusive or of one hash per turn and place.
That sum is built in pieces, so the turns of one conversation may lie in many partitions, and a node's parent is its own
digest without its last turn.  Nodes of one digest are compared by parent, depth, role and text.

Totals of subtrees are added up per shard: the shard's digests get slots by a minimal perfect hash (and every slot is
checked against the digest that it stands for), counts are scattered into flat arrays, and each depth, from the deepest
on, adds its numbers to the places named by the array of parent slots.  A shard holds whole pieces of the trie.  A piece
joins nodes with between SPAN^k and SPAN^(k+1) members, so it is as wide as SPAN nodes at most; pieces of small k come
first and hand their totals to the pieces above.  Nodes with one member need no sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselar.llm.common import cut
from tesselar.scale import ranked

# Members by which the pieces of one round differ, nodes per shard, and characters of one piece of a list of ends.
SPAN, SHARD_NODES, ENDS_CHARS = 1024, 200_000, 1 << 16
# Choices of hashes that are tried before digests count as ambiguous.
TRIES = 4
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


class SlotTable:
    """Minimal perfect hash of distinct 128-bit keys, with the keys themselves for verification.

    Keys that are alone at a place of a bit array get that bit, all others go on to the next array.  A key's slot is the
    number of bits before its own, so n keys have exactly the slots 0 to n − 1.
    """

    def __init__(self, keys: np.ndarray):
        self.levels, rest = [], np.arange(len(keys))
        while len(rest):
            if len(self.levels) == 64:
                raise ValueError("keys are not distinct")
            size = max(8, 2 * len(rest))
            at = _places(keys[rest], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            rest = rest[~alone[at]]
        self.before = [np.cumsum(bits) - bits for bits in self.levels]
        first = 0
        for rank, bits in zip(self.before, self.levels):
            rank += first
            first += int(bits.sum())
        self.keys = np.zeros((len(keys), 2), dtype=np.uint64)
        self.keys[self._find(keys)] = keys

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot, rest = np.full(len(keys), -1), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.before)):
            at = _places(keys[rest], level, len(bits))
            slot[rest[bits[at]]] = rank[at[bits[at]]]
            rest = rest[~bits[at]]
        return slot

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key, −1 for one that the table does not hold."""
        slot = self._find(keys)
        held = slot >= 0
        held[held] = (self.keys[slot[held]] == keys[held]).all(axis=1)
        return np.where(held, slot, -1)


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (keys[:, 0] ^ (keys[:, 1] * _MIX[0])) + np.full(1, level + 1, dtype=np.uint64) * _MIX[1]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def add_up(parent: np.ndarray, depth: np.ndarray, totals: list[np.ndarray]) -> None:
    """Adds every place's totals to its parent's (−1: none), the deepest places first."""
    order = np.argsort(-depth, kind="stable")
    ends = np.flatnonzero(np.diff(depth[order], append=-1)) + 1
    for lo, hi in zip(np.concatenate(([0], ends[:-1])), ends):
        here = order[lo:hi]
        here = here[parent[here] >= 0]
        for total in totals:
            np.add.at(total, parent[here], total[here])


def _pair(t: pa.Table, *names: str) -> np.ndarray:
    return np.stack([t[n].to_numpy() for n in names], axis=1).view(np.uint64)


def _shard_totals(t: pa.Table) -> pa.Table:
    """Subtree totals of one shard's nodes; ``top`` marks nodes whose parent is not in the shard."""
    keys = _pair(t, "p1", "p2")
    table = SlotTable(keys)
    slot = table.slots(keys)
    if not (np.bincount(slot, minlength=len(keys)) == 1).all():
        raise ValueError("two nodes share a slot")
    n = len(keys)
    flat = {c: np.zeros(n, dtype=np.int64) for c in ("depth", "leaves", "saved")}
    for c, values in flat.items():
        values[slot] = t[c].to_numpy()
    parents = np.zeros((n, 2), dtype=np.uint64)
    parents[slot] = _pair(t, "q1", "q2")
    parent = table.slots(parents)
    parent[flat["depth"] == 0] = -1
    add_up(parent, flat["depth"], [flat["leaves"], flat["saved"]])
    own, up = table.keys.view(np.int64), parents.view(np.int64)
    columns = [own[:, 0], own[:, 1], up[:, 0], up[:, 1], flat["leaves"], flat["saved"], parent < 0]
    return pa.table([pa.array(np.ascontiguousarray(c)) for c in columns], names=["p1", "p2", "q1", "q2", "leaves", "saved", "top"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), role, text: turns by turn (NULL first), ties by role and text; NULL texts are empty.

    Rows without conv_id belong to no conversation and are left out.  A conversation may have any share of all rows.
    """
    empty = F.lit("")
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"), F.monotonically_increasing_id().alias("nth"),
    )
    return ranked(turns, ["conv_id"], ["turn", "role", "text", "nth"], "depth").select(
        "conv_id", (F.col("depth") + 1).alias("depth"), "role", "text",
    )


def grafted(turns: DataFrame, group: int, heads: int, head: Column) -> DataFrame:
    """Conversations whose first ``head`` turns (fewer than ``heads``) come from the conversation conv_id − conv_id % group.

    The own turns follow after the first ``head`` ones.  A missing or short source gives fewer turns.  The result has
    conv_id, depth, role and text; conversations that lose all turns have no row in it.
    """
    sizes = cut(turns.groupBy("conv_id").agg(F.count("*").alias("size")), "sizes")
    source = F.col("conv_id") - F.col("conv_id") % group
    asked = sizes.select("conv_id", source.alias("source"), head.alias("head"))
    from_source = sizes.select(F.col("conv_id").alias("source"), "size")
    taken = cut(
        asked.join(from_source, "source", "left")
        .select("conv_id", "source", "head", F.least("head", F.coalesce("size", F.lit(0))).alias("taken")), "grafts",
    )
    first = turns.filter((F.col("conv_id") % group == 0) & (F.col("depth") < heads)).withColumnRenamed("conv_id", "source")
    begin = taken.join(first, "source").filter(F.col("depth") <= F.col("head")).select("conv_id", "depth", "role", "text")
    own = turns.join(taken, "conv_id").filter(F.col("depth") > F.col("head"))
    return begin.unionByName(own.select("conv_id", (F.col("depth") - F.col("head") + F.col("taken")).alias("depth"), "role", "text"))


def _running(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exclusive or of the hashes of a conversation's turns so far, within a sorted partition."""
    last, carry = None, np.zeros(2, dtype=np.int64)
    for t in tables:
        if not t.num_rows:
            continue
        conv = t.column("conv_id").to_numpy()
        start = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        new = []
        for k, name in enumerate(("w1", "w2")):
            total = np.bitwise_xor.accumulate(t.column(name).to_numpy())
            before = np.concatenate(([0], total[start[1:] - 1]))
            if conv[0] == last:
                before[0] = carry[k]
            so_far = total ^ np.repeat(before, np.diff(start, append=len(conv)))
            new.append(pa.array(so_far))
            carry[k] = so_far[-1]
        last = conv[-1]
        yield pa.RecordBatch.from_arrays([*t.columns, *new], names=[*t.schema.names, "s1", "s2"])


def _paths(turns: DataFrame, members: DataFrame, seed: int) -> DataFrame:
    """conv_id, depth, role, text, own digest p and parent's digest q of every prefix, the empty one included."""
    w = [F.xxhash64(F.lit(2 * seed + k), "depth", "role", "text").alias(f"w{k + 1}") for k in (0, 1)]
    placed = cut(
        turns.select("conv_id", "depth", "role", "text", *w).repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(_running, "conv_id bigint, depth bigint, role string, text string, w1 bigint, w2 bigint, part int, s1 bigint, s2 bigint"),
        "digests",
    )
    # A conversation that goes on from earlier partitions adds their turns: at most one per partition does.
    runs = Window.partitionBy("conv_id").orderBy("part")
    earlier = runs.rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("conv_id", "part").agg(F.bit_xor("w1").alias("x1"), F.bit_xor("w2").alias("x2"))
    going_on = parts.select(
        "conv_id", "part", F.row_number().over(runs).alias("nth"), F.bit_xor("x1").over(earlier).alias("o1"), F.bit_xor("x2").over(earlier).alias("o2"),
    ).filter("nth > 1").drop("nth")
    p = [F.col(f"s{k}").bitwiseXOR(F.coalesce(f"o{k}", F.lit(0))).alias(f"p{k}") for k in (1, 2)]
    digests = placed.join(cut(going_on, "going-on"), ["conv_id", "part"], "left").select("conv_id", "depth", "role", "text", "w1", "w2", *p)
    q = [F.col(f"p{k}").bitwiseXOR(F.col(f"w{k}")).alias(f"q{k}") for k in (1, 2)]
    zero, none = F.lit(0).cast("bigint"), F.lit("")
    roots = members.select("conv_id", zero.alias("depth"), none.alias("role"), none.alias("text"), *[zero.alias(c) for c in ("p1", "p2", "q1", "q2")])
    return digests.select("conv_id", "depth", "role", "text", "p1", "p2", *q).unionByName(roots)


def _nodes(paths: DataFrame) -> tuple[DataFrame, bool]:
    """One row per digest, and whether all its prefixes were equal (same parent, depth, role and text)."""
    same = ("depth", "q1", "q2", "role", "text")
    found = paths.groupBy("p1", "p2").agg(
        *[f(c).alias(f"{c}_{n}") for c in same for f, n in ((F.min, "a"), (F.max, "z"))], F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
    )
    equal = F.lit(True)
    for c in same:
        equal = equal & (F.col(f"{c}_a") == F.col(f"{c}_z"))
    nodes = cut(
        found.select(
            "p1", "p2", F.col("q1_a").alias("q1"), F.col("q2_a").alias("q2"), F.col("depth_a").alias("depth"), "n_convs", "conv_id",
            F.char_length("text_a").cast("bigint").alias("chars"), equal.alias("equal"),
        ), "nodes",
    )
    return nodes, nodes.filter(~F.col("equal")).isEmpty()


def _joined(limit: int):
    """Pieces of the lists of ends: runs of a sorted partition's ids under one digest."""

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size = None, [], 0
        row = lambda: pa.RecordBatch.from_pydict({"p1": [node[0]], "p2": [node[1]], "first": [ids[0]], "ids": [",".join(map(str, ids))]})
        for t in tables:
            for p1, p2, conv in zip(*(c.to_pylist() for c in t.columns)):
                if ids and (node != (p1, p2) or size > limit):
                    yield row()
                    ids, size = [], 0
                node = p1, p2
                ids.append(conv)
                size += 12
        if ids:
            yield row()

    return work


def _hashed(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each digest in order; only the hash's state is held."""
    node, state = None, None
    row = lambda: pa.RecordBatch.from_pydict({"p1": [node[0]], "p2": [node[1]], "ends_sha256": [state.hexdigest()]})
    for t in tables:
        for p1, p2, ids in zip(*(c.to_pylist() for c in t.columns)):
            if node != (p1, p2):
                if node is not None:
                    yield row()
                node, state = (p1, p2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if node is not None:
        yield row()


def _ends(paths: DataFrame) -> DataFrame:
    """p1, p2 and the digest of the ids of conversations that end there."""
    last = paths.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ends = paths.select("conv_id", "depth", "p1", "p2").join(last, ["conv_id", "depth"]).select("p1", "p2", "conv_id")
    order = ["p1", "p2", "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined(ENDS_CHARS), "p1 bigint, p2 bigint, first bigint, ids string")
    in_order = pieces.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first").select("p1", "p2", "ids")
    return in_order.mapInArrow(_hashed, "p1 bigint, p2 bigint, ends_sha256 string")


def _subtree_totals(nodes: DataFrame, paths: DataFrame) -> DataFrame | None:
    """p1, p2, leaves, saved of every node with two members or more (``nodes`` has n_children and n_single)."""
    rank = sum(((F.col("n_convs") >= SPAN**k).cast("int") for k in range(1, 64) if SPAN**k < 1 << 63), F.lit(0))
    shared = cut(
        nodes.filter("n_convs > 1").select(
            "p1", "p2", "q1", "q2", "depth", "conv_id", rank.alias("rank"),
            ((F.col("n_children") == 0).cast("bigint") + F.col("n_single")).alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        ), "shared",
    )
    highest = shared.agg(F.max("rank")).first()[0]
    if highest is None:
        return None
    # The topmost node of a piece, by the path of the node's smallest member.
    way = paths.select("conv_id", "p1", "p2").join(shared.select("conv_id").distinct(), "conv_id", "left_semi")
    on_way = way.join(shared.select("p1", "p2", "depth", "rank"), ["p1", "p2"])
    tops = on_way.groupBy("conv_id", "rank").agg(F.min_by(F.struct("p1", "p2"), "depth").alias("top"))
    columns = ["p1", "p2", "q1", "q2", "depth", "leaves", "saved"]
    pieces = cut(shared.join(tops, ["conv_id", "rank"]).select(*columns, "rank", "top"), "pieces")
    done, handed = [], None
    for k in range(highest + 1):
        mine = pieces.filter(F.col("rank") == k)
        if handed is not None:
            more = handed.groupBy("q1", "q2").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
            more = more.withColumnsRenamed({"q1": "p1", "q2": "p2"})
            plus = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
            mine = mine.join(more, ["p1", "p2"], "left").select("p1", "p2", "q1", "q2", "depth", "top", plus("leaves"), plus("saved"))
        shards = max(1, -(-mine.count() // SHARD_NODES))
        totals = cut(
            mine.select("p1", "p2", "q1", "q2", "depth", "leaves", "saved", F.pmod(F.xxhash64("top"), F.lit(shards)).alias("shard"))
            .groupBy("shard").applyInArrow(_shard_totals, "p1 bigint, p2 bigint, q1 bigint, q2 bigint, leaves bigint, saved bigint, top boolean"),
            "totals",
        )
        done.append(totals.select("p1", "p2", "leaves", "saved"))
        up = totals.filter("top").select("q1", "q2", "leaves", "saved")
        handed = up if handed is None else handed.unionByName(up)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations' (role, text) sequences.

    ``turns(conv_id, depth, role, text)`` has depths from 1 without gaps, ``members(conv_id)`` names every conversation
    once, also those without turns.  The result: conv_id (smallest member), depth, parent_conv_id (the parent's smallest
    member, NULL at the root), n_convs (members), n_children, n_leaves (nodes without children in the subtree, itself
    included), saved_tokens (code points of last texts times members but one, summed over the subtree), ends_sha256 (of
    the ascending decimal ids of members that end there, joined by commas).  An empty table has no root and no rows.

    Members are combined before they are shuffled and joins are plain equi-joins, so a prefix that a third of all
    conversations share costs a row per partition.  A list of ends is hashed by one task, which holds none of it.  The
    longest shared conversation times SPAN bounds a piece.
    """
    for seed in range(TRIES):
        paths = cut(_paths(turns, members, seed), "paths")
        nodes, equal = _nodes(paths)
        if equal:
            break
    else:
        raise RuntimeError("prefix digests collide")
    below = nodes.filter("depth > 0").groupBy("q1", "q2").agg(F.count("*").alias("n_children"), F.sum((F.col("n_convs") == 1).cast("bigint")).alias("n_single"))
    below = below.withColumnsRenamed({"q1": "p1", "q2": "p2"})
    nodes = cut(nodes.join(below, ["p1", "p2"], "left").fillna(0, ["n_children", "n_single"]), "trie")
    totals = _subtree_totals(nodes, paths)
    one = nodes.select("p1", "p2", F.lit(1).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved")).filter("false")
    found = nodes.join(totals if totals is not None else one, ["p1", "p2"], "left").join(_ends(paths), ["p1", "p2"], "left")
    above = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    root = F.col("depth") == 0
    return found.join(above, ["q1", "q2"], "left").select(
        "conv_id", "depth", F.when(~root, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
