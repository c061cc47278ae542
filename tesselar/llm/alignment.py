"""Which tokens of two tokenizers stand for the same bytes, and how often an id pair meets in a corpus.

A token-byte incidence matrix has one row per token and a one for each byte that it covers; it is held as compressed
sparse rows built by hand from the token lengths.  Gustavson's row products A·Bᵀ give the overlap links: row i of the
product adds up the rows of Bᵀ (bytes × tokens) named by the bytes of token i, and its values are the shared bytes.
Offsets at which tokens of both sides end cut the tokens into groups; the product of the token-group incidences gives
the shared-group links.  No link crosses a group, so long texts are multiplied in runs of whole groups.
"""

from __future__ import annotations

import array
import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm.common import cut

# Bytes of text that share one list of distinct id pairs, that are aligned together and that one product covers.
SLICE_BYTES, BATCH_BYTES, PRODUCT_BYTES = 32 << 20, 1 << 20, 1 << 18
SPACE_PIECE = "▁"
# Encoded pieces that a worker remembers per side, and the longest one worth remembering.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64


class Csr(NamedTuple):
    """Row i has the columns ``columns[starts[i]:starts[i + 1]]``, in rising order."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1


def token_bytes(lengths: np.ndarray) -> Csr:
    """Tokens × bytes of tokens that follow each other without a gap."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return Csr(starts, np.arange(starts[-1]), int(starts[-1]))


def token_groups(group: np.ndarray, groups: int) -> Csr:
    """Tokens × groups; every token is in one group."""
    return Csr(np.arange(len(group) + 1), group, groups)


def transposed(m: Csr) -> Csr:
    rows = np.repeat(np.arange(m.height), np.diff(m.starts))
    order = np.argsort(m.columns, kind="stable")
    return Csr(np.concatenate(([0], np.cumsum(np.bincount(m.columns, minlength=m.width)))), rows[order], m.height)


def gustavson(a: Csr, b: Csr) -> tuple[Csr, np.ndarray]:
    """a·b of 0/1 matrices and its values: the rows of b named by a row of a, with equal columns added up."""
    fan = np.diff(b.starts)[a.columns]
    ends = np.cumsum(fan)
    rows = np.repeat(np.repeat(np.arange(a.height), np.diff(a.starts)), fan)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(b.starts[a.columns] - ends + fan, fan)
    key = rows * b.width + b.columns[at]
    if len(key) and (key[1:] < key[:-1]).any():
        key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    row, column = np.divmod(key[first], b.width) if len(first) else (key, key)
    starts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=a.height))))
    return Csr(starts, column, b.width), np.diff(first, append=len(key))


class Aligned(NamedTuple):
    """Tokens of a batch of texts, all texts behind each other."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    groups: int
    ends_a: np.ndarray
    ends_b: np.ndarray

    def blocks(self) -> Iterator[tuple[slice, slice]]:
        """Runs of whole groups of about PRODUCT_BYTES, as token ranges of both sides."""
        last = np.flatnonzero(np.diff(self.group_a, append=self.groups))
        byte = self.ends_a[last]
        block = np.concatenate(([0], byte[:-1])) // PRODUCT_BYTES
        cuts = np.concatenate((np.flatnonzero(np.diff(block)), [len(last) - 1])) if len(last) else []
        i = j = 0
        for g in cuts:
            k, m = int(last[g]) + 1, int(np.searchsorted(self.group_b, g, side="right"))
            yield slice(i, k), slice(j, m)
            i, j = k, m

    def overlap_links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the linked tokens of A and B, and the bytes that they share."""
        lengths_a, lengths_b = np.diff(self.ends_a, prepend=0), np.diff(self.ends_b, prepend=0)
        return self._links(lambda s, t: gustavson(token_bytes(lengths_a[s]), transposed(token_bytes(lengths_b[t]))))

    def group_links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the tokens of A and B that are in one group."""

        def product(s, t):
            base = self.group_a[s.start]
            width = int(self.group_a[s.stop - 1] - base) + 1
            return gustavson(token_groups(self.group_a[s] - base, width), transposed(token_groups(self.group_b[t] - base, width)))

        return self._links(product)

    def _links(self, product) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [(s, t, *product(s, t)) for s, t in self.blocks()]
        if not found:
            return (np.zeros(0, dtype=np.int64),) * 3
        a = np.concatenate([np.repeat(np.arange(m.height) + s.start, np.diff(m.starts)) for s, _, m, _ in found])
        b = np.concatenate([m.columns + t.start for _, t, m, _ in found])
        return a, b, np.concatenate([v for *_, v in found])


def aligned(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """``size_a`` and ``size_b`` give the bytes of every id; both sides must cover the same bytes."""
    ends_a, ends_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
    total = int(ends_a[-1]) if len(ends_a) else 0
    is_end_a, is_end_b = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
    is_end_a[ends_a], is_end_b[ends_b] = True, True
    both_a, both_b = is_end_b[ends_a], is_end_a[ends_b]
    group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
    return Aligned(ids_a, ids_b, group_a, group_b, int(both_a.sum()), ends_a, ends_b)


def _byte_letters() -> dict[str, int]:
    """Letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows 0x100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class Side:
    """One tokenizer of a worker: encodes texts piece by piece, and each piece once.

    ``pieces`` cuts space and text into strings that the tokenizer never joins, ``encode`` gives the ids of many of them.
    """

    def __init__(self, pieces, encode, entries: list[bytes]):
        self.pieces, self._encode, self.entries = pieces, encode, entries
        self.size = np.array([len(x) for x in entries])
        self.known: dict[str, bytes | None] = {}

    def encode(self, spaced: list[str]) -> list[bytes | None]:
        """Ids as 32-bit integers; None for a text whose joined token bytes differ from it."""
        cut_up = [self.pieces(t) for t in spaced]
        wanted = set().union(*cut_up)
        missing = [p for p in wanted if p not in self.known]
        if len(self.known) + len(missing) > CACHE_ENTRIES:
            self.known, missing = {}, list(wanted)
        found, entries = self.known, self.entries
        for piece, ids in zip(missing, self._encode(missing)):
            found[piece] = array.array("I", ids).tobytes() if b"".join([entries[i] for i in ids]) == piece.encode() else None
        differ = {p for p in wanted if found[p] is None}
        out = [None if differ and differ.intersection(pieces) else b"".join([found[p] for p in pieces]) for pieces in cut_up]
        for piece in missing:
            if len(piece) > CACHE_CHARS:
                del found[piece]
        return out


# Texts of these characters are cut here as byte-level vocabularies cut them; any other text is one piece.
_PLAIN = re.compile("[\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u2010-\u2027]*").fullmatch
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
# The published pattern of such vocabularies, with the letters and digits of plain texts for its classes (fixed value).
_BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+").findall
# A run of spaces with what follows it; spaces at the end go with the last word.
_SPACE_PIECES = re.compile(r" +[^ ]+(?: +\Z)?| +\Z").findall


class Tokenizers:
    """Both tokenizers of one worker with the bytes of all their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        a.encode_special_tokens = True
        letters = _byte_letters()
        words = a.get_vocab(with_added_tokens=True)
        bytes_a = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            bytes_a[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE_PIECE, " ").encode() for i, p in enumerate(pieces)]
        self.a = Side(lambda t: _BYTE_PIECES(t) if _PLAIN(t) else [t], lambda x: [e.ids for e in a.encode_batch_fast(x, add_special_tokens=False)], bytes_a)
        # Pieces meet only in front of a space if no entry has a space behind another character.
        apart = not any(SPACE_PIECE in p.lstrip(SPACE_PIECE) for p in pieces)
        # The model adds the first space itself.
        self.b = Side(_SPACE_PIECES if apart else lambda t: [t], lambda x: b.encode([t[1:] for t in x], num_threads=1), bytes_b)
        # The decimal ids with the mark that follows them: A's end with "," or "|", B's with "," or ";".
        ids_a, ids_b = range(len(bytes_a)), range(len(bytes_b))
        self.written = [f"{i}," for i in ids_a] + [f"{i}|" for i in ids_a] + [f"{i}," for i in ids_b] + [f"{i};" for i in ids_b]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides of all texts, and each text's number of ids; texts that are empty or not reproduced have none."""
        spaced = [" " + t for t in texts]
        both = [(x, y) if t and x is not None and y is not None else (b"", b"") for t, x, y in zip(texts, self.a.encode(spaced), self.b.encode(spaced))]
        ids = [np.frombuffer(b"".join([x[k] for x in both]), dtype=np.uint32).astype(np.int64) for k in (0, 1)]
        return *ids, *[np.array([len(x[k]) // 4 for x in both], dtype=np.int64) for k in (0, 1)]

    def groups_text(self, x: Aligned) -> list[str]:
        """Every token's decimal id and the mark behind it, in the order of the groups text of the whole batch."""
        n_a, n_b = len(self.a.entries), len(self.b.entries)
        last_a, last_b = np.diff(x.group_a, append=x.groups) > 0, np.diff(x.group_b, append=x.groups) > 0
        code_a = x.a + n_a * last_a
        code_b = x.b + 2 * n_a + n_b * last_b
        # A token stands behind its own side's earlier tokens and behind the other side's tokens of earlier groups (for
        # B also of its own group).
        per_a, per_b = np.bincount(x.group_a, minlength=x.groups), np.bincount(x.group_b, minlength=x.groups)
        code = np.empty(len(x.a) + len(x.b), dtype=np.int64)
        code[np.arange(len(x.a)) + (np.cumsum(per_b) - per_b)[x.group_a]] = code_a
        code[np.arange(len(x.b)) + np.cumsum(per_a)[x.group_b]] = code_b
        written = self.written
        return [written[c] for c in code.tolist()]


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One pair of tokenizers per worker process, kept between tasks."""
    if (path_a, path_b) not in _LOADED:
        _LOADED.clear()
        _LOADED[path_a, path_b] = Tokenizers(path_a, path_b)
    return _LOADED[path_a, path_b]


def _batches(pairs: Iterator[tuple[object, str]], limit: int) -> Iterator[list]:
    """Lists of (id, text) of about ``limit`` bytes; a longer text is a list of its own size."""
    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, packed: small numbers take little room."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _numbers(packed: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


SLICED = (
    "slice bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, groups_sha256 string, "
    "places binary, times binary, pairs binary, in_documents binary"
)
_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


def _align_batch(tools: Tokenizers, batch: list) -> tuple[list[dict], list[np.ndarray], list[np.ndarray]]:
    """Per text: counts and digest, the distinct linked id pairs (as one number) and how often each is linked."""
    ids_a, ids_b, n_a, n_b = tools.encode([t for _, t in batch])
    x = aligned(ids_a, ids_b, tools.a.size, tools.b.size)
    at_a, at_b, _ = x.overlap_links()
    written = tools.groups_text(x)
    doc_a = np.repeat(np.arange(len(batch)), n_a)
    groups = np.bincount(doc_a[np.flatnonzero(np.diff(x.group_a, append=x.groups))], minlength=len(batch))
    links = np.bincount(doc_a[at_a], minlength=len(batch))
    per_a, per_b = np.bincount(x.group_a, minlength=x.groups), np.bincount(x.group_b, minlength=x.groups)
    shared = np.add.reduceat(np.append(per_a * per_b, 0), np.minimum(np.cumsum(groups) - groups, x.groups)) * (groups > 0)
    width = len(tools.a.entries) * len(tools.b.entries)
    key = doc_a[at_a] * width + x.a[at_a] * len(tools.b.entries) + x.b[at_b]
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    doc, pair = np.divmod(key[first], width)
    times = np.diff(first, append=len(key))
    of_doc = np.searchsorted(doc, np.arange(len(batch) + 1))
    ends = np.concatenate(([0], np.cumsum(n_a + n_b)))
    rows = []
    for i, (doc_id, _) in enumerate(batch):
        text = "".join(written[ends[i] : ends[i + 1]])[:-1]
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        rows.append(dict(doc_id=doc_id, n_a=int(n_a[i]), n_b=int(n_b[i]), n_groups=int(groups[i]), n_links=int(links[i]), n_shared=int(shared[i]), groups_sha256=digest))
    cut_up = lambda v: [v[of_doc[i] : of_doc[i + 1]] for i in range(len(batch))]
    return rows, cut_up(pair), cut_up(times)


def _sliced(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document, and one per slice with the slice's distinct pairs and the documents that hold each.

    A document names its pairs by their places in the slice's list, as differences.
    """
    kept = SLICE_BYTES, BATCH_BYTES

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tokenizers(path_a, path_b)
        slice_bytes, batch_bytes = kept
        name = None
        schema = pa.schema([
            ("slice", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("groups_sha256", pa.string()),
            *[(c, pa.binary()) for c in ("places", "times", "pairs", "in_documents")],
        ])

        def texts():
            nonlocal name
            for t in tables:
                for nth, doc_id, text in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2)):
                    name = nth if name is None else name
                    yield doc_id, text.as_py() or ""

        def ended(rows, pairs, times):
            """The rows of a slice in batches of bounded size."""
            everything, count = np.unique(np.concatenate(pairs), return_counts=True)
            for i in range(0, len(rows), 2000):
                part = []
                for row, p, t in zip(rows[i : i + 2000], pairs[i : i + 2000], times[i : i + 2000]):
                    places = np.diff(np.searchsorted(everything, p), prepend=0)
                    part.append(row | dict(slice=name, places=_planes(places), times=_planes(t)))
                yield pa.RecordBatch.from_pylist(part, schema=schema)
            yield pa.RecordBatch.from_pylist([dict(slice=name, pairs=everything.tobytes(), in_documents=count.tobytes())], schema=schema)

        rows, pairs, times, size = [], [], [], 0
        for batch in _batches(texts(), batch_bytes):
            for held, more in zip((rows, pairs, times), _align_batch(tools, batch)):
                held.extend(more)
            size += sum(len(t) for _, t in batch)
            if size >= slice_bytes:
                yield from ended(rows, pairs, times)
                rows, pairs, times, size, name = [], [], [], 0, None
        if rows:
            yield from ended(rows, pairs, times)

    named = docs.select(F.monotonically_increasing_id().alias("nth"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return named.mapInArrow(work, SLICED)


def _exploded(slices: DataFrame) -> DataFrame:
    """(slice, place, pair, n) of the slices' lists."""

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            for name, pairs, n in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2).to_pylist()):
                pair, count = np.frombuffer(pairs, dtype=np.int64), np.frombuffer(n, dtype=np.int64)
                for i in range(0, len(pair), 50_000):
                    p = pair[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p), name)), pa.array(np.arange(i, i + len(p), dtype=np.int32)), pa.array(p), pa.array(count[i : i + 50_000])],
                        names=["slice", "place", "pair", "n"],
                    )

    return slices.filter("pairs IS NOT NULL").select("slice", "pairs", "in_documents").mapInArrow(work, "slice bigint, place int, pair bigint, n bigint")


def _answer(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over the links of every document of a slice."""
    docs = docs.filter(pc.is_null(docs["pairs"]))
    total, best = np.zeros(len(answers), dtype=np.int64), np.zeros(len(answers), dtype=np.int64)
    at = answers["place"].to_numpy()
    total[at], best[at] = answers["total"].to_numpy(), answers["best"].to_numpy()
    sums, n_best = [], []
    for places, times in zip(docs["places"].to_pylist(), docs["times"].to_pylist()):
        p, t = np.cumsum(_numbers(places)), _numbers(times)
        sums.append(int((total[p] * t).sum()))
        n_best.append(int((best[p] * t).sum()))
    out = docs.select(["doc_id", *_COUNTS, "groups_sha256"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``docs(doc_id, text)`` → doc_id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, n_best, count_sum.

    A encodes space and text by a byte-level BPE file, B the text by a sentencepiece model that adds the space; special
    tokens are plain text.  n_links counts overlap links, n_shared shared-group links.  The count of an id pair is the
    number of documents that hold it linked; n_best counts the links whose pair has the highest count of its A id (ties
    included), count_sum adds the counts over the links.  NULL and empty texts, and texts whose token bytes differ from
    space and text, have zeros and an empty digest.  Repeated rows and rows without id are documents of their own, an
    empty table gives an empty result, other columns are not read.

    Pairs are counted per slice of SLICE_BYTES before they are shuffled, and every slice asks once for each of its
    distinct pairs, so a pair that all documents share costs one row per slice.  A text is encoded whole by one task.
    """
    rows = cut(_sliced(docs, path_a, path_b), "aligned")
    pairs = _exploded(rows)
    width = _vocabulary_b(path_b)
    totals = cut(pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("a", F.expr(f"pair div {width}")), "pair-counts")
    # One row per A id: as many as the vocabulary has, whatever the corpus.
    highest = totals.groupBy("a").agg(F.max("total").alias("highest"))
    judged = totals.join(F.broadcast(highest), "a").select("pair", "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))
    answers = pairs.select("slice", "place", "pair").join(judged, "pair").select("slice", "place", "total", "best")
    out = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return rows.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_answer, out)


def _vocabulary_b(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def links(docs: DataFrame, path_a: str, path_b: str, kind: str = "overlap") -> DataFrame:
    """One row per link: doc_id, place_a, place_b (token numbers from 0), id_a, id_b, shared.

    ``kind`` is "overlap" (shared: common bytes) or "group" (tokens of one group; shared is 1).  Texts without tokens
    have no rows.
    """
    if kind not in ("overlap", "group"):
        raise ValueError("kind must be 'overlap' or 'group'")
    limit = BATCH_BYTES

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tokenizers(path_a, path_b)
        texts = ((i, t or "") for table in tables for i, t in zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
        for batch in _batches(texts, limit):
            for doc_id, text in batch:
                x = aligned(*tools.encode([text])[:2], tools.a.size, tools.b.size)
                i, j, shared = x.overlap_links() if kind == "overlap" else x.group_links()
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * len(i), pa.int64()), pa.array(i), pa.array(j), pa.array(x.a[i]), pa.array(x.b[j]), pa.array(shared)],
                        names=["doc_id", "place_a", "place_b", "id_a", "id_b", "shared"],
                    )

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return ids.mapInArrow(work, "doc_id bigint, place_a bigint, place_b bigint, id_a bigint, id_b bigint, shared bigint")
