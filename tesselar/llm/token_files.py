"""Token ids in binary files, packed by a word-aligned code.

A file holds whole documents.  Its ids are cut into blocks of BLOCK ids; each block is a row of 64-bit words in the
Simple-8b manner: the top four bits select how many ids of which width share the other 60.  The largest number of a
width is an escape mark: the id itself stands in the block's list of escapes, so one rare id does not widen its
neighbours.  The offsets of every block's words and escapes are stored, so any run of blocks is decoded at once.

Layout, little-endian: magic; words (u64); escapes (u32); block offsets (u64 pairs: words, escapes; one more than blocks);
doc ids (i64); doc id is NULL (u8); ids per document (u64); tail (six u64: ids, words, escapes, blocks, documents, block
size); magic.
"""

from __future__ import annotations

import array
import itertools
import os
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselar.llm.common import cut
from tesselar.scale import shared_dir

MAGIC = b"TSLIDS01"
BLOCK = 4096
# Ids after which a file is closed, blocks decoded at once, bytes of texts encoded at once, ids per batch of rows.
FILE_IDS, BLOCKS_AT_ONCE, TEXT_BYTES, ROW_IDS = 8 << 20, 256, 12 << 20, 1 << 20
# Files per run of the two-level offset sum, and most tasks that read files.
RUN, READERS = 1024, 16_384
# Pieces per call of the library.
PIECES_AT_ONCE = 500
# Mark at the end of the last entry of a word (a fixed value of the vocabulary's format).
PIECE_END = "</w>"

# Ids per word by selector (fixed values of the code); the width is what 60 bits give each, none for runs of zeros.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
# Largest id that a width holds beside the escape mark.
LARGEST = np.where(WIDTHS > 0, (1 << WIDTHS) - 2, 0)
_TAIL = 6 * 8 + len(MAGIC)


class Packed(NamedTuple):
    words: np.ndarray
    escapes: np.ndarray
    word_offsets: np.ndarray
    escape_offsets: np.ndarray


def _selectors(rows: np.ndarray, block: int) -> np.ndarray:
    """For a word that begins at each id: the selector with the fewest bits per id, escapes included.

    ``rows`` has one block per row, with zeros behind it for as many ids as a word may hold.  Widths that fit fewer than
    one id in four are not tried.
    """
    own = rows[:, :block]
    best = np.full((len(rows), block), np.inf, dtype=np.float32)
    chosen = np.zeros((len(rows), block), dtype=np.int8)
    before = np.zeros((len(rows), rows.shape[1] + 1), dtype=np.int16 if rows.shape[1] < 1 << 15 else np.int32)
    for s, (count, largest) in enumerate(zip(COUNTS.tolist(), LARGEST.tolist())):
        if 4 * np.count_nonzero(own <= min(largest, 2**32 - 1)) < own.size:
            continue
        np.cumsum(rows > min(largest, 2**32 - 1), axis=1, dtype=before.dtype, out=before[:, 1:])
        escapes = before[:, count : count + block] - before[:, :block]
        # A run of zeros has no escape mark.
        bits = escapes.astype(np.float32) * np.float32(32 / count) + np.float32(64 / count)
        cost = bits if WIDTHS[s] else np.where(escapes, np.float32(np.inf), bits)
        better = cost < best
        np.copyto(best, cost, where=better)
        np.copyto(chosen, np.int8(s), where=better)
    return chosen


def _pack_blocks(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, and the number of both per block."""
    blocks = -(-len(ids) // block)
    rows = np.zeros((blocks, block + int(COUNTS[0])), dtype=np.uint32)
    whole = np.zeros(blocks * block, dtype=np.uint32)
    whole[: len(ids)] = ids
    rows[:, :block] = whole.reshape(blocks, block)
    size = np.minimum(block, len(ids) - np.arange(blocks) * block)
    chosen = _selectors(rows, block)
    starts, row, at = [], np.arange(blocks), np.zeros(blocks, dtype=np.int64)
    while len(row):  # all blocks go on together, one word each
        starts.append(row * block + at)
        at = at + COUNTS[chosen[row, at]]
        live = at < size[row]
        row, at = row[live], at[live]
    start = np.sort(np.concatenate(starts))
    row, at = start // block, start % block
    selector = chosen[row, at]
    words = selector.astype(np.uint64) << np.uint64(60)
    there = np.minimum(COUNTS[selector], size[row] - at)
    escaped = ids > LARGEST[np.repeat(selector, there)]
    flat, place = rows.ravel(), row * rows.shape[1] + at
    for s in range(2, len(COUNTS)):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            value = flat[place[mine][:, None] + np.arange(COUNTS[s])].astype(np.uint64)
            if LARGEST[s] < 2**32 - 1:
                value[value > np.uint64(LARGEST[s])] = (1 << int(WIDTHS[s])) - 1
            words[mine] |= np.bitwise_or.reduce(value << (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64), axis=1)
    of_block = np.arange(len(ids)) // block
    return words, ids[escaped], np.bincount(row, minlength=blocks), np.bincount(of_block[escaped], minlength=blocks)


def pack(ids: np.ndarray, block: int = BLOCK) -> Packed:
    """Code of unsigned 32-bit ids."""
    step = block * max(1, BLOCKS_AT_ONCE * BLOCK // block)
    parts = [_pack_blocks(ids[i : i + step], block) for i in range(0, len(ids), step)] or [(np.zeros(0, dtype=np.uint64), ids, *[np.zeros(0, dtype=np.int64)] * 2)]
    words, escapes, n_words, n_escapes = (np.concatenate(c) for c in zip(*parts))
    return Packed(words, escapes, np.concatenate(([0], np.cumsum(n_words))), np.concatenate(([0], np.cumsum(n_escapes))))


def unpack(words: np.ndarray, escapes: np.ndarray, word_offsets: np.ndarray, ids_in_block: np.ndarray) -> np.ndarray:
    """Ids of a run of blocks; ``word_offsets`` starts at 0 and has one entry more than there are blocks."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    block = np.repeat(np.arange(len(ids_in_block)), np.diff(word_offsets))
    first_id = np.concatenate(([0], np.cumsum(ids_in_block)))
    before = np.concatenate(([0], np.cumsum(count)))
    start = before[:-1] - before[word_offsets[:-1]][block] + first_id[block]
    out = np.zeros(first_id[-1], dtype=np.int64)
    escaped = np.zeros(first_id[-1], dtype=bool)
    for s in range(2, len(COUNTS)):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            mark = (1 << int(WIDTHS[s])) - 1
            lane = start[mine][:, None] + np.arange(COUNTS[s])
            value = (words[mine][:, None] >> (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64) & np.uint64(mark)).astype(np.int64)
            there = lane < first_id[block[mine] + 1][:, None]
            out[lane[there]] = value[there]
            escaped[lane[there]] = value[there] == mark
    out[escaped] = escapes
    return out.astype(np.uint32)


def file_bytes(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> list[bytes]:
    """A whole file, as pieces to be written behind each other."""
    p = pack(ids)
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    tail = [len(ids), len(p.words), len(p.escapes), len(p.word_offsets) - 1, len(doc_ids), BLOCK]
    return [
        MAGIC, p.words.astype("<u8").tobytes(), p.escapes.astype("<u4").tobytes(),
        np.stack((p.word_offsets, p.escape_offsets), axis=1).astype("<u8").tobytes(), names.tobytes(),
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(), np.array(lengths, dtype="<u8").tobytes(),
        np.array(tail, dtype="<u8").tobytes(), MAGIC,
    ]


class TokenFile:
    """Reader of one file; ``source`` needs seek() and read()."""

    def __init__(self, source, size: int):
        self.source = source
        tail = self._at(size - _TAIL, _TAIL)
        if tail[-len(MAGIC) :] != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file, or an incomplete one")
        self.ids, self.words, self.escapes, self.blocks, self.documents, self.block = (int(x) for x in np.frombuffer(tail[:48], dtype="<u8"))
        self._escapes_at = len(MAGIC) + 8 * self.words
        at = self._escapes_at + 4 * self.escapes
        offsets = np.frombuffer(self._at(at, 16 * (self.blocks + 1)), dtype="<u8").reshape(-1, 2).astype(np.int64)
        self.word_offsets, self.escape_offsets = offsets[:, 0], offsets[:, 1]
        at += 16 * (self.blocks + 1)
        names = np.frombuffer(self._at(at, 8 * self.documents), dtype="<i8")
        nulls = np.frombuffer(self._at(at + 8 * self.documents, self.documents), dtype=np.uint8)
        self.doc_ids = [None if null else int(d) for d, null in zip(names, nulls)]
        self.lengths = np.frombuffer(self._at(at + 9 * self.documents, 8 * self.documents), dtype="<u8").astype(np.int64)

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def decode(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks ``first`` to ``last`` − 1."""
        w, e = self.word_offsets[first : last + 1], self.escape_offsets[first : last + 1]
        words = np.frombuffer(self._at(len(MAGIC) + 8 * int(w[0]), 8 * int(w[-1] - w[0])), dtype="<u8")
        escapes = np.frombuffer(self._at(self._escapes_at + 4 * int(e[0]), 4 * int(e[-1] - e[0])), dtype="<u4")
        ids = np.minimum(np.arange(first + 1, last + 1) * self.block, self.ids) - np.arange(first, last) * self.block
        return unpack(words, escapes, w - w[0], ids)

    def texts(self) -> Iterator[tuple[object, np.ndarray]]:
        """(doc_id, ids) of every document; no more than one document and one run of blocks is held."""
        held, block = np.zeros(0, dtype=np.uint32), 0
        for doc_id, n in zip(self.doc_ids, self.lengths):
            while len(held) < n:
                more = min(block + max(BLOCKS_AT_ONCE, int(n - len(held)) // self.block + 1), self.blocks)
                held = np.concatenate((held, self.decode(block, more)))
                block = more
            yield doc_id, held[:n]
            held = held[n:]


def _latin_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each Latin-1 character (white space, letter, digit, sign, other), and its lower case.

    Apostrophes may join the letters behind them, "<" and "|" may begin a special token: they are not plain signs.
    """
    kind = np.full(256, OTHER, dtype=np.uint8)
    for i in [*range(0x20, 0x7F), 0x09, 0x0A, 0x0D, *range(0xC0, 0x100)]:
        c = chr(i)
        if c not in "'<|×÷":
            kind[i] = SPACE if c.isspace() else LETTER if c.isalpha() else DIGIT if c.isdigit() else SIGN
    return kind, np.array([ord(chr(i).lower()) if kind[i] == LETTER else i for i in range(256)], dtype=np.uint8)


SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
_KIND, _LOWER = _latin_classes()


def _latin(text: str) -> bytes:
    """Latin-1 bytes; one that is not plain stands for a text without them."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return b"'"


class WordEncoder:
    """Ids of whole texts by a word-level BPE file, little-endian unsigned 32-bit.

    The vocabulary lower-cases, splits letters, digits and signs and drops white space, so a text is encoded piece by
    piece and each piece once per batch.  Texts of Latin-1 letters, digits and plain signs are cut into those pieces here, a whole
    batch at once; any other text is cut at white space only, and the library does the rest.
    """

    _chunks = re.compile("[^ \t\n\r]+").findall

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for pieces that are already what the vocabulary's own steps make of a text.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_piece = np.zeros(max(words.values()) + 1, dtype=bool)
        self.ends_piece[[i for w, i in words.items() if w.endswith(PIECE_END)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _entries(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different simple pieces behind each other, and where each piece's end.

        Some hundred pieces go to the library in one call; each ends with an id that marks its end.
        """
        cuts = pa.array([*range(0, len(pieces), PIECES_AT_ONCE), len(pieces)], pa.int32())
        texts = [t.decode("latin-1") for t in pc.binary_join(pa.ListArray.from_arrays(cuts, pieces), b" ").to_pylist()]
        found = self.bare.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.frombuffer(b"".join([array.array("I", e.ids).tobytes() for e in found]), dtype=np.uint32)
        ends = np.flatnonzero(self.ends_piece[ids]) + 1
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            alone = self._ids([p.decode("latin-1") for p in pieces.to_pylist()])
            return np.frombuffer(b"".join(alone), dtype=np.uint32), np.cumsum([len(a) // 4 for a in alone])
        return ids, ends

    def _plain(self, texts: list[bytes]) -> list[bytes | None]:
        """Ids of texts of Latin-1 bytes; None for one with a character of another class."""
        sizes = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        kind = _KIND[raw]
        odd = np.add.reduceat(kind == OTHER, ends - sizes) > 0
        if odd.any():
            kind[np.repeat(odd, sizes)] = SPACE
        solid = kind != SPACE
        begins = solid.copy()
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        start = np.flatnonzero(begins)
        if not len(start):
            return [None if o else b"" for o in odd]
        # Without white space the pieces touch: one begins where the one before it ends.
        offsets = np.append(np.flatnonzero(begins[solid]), np.count_nonzero(solid)).astype(np.int32)
        letters = _LOWER[raw[solid]]
        pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        flat, upto = self._entries(pieces.dictionary)
        which = pieces.indices.to_numpy()
        length = np.diff(upto, prepend=0)[which]
        total = np.cumsum(length)
        ids = flat[np.arange(total[-1]) + np.repeat(upto[which] - total, length)].tobytes()
        cuts = (4 * np.append(0, total)[np.searchsorted(start, np.append(0, ends))]).tolist()
        return [None if o else ids[i:j] for o, (i, j) in zip(odd, itertools.pairwise(cuts))]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = self._plain([_latin(t) for t in texts]) if texts else []
        rest = [i for i, ids in enumerate(out) if ids is None]
        cut_up = [self._chunks(texts[i]) for i in rest]
        wanted = list(set().union(*cut_up))
        found = dict(zip(wanted, self._ids(wanted)))
        for i, chunks in zip(rest, cut_up):
            out[i] = b"".join(map(found.__getitem__, chunks))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One encoder per worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _store(uri: str):
    """File system and path of a folder that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into files of ``folder``; returns their list: file, base (ids of all files before it), n_ids, n_docs.

    Documents stand in ascending order of doc_id (NULL first, equal ids in input order), each followed by ``end_id``.
    NULL and empty texts have no other id.  Special tokens in a text follow the vocabulary file; none is added.  Other
    columns are not read; an empty table gives an empty list.

    The sort is a range partitioning with the row's place as last key, so no doc_id is too frequent for one task.  A task
    gives each file a new name and only the list that Spark commits says which files count, so a task that runs twice
    does no harm; the folder may hold files that no list names.
    """
    at_once = TEXT_BYTES, FILE_IDS

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (store, root) = _encoder(tokenizer_path), _store(folder)
        part, end = TaskContext.get().partitionId(), array.array("I", [end_id]).tobytes()
        text_bytes, file_ids = at_once
        names, ids, lengths, n, seq = [], [], [], 0, 0

        def written() -> pa.RecordBatch:
            nonlocal seq
            file = f"ids-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.s8b"
            with store.open_output_stream(f"{root}/{file}") as out:
                for piece in file_bytes(np.frombuffer(b"".join(ids), dtype=np.uint32), names, lengths):
                    out.write(piece)
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [file], "n_ids": [n], "n_docs": [len(names)]})
            seq += 1
            return row

        def texts():
            held, size = [], 0
            for t in tables:
                for doc_id, text in zip(t.column(0).to_pylist(), t.column(1)):
                    held.append((doc_id, text.as_py() or ""))
                    size += len(held[-1][1])
                    if size >= text_bytes:
                        yield held
                        held, size = [], 0
            yield held

        store.create_dir(root, recursive=True)
        for batch in texts():
            for (doc_id, _), raw in zip(batch, encoder.encode([t for _, t in batch]) if batch else []):
                names.append(doc_id)
                ids.append(raw + end)
                lengths.append(len(raw) // 4 + 1)
                n += lengths[-1]
                if n >= file_ids:
                    yield written()
                    names, ids, lengths, n = [], [], [], 0
        if names:
            yield written()

    nth = F.monotonically_increasing_id().alias("nth")
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", nth).repartitionByRange("doc_id", "nth").sortWithinPartitions("doc_id", "nth")
    files = cut(ordered.select("doc_id", "text").mapInArrow(work, "part bigint, seq bigint, file string, n_ids bigint, n_docs bigint"), "token-files")
    # Offsets in two levels: files inside runs of parts, then the runs.
    files = files.withColumn("run", F.expr(f"part div {RUN}"))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = files.groupBy("run").agg(F.sum("n_ids").alias("n_ids")).select("run", before(Window.orderBy("run")).alias("run_base"))
    inside = before(Window.partitionBy("run").orderBy("part", "seq"))
    return cut(files.withColumn("inside", inside).join(runs, "run").select("file", (F.col("inside") + F.col("run_base")).alias("base"), "n_ids", "n_docs"), "file-list")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """Documents of listed files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian u32)."""
    row_ids = ROW_IDS

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for t in tables:
            for file, base in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{file}") as source:
                    rows, held = [], 0
                    for doc_id, ids in TokenFile(source, source.size()).texts():
                        rows.append((doc_id, base, len(ids), ids.astype("<u4").tobytes()))
                        base, held = base + len(ids), held + len(ids)
                        if held >= row_ids:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    tasks = max(1, min(files.count(), READERS))
    return files.select("file", "base").repartition(tasks).mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def stored_tokens(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the files to a new folder beside the checkpoints and read them back."""
    folder = f"{shared_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(docs, tokenizer_path, folder, end_id), folder)
