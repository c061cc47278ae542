"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

Every byte stands for one code point, so a vocabulary entry becomes a piece of as many characters as it has bytes.
A piece's score is its negative rank: the library always joins the neighbouring pair with the best score, which is
the pair of lowest rank.  Normalisation is the identity, so nothing but the merges changes a text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Byte b is written as the code point BYTE_BASE + b (Latin letters without special meaning to the library).
BYTE_BASE = 0x100
# Encoded pre-tokens that a worker remembers, and the longest one worth remembering.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64

# Wire format of a sentencepiece model (fixed values): field numbers and enum members.
F_PIECES, F_TRAINER, F_NORMALIZER = 1, 2, 3
F_PIECE, F_SCORE, F_TYPE, TYPE_NORMAL, TYPE_UNKNOWN = 1, 2, 3, 1, 2
F_MODEL_TYPE, MODEL_BPE, F_VOCAB_SIZE, F_UNK_ID, F_BOS_ID, F_EOS_ID, F_PAD_ID = 3, 2, 4, 40, 41, 42, 43
F_NAME, F_DUMMY_PREFIX, F_EXTRA_SPACES, F_ESCAPE_SPACES = 1, 3, 4, 5


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a rank file: one base64 entry and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def piece_of(entry: bytes) -> str:
    return "".join(chr(BYTE_BASE + b) for b in entry)


def bytes_of(piece: str) -> bytes:
    return bytes(ord(c) - BYTE_BASE for c in piece)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The model: pieces in order of rank, then one unknown piece (no text reaches it, all bytes are pieces)."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks the single bytes {missing[:8]}")
    out = bytearray()
    for entry, rank in sorted(ranks.items(), key=lambda x: x[1]):
        body = _bytes(F_PIECE, piece_of(entry).encode()) + _float(F_SCORE, -float(rank)) + _number(F_TYPE, TYPE_NORMAL)
        out += _bytes(F_PIECES, body)
    unknown = _bytes(F_PIECE, b"<unk>") + _float(F_SCORE, 0.0) + _number(F_TYPE, TYPE_UNKNOWN)
    out += _bytes(F_PIECES, unknown)
    trainer = _number(F_MODEL_TYPE, MODEL_BPE) + _number(F_VOCAB_SIZE, len(ranks) + 1) + _number(F_UNK_ID, len(ranks))
    trainer += b"".join(_number(f, -1) for f in (F_BOS_ID, F_EOS_ID, F_PAD_ID))
    normalizer = _bytes(F_NAME, b"identity") + _number(F_DUMMY_PREFIX, 0)
    normalizer += _number(F_EXTRA_SPACES, 0) + _number(F_ESCAPE_SPACES, 0)
    out += _bytes(F_TRAINER, trainer) + _bytes(F_NORMALIZER, normalizer)
    return bytes(out)


class Codec:
    """Encoder and decoder of one worker.  Ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, model: bytes, ranks: list[int], pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.ids = [struct.pack("<I", r) for r in ranks]
        pieces = [self.processor.id_to_piece(i) for i in range(len(ranks))]
        self.entry = {r: bytes_of(p) for r, p in zip(ranks, pieces)}
        self.whole = {bytes_of(p): i for p, i in zip(pieces, self.ids)}
        self.known: dict[str, bytes] = {}

    def pre_token(self, token: str) -> bytes:
        """Ids of one pre-token.  One that is itself an entry is that entry; the merges do the rest."""
        found = self.known.get(token)
        if found is None:
            raw = token.encode("utf-8", "surrogatepass")
            found = self.whole.get(raw)
            if found is None:
                found = b"".join([self.ids[i] for i in self.processor.encode(piece_of(raw))])
            if len(token) <= CACHE_CHARS:
                if len(self.known) >= CACHE_ENTRIES:
                    self.known.clear()
                self.known[token] = found
        return found

    def encode(self, text: str) -> bytes:
        tokens = self.find(text)
        known = self.known
        return b"".join([known.get(t) or self.pre_token(t) for t in tokens])

    def decode(self, ids: bytes) -> bytes:
        entry = self.entry
        return b"".join([entry[i] for i in memoryview(ids).cast("I")])


def encode_documents(docs: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` → doc_id, ids (little-endian uint32), n_tokens, decoded (bytes).

    The whole text is encoded, without special tokens: their strings are ordinary text.  NULL and empty texts have no
    ids and decode to nothing; rows without doc_id and repeated rows are encoded like any other; other columns are not
    read.  An empty table gives an empty result.  No shuffle: a row needs only itself and the model (one vocabulary,
    which does not grow with the data).
    """
    ranks = read_ranks(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast((serialise_model(ranks), sorted(ranks.values()), pattern))

    @F.pandas_udf("ids binary, n_tokens bigint, decoded binary")
    def both_ways(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(*shared.value)
        for texts in batches:
            ids = [codec.encode(t) if t else b"" for t in texts]
            yield pd.DataFrame({"ids": ids, "n_tokens": [len(i) // 4 for i in ids], "decoded": [codec.decode(i) for i in ids]})

    return docs.select("doc_id", both_ways(F.col("text")).alias("e")).select("doc_id", "e.*")


def token_digests(encoded: DataFrame) -> DataFrame:
    """Digests of ids and decoded bytes in place of the bytes themselves."""
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
