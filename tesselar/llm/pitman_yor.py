"""Scoring by a hierarchical Pitman-Yor language model.

A restaurant for each context (the preceding word) seats that context's words; every table it opens is a customer of the
parent restaurant, which all contexts share, and the parent's base is uniform over the vocabulary.
Tables are sampled by Gibbs sweeps: all customers of every dish leave and sit down again, at new tables with the odds of
the parent's probability for the dish.  Table sizes are integrated out, so a dish is its customers c and tables t; given
the weight w of a new table, t is drawn from its conditional, which is in proportion to S(c, t) w^t with generalised
Stirling numbers S.  The probability of a token is the mean of the predictive probabilities of all samples.

Words are dealt into buckets by hash.  A bucket has all contexts of its words, so both levels are sampled inside it.  A
word's bucket is also the home of its restaurant: there its customers and kinds, which steer the seating, and its tables
in each sample, which the predictions need, are added up over all buckets.

Texts are cut into slices and read once: a slice sends its different (word, context) cells with their training counts to
the buckets and its tokens as numbers past them, and gets the seating of its cells and words back.
"""

from __future__ import annotations

import pickle
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm.common import cut, held_out, words_of

# Contexts of a seating that is made by hand; those of a bucket are as many as it has.
CONTEXTS = 256
# Bytes of text per slice and per bucket of words.
SLICE_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20
# Strength of both levels, Gibbs sweeps before the first sample, samples, and sweeps between samples.
STRENGTH, BURN, SAMPLES, BETWEEN, SEED = 1.0, 12, 3, 4, 11
# Customers up to which the Stirling numbers are tabulated; beyond, the tables are drawn by their saddle point.
EXACT = 256
# Customers of the whole bucket that count beside a restaurant's own where its tables are estimated.
PRIOR = 16.0
END = 0x9AE16A3B2F90404F  # stands for the end of a text in place of a word's hash, and as a context for its start
# Kinds of rows: cells asked for, tokens of a slice, training cells, restaurants' totals, seating, tables beyond one a kind.
ASK, TOKENS, OWN, HOME, SEATED, MORE = range(6)
ROW = "kind int, key bigint, g bigint, body binary"


def word_hashes(words: Iterable[str]) -> list[int]:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return [digest(w.encode("utf-8", "surrogatepass")) for w in words]


class Tokens:
    """Texts as arrays: for each token the number of its word and of the word before it, its context.

    Words are numbered in the order of their hashes.
    """

    def __init__(self, texts: list[str], buckets: int = 1):
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        ids = array("q")
        sizes = []
        for text in texts:
            some = words_of(text)
            ids.extend(map(number.__getitem__, some))
            ids.append(-1)
            sizes.append(len(some) + 1)
        hashes = np.array([*word_hashes(number), END], dtype=np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.hashes, self.bucket = hashes[order], _bucket(hashes, buckets)[order]
        self.word, self.end = rank[np.array(ids, dtype=np.int64)], int(rank[-1])
        self.sizes = np.array(sizes, dtype=np.int64)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, so words in the order of their hashes are in that of their buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cells(word: np.ndarray, end: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Different cells (word × words + context) of a slice's tokens, and the place of each token's cell."""
    # The end of the text before stands for the start of a text.
    context = np.concatenate(([end], word[:-1])) if len(word) else word
    return np.unique(word * words + context, return_inverse=True)


def _numbers(*columns: np.ndarray) -> bytes:
    """Columns of equal length of numbers from zero to 2^32, by bytes of one place, compressed."""
    table = np.stack([np.asarray(c).astype("<u4", copy=False) for c in columns])
    planes = np.ascontiguousarray(table.view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1)).tobytes()
    return np.array([len(columns), table.shape[1]], "<u8").tobytes() + (bytes(pa.compress(planes, "zstd")) if planes else b"")


def _columns(body: bytes) -> np.ndarray:
    k, n = np.frombuffer(body, "<u8", 2).tolist()
    if not n:
        return np.zeros((k, 0), dtype="<u4")
    planes = np.frombuffer(pa.decompress(body[16:], 4 * k * n, "zstd"), np.uint8).reshape(k, 4, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(k, n)


def _hashes(sorted_: np.ndarray) -> bytes:
    """Sorted hashes by their steps; what many small steps leave empty is compressed away."""
    steps = np.diff(sorted_, prepend=np.uint64(0))
    return _numbers(steps & np.uint64(0xFFFFFFFF), steps >> np.uint64(32))


def _unhashed(body: bytes) -> np.ndarray:
    low, high = _columns(body).astype(np.uint64)
    return np.cumsum(low | high << np.uint64(32), dtype=np.uint64)


def _places(places: np.ndarray, there: np.ndarray) -> bytes:
    """Growing places, from 0, of what is there."""
    steps = np.zeros(len(places), dtype=np.int64)
    steps[there] = np.diff(places[there], prepend=-1)
    return _numbers(steps)


def _placed(body: bytes) -> np.ndarray:
    """The places from one; 0: not there."""
    steps = _columns(body)[0]
    return np.cumsum(steps, dtype=np.int64) * (steps > 0)


def _pack(words: np.ndarray, contexts: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Hashes of words and contexts, and of each cell (word × contexts + context, sorted) its context and training count."""
    per = np.bincount(cells // max(1, len(contexts)), minlength=len(words))
    return pickle.dumps((_hashes(words), _hashes(contexts), _numbers(per), _numbers(cells % max(1, len(contexts)), counts)))


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, contexts, per, rest = pickle.loads(body)
    words, contexts = _unhashed(words), _unhashed(contexts)
    context, counts = _columns(rest)
    return words, contexts, np.repeat(np.arange(len(words)), _columns(per)[0]) * len(contexts) + context, counts.astype(np.int64)


def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t), for c up to EXACT."""
    log = np.full((EXACT + 1, EXACT + 1), -np.inf)
    log[0, 0] = 0.0
    t = np.arange(1, EXACT + 1)
    for c in range(1, EXACT + 1):
        weight = np.where(t < c, c - 1 - discount * t, 0.0)
        with np.errstate(divide="ignore"):
            log[c, 1:] = np.logaddexp(log[c - 1, :-1], log[c - 1, 1:] + np.log(np.maximum(weight, 0)))
    return log


def alone_table(discount: float) -> np.ndarray:
    """Probability that a random one of c customers at t tables sits alone, for c up to EXACT."""
    log = log_stirling(discount)
    out = np.zeros_like(log)
    with np.errstate(invalid="ignore"):
        out[1:, 1:] = np.exp(log[:-1, :-1] - log[1:, 1:])
    return np.nan_to_num(out, nan=0.0, posinf=1.0)


class Dishes:
    """Tables of many dishes; ``weight`` of a new table comes from outside."""

    def __init__(self, customers: np.ndarray, discount: float, rng: np.random.Generator):
        self.discount, self.log, self.rng = discount, log_stirling(discount), rng
        self.set(customers)

    def set(self, customers: np.ndarray) -> None:
        self.customers = customers
        self.tables = np.ones(len(customers), dtype=np.int64)
        order = np.argsort(customers, kind="stable")
        sizes = customers[order]
        self.small = [(c, order[slice(*np.searchsorted(sizes, [c, c + 1]))]) for c in np.unique(sizes[(sizes > 1) & (sizes <= EXACT)]).tolist()]
        self.large = order[np.searchsorted(sizes, EXACT, "right"):]

    def sweep(self, weight: np.ndarray) -> None:
        """All customers of every dish leave and sit down again."""
        weight = np.maximum(weight, 1e-300)
        for c, rows in self.small:
            p = self.log[c, 1 : c + 1] + np.log(weight[rows])[:, None] * np.arange(1, c + 1)
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            drawn = self.rng.random(len(rows)) * p[:, -1]
            self.tables[rows] = np.minimum((p <= drawn[:, None]).sum(axis=1) + 1, c)
        if len(self.large):
            self.tables[self.large] = self._many(self.customers[self.large].astype(np.float64), weight[self.large])

    def _many(self, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Draws for many customers.

        A seating is a compound Poisson sum of tables, tilted by z, that has c customers.  One table is that of a given
        customer, the others number about Λ = w (1 − (1 − z)^d) / d; the tilt z makes c the mean, and the condition
        narrows their variance.  A binomial number has that mean and variance; its error against S(c, t) w^t is
        below a fifth of a standard deviation.
        """
        d = self.discount
        low, high = np.log(0.1 * (1 - d) / c), np.zeros(len(c))
        for _ in range(50):
            middle = (low + high) / 2
            e = np.exp(middle)
            over = w * (1 - e) * e ** (d - 1) + 1 + (1 - d) * (1 - e) / e > c
            low, high = np.where(over, middle, low), np.where(over, high, middle)
        e = np.exp((low + high) / 2)
        z = 1 - e
        mean = -w * np.expm1(d * np.log(e)) / d
        seated = w * z * e ** (d - 1)
        spread = seated + w * z * z * (1 - d) * e ** (d - 2) + (1 - d) * z / e**2
        narrowed = np.clip(seated**2 / np.maximum(spread * mean, 1e-300), 1e-9, 1.0)
        trials = np.maximum(1, np.rint(mean / narrowed)).astype(np.int64)
        return np.minimum(1 + self.rng.binomial(trials, np.clip(mean / trials, 0.0, 1.0)), c.astype(np.int64))


class Shape:
    """What the seating of a bucket takes from outside: totals of the corpus, of its restaurants, and the discounts."""

    def __init__(self, tokens: int, types: int, customers: np.ndarray, kinds: np.ndarray, discount: float, parent: float, cells: int | None = None):
        self.tokens, self.types, self.customers, self.kinds = tokens, types, customers, kinds
        self.discount, self.parent = discount, parent
        self.cells = float(np.sum(kinds)) if cells is None else float(cells)
        self.base = 1.0 / (types + 1)


def seat(cells: np.ndarray, counts: np.ndarray, words: int, shape: Shape, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Samples of one bucket: (tables of each cell, parent customers of each word, parent tables of each word).

    The tables of a restaurant are its kinds in the whole corpus and, of its other customers there, the share that has
    opened tables here; where few are here, the share of the whole bucket counts.
    """
    rng = np.random.default_rng([SEED, bucket])
    contexts = max(1, len(shape.kinds))
    # One customer is one table: only the other cells can change.
    moving = np.flatnonzero(counts > 1)
    alone = np.bincount(cells[counts == 1] // contexts, minlength=words)
    word, context = cells[moving] // contexts, cells[moving] % contexts
    low = Dishes(counts[moving], shape.discount, rng)
    high = Dishes(alone + np.bincount(word, minlength=words), shape.parent, rng)
    spare = np.bincount(context, weights=counts[moving] - 1, minlength=contexts)
    others = np.maximum(0.0, shape.customers - shape.kinds)
    chance = np.bincount(cells // contexts, weights=counts, minlength=words) / max(1, shape.tokens)
    opened = np.asarray(shape.kinds, dtype=np.float64)
    low.sweep((STRENGTH + shape.discount * opened[context]) * chance[word])
    tables = float(shape.types)
    for n in range(BURN + (SAMPLES - 1) * BETWEEN + 1):
        more = np.bincount(context, weights=low.tables - 1, minlength=contexts)
        share = (more + PRIOR * (more.sum() / max(1.0, spare.sum()))) / (spare + PRIOR)
        opened = shape.kinds + share * others
        seated = alone + np.bincount(word, weights=low.tables, minlength=words).astype(np.int64)
        high.set(seated)
        weight = (STRENGTH + shape.parent * tables) * shape.base
        high.sweep(np.full(words, weight))
        tables = shape.types * high.tables.mean() if words else 0.0
        weight = (STRENGTH + shape.parent * tables) * shape.base
        customers = shape.cells * (seated.sum() / len(cells) if len(cells) else 1.0)
        chance = (high.customers - shape.parent * high.tables + weight) / (STRENGTH + customers)
        low.sweep((STRENGTH + shape.discount * opened[context]) * chance[word])
        if n >= BURN and (n - BURN) % BETWEEN == 0:
            seated = alone + np.bincount(word, weights=low.tables, minlength=words).astype(np.int64)
            every = np.ones(len(cells), dtype=np.int64)
            every[moving] = low.tables
            yield every, seated, np.minimum(high.tables, seated)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    some, held = [], 0
    for batch in batches:
        sizes = batch["text"].str.len().to_numpy()
        start = 0
        while start < len(batch):
            stop = start + int(np.searchsorted(held + np.cumsum(sizes[start:]), SLICE_BYTES)) + 1
            some.append(batch[start:stop])
            held += int(sizes[start:stop].sum())
            start = stop
            if held >= SLICE_BYTES:
                yield pd.concat(some)
                some, held = [], 0
    if some:
        yield pd.concat(some)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "key", "g", "body"])


def _split(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its hashes among sorted ones."""
    bucket = _bucket(hashes, buckets)
    for b in np.unique(bucket).tolist():
        yield b, np.arange(*np.searchsorted(bucket, [b, b + 1]))


def _at(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted number among sorted ones, and whether it is there (place 0 if not)."""
    k = np.searchsorted(sorted_, wanted)
    there = k < len(sorted_)
    there[there] = sorted_[k[there]] == wanted[there]
    return np.where(there, k, 0), there


def _sums(df: DataFrame, column: str, n: int) -> np.ndarray:
    rows = df.select(F.posexplode(column).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(n)
    for r in rows:
        out[r["k"]] = r["x"]
    return out


def score(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` → doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row.

    Words end at ASCII white space, A-Z count as a-z; every text ends with one end token, so NULL, empty and blank texts
    have one token.  Rows without doc_id are held out; repeated rows train as often as they occur and score alike.
    Other columns are not read.  Without training rows every token is unknown.  An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    # The id is only carried; as a string it passes through Python unchanged, NULL included.
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"), held_out(F.col("doc_id"), 5, 1).alias("held_out"))
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_BYTES))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for n, some in enumerate(_slices(batches)):
            tokens = Tokens(list(some["text"]), buckets)
            words = len(tokens.hashes)
            cells, place = _cells(tokens.word, tokens.end, words)
            trains = np.repeat(~some["held_out"].to_numpy(dtype=bool), tokens.sizes)
            counts = np.bincount(place[trains], minlength=len(cells))
            del place
            body = pickle.dumps((list(some["doc_id"]), list(some["held_out"]), tokens.end, words, _numbers(tokens.sizes), _numbers(tokens.word)))
            # A slice that is read again with other rows has another name, so a mixture could not pass unseen.
            g = xxhash.xxh3_64_intdigest(body, TaskContext.get().partitionId() << 32 | n) >> 1
            yield _rows([(TOKENS, g, g, body)])
            used = np.flatnonzero(np.bincount(tokens.word, minlength=words))
            bounds = np.searchsorted(cells // words, np.searchsorted(tokens.bucket, np.arange(buckets + 1)))
            for b in np.unique(tokens.bucket[used]).tolist():
                own = slice(bounds[b], bounds[b + 1])
                word, w = np.unique(cells[own] // words, return_inverse=True)
                context, c = np.unique(cells[own] % words, return_inverse=True)
                yield _rows([(ASK, b, g, _pack(tokens.hashes[word], tokens.hashes[context], w * len(context) + c, counts[own]))])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        """The training cells of a bucket (OWN), and for each slice the places of its words and cells there, from one; 0: none."""
        kind, key = int(rows["kind"].iloc[0]), int(rows["key"].iloc[0])
        if kind == TOKENS:
            return rows.assign(facts=None)
        parts = [_unpack(b) for b in rows["body"]]
        hashes, contexts = (np.unique(np.concatenate([p[i] for p in parts])) for i in (0, 1))
        keys = []
        for words, preceding, cell, _ in parts:
            c = max(1, len(preceding))
            keys.append(np.searchsorted(hashes, words)[cell // c] * len(contexts) + np.searchsorted(contexts, preceding)[cell % c])
        cells, back = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([p[3] for p in parts]), minlength=len(cells)).astype(np.int64)
        trained = counts > 0
        cells, kept = cells[trained], np.cumsum(trained) - 1
        used, w = np.unique(cells // len(contexts), return_inverse=True)
        before, c = np.unique(cells % len(contexts), return_inverse=True)
        counts, per_word = counts[trained], np.bincount(w, minlength=len(used))
        facts = [counts.sum(), len(used), (counts == 1).sum(), (counts == 2).sum(), (per_word == 1).sum(), (per_word == 2).sum(), len(counts)]
        out = [(OWN, key, -1, _pack(hashes[used], contexts[before], w * len(before) + c, counts))]
        at = 0
        for g, (words, _, cell, _) in zip(rows["g"], parts):
            k, there = _at(hashes[used], words)
            some = back[at : at + len(cell)]
            out.append((ASK, key, int(g), pickle.dumps((_places(k, there), _places(kept[some], trained[some])))))
            at += len(cell)
        return _rows(out).assign(facts=[np.array(facts, dtype=np.float64), *[None] * len(parts)])

    sliced = base.mapInPandas(read, ROW)
    merged = cut(sliced.groupBy("kind", "key").applyInPandas(merge, f"{ROW}, facts array<double>"), "cells")
    facts = _sums(merged, "facts", 7)
    ratio = lambda one, two: float(np.clip(one / max(1.0, one + 2 * two), 0.05, 0.95))
    n_tokens, n_types, n_cells, discount, parent = int(facts[0]), int(facts[1]), int(facts[6]), ratio(facts[2], facts[3]), ratio(facts[4], facts[5])
    merged = merged.drop("facts")
    own = merged.filter(F.col("kind") == OWN)

    def kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For the home of each context of a bucket its kinds here, and the customers of the words that live here."""
        for batch in batches:
            for key, body in zip(batch["key"], batch["body"]):
                hashes, contexts, cells, counts = _unpack(body)
                of = np.bincount(cells % max(1, len(contexts)), minlength=len(contexts))
                customers = np.bincount(cells // max(1, len(contexts)), weights=counts, minlength=len(hashes))
                yield _rows([(OWN, key, key, pickle.dumps((_hashes(hashes), _numbers(customers))))])
                yield _rows([(HOME, home, key, pickle.dumps((_hashes(contexts[some]), _numbers(of[some])))) for home, some in _split(contexts, buckets)])

    def add_kinds(rows: pd.DataFrame) -> pd.DataFrame:
        """Back to each bucket customers and kinds of its contexts, in their order; also to the home itself, for all words."""
        home, bodies = int(rows["key"].iloc[0]), [pickle.loads(b) for b in rows["body"]]
        # Every context is a word of the training texts or their end, and lives here.
        hashes, customers = next((_unhashed(h), _columns(n)[0]) for k, (h, n) in zip(rows["kind"], bodies) if k == OWN)
        all_kinds = np.zeros(len(hashes), dtype=np.int64)
        asked = [(int(b), np.searchsorted(hashes, _unhashed(h)), n) for k, b, (h, n) in zip(rows["kind"], rows["g"], bodies) if k == HOME]
        for _, at, n in asked:
            all_kinds[at] += _columns(n)[0]
        return _rows([(OWN, home, home, _numbers(all_kinds)), *[(HOME, b, home, _numbers(customers[at], all_kinds[at])) for b, at, _ in asked]])

    homes = cut(own.mapInPandas(kinds, ROW).groupBy("key").applyInPandas(add_kinds, ROW), "kinds")

    def sit(rows: pd.DataFrame) -> pd.DataFrame:
        """The seating of a bucket, for the homes of its contexts the tables beyond one a kind, and the parent's totals."""
        key = int(rows["key"].iloc[0])
        told = {int(g): b for k, g, b in zip(rows["kind"], rows["g"], rows["body"]) if k == HOME}
        hashes, contexts, cells, counts = _unpack(next(b for k, b in zip(rows["kind"], rows["body"]) if k == OWN))
        known = np.zeros((2, len(contexts)))
        for home, some in _split(contexts, buckets):
            known[:, some] = _columns(told[home])
        shape = Shape(n_tokens, n_types, known[0], known[1], discount, parent, n_cells)
        samples = list(seat(cells, counts, len(hashes), shape, key))
        more = np.stack([np.bincount(cells % len(contexts), weights=t - 1, minlength=len(contexts)) for t, _, _ in samples])
        some = np.flatnonzero(more.any(axis=0))
        customers = np.bincount(cells // max(1, len(contexts)), weights=counts, minlength=len(hashes))
        out = [(SEATED, key, key, pickle.dumps((_hashes(hashes), _numbers(customers, *[x for _, a, b in samples for x in (a, b)]), _numbers(counts, *[t for t, _, _ in samples]))))]
        for home, part in _split(contexts[some], buckets):
            out.append((MORE, home, key, pickle.dumps((_hashes(contexts[some][part]), _numbers(*more[:, some[part]])))))
        totals = np.array([float(x.sum()) for _, a, b in samples for x in (a, b)])
        return _rows(out).assign(facts=[totals, *[None] * (len(out) - 1)])

    told = homes.filter(F.col("kind") == HOME)
    seated = cut(own.unionByName(told).groupBy("key").applyInPandas(sit, f"{ROW}, facts array<double>"), "seated")
    sums = _sums(seated, "facts", 2 * SAMPLES)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        """For each slice count, seating and restaurant of its words, and count and tables of its cells."""
        key, bodies = int(rows["key"].iloc[0]), defaultdict(list)
        for kind, g, body in zip(rows["kind"], rows["g"], rows["body"]):
            bodies[kind].append((int(g), body))
        hashes, of_word, of_cell = pickle.loads(bodies[SEATED][0][1])
        hashes = _unhashed(hashes)
        opened = np.repeat(_columns(bodies[HOME][0][1]), SAMPLES, axis=0) if bodies[HOME] else np.zeros((SAMPLES, 0), "<u4")
        for _, body in bodies[MORE]:
            h, n = pickle.loads(body)
            opened[:, np.searchsorted(hashes, _unhashed(h))] += _columns(n)
        of_word, of_cell = np.vstack([_columns(of_word), opened]), _columns(of_cell)
        of_word, of_cell = (np.pad(x, ((0, 0), (1, 0))) for x in (of_word, of_cell))
        return _rows([(ASK, g, key, pickle.dumps([_numbers(*x[:, _placed(n)]) for x, n in zip((of_word, of_cell), pickle.loads(body))])) for g, body in bodies[ASK]])

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        body = next(b for k, b in zip(rows["kind"], rows["body"]) if k == TOKENS)
        ids, held, end, words, sizes, word = pickle.loads(body)
        sizes, word = (_columns(x)[0].astype(np.int64) for x in (sizes, word))
        replies = [pickle.loads(b) for k, _, b in sorted(zip(rows["kind"], rows["g"], rows["body"])) if k == ASK]
        of_word = np.concatenate([_columns(w) for w, _ in replies], axis=1)
        cells, place = _cells(word, end, words)
        used = np.flatnonzero(np.bincount(word, minlength=words))
        at = np.zeros(words, dtype=np.int64)
        at[used] = np.arange(len(used))
        if of_word.shape[1] != len(used):
            raise RuntimeError("a slice of the texts was read again with other rows")
        chances = []
        for k in range(SAMPLES):
            spare = STRENGTH + parent * sums[2 * k + 1]
            chances.append((of_word[1 + 2 * k] - parent * of_word[2 + 2 * k] + spare / (n_types + 1)) / (STRENGTH + sums[2 * k]))
        logs, done = np.empty(len(cells)), 0
        for _, body in replies:
            low = _columns(body)
            some = cells[done : done + low.shape[1]]
            w, context = at[some // words], at[some % words]
            p = np.zeros(len(some))
            for k, chance in enumerate(chances):
                p += low[0] - discount * low[1 + k] + (STRENGTH + discount * of_word[1 + 2 * SAMPLES + k][context]) * chance[w]
            logs[done : done + len(some)] = np.log10(p / (SAMPLES * (STRENGTH + of_word[0][context])))
            done += len(some)
        if done != len(cells):
            raise RuntimeError("a slice of the texts was read again with other rows")
        seen = of_word[0][at[word]]
        plain = np.log10((seen + 0.5) / (n_tokens + 0.5 * (n_types + 1)))
        text = np.repeat(np.arange(len(sizes)), sizes)
        per = lambda w: np.bincount(text, weights=w, minlength=len(sizes))
        return pd.DataFrame({
            "doc_id": ids, "held_out": held, "n_tokens": sizes, "n_known": per(seen > 0).astype(np.int64),
            "base_score": per(plain), "score": per(logs[place]),
        })

    asked = merged.filter(F.col("kind") == ASK).unionByName(homes.filter(F.col("kind") == OWN).withColumn("kind", F.lit(HOME))).unionByName(seated.drop("facts"))
    replies = asked.groupBy("key").applyInPandas(answer, ROW)
    done = replies.unionByName(merged.filter(F.col("kind") == TOKENS)).groupBy("key").applyInPandas(
        finish, "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double",
    )
    return done.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
