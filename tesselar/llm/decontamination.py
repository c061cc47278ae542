"""Benchmark decontamination by a hash set of test windows, with DataFrame functions only.

The windows of the test items are hashed; every window of the training words is looked up by its hash and verified word
by word.  The set travels to the executors while its measured size is bounded; beyond that the same lookup is an
equi-join on the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.llm.common import cut, lower_az, unwrapped, wrapped

WINDOW = 10
# Everything between two words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Largest hash set (bytes of hashes and window words) that is sent to every executor.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Lower-cased words; NULL has none."""
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), GAPS), "")


def test_windows(items: DataFrame, window: int) -> DataFrame:
    """``items(item_id, text)`` → one row per different window: hash, length, gram, item_ids (as sorted strings)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - window + 1, F.lit(1))
    starts = w.select("item", "w", F.explode(F.sequence(F.lit(1), last)).alias("i"))
    grams = starts.select("item", F.expr(f"slice(w, i, {int(window)})").alias("gram"))
    return (
        grams.groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
        .select(F.xxhash64("gram").alias("hash"), F.size("gram").alias("length"), "gram", "item_ids")
    )


def _starts(w: Column, n: int) -> Column:
    """Places at which a window of ``n`` words begins."""
    return F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))


def _slots(windows: int) -> int:
    """64-bit words of the bitmap: a power of two with 16 to 32 bits for each window."""
    return 1 << max(0, (max(1, windows) * 16 // 64).bit_length())


def _bitmap(found: DataFrame, windows: int) -> Column:
    """Bits of the window hashes as one array of longs; windows without their bit set cannot be in the hash set."""
    n = _slots(windows)
    slot, bit = F.shiftright("hash", 6).bitwiseAND(F.lit(n - 1)), F.expr("shiftleft(1L, cast(hash & 63 AS int))")
    marked = found.groupBy(slot.alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = found.sparkSession.range(n).join(marked, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    return cut(every.agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).alias("b")).select(F.col("b.bits").alias("b")), "bitmap").scalar()


def _bit(bits: Column, h: Column, windows: int) -> Column:
    word = F.get(bits, F.shiftright(h, 6).bitwiseAND(F.lit(_slots(windows) - 1)).cast("int"))
    return F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text)``, ``items(item_id, text)`` → one row per different (doc_id, text) with hits.

    Columns: doc_id, digest (of the text), hit (sorted 0-based places of hit words), item_ids (sorted strings).
    An item shorter than a window, but not empty, is one window of its own length.  NULL and empty texts have no words
    and no hits; a NULL item_id counts as no item but its windows still hit; repeated rows of either table change
    nothing.  Other columns are not read.
    """
    found = cut(test_windows(items, window), "windows")
    size = found.agg(
        F.coalesce(F.sum(F.length(F.array_join("gram", " ")) + 64 + 16 * F.size("item_ids")), F.lit(0)).alias("bytes"),
        F.collect_set("length").alias("lengths"), F.count("*").alias("windows"),
    ).first()
    # One probe per position and window length that occurs; there are at most ``window`` lengths.
    lengths = sorted(size["lengths"]) or [window]
    bounded = size["bytes"] <= BROADCAST_BYTES
    bits = _bitmap(found, size["windows"]) if bounded else F.lit(None).cast("array<bigint>")

    def of_length(w: Column, bits: Column, n: int) -> Column:
        # Single elements cost the same wherever they stand; slice() would copy the whole text for every window.
        gram = lambda i: [F.get(w, i + k) for k in range(n)]
        hashed = F.transform(_starts(w, n), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.array(*gram(i))).alias("hash")))
        maybe = hashed if not bounded else F.filter(hashed, lambda p: _bit(bits, p["hash"], size["windows"]))
        return F.transform(maybe, lambda p: F.struct(p["pos"], p["hash"], F.array(*gram(p["pos"])).alias("probe")))

    def probes(w: Column) -> Column:
        return F.concat(*[of_length(w, F.col("bits"), n) for n in lengths])

    # The one-element array makes the words a lambda variable: they are split once per text, not once per window.
    every = F.flatten(F.transform(F.array(words(F.col("text"))), probes))
    texts = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce("text", F.lit("")).alias("text"), bits.alias("bits"))
    each = texts.select("doc_id", "digest", F.explode(every).alias("p")).select("doc_id", "digest", "p.pos", "p.hash", "p.probe")
    hits = each.join(F.broadcast(found) if bounded else found, "hash").filter(F.col("probe") == F.col("gram"))
    return (
        hits.groupBy("doc_id", "digest")
        .agg(F.collect_set(F.struct("pos", "length")).alias("spans"), F.collect_set("item_ids").alias("items"))
        .select(
            "doc_id", "digest",
            F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["length"] - 1))))).alias("hit"),
            F.array_sort(F.array_distinct(F.flatten("items"))).alias("item_ids"),
        )
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_words, n_hit, n_items, item_ids, contaminated."""
    hits = find_hits(docs, items, window).withColumnRenamed("doc_id", "hit_id").withColumnRenamed("digest", "hit_digest")
    base = docs.select(
        "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.size(words(F.col("text"))).cast("long").alias("n_words"),
    )
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", F.coalesce(F.size("hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"),
        F.col("hit").isNotNull().alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a test window; all columns stay, clean rows are untouched."""
    hits = find_hits(docs, items, window).select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"))
    on = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("hit_digest"))
    return unwrapped(wrapped(docs).join(hits, on, "left_anti"), docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every hit word cut out of the text; what stands between words stays."""
    hits = find_hits(docs, items, window).select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), "hit")
    on = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("hit_digest"))
    joined = wrapped(docs).join(hits, on, "left")
    text = F.coalesce("text", F.lit(""))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    whole = F.struct(F.regexp_extract_all(text, F.lit(word), F.lit(0)).alias("words"), F.split(text, word).alias("gaps"), "hit")

    def rest(s: Column) -> Column:
        """All gaps and the words that are not hit, in order.  The text is split once: ``s`` is a lambda variable."""
        left = F.array_except(F.sequence(F.lit(0), F.size(s["words"]) - 1), s["hit"])
        gaps = F.transform(s["gaps"], lambda x, i: F.struct(i.alias("at"), F.lit(0).alias("kind"), x.alias("x")))
        words_ = F.transform(left, lambda i: F.struct(i.alias("at"), F.lit(1).alias("kind"), F.get(s["words"], i).alias("x")))
        return F.array_join(F.transform(F.array_sort(F.concat(gaps, words_)), lambda p: p["x"]), "")

    both = F.transform(F.array(whole), rest)[0]
    return unwrapped(joined.withColumn("text", F.when(F.col("hit").isNull(), F.col("text")).otherwise(both)), docs.columns)
