"""Benchmark decontamination by winnowing, with DataFrame functions only.

The words of documents and benchmark items become 64-bit hashes.  Of every sliding window of ``WINDOW - K + 1``
successive K-gram hashes the smallest is kept with its position; so two texts that share ``WINDOW`` successive words
keep a common fingerprint inside them, at the same place.  Documents' fingerprints meet the benchmark's in a join,
and every hit is extended: the windows around it, at most ``WINDOW - K + 1``, are compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.tables import cut_lineage

#: Successive words that count as a hit, and the words of a fingerprint.
WINDOW, K = 8, 5
SPAN = WINDOW - K  # words that a window can reach before its fingerprint
#: The benchmark's fingerprints are broadcast up to so many rows (about 200 bytes each), and shuffled beyond.
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased; none for a null."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)  # then lower() changes A-Z only, and fast
    folded = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _hashed(df: DataFrame, text_col: str) -> DataFrame:
    words = F.transform(word_array(F.col(text_col)), lambda w: F.xxhash64(w))
    return df.withColumn("wh", words).withColumn("n_words", F.size("wh"))


def _fingerprints() -> Column:
    """Of the array ``wh``: an array of (key, at, before, near) for each kept K-gram: 32 bits of its hash, its position
    from 1, how many words of ``near`` precede it, and the word hashes that its windows can reach."""
    grams = F.transform(
        F.sequence(F.lit(1), F.col("n_words") - (K - 1)),
        lambda i: F.xxhash64(F.slice("wh", i, K)).bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(i.cast("long")),
    )
    least = F.transform(F.sequence(F.lit(1), F.size("g") - SPAN), lambda i: F.array_min(F.slice("g", i, SPAN + 1)))
    kept = F.array_distinct(least)

    def placed(f: Column) -> Column:
        at = f.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        first = F.greatest(at - SPAN, F.lit(1))
        return F.struct(F.shiftright(f, 32).alias("key"), at.alias("at"), (at - first).alias("before"), F.slice("wh", first, at - first + WINDOW).alias("near"))

    return grams, F.transform(kept, placed)


def _with_fingerprints(hashed: DataFrame) -> DataFrame:
    grams, kept = _fingerprints()
    empty = F.array().cast("array<struct<key:bigint,at:int,before:int,near:array<bigint>>>")
    enough = F.col("n_words") >= WINDOW
    return hashed.withColumn("g", F.when(enough, grams)).withColumn("fp", F.when(enough, kept).otherwise(empty)).drop("g")


def _all_grams(size: int) -> Column:
    """Of the array ``wh``: every run of ``size`` words, marked by a key of its own for each size."""
    starts = F.when(F.col("n_words") >= size, F.sequence(F.lit(1), F.col("n_words") - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.lit((1 << 33) + size).alias("key"), i.alias("at"), F.lit(0).alias("before"), F.slice("wh", i, size).alias("near")))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_items: int = 2) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids, contaminated`` of every row of ``docs``.

    A word is hit if it lies in an occurrence of a window: ``WINDOW`` successive words of a benchmark item, or the
    whole of an item that has fewer words, but some.  ``item_ids`` are the items with occurring windows, as sorted
    strings; ``contaminated`` says that they are at least ``min_items``.  A null text has no words; items without
    words or id occur nowhere; repeated items count once, repeated rows give equal rows, and a null id is kept.
    Other columns are ignored; an empty benchmark hits nothing and an empty table gives an empty result.
    """
    items = _hashed(benchmark.where("item_id is not null").select("item_id", F.col("text").alias("t")), "t").where("n_words > 0").drop("t").distinct()
    items = cut_lineage(items)
    marks = (
        _with_fingerprints(items)
        .select("item_id", F.explode("fp").alias("f"))
        .select(F.col("f.key").alias("key"), "item_id", F.col("f.at").alias("item_at"), F.col("f.before").alias("item_before"), F.col("f.near").alias("item_near"))
    )
    marks = cut_lineage(marks)
    short = [r[0] for r in items.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect()]  # at most WINDOW - 1 values
    hashed = _hashed(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t")), "t").drop("t")
    # one more element, so that a document without fingerprints keeps a row
    lone = F.struct(F.lit(-1 << 40).alias("key"), F.lit(0).alias("at"), F.lit(0).alias("before"), F.array().cast("array<bigint>").alias("near"))
    shorter = [_all_grams(size) for size in short]
    rows = (
        _with_fingerprints(hashed)
        .select("doc_id", "text_hash", "n_words", F.explode(F.concat("fp", F.array(lone), *shorter)).alias("f"))
        .select("doc_id", "text_hash", "n_words", "f.key", "f.at", "f.before", "f.near")
        .withColumn("key2", F.when(F.col("key") >= 1 << 33, F.xxhash64("near")).otherwise(F.lit(0)))
    )
    if short:
        whole = items.where(F.col("n_words") < WINDOW)
        marks = marks.withColumn("key2", F.lit(0).cast("long")).unionByName(
            whole.select((F.lit(1 << 33) + F.col("n_words")).alias("key"), "item_id", F.lit(1).alias("item_at"), F.lit(0).alias("item_before"), F.col("wh").alias("item_near"), F.xxhash64("wh").alias("key2"))
        )
    else:
        marks = marks.withColumn("key2", F.lit(0).cast("long"))
    if marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    met = rows.join(marks, ["key", "key2"], "left").where(f"item_id is not null or key = {-1 << 40}")

    # of a hit, the windows that start 0 to SPAN words before the fingerprint
    def window(d: Column, before: str, near: str) -> Column:
        return F.slice(near, F.col(before) - d + 1, WINDOW)

    back = F.filter(
        F.transform(F.sequence(F.lit(0), F.least("before", "item_before")), lambda d: F.when((F.size(window(d, "before", "near")) == WINDOW) & (window(d, "before", "near") == window(d, "item_before", "item_near")), F.struct((F.col("at") - d).alias("start"), F.lit(WINDOW).alias("len")))),
        lambda x: x.isNotNull(),
    )
    exact = F.when(F.col("near") == F.col("item_near"), F.array(F.struct(F.col("at").alias("start"), F.size("near").alias("len")))).otherwise(F.array().cast("array<struct<start:int,len:int>>"))
    seen = cut_lineage(met.select("doc_id", "text_hash", "n_words", "item_id", F.when(F.col("item_id").isNull(), F.lit(None)).when(F.col("key") >= 1 << 33, exact).otherwise(back).alias("windows")))
    own = seen.where("item_id is null").select("doc_id", "text_hash", "n_words")
    hits = seen.where("item_id is not null").select("doc_id", "text_hash", "item_id", F.explode("windows").alias("w")).select("doc_id", "text_hash", "item_id", "w.start", "w.len").distinct()
    words = hits.select("doc_id", "text_hash", F.explode(F.expr("sequence(start, start + len - 1)")).alias("word")).distinct().groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit"))
    named = hits.select("doc_id", "text_hash", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    found = words.join(named, ["doc_id", "text_hash"]).where("doc_id is not null").unionByName(_nameless(words, named))
    same = own["doc_id"].eqNullSafe(found["doc_id"]) & (own["text_hash"] == found["text_hash"])
    n_items = F.coalesce(F.size("item_ids"), F.lit(0))
    return own.join(found, same, "left").select(
        own["doc_id"],
        own["n_words"].cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("item_ids").isNull(), 0).otherwise(n_items).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (F.when(F.col("item_ids").isNull(), 0).otherwise(n_items) >= min_items).alias("contaminated"),
        own["text_hash"],
    )


def _nameless(words: DataFrame, named: DataFrame) -> DataFrame:
    """The hits of rows without an id, which a plain join leaves out."""
    return words.where("doc_id is null").join(named.where("doc_id is null").drop("doc_id"), "text_hash").select("doc_id", "text_hash", "n_hit", "item_ids")
