"""Benchmark decontamination by spaced seeds (operator 1), in DataFrame functions only.

A mask keeps some of ``SPAN`` neighbouring words and ignores the others, so a replaced word spoils only the
windows that keep it. Hashes of every window of every text are joined with those of the benchmark items; around
each hit the words of both sides are compared, and enough agreement there proves the overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.session import cut_lineage

SPAN = 10
#: Kept positions of each mask (weight 7 of 10).
MASKS = ((0, 1, 2, 4, 5, 7, 9), (0, 1, 3, 4, 6, 8, 9), (0, 2, 3, 5, 7, 8, 9))
#: Words compared on both sides of a hit besides its span.
MARGIN = 3
#: Up to so many seeds (24 bytes each) are sent to all executors; more are joined by a shuffle.
BROADCAST_SEEDS = 2_000_000
#: Up to so many alignments are sent to all executors (about 1 KB each with its item); more are joined by a shuffle.
BROADCAST_LINES = 100_000


#: Scripts written without spaces: each of their letters is a word.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
#: Blocks that hold all of them; only texts with a character from these take the slower pattern.
MAYBE = r"[\u0E00-\u109F\u1780-\u17FF\u3005-\uABFF\uF900-\uFAFF\uFF66-\uFF9F\x{16FE0}-\x{3FFFF}]"
WORD = rf"[\p{{L}}\p{{N}}&&[^{UNSPACED}]]+|[\p{{L}}\p{{N}}&&[{UNSPACED}]]"


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, single letters of unspaced scripts; null is the empty text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    runs, single = (F.regexp_extract_all(lowered, F.lit(x), F.lit(0)) for x in (r"[\p{L}\p{N}]+", WORD))
    return F.when(lowered.rlike(MAYBE), single).otherwise(runs)


def _seeds(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., pos, mask, seed): a row for each window and mask; ``df`` has ``words``."""
    n = F.size("words") - SPAN + 1
    shifted = F.arrays_zip(*[F.slice("words", F.lit(i + 1), n).alias(f"w{i}") for i in range(SPAN)])
    windows = df.where(F.size("words") >= SPAN).select(*keep, F.posexplode(shifted).alias("pos", "w"))
    hashes = [F.xxhash64(*[F.col(f"w.w{i}") for i in mask]) for mask in MASKS]
    return windows.select(*keep, "pos", F.posexplode(F.array(*hashes)).alias("mask", "seed"))


def _whole(texts: DataFrame, tests: DataFrame) -> DataFrame | None:
    """(doc_id, item_id, matched, item_words, n) of items of under ``SPAN`` words: their equally long windows in the texts.

    None without such an item. Hashes of all words find the windows, the words themselves decide.
    """
    short = tests.where(F.size("item").between(1, SPAN - 1)).withColumn("size", F.size("item")).withColumn("key", F.xxhash64("item"))
    sizes = sorted(r["size"] for r in short.select("size").distinct().collect())
    if not sizes:
        return None
    few = short.count() <= BROADCAST_SEEDS
    last = F.size("words") - sizes[0]
    windows = texts.where(last >= 0).select("doc_id", F.explode(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, sizes[-1]))).alias("window"))
    parts = windows.select("doc_id", F.explode(F.array(*[F.when(F.size("window") >= k, F.slice("window", 1, k)) for k in sizes])).alias("part"))
    parts = parts.where(F.col("part").isNotNull()).withColumn("key", F.xxhash64("part"))
    hits = parts.join(F.broadcast(short) if few else short, (parts["key"] == short["key"]) & (F.col("part") == F.col("item")))
    size = F.max("size").cast("int")
    return hits.groupBy("doc_id", "item_id").agg(size.alias("matched"), size.alias("item_words"), F.count(F.lit(1)).alias("n"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, item_id, matched, item_words, n_hits): every document that overlaps a benchmark item.

    A hit counts when at least ``percent`` of the words from ``MARGIN`` before to ``MARGIN`` after its span agree
    (the stretch is clipped to item and text). ``matched`` is the largest number of item words that agree on one
    alignment, ``n_hits`` the number of hits that count. All windows of all whole texts are looked up.

    An item of under ``SPAN`` words counts wherever all its words stand in a text, in order and side by side; each such
    place is a hit. Letters of scripts without spaces are words of their own (``UNSPACED``). Null or empty texts and items
    have no row, nor has a text of under ``SPAN`` words that is only a part of a longer item. Copies under
    different ids get rows of their own; repeated rows of one id count as one document whose hits add up; rows with
    null ids are kept under null. Other columns are ignored; an empty table on either side gives no rows.
    """
    tests = items.select(F.col(item_id_col).alias("item_id"), words_of(F.col(item_text_col)).alias("item")).distinct()
    every = tests
    seeds = _seeds(tests.withColumnRenamed("item", "words").select("item_id", F.xxhash64("words").alias("version"), "words"),
                   ["item_id", "version"]).withColumnRenamed("pos", "q")
    few = seeds.count() <= BROADCAST_SEEDS
    texts = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    hits = _seeds(texts, ["doc_id"]).join(F.broadcast(seeds) if few else seeds, ["mask", "seed"])
    # one row for each alignment; the hits on it are at most masks x words of the item
    lines = cut_lineage(hits.groupBy("doc_id", "item_id", "version", (F.col("pos") - F.col("q")).alias("shift")).agg(
        F.collect_set(F.struct("mask", "q")).alias("hits")))
    small = lines.count() <= BROADCAST_LINES
    tests = tests.select(F.col("item_id").alias("_i"), F.xxhash64("item").alias("_k"), "item")
    lines = lines.join(F.broadcast(tests) if few else tests, F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("version") == F.col("_k")))
    lines = lines.withColumnRenamed("doc_id", "_d")
    # only texts with a hit are split again; of their words what lies against the item is kept
    shift, start = F.col("shift"), F.greatest(F.lit(0), -F.col("shift"))
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")).join(
        F.broadcast(lines) if small else lines, F.col("doc_id").eqNullSafe(F.col("_d")))
    found = cut_lineage(found.select("doc_id", "item_id", "version", "shift", "item", "hits", start.alias("start"),
                                     F.slice(words_of(F.col("_t")), start + shift + 1, F.size("item") - start).alias("part")))

    def agree(a: Column, b: Column) -> Column:
        n = F.greatest(b - a, F.lit(0))
        both = F.zip_with(F.slice("part", a - F.col("start") + 1, n), F.slice("item", a + 1, n), lambda x, y: x == y)
        return F.size(F.filter(both, lambda x: x))

    end = F.col("start") + F.size("part")

    def near(hit: Column) -> Column:
        first, last = F.greatest(hit["q"] - MARGIN, F.col("start")), F.least(hit["q"] + SPAN + MARGIN, end)
        return (last - first >= SPAN) & (agree(first, last) * 100 >= percent * (last - first))

    counted = found.select("doc_id", "item_id", "version", "shift", F.size("item").alias("item_words"), agree(F.col("start"), end).alias("matched"),
                           F.size(F.filter("hits", near)).alias("n")).where("n > 0")
    counted = counted.groupBy("doc_id", "item_id", "version", "shift").agg(
        F.max("n").alias("n"), F.max("matched").alias("matched"), F.max("item_words").alias("item_words"))
    counted = counted.select("doc_id", "item_id", "matched", "item_words", F.col("n").cast("long").alias("n"))
    whole = _whole(texts, every)
    if whole is not None:
        counted = counted.unionByName(whole)
    return counted.groupBy("doc_id", "item_id").agg(
        F.max("matched").cast("long").alias("matched"), F.max("item_words").cast("long").alias("item_words"),
        F.sum("n").cast("long").alias("n_hits"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that overlap no item; rows with a null id are compared by null-safe equality."""
    found = contamination(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("_leak")), "left_anti")
