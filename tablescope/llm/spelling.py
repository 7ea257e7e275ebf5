"""Spelling variants by blocked Gram matrices (operator 12).

Words are counted, sorted by length and cut into blocks. Products of the blocks' letter-count vectors give squared
distances: one inserted or deleted code point makes 1, a replaced one 2. Pairs of at most two in the same or the next
length are verified code point by code point. Blocks whose letter classes differ too much are not multiplied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.session import cut_lineage

#: Words and code points of a block.
BLOCK_WORDS, BLOCK_POINTS = 2048, 1 << 18
#: Letter classes by which words of one length are sorted: blocks far apart in one of them cannot hold near words.
CLASSES = ("aeiou", "rstln", "dcmp")
#: Code points of candidate pairs verified at once.
VERIFY_POINTS = 1 << 22

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"

BLOCKS = "block long, length int, low array<int>, high array<int>, words array<string>, counts array<long>"
EDGES = "word string, n long, near string, near_n long"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_n: int = 5,
                every: int | None = 199) -> DataFrame:
    """(word, n): letter runs with A-Z lower-cased, of at least ``least_length`` code points and ``least_n`` occurrences.

    With ``every`` a run loses the code point at crc32 % length where crc32 of ``<id>:<run>`` is divisible by it. Null text
    has no runs; a null id counts as empty.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id")
    runs = docs.select(key, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("w"))
    runs = runs.where(F.length("w") >= least_length).select("_id", F.translate("w", UPPER, LOWER).alias("w"))
    if every:
        h = F.crc32(F.concat("_id", F.lit(":"), "w"))
        at = (h % F.length("w")).cast("int")
        cut = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
        runs = runs.select(F.when(h % every == 0, cut).otherwise(F.col("w")).alias("w")).where(F.length("w") >= least_length)
    return runs.groupBy(F.col("w").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def _class_counts(word: Column) -> list[Column]:
    return [F.length(word) - F.length(F.translate(word, letters, "")) for letters in CLASSES]


def _blocks(batches):
    """Rows (length, c0.., word, n) in order to blocks of one length with the range of each class count."""
    task, seen, held = TaskContext.get().partitionId() << 32, 0, []

    def block(rows):
        nonlocal seen
        seen += 1
        classes = np.array([r[1:-2] for r in rows])
        return pa.record_batch([pa.array([task + seen]), pa.array([rows[0][0]], pa.int32()), pa.array([classes.min(0).tolist()], pa.list_(pa.int32())),
                                pa.array([classes.max(0).tolist()], pa.list_(pa.int32())), pa.array([[r[-2] for r in rows]]), pa.array([[r[-1] for r in rows]])],
                               [c.split()[0] for c in BLOCKS.split(", ")])
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and (row[0] != held[0][0] or len(held) >= BLOCK_WORDS or (len(held) + 1) * row[0] > BLOCK_POINTS):
                yield block(held)
                held = []
            held.append(row)
    if held:
        yield block(held)


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _letter_counts(points: np.ndarray, letters: np.ndarray) -> np.ndarray:
    slot = np.searchsorted(letters, points) + np.arange(len(points))[:, None] * len(letters)
    return np.bincount(slot.ravel(), minlength=len(points) * len(letters)).reshape(len(points), len(letters)).astype(np.float64)


def near_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of code point matrices ``a`` and ``b``, as long as or one longer than ``a``, that are one edit apart."""
    letters = np.union1d(a, b)
    x, y = _letter_counts(a, letters), _letter_counts(b, letters)
    # g - (|x|^2 + |y|^2) / 2 + 1 >= 0: squared distance of two at most; the constants ride along as two more letters
    x = np.hstack([x, 1 - (x * x).sum(1, keepdims=True) / 2, np.ones((len(x), 1))])
    y = np.hstack([y, np.ones((len(y), 1)), -(y * y).sum(1, keepdims=True) / 2])
    kind = np.float32 if a.shape[1] < 1000 else np.float64  # whole and half numbers, exact
    close = np.flatnonzero((x.astype(kind) @ y.astype(kind).T).ravel() >= 0)
    i, j = close // len(b), close % len(b)
    keep = np.zeros(len(i), bool)
    step = max(1, VERIFY_POINTS // max(1, b.shape[1]))
    for at in range(0, len(i), step):
        p, q = a[i[at:at + step]], b[j[at:at + step]]
        if a.shape[1] == b.shape[1]:
            keep[at:at + step] = (p != q).sum(1) == 1
        else:
            head = np.logical_and.accumulate(p == q[:, :-1], axis=1).sum(1)
            tail = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1).sum(1)
            keep[at:at + step] = head + tail >= a.shape[1]
    return i[keep], j[keep]


def _edges(batches):
    held = (None, None)
    for batch in batches:
        for r in batch.to_pylist():
            if held[0] != r["a"]:
                held = r["a"], _points(r["words"], r["length"])
            same = r["a"] == r["b"]
            other = held[1] if same else _points(r["words_b"], r["length_b"])
            i, j = near_pairs(held[1], other)
            if same:
                i, j = i[i < j], j[i < j]
            v, n, w, m = (np.array(r[c], object)[k] for c, k in (("words", i), ("counts", i), ("words_b", j), ("counts_b", j)))
            both = [np.concatenate(x) for x in ((v, w), (n, m), (w, v), (m, n))]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(both, (pa.string(), pa.int64()) * 2, strict=True)], [c.split()[0] for c in EDGES.split(", ")])


def near_words(counts: DataFrame) -> DataFrame:
    """(word, n, near, near_n) in both directions for all words of ``counts(word, n)`` that are one edit apart.

    Words are distinct and not null. Any two blocks of the same or the next length meet unless their classes rule it out.
    """
    k = len(CLASSES)
    spark = counts.sparkSession
    keyed = counts.select(F.length("word").alias("length"), *[c.alias(f"c{i}") for i, c in enumerate(_class_counts(F.col("word")))], "word", "n")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["length", *[f"c{i}" for i in range(k)], "word"]
    blocks = cut_lineage(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_blocks, BLOCKS))
    about = blocks.select("block", "length", "low", "high")
    a, b = (about.select(*[F.col(c).alias(f"{c}_{s}") for c in about.columns]) for s in "ab")
    # a replaced letter moves each class by one at most; an inserted one adds one to one class at most
    grown = F.col("length_b") - F.col("length_a")
    fits = [(F.col("low_b")[i] <= F.col("high_a")[i] + 1) & (F.col("high_b")[i] >= F.col("low_a")[i] - F.when(grown == 0, 1).otherwise(0)) for i in range(k)]
    once = (grown == 1) | (F.col("block_a") <= F.col("block_b"))
    pairs = a.withColumn("length_b", F.explode(F.array("length_a", F.col("length_a") + 1))).join(b, "length_b").where(once)
    for f in fits:
        pairs = pairs.where(f)
    pairs = pairs.select(F.col("block_a").alias("a"), F.col("block_b").alias("b"))
    left = blocks.select(F.col("block").alias("a"), "length", "words", "counts")
    right = blocks.select(F.col("block").alias("b"), F.col("length").alias("length_b"), F.col("words").alias("words_b"), F.col("counts").alias("counts_b"))
    return pairs.join(right.hint("shuffle_hash"), "b").join(left.hint("shuffle_hash"), "a").mapInArrow(_edges, EDGES)


def variants(counts: DataFrame, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``counts(word, n)``.

    ``form`` is the near word of largest n (ties: the smallest in code point order) if that n is at least ``factor``
    times the word's; ``root`` follows forms to the last and is the word itself without form. As n grows along forms,
    there are no rings, and the rounds that double the pointers are few. An empty table gives no rows.
    """
    words = cut_lineage(counts)
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("top"))
    out = words.join(best, "word", "left").select(
        "word", F.when(-F.col("top.m") >= factor * F.col("n"), F.col("top.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("top.m") >= factor * F.col("n"), -F.col("top.m")).alias("form_n"))
    out = cut_lineage(out)
    step = cut_lineage(out.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cut_lineage(step.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            break
    return out.join(step.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
