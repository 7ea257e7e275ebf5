"""Removal of repeated byte strings by distributed prefix doubling (operator 5).

Ranks of positions start with short prefixes and grow until a rank is unique (the position repeats nothing) or its
prefix reaches the threshold. Sorting every byte position would move many times the input, so neighbouring window
starts stay together in one row as long as they share their fate:

1. Every window of ``length`` bytes has one anchor, the smallest hash of its ``ANCHOR``-byte strings. The windows of one
   anchor are a block; the anchor is the prefix that they share, the block the bytes that they cover.
2. Spark sorts the rows by the pair (rank of the shared bytes, rank of the covered bytes) and position. Where the first is
   unique nothing repeats; where the pair occurred before, all windows of the row are repeated; where all
   rows of a first rank are alike, the first of them is settled too.
3. The rows that are left, the edges of repeated passages, are cut into rows of ``WIDTHS`` windows, which share more
   bytes (``length`` less the width), and are ranked again, until the shared bytes are the whole window.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm import textnum as X
from tablescope.session import cut_lineage

ANCHOR = 32
#: Bytes of text worked on at once: about a hundred bytes of arrays for each.
TEXT_BYTES = 1 << 17
WIDTHS = (16, 4, 1)
#: Up to so many documents' span lists are sent to all executors; more are joined by shuffle.
BROADCAST_DOCUMENTS = 400_000
BROADCAST_SPANS = 2_500_000
_SPANS = "array<struct<lo:int,hi:int>>"
_RANKED = "a long, c long, key long, lo int, hi int, at int"


def _windows(offsets: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows of ``length`` bytes inside the texts."""
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    return X.ragged(offsets[:-1], n)


def _sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``v[i:i + width]`` for every full window."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def _blocks(length: int):
    """(a, c, key, lo, hi, at): ranks of anchor and block, the window starts lo .. hi, and the place of the anchor."""
    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, b, offsets in X.chunks(batch.column(1), TEXT_BYTES):
                if len(b) < length:
                    continue
                prefix = X.prefix_hash(b)
                at = np.arange(len(b) - ANCHOR + 1)
                gram = X.span_hash(prefix, at, at + ANCHOR)
                with np.errstate(over="ignore"):
                    order = (gram ^ (gram >> X.U64(29))) * X.U64(0xBF58476D1CE4E5B9)
                bits = X.U64(int(len(b)).bit_length())
                low = (X.U64(1) << bits) - X.U64(1)
                least = _sliding_minimum((order & ~low) | at.astype(np.uint64), length - ANCHOR + 1) & low
                start = _windows(offsets, length)
                if not len(start):
                    continue
                anchor = least[start].astype(np.int64)
                cut = np.ones(len(start), bool)
                cut[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
                begin = np.flatnonzero(cut)
                lo, hi = start[begin], start[np.append(begin[1:], len(start)) - 1]
                where = anchor[begin]
                a = X.mix(gram[where], 31)
                c = X.mix(X.span_hash(prefix, lo, hi + length) + (where - lo).astype(np.uint64), 32)
                doc = np.searchsorted(offsets, lo, "right") - 1
                base = offsets[doc]
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(keys[first + doc]),
                                       pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32)), pa.array((where - base).astype(np.int32))],
                                      ["a", "c", "key", "lo", "hi", "at"])
        X.release()
    return run


def _tiles(width: int, length: int):
    """(key, text, lists lo, hi, at) -> rows of ``_blocks`` for these open window starts, cut at multiples of ``width`` before the anchor."""
    def run(batches):
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy())
            lo, hi, at = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3, 4))
            bounds = X.counts_to_offsets(size)
            for first, end, b, offsets in X.chunks(batch.column(1), TEXT_BYTES):
                mine = slice(bounds[first], bounds[end])
                doc = np.repeat(np.arange(end - first), size[first:end])
                l, h, p = lo[mine], hi[mine], at[mine]
                one, many = (p - h) // width, (p - l) // width - (p - h) // width + 1
                j, of = X.ragged(one, many), np.repeat(np.arange(len(l)), many)
                l, h, p, doc = l[of], h[of], p[of], doc[of]
                h, l = p - np.maximum(j * width, p - h), p - np.minimum(j * width + width - 1, p - l)
                base = offsets[doc]
                prefix = X.prefix_hash(b)
                shared = X.span_hash(prefix, base + p - j * width, base + p - j * width - width + 1 + length)
                covered = X.span_hash(prefix, base + l, base + h + length)
                a = X.mix(shared + j.astype(np.uint64), 33)
                c = X.mix(covered + ((p - l) * 4096 + p - h).astype(np.uint64), 34)
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).slice(first, end - first).take(pa.array(doc)),
                                       *(pa.array(x.astype(np.int32)) for x in (l, h, p))], ["a", "c", "key", "lo", "hi", "at"])
        X.release()
    return run


def _resolve(batches):
    """Rows sorted by (a, c, key, lo) -> (open, key, lo, hi, at): repeated rows (open false) and rows left to rank."""
    last = None  # (a, c) of the last row
    pending = None  # the only kind of row of the last shared bytes so far: (key, lo, hi, at)
    several = False  # the last shared bytes have more than one kind
    for batch in batches:
        a, c, key, lo, hi, at = (batch.column(i).to_numpy() for i in range(6))
        if not len(a):
            continue
        new_a, new_c = np.ones(len(a), bool), np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        new_c[1:] = new_a[1:] | (c[1:] != c[:-1])
        if last is not None and last[0] == a[0]:
            new_a[0] = False
            new_c[0] = last[1] != c[0]
        group = np.cumsum(new_a)  # 0: the one that began earlier
        kinds = np.flatnonzero(new_c)
        per_group = np.bincount(group[kinds], minlength=int(group[-1]) + 1)
        if pending is not None and not new_a[0]:
            per_group[0] += 1
        left = (per_group > 1)
        if not new_a[0]:
            left[0] |= several
        out = kinds[left[group[kinds]]]
        copies = np.flatnonzero(~new_c)
        rows = [np.concatenate([x[copies], x[out]]) for x in (key, lo, hi, at)]
        opened = np.concatenate([np.zeros(len(copies), bool), np.ones(len(out), bool)])
        if pending is not None and not new_a[0] and left[0]:
            rows = [np.append(x, np.array(p, x.dtype)) for x, p in zip(rows, pending, strict=True)]
            opened = np.append(opened, True)
            pending = None
        yield pa.record_batch([pa.array(opened), *map(pa.array, rows)], ["open", "key", "lo", "hi", "at"])
        end = int(group[-1])
        if end > 0 or new_a[0]:
            of_last = kinds[group[kinds] == end]
            several = bool(left[end])
            i = of_last[0]
            pending = None if several else (key[i], lo[i], hi[i], at[i])
        else:
            several = bool(left[0])
            if several:
                pending = None
        last = (a[-1], c[-1])


def _merged(batches):
    """(key, sorted list of spans) -> (key, lists lo and hi of the maximal spans of overlapping or touching ones)."""
    for batch in batches:
        lists = batch.column(1)
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        lo, hi = (lists.flatten().field(i).to_numpy().astype(np.int64) for i in range(2))
        reach = np.maximum.accumulate((owner << 32) + hi)
        new = np.ones(len(lo), bool)
        new[1:] = (owner[1:] << 32) + lo[1:] > reach[:-1]
        begin = np.flatnonzero(new)
        end = reach[np.append(begin[1:], len(lo)) - 1] & 0xFFFFFFFF
        offsets = pa.array(X.counts_to_offsets(np.bincount(owner[begin], minlength=len(lists))).astype(np.int32))
        yield pa.record_batch([batch.column(0), *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (lo[begin], end))], ["key", "lo", "hi"])


def _keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> tuple[DataFrame, bool]:
    """(id, key, text), and whether keys are distinct: ``key`` orders the documents; equal rows share one key.

    With distinct, non-null long ids the key is the id. Otherwise documents are numbered by (id, nulls last, hash of text).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.struct(*[F.col(c).alias(c) for c in keep], F.lit(True).alias("_")).alias("payload"))
    odd = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null")
    if odd.isEmpty():
        return rows.select("id", F.col("id").alias("key"), "text", "payload"), True
    from tablescope.plans.blocks import ordered
    named = rows.withColumn("h", F.xxhash64("text"))
    ids = named.select(F.lit(1).alias("one"), F.col("id").isNull().alias("last"), F.coalesce("id", F.lit(0)).alias("i"), "h").distinct()
    numbers = ordered(ids, ["one"], ["last", "i", "h"]).select("last", "i", "h", F.col("_rn").alias("key"))
    keyed = named.withColumn("last", F.col("id").isNull()).withColumn("i", F.coalesce("id", F.lit(0))).join(numbers, ["last", "i", "h"])
    return keyed.select("id", "key", "text", "payload"), False


def _with_lists(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``rows`` and the lists (``lo`` and others as long) of their key.

    Lists of whole numbers take 4 bytes a number where they are broadcast, a list of structs 8 and 16 a struct besides.
    """
    lists = cut_lineage(lists)
    small = lists.count() <= BROADCAST_DOCUMENTS and (lists.agg(F.sum(F.size("lo"))).first()[0] or 0) <= BROADCAST_SPANS
    return rows.join(F.broadcast(lists) if small else lists, "key", how)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
                   keep: list[str] | None = None) -> DataFrame:
    """(id, text, spans, payload): every row with the maximal byte spans ``[lo, hi)`` covered by a repeated string.

    A string of ``length`` bytes is repeated where it also starts earlier: in a document with a smaller id, or earlier in
    the same one; overlapping occurrences count, and matches never leave a document. Texts are UTF-8
    bytes; all windows of all whole texts are judged on the input. ``length`` is at least 64.

    Null text is the empty text. Rows equal in id and text are one document and get the same spans; different texts
    under one id follow in the order of their hashes, null ids come last. Other columns are ignored but for those
    named in ``keep``, which become fields of ``payload``; an empty table gives no rows.
    """
    if length < 64:
        raise ValueError("length must be at least 64")
    spark = docs.sparkSession
    rows, distinct = _keyed(docs, id_col, text_col, keep or [])
    texts = rows.select("key", "text") if distinct else rows.select("key", "text").dropDuplicates(["key"])
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = texts.mapInArrow(_blocks(length), _RANKED)
    removed = []
    for width in (*WIDTHS, None):
        settled = cut_lineage(blocks.repartition(n, "a").sortWithinPartitions("a", "c", "key", "lo").mapInArrow(
            _resolve, "open boolean, key long, lo int, hi int, at int"))
        removed.append(settled.where("not open").select("key", "lo", (F.col("hi") + length).alias("hi")))
        if width:
            left = settled.where("open").groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "at")).alias("spans")).select("key", "spans.lo", "spans.hi", "spans.at")
            blocks = _with_lists(texts, left, "inner").mapInArrow(_tiles(width, length), _RANKED)
    lists = reduce(DataFrame.union, removed).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    out = _with_lists(rows, lists.mapInArrow(_merged, "key long, lo array<int>, hi array<int>"), "left")
    return out.select("id", "text", F.coalesce(F.arrays_zip("lo", "hi"), F.array()).cast(_SPANS).alias("spans"), "payload")


def _outside(text: str, spans) -> bytes:
    b, at, parts = text.encode("utf-8", "surrogatepass"), 0, []
    for s in spans:
        parts.append(b[at:s["lo"]])
        at = s["hi"]
    parts.append(b[at:])
    return b"".join(parts)


def kept_bytes(text: Column, spans: Column) -> Column:
    """The bytes of ``text`` outside ``spans``, one after another.

    Joined as hexadecimal text without a Python worker: whole batches of texts do not leave the JVM, and every byte is copied
    equally often, however many spans there are. The text is bound once as bytes, not cast again for every span.
    """
    def cut(b: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), spans["hi"])
        ends = F.concat(spans["lo"], F.array(F.length(b)))
        return F.array_join(F.zip_with(starts, ends, lambda lo, hi: F.hex(F.substring(b, lo + 1, hi - lo))), "")
    return F.unhex(F.transform(F.array(text.cast("binary")), cut)[0])


def _cut(batches):
    """(text, spans, ...) -> (text without the bytes of its spans, cut, ...), in pieces of about ``CHUNK`` bytes of text."""
    for batch in batches:
        text, lists, rest = batch.column(0), batch.column(1), batch.columns[2:]
        for first, end, _, _ in X.chunks(text):
            texts, spans = text.slice(first, end - first), lists.slice(first, end - first)
            cut = np.diff(spans.offsets.to_numpy()) > 0
            if cut.any():
                texts = pa.array([_outside(t, x).decode("utf-8", "ignore") if c else t
                                  for t, x, c in zip(texts.to_pylist(), spans.to_pylist(), cut.tolist(), strict=True)], batch.schema.field(0).type)
            yield pa.record_batch([texts, pa.array(cut), *[c.slice(first, end - first) for c in rest]], ["text", "cut", *batch.schema.names[2:]])
    X.release()


def cut_texts(spans: DataFrame) -> DataFrame:
    """(id, text, cut, payload) of the rows of ``repeated_spans``: the text outside the spans, and whether it has any.

    Bytes of a character that a span has split are left out. One pass of one function, so a task needs one Python worker and,
    beyond its batch, the memory of a piece of it, whatever is filtered or derived from the text afterwards.
    """
    rows = spans.select("text", "spans", "id", "payload")
    payload = rows.schema["payload"].dataType.simpleString()
    return rows.mapInArrow(_cut, f"text string, cut boolean, id long, payload {payload}").select("id", "text", "cut", "payload")
