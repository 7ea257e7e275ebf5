"""Vectors in blocks: a grid of query tiles and candidate shards, best lists per cell, tree merges.

Shared by the exact search (operator 13) and the hard negatives (operator 11). Every vector component becomes
``floor(256 * x)``, so scores are integers and equal on every machine. A cell holds one bounded tile of queries and one
bounded shard of candidates; it leaves a few best entries per query, and cells are merged in rounds of ``FAN``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.session import cut_lineage

#: Rows and bytes of a block of vectors, the unit that is moved.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Bytes of the vectors of one cell: queries and candidates.
TILE_BYTES, SHARD_BYTES = 8 << 20, 32 << 20
#: Queries multiplied at once.
STEP = 1024
#: Cells merged at once.
FAN = 16
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

VECTORS = "dim int, n int, ids binary, keys binary, labels binary, kind string, matrix binary"
STATE = "dim int, i int, j int, scores binary, ids binary"
Best = tuple[np.ndarray, np.ndarray]


def _narrow(m: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them; beyond 32 bits they stay doubles."""
    top = np.abs(m).max(initial=0)
    return m.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64)


def _vector_row(ids, keys, labels, m) -> tuple:
    order = np.lexsort((keys, ids))  # ties go to the smaller id: columns of a product are in this order
    m = _narrow(m[order])
    return m.shape[1], len(ids), ids[order].tobytes(), keys[order].tobytes(), labels[order].tobytes(), m.dtype.str, m.tobytes()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[f.split() for f in schema.split(", ")], strict=True)
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vector) to blocks of one length of vectors; rows that take no part are left out."""
    task, seen, held, held_bytes = TaskContext.get().partitionId() << 40, 0, {}, 0

    def block(dim):
        parts = held.pop(dim)
        ids, labels, keys, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim))))
        for at in range(0, len(ids), size):
            part = slice(at, at + size)
            yield _batch([_vector_row(ids[part], keys[part], labels[part], m[part])], VECTORS)

    for batch in batches:
        vectors = batch.column(2)
        if isinstance(vectors, pa.ChunkedArray):
            vectors = vectors.combine_chunks()
        ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        labels = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        there = np.ones(len(batch), bool)
        for c in (0, 1, 2):
            if batch.column(c).null_count:
                there &= batch.column(c).is_valid().to_numpy(zero_copy_only=False)
        offsets = vectors.offsets.to_numpy()
        values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # a null component reads as NaN
        there &= odd[offsets[1:]] == odd[offsets[:-1]]
        with np.errstate(over="ignore", invalid="ignore"):
            values = np.floor(256 * values)
        values[~np.isfinite(values)] = np.finfo(np.float64).max
        dims, keys = np.diff(offsets), task + seen + np.arange(len(batch))
        seen += len(batch)
        for dim in np.unique(dims[there]):
            at = np.flatnonzero(there & (dims == dim))
            m = values[(offsets[at][:, None] + np.arange(dim)).astype(np.int64)]
            held.setdefault(int(dim), []).append((ids[at], labels[at], keys[at], m))
            held_bytes += m.nbytes + 24 * len(at)
            if sum(len(x[0]) for x in held[dim]) >= BLOCK_ROWS or sum(x[3].nbytes for x in held[dim]) >= BLOCK_BYTES:
                yield from block(int(dim))
        if held_bytes > 8 * BLOCK_BYTES:
            for dim in list(held):
                yield from block(dim)
            held_bytes = 0
    for dim in list(held):
        yield from block(dim)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, keys, labels, matrix) of one packed row."""
    ids, keys, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "keys", "labels"))
    return ids, keys, labels, np.frombuffer(row["matrix"], row["kind"]).reshape(row["n"], row["dim"])


def pack(vectors: DataFrame, id_col: str, vector_col: str, label=None) -> DataFrame:
    """Blocks of ``vectors``, written once; every row gets a key of its own, so equal rows stay two rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.lit(0) if label is None else label).cast("long").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    return cut_lineage(rows.mapInArrow(_pack, VECTORS).withColumn("block", F.xxhash64("keys")))


def query_tiles(blocks: DataFrame, modulus: int) -> DataFrame:
    """Rows of ``blocks`` whose id is divisible by ``modulus``, as tiles (dim, i) in the order of their keys."""
    def cut(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids, keys, labels, m = _read(row)
                take = ids % modulus == 0
                if take.any():
                    out.append((*_vector_row(ids[take], keys[take], labels[take], m[take].astype(np.float64)), row["block"]))
            yield _batch(out, VECTORS + ", block long")

    def join(key, table):
        ids, keys, labels, m = zip(*[_read(r) for r in table.to_pylist()], strict=True)
        ids, keys, labels, m = np.concatenate(ids), np.concatenate(keys), np.concatenate(labels), _narrow(np.concatenate(m).astype(np.float64))
        order = np.argsort(keys)
        row = (m.shape[1], len(ids), ids[order].tobytes(), keys[order].tobytes(), labels[order].tobytes(), m.dtype.str, m[order].tobytes(), key[1].as_py())
        return pa.Table.from_batches([_batch([row], VECTORS + ", i int")])

    parts = cut_lineage(blocks.mapInArrow(cut, VECTORS + ", block long"))
    size = parts.agg(F.coalesce(F.sum(F.col("n") * (F.col("dim") + 4) * 8), F.lit(0))).first()[0]
    tiles = parts.withColumn("i", F.pmod("block", F.lit(size // TILE_BYTES + 1)).cast("int"))
    return cut_lineage(tiles.groupBy("dim", "i").applyInArrow(join, VECTORS + ", i int"))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows; as floats where those are exact, else as 64-bit numbers.

    Products beyond 64 bits are held at the ends of their range.
    """
    bound = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * q.shape[1]
    for kind, exact in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if bound < exact:
            return q.astype(kind) @ c.astype(kind).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q).dot(whole(c).T), LEAST + 1, MOST).astype(np.int64)


def none_yet(rows: int, k: int) -> Best:
    return np.full((rows, k), LEAST), np.full((rows, k), MOST)


def improve(best: Best, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> Best:
    """The best lists after one tile: a row's k highest scores, ties to the smaller id; ``ids`` ascend."""
    k, edge = best[0].shape[1], best[0][:, -1]
    allowed = allowed & (scores >= edge[:, None])
    if np.count_nonzero(allowed) > 4 * best[0].size and scores.shape[1] > k:
        low = LEAST if scores.dtype == np.int64 else -np.inf
        open_ = np.where(allowed, scores, low)
        cut = np.partition(open_, -k, axis=1)[:, -k][:, None]
        level = allowed & (open_ == cut)
        allowed = allowed & ((open_ > cut) | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= k)))
    row, column = np.nonzero(allowed)
    if not len(row):
        return best
    rows = np.concatenate([np.repeat(np.arange(len(edge)), k), row])
    all_scores = np.concatenate([best[0].ravel(), scores[row, column].astype(np.int64)])
    all_ids = np.concatenate([best[1].ravel(), ids[column]])
    order = np.lexsort((all_ids, ~all_scores, rows))
    count = np.bincount(rows, minlength=len(edge))
    first = order[(np.cumsum(count) - count)[:, None] + np.arange(k)]
    return all_scores[first], all_ids[first]


def _merge(parts: list[Best]) -> Best:
    k = parts[0][0].shape[1]
    scores, ids = np.concatenate([p[0] for p in parts], 1), np.concatenate([p[1] for p in parts], 1)
    order = np.lexsort((ids, ~scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def best_lists(tiles: DataFrame, blocks: DataFrame, k: int, lists: int, start: Callable, allow: Callable) -> DataFrame:
    """(dim, i, scores, ids): for every query of a tile ``lists`` best lists of ``k`` entries.

    ``start(tile)`` gives what ``allow(start, rows, scores, own, ids, labels)`` needs; the latter yields one mask per list for
    the queries ``rows`` against one block of candidates. ``own`` marks the query's own row. Both run in the tasks.
    """
    spark = blocks.sparkSession
    size, groups = blocks.agg(F.coalesce(F.sum(F.col("n") * (F.col("dim") + 4) * 8), F.lit(0))).first()[0], tiles.agg(F.coalesce(F.max("i"), F.lit(0))).first()[0] + 1
    spread = 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // groups
    shards = max(1, spread, size // SHARD_BYTES + 1)

    def cell(key, left, right):
        if not (left.num_rows and right.num_rows):
            return pa.Table.from_batches([_batch([], STATE)])
        tile = right.to_pylist()[0]
        _, q_keys, _, q = _read(tile)
        state = [none_yet(len(q), k) for _ in range(lists)]
        shared = start(tile)
        for row in sorted(left.to_pylist(), key=lambda r: r["block"]):
            ids, keys, labels, c = _read(row)
            for at in range(0, len(q), STEP):
                rows = slice(at, min(at + STEP, len(q)))
                scores = products(q[rows], c)
                own = np.zeros(scores.shape, bool)
                _, a, b = np.intersect1d(q_keys[rows], keys, assume_unique=True, return_indices=True)
                own[a, b] = True
                for s, mask in enumerate(allow(shared, rows, scores, own, ids, labels)):
                    state[s][0][rows], state[s][1][rows] = improve((state[s][0][rows], state[s][1][rows]), scores, mask, ids)
        scores, found = (np.stack([x[p] for x in state], 1) for p in (0, 1))
        return pa.Table.from_batches([_batch([(tile["dim"], tile["i"], key[2].as_py(), scores.tobytes(), found.tobytes())], STATE)])

    def merge(key, table):
        scores, ids = _merge_packed(table, k)
        return pa.Table.from_batches([_batch([(key[0].as_py(), key[1].as_py(), key[2].as_py(), scores.tobytes(), ids.tobytes())], STATE)])

    candidates = blocks.withColumn("j", F.pmod("block", F.lit(shards)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = tiles.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    key = ["dim", "i", "j"]
    out = cut_lineage(candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(cell, STATE))
    while shards > 1:
        shards = -(-shards // FAN)
        out = out.withColumn("j", F.floor(F.col("j") / FAN).cast("int")).groupBy(*key).applyInArrow(merge, STATE)
    return out.drop("j")


def _merge_packed(table: pa.Table, k: int) -> Best:
    return _merge([(unpack(r["scores"], k), unpack(r["ids"], k)) for r in table.to_pylist()])


def unpack(data: bytes, k: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, k)
