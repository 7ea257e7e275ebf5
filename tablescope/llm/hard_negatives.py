"""Hard negatives by slot-decomposed selection (operator 11).

The positives of an anchor set windows of scores that overlap. Their upper limits cut the scores into disjoint slots;
every cell keeps the best few entries of each slot, cells are merged slot by slot, and a merge of the slots from
below upwards gives for each slot the best of it and all lower ones, from which every window takes its first entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm import tiles as T

TRIPLES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def windows(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) negative score for each positive score: 50 to 95 percent of it; empty where it is negative or missing."""
    there = positive >= 0
    p = np.where(there, positive, 0)
    return np.where(there, p // 2 + p % 2, T.MOST), np.where(there, p - p // 20 - (p % 20 > 0), T.LEAST)


def slots(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lowest, highest score of each disjoint slot, slot of each positive), from positives in descending order of score.

    Slot s ends where the window of positive s ends and begins above the next lower limit, the last one at the lowest
    score of any window. A positive that repeats a limit belongs to the first one's slot; its own slot is empty.
    """
    low, high = windows(positive)
    n, k = positive.shape
    fresh = np.ones((n, k), bool)
    fresh[:, 1:] = high[:, 1:] != high[:, :-1]
    fresh &= high != T.LEAST
    slot = np.maximum(np.cumsum(fresh, 1) - 1, 0)
    ends = np.full((n, k + 1), T.LEAST)
    row, column = np.nonzero(fresh)
    ends[row, slot[row, column]] = high[row, column]
    lowest = low.min(1)
    begins = np.where(ends[:, 1:] != T.LEAST, ends[:, 1:] + 1, lowest[:, None])
    used = ends[:, :-1] != T.LEAST
    return np.where(used, np.maximum(begins, lowest[:, None]), T.MOST), np.where(used, ends[:, :-1], T.LEAST), slot


def mine(vectors: DataFrame, modulus: int = 50, positives: int = 5, negatives: int = 3, id_col: str = "vec_id",
         vector_col: str = "embedding", label=None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``modulus``; their positives are the ``positives`` best other rows of the
    same label, and for each positive the ``negatives`` best rows of another label whose score lies between 50 and 95
    percent of the positive's. Scores are integer inner products, higher first, ties to the smaller id. ``label`` is the
    label expression (column ``label`` by default).

    Rows with null id, label or vector, or a null or non-finite component take no part; vectors of different lengths
    are not compared. A positive of negative score has no window. Repeated rows are rows of their own. An anchor
    without positives or a window without rows gives no row, as does an empty table; other columns are ignored.
    """
    blocks = T.pack(vectors, id_col, vector_col, F.col("label") if label is None else label)
    tiles = T.query_tiles(blocks, modulus)

    def same(labels_of, rows, scores, own, ids, labels):
        return ((labels_of[rows, None] == labels) & ~own,)

    def between(shared, rows, scores, own, ids, labels):
        labels_of, low, high = shared
        other = labels_of[rows, None] != labels
        for s in range(positives):
            yield other & (scores >= low[rows, s, None]) & (scores <= high[rows, s, None])

    def limits(tile):
        return (np.frombuffer(tile["labels"], np.int64), *slots(T.unpack(tile["pos_scores"], positives))[:2])

    best = T.best_lists(tiles, blocks, positives, 1, lambda tile: np.frombuffer(tile["labels"], np.int64), same)
    tiles = T.cut_lineage(tiles.join(best.select("dim", "i", F.col("scores").alias("pos_scores"), F.col("ids").alias("pos_ids")), ["dim", "i"]))
    found = T.best_lists(tiles, blocks, negatives, positives, limits, between).withColumnRenamed("ids", "neg_ids")
    return tiles.join(found, ["dim", "i"]).select("ids", "pos_scores", "pos_ids", "scores", "neg_ids").mapInArrow(_triples(positives, negatives), TRIPLES)


def _triples(positives: int, negatives: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                anchors = np.frombuffer(row["ids"], np.int64)
                p_score, p_id = T.unpack(row["pos_scores"], positives), T.unpack(row["pos_ids"], positives)
                shape = (len(anchors), positives, negatives)
                score, found = (np.frombuffer(row[c], np.int64).reshape(shape).copy() for c in ("scores", "neg_ids"))
                for s in range(positives - 2, -1, -1):  # from the lowest slot upwards: the best of a slot and of all below
                    score[:, s], found[:, s] = T._merge([(score[:, s], found[:, s]), (score[:, s + 1], found[:, s + 1])])
                low, high = windows(p_score)
                _, _, slot = slots(p_score)
                at = np.arange(len(anchors))[:, None]
                score, found = score[at, slot], found[at, slot]
                there = (score != T.LEAST) & (score >= low[:, :, None]) & (score <= high[:, :, None])
                a, p, r = np.nonzero(there)
                yield pa.record_batch([pa.array(x) for x in (anchors[a], p_id[a, p], (r + 1).astype(np.int32), found[there], p_score[a, p], score[there])],
                                      [c.split()[0] for c in TRIPLES.split(", ")])
    return run
