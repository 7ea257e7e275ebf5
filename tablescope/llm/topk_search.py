"""Exact top-k search by tiled matrix products (operator 13)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablescope.llm import tiles as T

HITS = "query_id long, rank int, vec_id long, score long"


def search(vectors: DataFrame, modulus: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of every query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``modulus``, candidates are all rows but the query's own. Query tiles
    meet candidate shards in cells, each leaves k entries a query, and cells are merged in a tree.

    Rows with null id, null vector, or a null or non-finite component take no part; vectors of different lengths are not
    compared (an empty vector scores 0 with other empty ones). Repeated rows are rows of their own: each is a query, and
    a candidate of the other. Fewer candidates than ``k``: all. An empty table gives no rows; other columns are ignored.
    """
    blocks = T.pack(vectors, id_col, vector_col)
    tiles = T.query_tiles(blocks, modulus)
    best = T.best_lists(tiles, blocks, k, 1, lambda tile: None, lambda shared, rows, scores, own, ids, labels: (~own,))
    return tiles.join(best.withColumnRenamed("ids", "found"), ["dim", "i"]).select("ids", "scores", "found").mapInArrow(_hits(k), HITS)


def _hits(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, scores, found = np.frombuffer(row["ids"], np.int64), T.unpack(row["scores"], k), T.unpack(row["found"], k)
                there = scores != T.LEAST
                rank = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), there.shape)
                yield pa.record_batch([pa.array(x) for x in (np.repeat(ids, there.sum(1)), rank[there], found[there], scores[there])],
                                      ["query_id", "rank", "vec_id", "score"])
    return run
