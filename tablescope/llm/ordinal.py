"""Ordinal cumulative-link regression on hashed text (operator 6).

``P(grade <= j | x) = sigmoid(t_j - w.x)``: one weight vector for all grades and ordered thresholds t_j. Features
are hashed lower-cased words, their first letters and runs of signs, each counted once per text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.textnum import release
from tablescope.session import cut_lineage

TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")


def _slots(word: str, size: int) -> tuple[int, ...]:
    """Feature slots of one token; slot 0 is the intercept's and stays unused."""
    data = word.encode("utf-8", "surrogatepass")
    out = [zlib.crc32(data) % (size - 1) + 1]
    if word[0].isalpha() and len(word) >= 5:
        out += [zlib.crc32(b"^" + word[:k].encode("utf-8", "surrogatepass"), k) % (size - 1) + 1 for k in (4, 5)]
    return tuple(out)


def _tokens(text: str) -> set[str]:
    found = TOKEN.findall(text.lower())
    out = set(found)
    if found:
        # shape of the text as tokens of its own: share of repeated neighbours and of signs, in steps
        same = sum(a == b for a, b in zip(found, found[1:], strict=False))
        out.add(f"\x01repeat{min(9, 10 * same // len(found))}")
        upper = sum(map(str.isupper, text))
        out.add(f"\x01upper{min(9, 10 * upper // len(text))}")
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by slot and increasing thresholds between the grades 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray


def telling(counts: np.ndarray, grades: np.ndarray, least: int = 6, chi2: float = 24.0) -> np.ndarray:
    """Slots worth a weight, from ``counts`` (slots x grades) and the rows of each grade.

    Only slots seen in ``least`` rows whose grades differ from the whole by a chi-square of ``chi2`` get a
    weight: in long texts thousands of chance weights would drown the few words that matter.
    """
    n = counts.sum(1, keepdims=True)
    expected = n * (grades / max(1, grades.sum()))
    test = ((counts - expected) ** 2 / np.maximum(expected, 1e-9)).sum(1)
    return np.flatnonzero((n[:, 0] >= least) & (test >= chi2))


def fit(y: np.ndarray, owner: np.ndarray, slots: np.ndarray, grades: int, size: int, rounds: int = 250, decay: float = 3e-5) -> OrdinalModel:
    """Full-batch Adam on the log likelihood of the grades ``y``; entry k says that row ``owner[k]`` has feature ``slots[k]``.

    Thresholds stay ordered by construction.
    """
    share = np.bincount(y, minlength=grades) / max(1, len(y))
    used, column = np.unique(slots, return_inverse=True)
    row_weight = 1 / max(1, len(y))
    below = np.clip(np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    t0 = np.log(below / (1 - below))
    gap = np.log(np.maximum(np.diff(t0), 0.1))
    theta = np.concatenate([np.zeros(len(used)), t0[:1], gap])
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    for step in range(1, rounds + 1):
        w, t = theta[:len(used)], np.concatenate([theta[len(used):len(used) + 1], np.exp(theta[len(used) + 1:])]).cumsum()
        z = np.bincount(owner, w[column], len(y))
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        hi, lo = sigmoid(edge[y + 1] - z), sigmoid(edge[y] - z)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        dz = (dhi - dlo) / p * row_weight
        gt = np.zeros(len(t))
        np.add.at(gt, np.minimum(y, len(t) - 1), np.where(y < len(t), -dhi / p * row_weight, 0))
        np.add.at(gt, np.maximum(y - 1, 0), np.where(y > 0, dlo / p * row_weight, 0))
        tail = gt[::-1].cumsum()[::-1]
        g = np.concatenate([np.bincount(column, dz[owner], len(used)) + decay * w, tail[:1], tail[1:] * np.exp(theta[len(used) + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(size, np.float32)
    weights[used] = theta[:len(used)]
    return OrdinalModel(weights, np.concatenate([theta[len(used):len(used) + 1], np.exp(theta[len(used) + 1:])]).cumsum())


def grades_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade) from ``quality`` and ``toxic``: 0 toxic, 1 low quality, 2 good.

    Rows without id or without either label are left out; of repeated ids the worst label counts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return known.select("id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, text_col: str = "text", id_col: str = "doc_id", grades: int = 3,
          size: int = 1 << 18, max_rows: int = 12_000) -> OrdinalModel:
    """Fit on about ``max_rows`` rated documents: those whose hashed ids are the smallest.

    ``ratings`` has (id, grade). Training rows enter with all tokens of their whole texts; Spark counts slots by grade, and
    only slots that tell grades apart reach the driver: at most ``size`` of them, in ``max_rows`` rows. Rows with null
    grade or text are left out; of an id that occurs in several documents the text of the smallest hash counts. Without rows
    the model knows nothing and gives every text the same probabilities.
    """
    rated = ratings.where(F.col("id").isNotNull() & F.col("grade").between(0, grades - 1))
    n = rated.count()
    if n > max_rows:
        rated = rated.where(F.xxhash64("id") < -(1 << 63) + int((1 << 64) * max_rows / n))
    # about max_rows (id, grade) pairs: small enough for every executor
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(rated), "id")

    def slots(batches):
        for pdf in batches:
            out = [np.unique([s for w in _tokens(text) for s in _slots(w, size)]).astype(np.int32) for text in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "grade": pdf["grade"], "h": pdf["h"], "slots": out})
        release()

    kind = rows.schema["id"].dataType.simpleString()
    got = (rows.select("id", "grade", F.sha2("text", 256).alias("h"), "text").mapInPandas(slots, f"id {kind}, grade int, h string, slots array<int>")
           .groupBy("id").agg(F.min_by(F.struct("grade", "slots"), "h").alias("row")).select("row.*"))
    got = cut_lineage(got)
    by_grade = np.zeros(grades)
    for r in got.groupBy("grade").count().collect():
        by_grade[r["grade"]] = r["count"]
    table = got.select("grade", F.explode("slots").alias("slot")).groupBy("slot", "grade").count().toArrow()
    counts = np.zeros((size, grades), np.int32)
    counts[table["slot"].to_numpy(), table["grade"].to_numpy()] = table["count"].to_numpy()
    chosen = telling(counts, by_grade)
    del table, counts
    keep = got.sparkSession.sparkContext.broadcast(chosen.astype(np.int32))

    def telling_slots(batches):
        for batch in batches:
            lists = batch.column(1)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            take = np.isin(values, keep.value)
            take[:offsets[0]] = take[offsets[-1]:] = False
            new = np.concatenate([[0], np.cumsum(take)])[offsets]
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array((new - new[0]).astype(np.int32)), pa.array(values[take]))], ["grade", "slots"])

    few = got.select("grade", "slots").mapInArrow(telling_slots, "grade int, slots array<int>").toArrow().combine_chunks()
    lists = few["slots"].combine_chunks() if few.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    owner = np.repeat(np.arange(few.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    return fit(few["grade"].to_numpy().astype(np.int64), owner, lists.flatten().to_numpy(), grades, size)


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """``docs`` and the columns expected_grade and tail (probability of the highest grade).

    Null or empty text has no features: it gets the model's middle values. An existing column of one of
    these names is replaced. The model is sent to every executor: 4 bytes a slot, a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    size = len(model.weights)

    return _with_probabilities(docs, _iter_udf(shared, size)(F.col(text_col)), model)


def _iter_udf(shared, size):
    def logit(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, _ = shared.value
        known: dict[str, float] = {}
        for texts in parts:
            out = np.zeros(len(texts))
            for i, text in enumerate(texts):
                if not text:
                    continue
                z = 0.0
                for w in _tokens(text):
                    x = known.get(w)
                    if x is None:
                        x = known[w] = float(sum(weights[s] for s in _slots(w, size)))
                    z += x
                out[i] = z
                if len(known) > 100_000:
                    known.clear()
            yield pd.Series(out)
        known.clear()
        release()

    return F.pandas_udf(logit, "double")


def _with_probabilities(docs: DataFrame, z, model: OrdinalModel) -> DataFrame:
    above = [1 / (1 + F.exp(F.lit(float(t)) - F.col("_z"))) for t in model.thresholds]
    return docs.withColumn("_z", z).withColumns({
        "expected_grade": sum(above[1:], above[0]), "tail": above[-1]}).drop("_z")
