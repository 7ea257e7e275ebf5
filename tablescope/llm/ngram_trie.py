"""Language-model scoring with an Elias-Fano n-gram trie (operator 10).

Words are shards by the top bits of their hashes. Level 1 of a shard holds its words (Elias-Fano sequence of the
hashes, so a word's number is its place) and their counts (monotone sums). Level 2 holds the successors of each
word: monotone pointers to the word's range, the successors relative to their context as one monotone sequence, and
the smoothed probability of each in a byte. Files are memory-mapped from the shared folder by the tasks that score.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm import elias_fano as E
from tablescope.llm import textnum as X
from tablescope.session import shared_folder

CHUNK = 1 << 22
#: Entries that a task gathers before it sends them on.
GATHER = 3_000_000
#: Tokens of the corpus per shard, roughly.
SHARD_TOKENS = 1 << 20
DISCOUNT = 0.75
#: Hash of the end of a text; it also is the context of the first word.
END = int(X.mix(np.array([0x656E64], np.uint64), 99)[0])
_BLOB = "shard int, keys binary, counts binary"


def _tokens(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words and the end of each text, tokens per text)."""
    h, doc = X.word_hashes(b, offsets)
    texts = len(offsets) - 1
    n = np.bincount(doc, minlength=texts) + 1
    out = np.empty(len(h) + texts, np.uint64)
    last = np.cumsum(n) - 1
    word = np.ones(len(out), bool)
    word[last] = False
    out[word] = h
    out[last] = END
    return out, n


def _send(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shards: int):
    """Counts of (shard, key) as one row per shard: keys as differences of the sorted ones."""
    shard, key, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((key, shard))
    shard, key, count = shard[order], key[order], count[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])
    begin = np.flatnonzero(new)
    shard, key, count = shard[begin], key[begin], np.add.reduceat(count, begin)
    edges = np.searchsorted(shard, np.arange(shards + 1))
    rows = [(s, np.diff(key[a:b], prepend=np.uint64(0)).tobytes(), count[a:b].astype(np.uint32).tobytes())
            for s, a, b in zip(range(shards), edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b > a]
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                            pa.array([r[2] for r in rows], pa.binary())], ["shard", "keys", "counts"])


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their total counts."""
    keys = np.concatenate([np.cumsum(np.frombuffer(k, np.uint64), dtype=np.uint64) for k in table["keys"].to_pylist()])
    counts = np.concatenate([np.frombuffer(c, np.uint32) for c in table["counts"].to_pylist()]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.add.reduceat(counts, begin)


def _counted(chunk_counts, shards: int):
    """A map over (text) batches that gathers (shard, key, count) of many chunks before sending."""
    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for _, _, b, offsets in X.chunks(batch.column(0), CHUNK):
                part = chunk_counts(b, offsets)
                parts.append(part)
                size += len(part[0])
                if size > GATHER:
                    yield _send(parts, shards)
                    parts, size = [], 0
        if parts:
            yield _send(parts, shards)
    return run


@dataclass(frozen=True)
class Trie:
    """What a task needs to find everything: the folder, and the first word number of each shard."""

    folder: str
    bits: int
    offsets: np.ndarray
    tokens: int
    order: int = 2

    @property
    def words(self) -> int:
        return int(self.offsets[-1])


class Reader:
    """Opened levels of a trie; files are mapped when first needed."""

    def __init__(self, trie: Trie):
        self.trie, self.known, self.files = trie, None, {}

    def level(self, kind: str, shard: int) -> dict:
        if (kind, shard) not in self.files:
            a = E.load(f"{self.trie.folder}/{kind}-{shard}")
            if kind == "words":
                self.files[kind, shard] = {k: E.Sequence.load({x: a[f"{k}.{x}"] for x in ("meta", "low", "high", "ones")}) for k in ("hash", "sum")}
            else:
                self.files[kind, shard] = {"code": a["code"], "book": a["book"]} | {
                    k: E.Sequence.load({x: a[f"{k}.{x}"] for x in ("meta", "low", "high", "ones")}) for k in ("pointer", "next")}
        return self.files[kind, shard]

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of sorted distinct hashes."""
        number, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        shards = 1 << self.trie.bits
        edge = np.searchsorted(_shard(h, self.trie.bits), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edge)).tolist():
            if self.trie.offsets[s + 1] == self.trie.offsets[s]:
                continue
            a, b = int(edge[s]), int(edge[s + 1])
            level = self.level("words", s)
            i = level["hash"].find(_within(h[a:b], self.trie.bits))
            ok = np.flatnonzero(i >= 0)
            number[a + ok] = i[ok] + self.trie.offsets[s]
            count[a + ok] = (level["sum"].access(i[ok] + 1) - level["sum"].access(i[ok])).astype(np.int64)
        return number, count

    def pairs(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability or nan, distinct successors of the context) of sorted pairs of known words."""
        p, kinds = np.full(len(context), np.nan), np.zeros(len(context), np.int64)
        offsets = self.trie.offsets
        shard = np.searchsorted(offsets, context, "right") - 1
        edge = np.searchsorted(shard, np.arange(len(offsets)))
        for s in np.flatnonzero(np.diff(edge)).tolist():
            a, b = int(edge[s]), int(edge[s + 1])
            level = self.level("pairs", s)
            c = context[a:b] - offsets[s]
            u, back = np.unique(c, return_inverse=True)
            kinds[a:b] = (level["pointer"].access(u + 1) - level["pointer"].access(u)).astype(np.int64)[back]
            i = level["next"].find(c.astype(np.uint64) * X.U64(self.trie.words) + word[a:b].astype(np.uint64))
            ok = np.flatnonzero(i >= 0)
            p[a + ok] = level["book"][level["code"][i[ok]]]
        return p, kinds


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> X.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _within(h: np.ndarray, bits: int) -> np.ndarray:
    return h & X.U64((1 << (64 - bits)) - 1)


def train(docs: DataFrame, text_col: str = "text") -> Trie:
    """Count all whole texts and write the levels to the shared folder; returns their small index.

    Null text is the empty text: it counts one end. Every count is exact; counting, sorting and encoding are spread over
    shards whose number follows the number of tokens, so no task holds more than its shard. A very frequent
    word's successors stay in one shard: they are distinct words, added up before they are sent.
    The index holds one number per shard. Without a row the trie is empty and ``score`` uses the smoothing alone.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/ngram-{uuid.uuid4().hex}"
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (size // 6 // SHARD_TOKENS).bit_length())
    shards = 1 << bits

    def unigrams(b, offsets):
        h, n = np.unique(_tokens(b, offsets)[0], return_counts=True)
        return _shard(h, bits), h, n

    def write_words(key, table):
        h, n = _received(table)
        s = key[0].as_py()
        total = int(n.sum())
        E.save(f"{folder}/words-{s}", {f"{k}.{x}": v for k, q in (
            ("hash", E.Sequence.encode(_within(h, bits), 1 << (64 - bits))),
            ("sum", E.Sequence.encode(X.counts_to_offsets(n), total + 1))) for x, v in q.arrays().items()})
        return pa.table({"shard": pa.array([s], pa.int32()), "words": [len(h)], "tokens": [total]})

    rows = texts.mapInArrow(_counted(unigrams, shards), _BLOB).groupBy("shard").applyInArrow(write_words, "shard int, words long, tokens long").collect()
    offsets = np.zeros(shards + 1, np.int64)
    for r in rows:
        offsets[r["shard"] + 1] = r["words"]
    trie = Trie(folder, bits, np.cumsum(offsets), sum(r["tokens"] for r in rows))

    opened: list[Reader] = []

    def reader() -> Reader:
        if not opened:
            opened.append(Reader(trie))
        return opened[0]

    def bigrams(b, offsets):
        h, n = _tokens(b, offsets)
        u, back = np.unique(h, return_inverse=True)
        number = reader().words(u)[0][back]
        before = _contexts(number, n, reader())
        shard = np.searchsorted(trie.offsets, before, "right") - 1
        local = before - trie.offsets[shard]
        return shard, (local.astype(np.uint64) << X.U64(32)) | number.astype(np.uint64), np.ones(len(h), np.int64)

    def write_pairs(key, table):
        keys, n = _received(table)
        s = key[0].as_py()
        context, word = (keys >> X.U64(32)).astype(np.int64), (keys & X.U64(0xFFFFFFFF)).astype(np.int64)
        count = int(trie.offsets[s + 1] - trie.offsets[s])
        kinds = np.bincount(context, minlength=count)
        total = np.bincount(context, n, minlength=count)
        # the base probability of each successor, from level 1 of all shards
        u, back = np.unique(word, return_inverse=True)
        base = (_counts_of(reader(), u)[back] + 1) / (trie.tokens + trie.words + 1)
        p = np.log10(np.maximum(n - DISCOUNT, 0) / total[context] + DISCOUNT * kinds[context] / total[context] * base)
        book = np.unique(np.quantile(p, np.linspace(0, 1, 256), method="lower"))
        code = (np.searchsorted(book, p, "right") - 1).astype(np.uint8)  # rounds down
        sequences = (("pointer", E.Sequence.encode(X.counts_to_offsets(kinds), len(keys) + 1)),
                     ("next", E.Sequence.encode(context.astype(np.uint64) * X.U64(trie.words) + word.astype(np.uint64), count * trie.words)))
        E.save(f"{folder}/pairs-{s}", {"code": code, "book": book} | {f"{k}.{x}": v for k, q in sequences for x, v in q.arrays().items()})
        return pa.table({"shard": pa.array([s], pa.int32()), "pairs": [len(keys)]})

    if trie.words:
        texts.mapInArrow(_counted(bigrams, shards), _BLOB).groupBy("shard").applyInArrow(write_pairs, "shard int, pairs long").collect()
    return trie


def _counts_of(reader: Reader, number: np.ndarray) -> np.ndarray:
    """Counts of sorted distinct word numbers."""
    offsets = reader.trie.offsets
    out = np.zeros(len(number), np.int64)
    edge = np.searchsorted(np.searchsorted(offsets, number, "right") - 1, np.arange(len(offsets)))
    for s in np.flatnonzero(np.diff(edge)).tolist():
        a, b = int(edge[s]), int(edge[s + 1])
        i, sums = number[a:b] - offsets[s], reader.level("words", s)["sum"]
        out[a:b] = (sums.access(i + 1) - sums.access(i)).astype(np.int64)
    return out


def _contexts(number: np.ndarray, n: np.ndarray, reader: Reader) -> np.ndarray:
    """The word before each token; the end's number before the first of a text."""
    end = int(reader.words(np.array([END], np.uint64))[0][0])
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[np.cumsum(n) - n] = end
    return before


def score(docs: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row, log10 over its words and its end.

    ``base_score`` adds ``log10((c + 1) / (N + V + 1))`` of the tokens; ``score`` is the model's: an interpolated bigram
    with absolute discount, the probabilities of seen pairs from the trie (a byte each, rounded down), of unseen
    pairs by the context's left-over mass, of unseen contexts the base. Null text is the empty text: its end
    alone. Repeated rows and null ids are scored like any other; an empty table gives no rows.
    """
    def run(batches):
        reader = Reader(trie)
        norm = np.log10(trie.tokens + trie.words + 1)
        for batch in batches:
            for first, last, b, offsets in X.chunks(batch.column(1), CHUNK):
                h, n = _tokens(b, offsets)
                owner = np.repeat(np.arange(last - first), n)
                u, back = np.unique(h, return_inverse=True)
                number, count = reader.words(u)
                word, c = number[back], count[back]
                base = np.log10(c + 1.0) - norm
                p = base.copy()
                if trie.words:
                    before = _contexts(word, n, reader)
                    known = np.flatnonzero(before >= 0)
                    by_number = np.argsort(number, kind="stable")
                    key = before[known] * (trie.words + 1) + word[known] + 1  # 0: unknown word
                    pairs, where = np.unique(key, return_inverse=True)
                    context, after = pairs // (trie.words + 1), pairs % (trie.words + 1) - 1
                    seen, kinds = reader.pairs(context, np.maximum(after, 0))
                    seen[after < 0] = np.nan
                    total = _total(reader, context, number, count, by_number)
                    rest = np.log10(np.maximum(DISCOUNT * kinds / total, 1e-300))
                    p[known] = np.where(np.isnan(seen[where]), rest[where] + base[known], seen[where])
                rows = last - first
                yield pa.record_batch([
                    batch.column(0).slice(first, rows), pa.array(n.astype(np.int64)), pa.array(np.bincount(owner, c > 0, rows).astype(np.int64)),
                    pa.array(np.bincount(owner, base, rows)), pa.array(np.bincount(owner, p, rows))],
                    ["id", "n_tokens", "n_known", "base_score", "score"])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")


def _total(reader: Reader, context: np.ndarray, number: np.ndarray, count: np.ndarray, by_number: np.ndarray) -> np.ndarray:
    """Counts of the contexts; all but the end are words of the chunk."""
    order = number[by_number]
    at = np.minimum(np.searchsorted(order, context), len(order) - 1)
    return np.maximum(np.where(order[at] == context, count[by_number][at], 1), 1)
