"""Packing by power-of-two decomposition (operator 8).

A text's ids are cut into pieces whose lengths are powers of two, at most ``length``: as many full pieces as
fit, then the binary digits of the rest, longest first. Every piece is a sequence of its own, and sequences
of one length form a bucket (``bucket`` = log2 of the length), so batches of equal length need no padding,
and no sequence crosses documents.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm import textnum as X

#: Texts per chunk, in characters; pretokens repeated in a chunk are encoded once.
CHARACTERS = 1 << 20
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point under the split pattern of byte-level BPE: letter, number, white space, other."""
    every = np.arange(0x110000, dtype=np.uint32)
    every[0xD800:0xE000] = 0x40  # surrogates never occur in a text
    text = every.tobytes().decode("utf-32-le")
    out = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[m.start():m.end()] = kind
    return out


@lru_cache(maxsize=2)
def _encoder(path: str):
    """(encoder of one text, cache) for a byte-level BPE file of the tokenizers library.

    The vocabulary lists merges in the order of their ids, so the ids are the ranks of a byte-pair
    encoding; ``tiktoken`` encodes with them several times faster. Equality is tested against the library.
    """
    import tiktoken
    from tokenizers import pre_tokenizers

    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet(), key=ord)
    visible = {chr(i): i for i in range(256) if chr(i) in alphabet}
    hidden = iter(c for c in alphabet if c not in visible)
    for i in range(256):
        if chr(i) not in visible:
            visible[next(hidden)] = i
    vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    ranks = {bytes(visible[c] for c in token): i for token, i in vocabulary.items() if all(c in visible for c in token)}
    ranks = {token: i for token, i in ranks.items() if not (token.startswith(b"<|") and token.endswith(b"|>"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def _added(path: str) -> regex.Pattern | None:
    """Pattern of the file's added tokens."""
    added = sorted((t["content"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, added))) if added else None


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The library's tokenizer, loaded only where a text holds an added token."""
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def _pretokens(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First characters of the pretokens of texts without apostrophes laid one after another."""
    n = len(code)
    kind = _classes()[code]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    cut = np.ones(n, bool)
    cut[1:] = kind[1:] != kind[:-1]
    cut |= first[:n]
    space = kind == SPACE
    last = np.ones(n, bool)  # of its text
    last[:-1] = first[1:n]
    more = np.zeros(n, bool)  # a non-space of the same text follows
    more[:-1] = ~space[1:]
    more &= ~last
    final = space & more  # last white space of a run before a word
    blank = final & (code == 32)
    cut |= final
    after = np.zeros(n, bool)
    after[1:] = blank[:-1]
    cut &= ~after
    return np.flatnonzero(cut)


def encode(texts: list[str], path: str, end_id: int | None, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, number of ids of each).

    With ``added`` a text that contains an added token of the file goes through the library in its default setting.
    """
    encoder = _encoder(path)
    n = np.zeros(len(texts), np.int64)
    slow = {}
    if added:
        pattern = _added(path)
        slow = {i: _tokenizer(path).encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if pattern and pattern.search(t)}
    slow |= {i: encoder(t) for i, t in enumerate(texts) if i not in slow and ("'" in t or len(t) >= 1 << 22)}
    fast = [i for i, t in enumerate(texts) if t and i not in slow]
    parts: list[np.ndarray] = []
    flat, flat_offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)
    if fast:
        joined = "".join(texts[i] for i in fast)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(texts[i]) for i in fast), np.int64, len(fast))
        offsets = X.counts_to_offsets(lengths)
        start = _pretokens(code, offsets[:-1])
        end = np.append(start[1:], len(code))
        p, inv = X.powers(len(code) + 1)
        prefix = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(X.mix(code.astype(np.uint64), 21) * p[:len(code)], out=prefix[1:])
        h = X.mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64), 22)
        which, _ = pd.factorize(h)
        _, where = np.unique(which, return_index=True)
        pieces = [encoder(joined[a:b]) for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        pool = np.fromiter((x for y in pieces for x in y), np.uint32, int(size.sum()))
        length = size[which]
        flat = pool[X.ragged((np.cumsum(size) - size)[which], length)]
        owner = np.searchsorted(offsets, start, "right") - 1
        per_text = np.bincount(owner, length, len(fast)).astype(np.int64)
        flat_offsets = X.counts_to_offsets(per_text)
        n[fast] = per_text
    tail = [] if end_id is None else [end_id]
    position = {i: k for k, i in enumerate(fast)}
    for i in range(len(texts)):
        if i in slow:
            parts.append(np.array(slow[i], np.uint32))
            n[i] = len(slow[i])
        elif i in position:
            k = position[i]
            parts.append(flat[flat_offsets[k]:flat_offsets[k + 1]])
        parts.append(np.array(tail, np.uint32))
    return np.concatenate(parts) if parts else flat, n + len(tail)


def cut(n: int, length: int) -> list[int]:
    """Piece lengths of a text of n ids: full pieces, then the binary digits of the rest."""
    full, rest = divmod(n, length)
    return [length] * full + [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]


def _groups(texts: list[str]):
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHARACTERS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _pieces(path: str, end_id: int | None, length: int, added: bool):
    def run(batches):
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _groups(texts):
                ids, n = encode(texts[a:b], path, end_id, added)
                cuts = [cut(x, length) for x in n.tolist()]
                count = np.fromiter(map(len, cuts), np.int64, len(cuts))
                size = np.fromiter((x for c in cuts for x in c), np.int64, int(count.sum()))
                at = X.counts_to_offsets(size)
                owner = np.repeat(np.arange(b - a), count)
                text_start = X.counts_to_offsets(n)[:-1]
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [
                    None, pa.py_buffer(at * 4), pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())
                yield pa.record_batch([
                    batch.column(0).slice(a, b - a).take(pa.array(owner)), pa.array(at[:-1] - text_start[owner]), pa.array(size),
                    pa.array(n[owner]), pa.array(np.log2(np.maximum(size, 1)).astype(np.int32)),
                    pa.array(number + np.arange(len(size))), blob],
                    ["id", "start", "length", "doc_tokens", "bucket", "sequence_id", "ids"])
                number += len(size)
            del texts
            X.release()
    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048,
         end_id: int | None = None, added: bool = False) -> DataFrame:
    """One row per piece: (id, start, length, doc_tokens, bucket, sequence_id, offset, ids).

    ``ids`` are little-endian unsigned 32-bit numbers; ``start`` is the number of the text's ids before the
    piece; ``bucket`` is log2 of the length; ``offset`` is the piece's place in its sequence, always 0.
    ``sequence_id`` is the input partition and a running number in it, so it is unique and the same when a
    lost task runs again. ``length`` must be a power of two. ``end_id`` closes every text. With ``added`` the file's added
    tokens are matched inside texts, as the library does by default; without it they are plain text.

    Null text is the empty text: its only piece is the end id (none without ``end_id``). Repeated rows and
    null ids are packed like any other. Other columns are ignored; an empty table gives no rows.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_pieces(path, end_id, length, added),
                           f"id {kind}, start long, length long, doc_tokens long, bucket int, sequence_id long, ids binary").select(
        "id", "start", "length", "doc_tokens", "bucket", "sequence_id", F.lit(0).cast("long").alias("offset"), "ids")


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Pieces as Parquet, one folder per bucket."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(folder)
