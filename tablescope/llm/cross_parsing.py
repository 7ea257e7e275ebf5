"""Language identification by cross-parsing entropy (operator 4).

The labelled text of each language becomes a suffix automaton. A text is parsed greedily into the longest phrases that
occur in that text; few phrases mean the same language. Phrases are charged log2 of the sample's length, per
letter of the text, so samples of different lengths compare; the language with the least charge wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablescope.session import cut_lineage

#: Characters of a segment: texts are parsed in segments side by side; a phrase ends with its segment.
SEGMENT = 512
#: Segments parsed at once.
LANES = 4096


def _letters(text: str) -> np.ndarray:
    """Lower-cased code points; every run of other characters becomes one space."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[code]
    out = np.where(letter, code, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return out[keep]


_LETTER: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


@dataclass(frozen=True)
class LanguageModel:
    """All automata in one table: ``step[state, symbol]`` is the next state, negative where the phrase ends."""

    languages: list[str]
    symbols: np.ndarray  # code point -> symbol; 0 is unknown
    step: np.ndarray
    roots: np.ndarray
    cost: np.ndarray  # log2 of the sample lengths


def _automaton(text: np.ndarray, symbols: int) -> np.ndarray:
    """Transition table of the suffix automaton of a symbol sequence; state 0 is the root, -1 no transition."""
    step = np.full((2 * len(text) + 2, symbols), -1, np.int32)
    link, length = [-1], [0]
    rows: list[dict[int, int]] = [{}]
    last = 0
    for ch in text.tolist():
        cur = len(rows)
        rows.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in rows[p]:
            rows[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = rows[p][ch]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(rows)
                rows.append(dict(rows[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and rows[p].get(ch) == q:
                    rows[p][ch] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    for i, row in enumerate(rows):
        for ch, to in row.items():
            step[i, ch] = to
    return step[:len(rows)]


def fit(samples: dict[str, list[str]], characters: int) -> LanguageModel:
    """Automata of the first ``characters`` letters of each language's texts; texts are separated by unknown symbols."""
    joined = {}
    for lang, texts in samples.items():
        parts, n = [], 0
        for t in texts:
            x = _letters(t)[:characters - n]
            parts += [x, np.zeros(1, np.uint32)]
            n += len(x)
            if n >= characters:
                break
        joined[lang] = np.concatenate(parts) if parts else np.zeros(1, np.uint32)
    languages = sorted(joined)
    known = np.unique(np.concatenate([joined[x] for x in languages])) if languages else np.zeros(0, np.uint32)
    known = known[known > 0]
    symbols = np.zeros(0x110000, np.uint16)
    symbols[known] = np.arange(1, len(known) + 1)
    tables, roots, at = [], [], 0
    for lang in languages:
        # symbol 0 separates the sample texts; an unknown letter of a scored text must not match it
        table = _automaton(symbols[joined[lang]], len(known) + 1)
        table[:, 0] = -1
        tables.append(np.where(table >= 0, table + at, -1))
        roots.append(at)
        at += len(table)
    step = np.concatenate(tables).astype(np.int32) if tables else np.zeros((0, len(known) + 1), np.int32)
    cost = np.array([np.log2(max(2, len(joined[x]))) for x in languages])
    return LanguageModel(languages, symbols, step, np.array(roots, np.int64), cost)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", characters: int = 40_000, texts: int = 400) -> LanguageModel:
    """Learn from at most ``texts`` distinct texts and ``characters`` letters of every non-null language.

    Of each language the distinct texts with the smallest hashes are taken, exactly, and all of them where there are
    fewer; copies count once. Both bounds are per language, so the model stays small however long the table is; a
    language with a single text is learned from it, however many copies it has. Null texts and texts without a letter
    teach nothing. The number of languages bounds what reaches the driver: of each about ``texts`` hashes and texts.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.substring(F.col(text_col), 1, characters).alias("t")).where(
        F.col("t").rlike(r"\p{L}"))
    hashes = cut_lineage(rows.select("lang", "h").distinct())
    counts = {r["lang"]: r["n"] for r in hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen: list[tuple[str, int]] = []
    # hashes below the share that holds about the wanted texts replace sorting; where it holds too few, it is doubled
    share = {lang: min(1.0, (texts + 4 * texts**0.5) / n) for lang, n in counts.items()}
    while share:
        edge = F.create_map(*[x for lang, part in share.items() for x in (
            F.lit(lang), F.lit(min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * part))))])
        found: dict[str, list[int]] = {}
        for r in hashes.where(F.col("h") <= F.element_at(edge, F.col("lang"))).collect():
            found.setdefault(r["lang"], []).append(r["h"])
        full = {lang for lang in share if len(found.get(lang, ())) >= min(texts, counts[lang])}
        chosen += [(lang, h) for lang in full for h in sorted(found[lang])[:texts]]
        share = {lang: min(1.0, 2 * part) for lang, part in share.items() if lang not in full}
    if not chosen:
        return fit({}, characters)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            new = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
            if new:
                yield batch.take(pa.array(new, pa.int32()))

    wanted = docs.sparkSession.createDataFrame(chosen, StructType([rows.schema["lang"], rows.schema["h"]]))
    # copies of a chosen text are dropped in the task that reads them
    near = rows.join(F.broadcast(wanted), ["lang", "h"], "left_semi").select("lang", "h", "t").mapInArrow(once, rows.schema)
    samples: dict[str, list[tuple[int, str]]] = {}
    for r in near.groupBy("lang", "h").agg(F.min("t").alias("t")).toLocalIterator():
        samples.setdefault(r["lang"], []).append((r["h"], r["t"]))
    return fit({lang: [t for _, t in sorted(v)] for lang, v in samples.items()}, characters)


def parse(lengths: np.ndarray, symbols: np.ndarray, model: LanguageModel) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns); texts are symbol runs laid one after another."""
    texts = len(lengths)
    count = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(texts), count)
    number = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(lengths) - lengths, count) + number * SEGMENT
    size = np.minimum(SEGMENT, lengths[owner] - number * SEGMENT)
    order = np.argsort(-size, kind="stable")
    start, size, owner = start[order], size[order], owner[order]
    flat, width = model.step.ravel(), model.step.shape[1]
    out = np.zeros((texts, len(model.languages)))
    for a in range(0, len(start), LANES):
        s, n = start[a:a + LANES], size[a:a + LANES]
        state = np.repeat(model.roots[:, None], len(s), 1)
        phrases = np.zeros(state.shape, np.int32)
        for t in range(int(n[0])):
            live = int(np.searchsorted(-n, -t, "left"))  # segments are sorted by falling size
            ch = symbols[s[:live] + t].astype(np.int64)
            to = flat[state[:, :live] * width + ch]
            ends = to < 0
            phrases[:, :live] += ends
            again = flat[model.roots[:, None] * width + ch]
            again = np.where(again < 0, model.roots[:, None], again)
            state[:, :live] = np.where(ends, again, to)
        phrases += 1
        for k in range(len(model.languages)):
            out[:, k] += np.bincount(owner[a:a + LANES], phrases[k], texts)
    return out


def predict(text: Column, model: LanguageModel, spark) -> Column:
    """struct(lang_pred, score): score is the share of the winner when charges are turned into odds, 0 to 1.

    Null text and text without a letter, or a model without languages: ``und`` with score 0. Ties go to the
    language that sorts first. The model is bounded by its training limits and sent to every executor.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in parts:
            found: list[tuple[str, float]] = []
            group: list[np.ndarray] = []
            waiting = 0

            def flush(group):
                n = np.array([len(x) for x in group], np.int64)
                if not m.languages or not n.sum():
                    return [("und", 0.0)] * len(group)
                charge = parse(n, m.symbols[np.concatenate(group)], m) * m.cost / np.maximum(n, 1)[:, None]
                odds = 1 / np.maximum(charge, 1e-9) ** 4
                share = odds / odds.sum(1, keepdims=True)
                return [(m.languages[k], float(p[k])) if size else ("und", 0.0)
                        for k, p, size in zip(charge.argmin(1).tolist(), share, n.tolist(), strict=True)]
            for t in texts:
                x = _letters(t) if t else np.zeros(0, np.uint32)
                if len(x) and not (x != 32).any():
                    x = x[:0]
                group.append(x)
                waiting += len(x)
                if waiting >= LANES * SEGMENT:
                    found += flush(group)
                    group, waiting = [], 0
            if group:
                found += flush(group)
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return F.pandas_udf(run, "lang_pred string, score double")(text)
