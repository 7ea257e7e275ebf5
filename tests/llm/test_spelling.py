import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tablescope.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n int, form string"


def brute_counts(docs, least_length=6, least_n=5, every=199):
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(str.maketrans(S.UPPER, S.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            seen[w] += 1
    return {w: n for w, n in seen.items() if len(w) >= least_length and n >= least_n}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1:] for k in range(len(b)))


def brute(counts, factor=5):
    form, near = {}, {}
    for w in counts:
        found = [v for v in counts if one_edit(w, v)]
        near[w] = len(found)
        top = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top is not None and counts[top] >= factor * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], near[w], counts[form[w]] if form[w] else None))
    return sorted(out)


def vocabulary(rng, n):
    letters = "abcdeéÿlmnrst"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(n)}
    for w in list(words):
        for _ in range(3):
            k = rng.randrange(len(w))
            words.add(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]]))
    return sorted(words)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()))


def test_whole_job_equals_brute_force(spark):
    rng = random.Random(4)
    words = vocabulary(rng, 90)
    weight = [rng.choice([1, 6, 6, 40, 220]) for _ in words]
    docs = []
    for i in range(400):
        picked = rng.choices(words, weight, k=60)
        docs.append((i, rng.choice([" ", ", ", "\n", "1", "'"]).join(w.capitalize() if rng.random() < 0.2 else w for w in picked)))
    docs += [(None, " ".join(words[:30] * 5)), (7, None), (8, ""), (9, "short ab 123 中文"), (9, docs[9][1]), (9, docs[9][1])]
    docs.append((10, "Étranger " * 6 + "étranger " * 40 + "x" * 3000 + " " + ("y" * 2000 + " ") * 6))
    df = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in docs], SCHEMA).repartition(4)
    counts = brute_counts(docs)
    assert {r["word"]: r["n"] for r in S.word_counts(df).collect()} == counts
    got, want = tuples(S.variants(S.word_counts(df))), brute(counts)
    assert got == want
    assert sum(r[1] is not None for r in got) > 20 and any(r[2] not in (r[0], r[1]) for r in got)


def test_chain_of_forms_and_ties(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "zaaaaa": 25, "aaaaaÿ": 24, "qwertz": 5}
    rows = [(w, n) for w, n in counts.items()]
    got = tuples(S.variants(spark.createDataFrame(rows, "word string, n long")))
    assert got == brute(counts)
    by = {r[0]: r for r in got}
    assert by["aaaaaa"][1:3] == ("aaaaab", "aaabbb") and by["qwertz"][1:] == (None, "qwertz", 5, 0, None)


def test_many_blocks_lose_no_pair(spark):
    """Thousands of words of one length: block ranges rule out some pairs of blocks, never a near pair."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("aeioulrstdcmxyz") for _ in range(rng.choice([6, 7, 7, 7]))) for _ in range(7000)})
    df = spark.createDataFrame([(w, 5 + k % 9) for k, w in enumerate(words)], "word string, n long").repartition(3)
    got = {(r["word"], r["near"]) for r in S.near_words(df).collect()}
    known, want = set(words), set()
    for w in words:
        for k in range(len(w)):
            for v in {w[:k] + w[k + 1:], *(w[:k] + c + w[k + 1:] for c in "aeioulrstdcmxyz")}:
                if v in known and v != w:
                    want |= {(w, v), (v, w)}
    assert got == want


@pytest.mark.parametrize("grow", [0, 1])
def test_pairs_of_one_edit(grow):
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(97, 100, (80, 6)), axis=0).astype(np.uint32)
    b = np.unique(rng.integers(97, 100, (120, 6 + grow)), axis=0).astype(np.uint32)
    i, j = S.near_pairs(a, b)
    text = [["".join(map(chr, r)) for r in m] for m in (a, b)]
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for x, v in enumerate(text[0]) for y, w in enumerate(text[1]) if one_edit(v, w)}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.variants(S.word_counts(empty)).count() == 0
