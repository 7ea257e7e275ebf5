import random

import numpy as np

from tablescope.llm import partenum as P


def shingles(text, k):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(docs, k, percent):
    sets = [(i, shingles(t, k)) for i, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    group = {}
    for x, (i, _) in enumerate(sets):
        group.setdefault(find(x), []).append(i)
    return {i: (len(s), min(group[find(x)])) for x, (i, s) in enumerate(sets)}


def family(rng, words, edits, copies):
    base = [rng.choice("the of and ing er st ti on".split()) + str(rng.randint(0, 300)) for _ in range(words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    texts = family(rng, 150, 6, 90) + family(rng, 30, 3, 60) + family(rng, 12, 2, 40) + family(rng, 700, 30, 30) + family(rng, 5, 1, 20)
    texts += ["", None, " \t\n", "one", "One", "one two three", "ONE two three", "a b c d", "É b c d", "é b c d"]
    texts += texts[:5] + [texts[0].upper()]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = [(i, texts[j]) for i, j in enumerate(order)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    for k, percent in ((4, 85), (5, 80)):
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in P.similarity_components(df, k=k, percent=percent).collect()}
        assert got == brute(docs, k, percent)


def test_a_similar_pair_shares_a_signature():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9, 20, 60, 150, 400):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
            drop = rng.integers(0, 15 * n // 100 + 1)
            b = np.sort(np.concatenate([a[drop:], rng.integers(0, 1 << 62, rng.integers(0, 3), dtype=np.uint64)]))
            same = len(np.intersect1d(a, b))
            if not len(b) or 100 * same < 85 * (len(a) + len(b) - same):
                continue
            sig, owner = P.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), 85)
            assert set(sig[owner == 0]) & set(sig[owner == 1]), (n, drop)


def test_null_ids_repeated_rows_clashing_columns_and_empty(spark):
    t = "some words of a text that are said again and again"
    rows = [(None, t, 1), (7, t, 2), (7, t, 2), (None, "other words", 3), (9, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, v int")
    got = sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in P.similarity_components(df).collect()), key=str)
    assert got == sorted([(None, 7, 7), (7, 7, 7), (7, 7, 7), (None, 1, None), (9, 0, 9)], key=str)
    assert P.similarity_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_unlike_sets_with_common_elements_meet_in_many_cells(spark, monkeypatch):
    """Hundreds of sets share most signatures but few are similar: small cells lose no link between components."""
    monkeypatch.setattr(P, "CELL_SETS", 16)
    rng = random.Random(6)
    common = " ".join(f"c{i}" for i in range(12))
    texts = [common + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(18)) for _ in range(150)]
    base = [f"b{i}" for i in range(60)]
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        texts.append(" ".join(w))
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in P.similarity_components(spark.createDataFrame(docs, "doc_id long, text string"), k=3, percent=70).collect()}
    assert got == brute(docs, 3, 70)


def test_overlaps_and_spanning_links():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(300)]
    owner = np.repeat(np.arange(300), [len(x) for x in sets])
    out = P._overlaps(owner, np.concatenate(sets), 120, 180)
    assert all(out[i, j] == len(np.intersect1d(sets[i], sets[120 + j])) for i in range(120) for j in range(180))
    row, column = rng.integers(0, 200, 260), rng.integers(0, 200, 260)
    label = rng.integers(0, 190, 200)
    keep = P._spanning(row, column, label)

    def parts(links):
        lab = list(label)
        for _ in range(200):
            for x, y in links:
                low, high = sorted((lab[x], lab[y]))
                lab = [low if v == high else v for v in lab]
        return [lab.index(v) for v in lab]
    assert parts(list(zip(row, column, strict=True))) == parts(list(zip(row[keep], column[keep], strict=True))) and len(set(keep.tolist())) == len(keep) < 190
