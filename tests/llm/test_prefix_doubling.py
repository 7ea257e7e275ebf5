import hashlib
import random

from pyspark.sql import functions as F

from tablescope.llm.prefix_doubling import cut_texts, kept_bytes, repeated_spans

L = 100


def brute(docs):
    """Spans by a dictionary of every window, documents in order."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        b, covered = (text or "").encode(), []
        for s in range(len(b) - L + 1):
            w = b[s:s + L]
            if w in seen:
                if covered and s <= covered[-1][1]:
                    covered[-1][1] = s + L
                else:
                    covered.append([s, s + L])
            seen.add(w)
        out[i] = [tuple(c) for c in covered]
    return out


def sample():
    rng = random.Random(5)

    def words(n):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passage, base = words(60), words(400)
    docs = [(1, base), (2, base), (3, base[:700] + "x" + base[700:]), (4, passage), (5, words(30) + passage + words(25)),
            (6, words(9) + passage[:150] + words(4) + passage[120:] + words(3)), (7, "ab" * 300), (8, "z" * 500), (9, "z" * 99), (10, None), (11, ""),
            (12, base[50:149] + "#" + base[300:400]), (13, words(2000) + base + words(10) + passage)]
    docs += [(100 + i, words(3) + passage[i:i + 180] + base[7 * i:7 * i + 130] + words(5)) for i in range(20)]
    return docs


def spans(df):
    return {r["id"]: [(s["lo"], s["hi"]) for s in r["spans"]] for r in df.collect()}


def test_equals_brute_force(spark):
    docs = sample()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert spans(repeated_spans(df)) == brute(docs)


def test_kept_bytes(spark):
    docs = sample()
    out = repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r["id"]: r["h"] for r in out.select("id", F.sha2(kept_bytes(F.col("text"), F.col("spans")), 256).alias("h")).collect()}
    for i, text in docs:
        b, at, keep = (text or "").encode(), 0, b""
        for lo, hi in brute(docs)[i]:
            keep, at = keep + b[at:lo], hi
        assert got[i] == hashlib.sha256(keep + b[at:]).hexdigest()


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    t = "some words that are long enough to be found again " * 1 + "and more of them to pass the threshold of a hundred bytes in all"
    rows = [(1, t, 5, "k"), (1, t, 5, "k"), (None, t, 6, "k"), (2, t, 7, "k")]
    got = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string, key long, spans string"))
    by = [(r["id"], len(r["spans"])) for r in got.collect()]
    assert sorted(by, key=str) == sorted([(1, 0), (1, 0), (2, 1), (None, 1)], key=str)


def test_empty(spark):
    assert repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cut_texts_in_one_pass(spark, capsys):
    docs = sample()
    df = spark.createDataFrame([(*d, "l") for d in docs], "doc_id long, text string, lang string").repartition(3)
    out = cut_texts(repeated_spans(df, keep=["lang"]))
    for r in out.collect():
        b, at, keep = (dict(docs)[r["id"]] or "").encode(), 0, b""
        for lo, hi in brute(docs)[r["id"]]:
            keep, at = keep + b[at:lo], hi
        assert r["text"] == (keep + b[at:]).decode("utf-8", "ignore")
        assert r["cut"] == bool(brute(docs)[r["id"]]) and r["payload"]["lang"] == "l"


def test_pipeline_cuts_a_text_once(spark, capsys):
    """A filter on the text left must not cut every text again in a second Python worker."""
    import corpus_pipeline
    df = spark.createDataFrame([(i, t, "l", "s", 1) for i, t in sample()], "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.repeated_passages(spark, df, "").explain()
    plan = capsys.readouterr().out.split("Initial Plan")[0]
    assert "EvalPython" not in plan


def test_last_step_of_the_query_sends_no_texts_to_python(spark, tmp_path, capsys):
    """Whole batches of texts in Python workers took the executors' memory to its limit."""
    from tablescope.llm.queries import op5_prefix_doubling
    docs = sample()
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = op5_prefix_doubling(spark, str(tmp_path))
    want = brute(docs)
    for r in out.collect():
        b, at, keep = (dict(docs)[r["doc_id"]] or "").encode(), 0, b""
        for lo, hi in want[r["doc_id"]]:
            keep, at = keep + b[at:lo], hi
        assert r["kept_sha256"] == hashlib.sha256(keep + b[at:]).hexdigest()
        assert (r["n_bytes"], r["n_spans"], r["n_removed"]) == (len(b), len(want[r["doc_id"]]), sum(hi - lo for lo, hi in want[r["doc_id"]]))
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out
    assert "Scan" in plan and "EvalPython" not in plan


def test_kept_bytes_of_split_characters_and_many_spans(spark):
    rng = random.Random(6)
    texts = ["é€𝄞" * 3000, "x", "", "ab" * 20_000]
    lists = [sorted(rng.sample(range(len(t.encode()) + 1), min(4000, len(t.encode()) // 2 * 2))) for t in texts]
    rows = [(i, t, list(zip(x[::2], x[1::2], strict=True))) for i, (t, x) in enumerate(zip(texts, lists, strict=True))]
    rows.append((4, "whole", [(0, 5)]))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<lo:int,hi:int>>")
    got = {r["i"]: bytes(r["k"]) for r in df.select("i", kept_bytes(F.col("text"), F.col("spans")).alias("k")).collect()}
    for i, text, spans_ in rows:
        gone = {p for lo, hi in spans_ for p in range(lo, hi)}
        assert got[i] == bytes(x for p, x in enumerate(text.encode()) if p not in gone)


def test_broadcast_lists_hold_numbers_not_structs(spark, monkeypatch):
    from tablescope.llm import prefix_doubling as P
    kinds, join = [], P._with_lists
    monkeypatch.setattr(P, "_with_lists", lambda rows, lists, how: (kinds.append(dict(lists.dtypes)), join(rows, lists, how))[1])
    P.repeated_spans(spark.createDataFrame(sample(), "doc_id long, text string"))
    assert len(kinds) == 4 and not any("struct" in t for k in kinds for t in k.values())


def test_powers_take_no_more_than_the_texts_need(monkeypatch):
    import numpy as np

    from tablescope.llm import textnum as X
    monkeypatch.setattr(X, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    few = [x.copy() for x in X.powers(1000)]
    assert len(X._powers[0]) <= X.CHUNK // 2
    many = X.powers(2 * X.CHUNK + 5)
    assert len(many[0]) == 2 * X.CHUNK + 5 and all((a == b[:1000]).all() for a, b in zip(few, many, strict=True))
    assert (many[0][-3:] * many[1][-3:] == 1).all()
