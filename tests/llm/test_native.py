import random
import re

from pyspark.sql import functions as F

from tablescope.llm import quantile_rules as Q
from tablescope.llm import spaced_seeds as S


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def test_spaced_seeds_find_planted_passages_with_replaced_words(spark):
    rng = random.Random(2)
    items = [(i, words(rng, 30)) for i in range(6)]
    docs = []
    for i in range(40):
        text = words(rng, 200)
        if i % 4 == 0:
            passage = list(items[i % 6][1])
            if i % 8 == 0:
                passage[11] = passage[23] = "replaced"
            at = rng.randint(0, 200)
            text[at:at] = passage
        docs.append((i, ", ".join(text).upper() if i == 12 else " ".join(text)))
    bench = [(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (92, "too short to tell"), (0, " ".join(items[0][1]))]
    docs += [(50, None), (51, ""), (None, " ".join(items[1][1])), (12, docs[12][1])]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in S.contamination(d, b).collect()}
    want = {(i, i % 6): 28 if i % 8 == 0 else 30 for i in range(0, 40, 4)} | {(None, 1): 30}
    assert got == want
    assert {r["doc_id"] for r in S.clean(d, b).collect()} == {i for i, _ in docs if i is not None} - {i for i, _ in want}
    assert S.contamination(d, b.limit(0)).count() == 0
    assert S.contamination(d.limit(0), b).count() == 0


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i:i + 5]), []).append(i)
    for p in seen.values():
        if len(p) > 1:
            covered |= {i + k for i in p for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x " * 30, "é ü#|<>\na b\na b\n\na b", "line\n" * 12 + "  \x0b z"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, None if i % 7 == 0 else "en", "s", 1) for i, t in enumerate(texts)],
                               "doc_id long, text string, lang string, source string, n_words int")
    for r in Q.measures(df).collect():
        want = base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, texts[r["doc_id"]]
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_adaptive_rules_drop_outliers_only(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, 80)), "en" if i % 3 else None, f"s{i % 4}") for i in range(600)]
    rows += [(1000 + i, " ".join(w + "###" for w in words(rng, 80)), "en", "s1") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = Q.measures(df).cache()
    kept = {r["doc_id"]: r["kept"] for r in Q.apply_rules(measured).collect()}
    assert len(kept) == len(rows)
    assert not any(kept[i] for i in kept if i >= 1000)
    assert sum(kept[i] for i in kept if i < 1000) >= 590
    assert Q.apply_rules(measured.limit(0)).count() == 0
    # sketches merge by addition
    s = Q.sketches(measured)
    whole = Q.quartiles(Q.merged(s, []), []).where("measure = 'word_length'").first()
    exact = measured.where("not base_failed").select(F.percentile(F.expr("word_chars / n_words"), F.lit(0.75))).first()[0]
    assert abs(whole["q3"] - exact) <= 0.03 * exact


def test_fences_follow_the_rates_of_their_source(spark):
    rng = random.Random(8)

    def text(often):
        w = words(rng, 120) if not often else [x + rng.choice(("", "yyyy")) for x in words(rng, 120)]
        for _ in range(rng.randint(6, 12) if often else rng.randint(0, 1)):
            w[rng.randrange(120)] += "#"
        lines = [" ".join(w[i:i + 12]) for i in range(0, 120, 12)]
        if often:
            lines += lines[:rng.randint(1, 2)]
        return "\n".join(lines)
    rows = [(i, text(i % 2), "en", "noisy" if i % 2 else "plain") for i in range(400)] + [(900, text(1), "en", "plain"), (901, text(0), "en", "rare")]
    rows += [rows[0], (902, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("symbol_rate_high", F.lit("x"))
    measured = Q.measures(df).cache()
    fences = {r["source"]: r for r in Q.thresholds(Q.sketches(measured)).collect()}
    assert set(fences) == {"noisy", "plain", "rare"}
    for c in ("word_length_high", "symbol_rate_high", "dup_line_rate_high", "repeat_rate_high"):
        assert fences["noisy"][c] > 1.15 * fences["plain"][c], c
        assert fences["plain"][c] < fences["rare"][c], c  # one document: drawn towards its language, which mixes both
    out = Q.apply_rules(measured.withColumn("symbol_rate_high", F.lit("x")))
    rows_out = out.collect()
    got = {r["doc_id"]: r["kept"] for r in rows_out}
    sound = [r["doc_id"] for r in rows_out if r["doc_id"] < 400 and not r["base_failed"]]  # two repeated lines are over the base rule
    assert not got[900] and got[901] and not got[902] and out.count() == len(rows)
    assert len(sound) > 250 and sum(got[i] for i in sound) >= 0.95 * len(sound)
