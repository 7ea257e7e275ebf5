import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablescope.llm import binary_packing as B
from tablescope.llm import cross_parsing as C
from tablescope.llm import dom_model as D
from tablescope.llm import elias_fano as E
from tablescope.llm import ngram_trie as N
from tablescope.llm import ordinal as O
from tablescope.llm import snapshots as S

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    texts = ["plain words and more", None, "", "it's John's  two  spaces\n\n\tand tabs  nbsp ", "éèñ 漢字 😀 x1234 <|endoftext|> ... !!\n", " lead", "trail \n",
             "\n", "  ", "a\r\nb \r\n c", "word " * 3000, "don't" * 10, "x y 　z", "ⅷ½٣", "áb"]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)] + [(0, texts[0], 1), (None, "null id", 1)], "doc_id long, text string, start int")
    rows = B.pack(df, TOKENIZER, length=64, end_id=1).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    by = defaultdict(list)
    for r in rows:
        assert r["length"] <= 64 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0 and 1 << r["bucket"] == r["length"]
        by[r["id"]].append(r)
    for i, text in enumerate(texts):
        want = t.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by[i], key=lambda r: r["start"])
        if i == 0:
            pieces = pieces[::2]
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist() == want, text
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert all(r["doc_tokens"] == len(want) for r in pieces)
    assert B.pack(df.limit(0), TOKENIZER).count() == 0


def test_ordinal_regression_orders_grades_and_finds_toxic_words(spark):
    rng = random.Random(1)
    common = [f"word{i}" for i in range(200)]

    def text(grade):
        w = rng.choices(common, k=rng.randint(20, 200))
        if grade == 0:
            w[rng.randrange(len(w))] = rng.choice(["vilea", "vileb", "vilec"])
        return " ".join(x + "###" for x in w) if grade == 1 else " ".join(w)
    docs = [(i, text(i % 3), i % 3) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, tail int")
    model = O.train(df, df.where("doc_id < 1000").select(F.col("doc_id").alias("id"), F.col("tail").alias("grade")), size=1 << 14)
    assert all(a < b for a, b in zip(model.thresholds, model.thresholds[1:]))
    out = O.score(df.select("doc_id", "text"), model).where("doc_id >= 1000").collect()
    right = sum((r["tail"] >= 0.5) == (docs[r["doc_id"]][2] == 2) for r in out)
    assert right >= 0.97 * len(out)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "word1")], "doc_id long, text string")
    assert all(0 < r["tail"] < 1 for r in O.score(odd, model).collect())
    empty = O.train(odd.limit(0), df.limit(0).select(F.col("doc_id").alias("id"), F.col("tail").alias("grade")), size=64)
    assert O.score(odd, empty).count() == 3


def test_ordinal_fit_is_a_minimum_of_the_penalised_likelihood():
    rng = np.random.default_rng(5)
    n, size = 400, 12
    has = rng.random((n, size - 1)) < 0.3
    z = has @ rng.normal(size=size - 1)
    y = np.searchsorted([-0.5, 0.8], z + rng.logistic(size=n))
    owner, slot = np.nonzero(has)
    model = O.fit(y, owner, slot + 1, 3, size, rounds=3000, decay=0.01)

    def loss(w, t):
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        s = has @ w[1:]
        p = 1 / (1 + np.exp(-(edge[y + 1] - s))) - 1 / (1 + np.exp(-(edge[y] - s)))
        return -np.log(p).mean() + 0.005 * (w @ w)
    w, t = model.weights.astype(float), model.thresholds
    at = loss(w, t)
    for k in range(1, size):
        for d in (0.05, -0.05):
            assert loss(w + d * (np.arange(size) == k), t) > at
    for k in range(2):
        for d in (0.05, -0.05):
            assert loss(w, t + d * (np.arange(2) == k)) > at


def test_ordinal_fit_does_not_depend_on_partitions_and_repeated_ids(spark):
    rng = random.Random(2)
    docs = [(i % 120, " ".join(rng.choices(["good", "fine", "odd", "bad", "worse"], [3, 3, 1, i % 3, i % 2], k=12)), "x", 0.5) for i in range(240)]
    ratings = spark.createDataFrame([(i, i % 3) for i in range(120)], "id long, grade int")
    models = []
    for parts in (1, 5):
        rng.shuffle(docs)
        df = spark.createDataFrame(docs, "doc_id long, text string, grade string, slots double").repartition(parts)
        models.append(O.train(df, ratings, size=256))
    assert np.allclose(models[0].weights, models[1].weights, atol=1e-5) and np.abs(models[0].weights).max() > 0
    out = O.score(spark.createDataFrame([(1, "good fine", 9.0, 2.0), (1, "good fine", 9.0, 2.0)], "doc_id long, text string, tail double, expected_grade double"), models[0])
    assert out.columns.count("tail") == 1 and len({(r["tail"], r["expected_grade"]) for r in out.collect()}) == 1


def test_grades(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (3, 1, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["id"]: r["grade"] for r in O.grades_of(labels).collect()} == {1: 2, 2: 1, 3: 0}


def test_cross_parsing(spark):
    rng = random.Random(3)
    syllables = {"aa": ["ba", "bo", "ri", "ta"], "bb": ["ba", "ke", "lu", "mi"], "cc": ["éx", "ta", "oz", "ux"]}

    def text(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(n))
    docs = [(i, text(k, rng.randint(5, 300)), k) for i in range(240) for k in [list(syllables)[i % 3]]]
    df = spark.createDataFrame(docs + [(900, "123 !!", "aa"), (901, None, "aa"), (902, "漢字", None), (903, "", "bb")], "doc_id long, text string, lang string")
    model = C.train(df.where("doc_id < 120"), characters=4000)
    got = {r["doc_id"]: r["p"] for r in df.select("doc_id", C.predict(F.col("text"), model, spark).alias("p")).collect()}
    assert sum(got[i]["lang_pred"] == k for i, _, k in docs[120:]) >= 118
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 903))
    assert all(0 <= p["score"] <= 1 for p in got.values())
    empty = C.train(df.limit(0))
    assert df.select(C.predict(F.col("text"), empty, spark).alias("p")).where("p.lang_pred <> 'und'").count() == 0


def test_automaton_counts_greedy_phrases():
    rng = random.Random(9)
    sample = ["".join(rng.choices("abc", k=60)), "".join(rng.choices("abd", k=40))]
    model = C.fit({"x": sample}, 1000)
    for _ in range(30):
        t = "".join(rng.choices("abcdz", k=rng.randint(1, 80)))
        n, i = 0, 0
        while i < len(t):
            j = i
            while j < len(t) and any(t[i:j + 1] in s for s in sample):
                j += 1
            i, n = max(j, i + 1), n + 1
        x = C._letters(t)
        got = C.parse(np.array([len(x)]), model.symbols[x], model)[0, 0]
        assert abs(got - n) <= sum(c == "z" for c in t) + 1, (t, got, n)
        if "z" not in t:
            assert got == n


PAGE = """<html lang=en><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>{ad}<article><h1>The &amp; title</h1>
<p><b>First   paragraph,<br>with a break.<p>Second one, long enough to be a sentence &lt;here&gt;.</p><div class="comments"><p>Nice article, I like it.</p></div></article>
<aside>Read more, here.</aside><footer>&copy; all</footer><script>var t="</p>";</script></body></html>"""


def test_dom_model(spark):
    pages = [(i, f"u{i}", PAGE.replace("{ad}", f'<div class="ad">Buy number {i}, now.</div>')) for i in range(20)]
    odd = [(100, "u", None), (101, "u", ""), (102, "u", "just text, with a comma."), (103, "u", "<p>open <b>tags <i"), (104, "u", "<!-- "), (105, "u", "<script>x")]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string")
    model = D.train(df)
    got = {r["page_id"]: r["t"] for r in df.select("page_id", D.extract(F.col("html"), model, spark).alias("t")).collect()}
    want = "The & title\nFirst paragraph, with a break.\nSecond one, long enough to be a sentence <here>."
    assert all(got[i] == want for i in range(20))
    assert all(isinstance(v, str) for v in got.values()) and got[100] == got[101] == got[104] == ""
    assert D.train(df.limit(0)).odds == {}


BODY = "<h1>The title</h1><p>A first sentence, long enough to be one, of the article.</p><p>And a second sentence, again long enough.</p>"
TEXT = "The title\nA first sentence, long enough to be one, of the article.\nAnd a second sentence, again long enough."


@pytest.fixture(scope="module")
def dom(spark):
    return D.train(spark.createDataFrame([(i, PAGE.replace("{ad}", f'<div class="ad">Buy {i}.</div>')) for i in range(20)], "page_id long, html string"))


@pytest.mark.parametrize(("page", "want"), [
    (f'<nav>Menu</nav><div id="content" class="no-sidebar">{BODY}</div><div class="sidebar">See also.</div>', TEXT),
    (f'<div class="post-with-comments">{BODY}<div id="comments"><p>I like it, very much.</p></div></div>', TEXT),
    (f'<div class="wide sidebar">{BODY}</div><div class="site-footer"><p>All rights, reserved.</p></div>', TEXT),
    (f"<article><svg/>{BODY}</article>", TEXT),
    (f"<article><button>Share{BODY}</article>", "Share " + TEXT),
    (f"<article><div><button>Share</div>{BODY}<button>x</button></article>", TEXT),
    (f"<article><svg><title>t</title><g><path/><text>drawn</text></g></svg>{BODY}</article>", TEXT),
    (f'<article><header class="entry-header"><h1>Head</h1></header>{BODY}</article>', "Head\n" + TEXT),
    (f'<article><div class="entry-header"><h2>Head</h2></div>{BODY}</article>', "Head\n" + TEXT),
    (f"<article>{BODY}<figure><img src=a><figcaption>A view of it.</figcaption></figure></article>", TEXT + "\nA view of it."),
    (f"<article>{BODY}<table><tr><td>a<td>1<tr><td>b<td>2</table></article>", TEXT + "\na\n1\nb\n2"),
    (f"<article>{BODY}<p>Let <math><mi>x</mi><p>y</math> be a number, as above.</article>", TEXT + "\nLet be a number, as above."),
    (f"<article data-a='>' title=it's data-b=\"x'>\">{BODY}</article>", TEXT),
    (f"<article>{BODY}<p title=\"never closed>And an end, after all.</article>", TEXT + "\nAnd an end, after all."),
    (f"<article>{BODY}<p>1 < 2 <3, is it not?<!-- <p>hidden --></article><noscript><p>on</p></noscript>", TEXT + "\n1 < 2 <3, is it not?"),
    (f"<article>{BODY}</article><form><p>Your name, please.</p></form><select><option>a<option>b</select><textarea><p>t</textarea>", TEXT),
])
def test_dom_of_odd_pages(dom, page, want):
    assert D.main_text(f"<html><head><title>t</title></head><body>{page}</body></html>", dom).replace("Share\n", "Share ") == want


@pytest.mark.parametrize("piece", ["<script ", '<p title="x" ', '<a href="', "<p a='", "<button>", "<li>", "<div></p>", "<p = ", "<!-- ", "<svg><td>", "<ul><li><div>"])
def test_dom_takes_linear_time(piece):
    def seconds(n):
        start = time.process_time()
        D.parse(piece * n)
        return time.process_time() - start
    seconds(100)
    assert seconds(40_000) < 30 * seconds(4_000) + 0.5


def test_dom_repeated_rows_clashing_names_empty_table(spark, dom):
    df = spark.createDataFrame([(1, BODY, "x"), (1, BODY, "x"), (None, None, None)], "page_id long, html string, text string")
    out = df.withColumn("t", D.extract(F.col("html"), dom, spark))
    rows = out.collect()
    assert len(rows) == 3 and [r["text"] for r in rows].count("x") == 2
    assert len({r["t"] for r in rows if r["page_id"] == 1}) == 1
    assert out.limit(0).count() == 0


def test_sum_product_equals_enumeration():
    model = D.DomModel({"a": 0.7, "b": -1.1}, {(k, u, y): math.log(p) for k in ("run", "element") for u, y, p in ((0, 0, 0.9), (0, 1, 0.1), (1, 1, 0.7), (1, 0, 0.3))})
    nodes = [D.Node("#root", -1, []), D.Node("div", 0, ["a"]), D.Node("#text", 1, ["b"]), D.Node("p", 1, ["b"], prior=0.4), D.Node("#text", 3, ["a"])]
    total, mass = 0.0, np.zeros(5)
    for bits in range(32):
        y = [bits >> i & 1 for i in range(5)]
        e = 6.0 * y[0]
        for i in range(1, 5):
            e += y[i] * (nodes[i].prior + sum(model.odds[f] for f in nodes[i].features)) + model.edges[D._kind(nodes[i]), y[nodes[i].parent], y[i]]
        total += math.exp(e)
        mass += math.exp(e) * np.array(y)
    assert np.allclose(D.marginals(nodes, model), mass / total)


def test_elias_fano():
    rng = np.random.default_rng(5)
    for n, u in ((0, 10), (1, 1), (5, 5), (1000, 1 << 20), (3000, 3500), (500, 1 << 60)):
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        s = E.Sequence.load(E.Sequence.encode(v, u).arrays())
        assert (s.access(np.arange(n)) == v).all()
        x = np.unique(np.concatenate([v, rng.integers(0, u, 200, dtype=np.uint64)]))
        want = np.searchsorted(v, x)
        want = np.where((want < n) & (v[np.minimum(want, max(n - 1, 0))] == x if n else np.zeros(len(x), bool)), want, -1)
        assert (s.find(x) == want).all()


def test_ngram_scores(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "éa", "AB", "ab"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(80)] + [(200, None), (201, ""), (None, "w1 never seen")]
    train = [t for i, t in docs if i is not None and i < 60]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    trie = N.train(df.where("doc_id < 60"))
    c, b, after = Counter(), Counter(), defaultdict(set)

    def tokens(t):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in (t or "").split()] + [None]
    for t in train:
        last = None
        for w in tokens(t):
            c[w] += 1
            b[last, w] += 1
            after[last].add(w)
            last = w
    n, v = sum(c.values()), len(c)
    assert (trie.tokens, trie.words) == (n, v)
    for r in N.score(df, trie).collect():
        w = tokens(dict(docs)[r["id"]])
        base = [math.log10((c[x] + 1) / (n + v + 1)) for x in w]
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(c[x] > 0 for x in w)
        assert abs(r["base_score"] - sum(base)) < 1e-9
        s, last = 0.0, None
        for x, p in zip(w, base):
            s += math.log10((max(b[last, x] - 0.75, 0) + 0.75 * len(after[last]) * 10**p) / c[last]) if c[last] else p
            last = x
        assert s - 0.1 * len(w) <= r["score"] <= s + 1e-9
    empty = N.train(df.limit(0))
    assert N.score(df, empty).where("n_known > 0 or score <> base_score").count() == 0
    assert N.score(df.limit(0), trie).count() == 0


def test_snapshots(spark):
    a = [("user", "hi"), ("bot", "hello"), ("user", "more"), ("bot", None)]
    logs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [("user", "hi"), ("bot", "other")], 6: [(None, "hi")], 7: a[1:3], 8: [("user", str(i)) for i in range(600)], 9: [("user", str(i)) for i in range(300)]}
    rows = [(c, 10 * t, r, x, "e") for c, turns in logs.items() for t, (r, x) in enumerate(turns)]
    rows += [rows[0], (None, 0, "user", "alone", "e"), (None, 0, "user", "hi", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string").repartition(7)
    got = defaultdict(dict)
    for r in S.render(df).collect():
        got[r["conv_id"]][(r["segment"], hashlib.md5(r["text"].encode()).hexdigest())] = r
    assert set(got) == {3, 5, 6, 7, 8, None} and len(got[None]) == 2
    text = next(iter(got[3].values()))["text"]
    assert text == "<|user|>\nhi\n<|end|>\n<|bot|>\nhello\n<|end|>\n<|user|>\nmore\n<|end|>\n<|bot|>\n\n<|end|>\n"
    assert sorted(s for s, _ in got[8]) == [0, 1, 2] and all(r["n_turns"] == 600 for r in got[8].values())
    assert S.render(df.limit(0)).count() == 0
