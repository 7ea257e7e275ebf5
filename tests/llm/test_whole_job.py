"""Cases of the second review: each failed before its finding was settled."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tablescope.llm import binary_packing as B
from tablescope.llm import cross_parsing as C
from tablescope.llm import spaced_seeds as S


def test_languages_of_copies_are_learned_from_their_distinct_texts(spark):
    rows = [(lang, f"{lang} {word} text") for lang, word in (("aa", "bari"), ("bb", "kelu"), ("cc", "ozux"), ("dd", "mifa"), ("ee", "siro")) for _ in range(3000)]
    rows += [("ff", f"few {'abcde'[i % 5] * 3} kinds") for i in range(5000)] + [("gg", "123 !!")] * 900
    rows += [("hh", "x" + "".join("abcdefghij"[int(c)] for c in str(i))) for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = C.train(df)
    assert model.languages == ["aa", "bb", "cc", "dd", "ee", "ff", "hh"]
    assert all(model.cost[i] > 3 for i in range(7))
    # exactly the smallest hashes, at every table size
    wanted = [r["text"] for r in df.where("lang = 'hh'").distinct().orderBy(F.xxhash64("text")).limit(400).collect()]
    again = C.fit({"hh": wanted}, 40_000)
    assert model.cost[6] == again.cost[0]
    assert C.train(df.where("lang in ('aa', 'hh')").limit(50)).languages


def test_packing_matches_added_tokens_like_the_library(spark, tmp_path):
    import corpus_pipeline
    from tablescope.llm.queries import op8_binary_packing
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["See <|endoftext|> here", "<|endoftext|>", "it's <|endoftext|><|endoftext|> twice", "plain, <|endoftext| not", None, "a\n<|endoftext|>  b " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(path)
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    assert 50256 in want[0] and library.encode(texts[0], add_special_tokens=False).ids == [6214, 220, 50256, 994]
    got = {}
    for r in corpus_pipeline.packing(spark, df, "").orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == want
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["doc_tokens"] for r in op8_binary_packing(spark, str(tmp_path)).collect()} == {i: len(v) for i, v in want.items()}
    assert B.encode([texts[0]], path, None)[0].tolist() != want[0][:-1]


def test_short_and_unspaced_items_are_found(spark):
    question = "東京から大阪まで新幹線で何時間かかりますか"
    items = [(1, "What is the capital of Peru?"), (2, question), (3, "Lima"), (4, "one two three four five six seven eight nine"), (5, None), (6, "?!")]
    filler = " ".join(f"w{i}" for i in range(40))
    docs = [(1, f"{filler} what is THE capital, of peru {filler}"), (2, f"前置きの文です。{question}。答えは二時間半です。"), (3, "lima"), (4, "one two three four five six seven eight nine"),
            (5, "one two three four five six seven eight"), (6, f"{filler} lima {filler}, Lima."), (7, "what is the capital"), (8, None), (9, "..."), (None, "Lima"), (3, "lima")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["item_words"], r["n_hits"]) for r in S.contamination(d, b).collect()}
    hits = got.pop((2, 2))
    assert hits[0] == hits[1] == len(question) and hits[2] > 0
    assert got == {(1, 1): (6, 6, 1), (3, 3): (1, 1, 2), (4, 4): (9, 9, 1), (6, 3): (1, 1, 2), (None, 3): (1, 1, 1)}
    assert {r["doc_id"] for r in S.clean(d, b).collect()} == {5, 7, 8, 9}
