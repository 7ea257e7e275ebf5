import random
from collections import defaultdict

import numpy as np

import corpus_pipeline as P


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n)]


def test_stages_catch_what_was_planted_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(11)
    common = words(rng, 400)

    def prose(n):
        return rng.choices(common, k=n)
    docs, labels = {}, []
    for i in range(400):
        grade = i % 8
        w = prose(rng.randint(60, 160))
        if grade == 0:
            w[5] = w[20] = rng.choice(["vileone", "viletwo"])
        text = " ".join(x + "###" for x in w) if grade == 1 else " ".join(w)
        docs[i] = text
        labels.append((i, int(grade != 1), int(grade == 0)))
    bench = [(k, " ".join(words(rng, 30))) for k in range(3)]
    clean = [i for i in docs if i % 8 > 1]
    copies = {1000 + k: docs[clean[k]] for k in range(10)}
    near = {1100 + k: " ".join(docs[clean[20 + k]].split()[:-1] + ["changed"]) for k in range(10)}
    leaks = {1200 + k: " ".join(prose(40) + bench[k][1].split() + prose(40)) for k in range(3)}
    passage = " ".join(words(rng, 60))
    repeats = {1300 + k: " ".join(prose(50)) + " " + passage + " " + " ".join(prose(50)) for k in range(4)}
    toxic = {1400 + k: " ".join(prose(80) + ["vileone"] + prose(20) + ["viletwo"]) for k in range(4)}
    odd = {1500: "", 1501: None}
    every = docs | copies | near | leaks | repeats | toxic | odd
    rows = [(i, t, "en", "s", len(t or "")) for i, t in every.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), [set(every)]
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        assert frame.columns == P.COLUMNS
        seen.append({r["doc_id"] for r in frame.select("doc_id").collect()})
        if k == 2:
            texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    after_quality, after_near, after_repeats, after_leaks = seen[1:]
    assert not after_quality & set(toxic) and len(after_quality & set(clean)) >= 0.98 * len(clean)
    assert not any(i % 8 == 1 for i in after_quality if i < 400)
    assert not after_near & (set(copies) | set(near))
    assert after_quality - after_near <= set(copies) | set(near)
    assert sum(passage in (texts[i] or "") for i in repeats if i in texts) == 1
    assert not after_leaks & set(leaks) and after_repeats - after_leaks == set(leaks) & after_repeats
    assert set(odd) <= after_leaks
    packed = P.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
    total = defaultdict(int)
    for r in packed:
        total[r["doc_id"]] += r["length"]
        assert len(np.frombuffer(r["ids"], "<u4")) == r["length"]
    assert set(total) == after_leaks and total[1500] == total[1501] == 1


def test_near_duplicates_tell_rows_apart_not_ids(spark, tmp_path):
    rng = random.Random(3)
    a, b, c = (" ".join(words(rng, 80)) for _ in range(3))
    rows = [(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (7, b, "en", "t", 1), (None, a, None, "s", 1),
            (None, c, None, None, None), (8, None, "en", "s", 0), (8, None, "en", "s", 0), (9, "", "en", "s", 0), (3, a + " end", "de", "s", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for parts in (1, 4):
        got = P.near_duplicates(spark, spark.createDataFrame(rows, schema).repartition(parts), str(tmp_path))
        assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[k] for k in (0, 2, 6, 7, 8, 9)], key=str)
    assert P.near_duplicates(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0
