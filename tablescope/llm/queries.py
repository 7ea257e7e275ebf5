"""Registered queries of the numbered operators over the whole given tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.partenum import similarity_components
    out = similarity_components(_table(spark, sf_dir, "documents"), k=4, percent=85)
    return out.select(F.col("id").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.spaced_seeds import contamination
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quantile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.quantile_rules import apply_rules, measures
    from tablescope.session import cut_lineage
    measured = cut_lineage(measures(_table(spark, sf_dir, "documents")))
    return apply_rules(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_dom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.dom_model import extract, train
    pages = _table(spark, sf_dir, "pages")
    out = pages.select("page_id", "url", extract(F.col("html"), train(pages), spark).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.cross_parsing import predict, train
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = train(docs.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), predict(F.col("text"), model, spark).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op5_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.prefix_doubling import kept_bytes, repeated_spans
    out = repeated_spans(_table(spark, sf_dir, "documents"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return out.select(F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"),
                      F.when(F.size("spans") == 0, F.sha2(F.col("text").cast("binary"), 256)).otherwise(
                          F.sha2(kept_bytes(F.col("text"), F.col("spans")), 256)).alias("kept_sha256"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.ordinal import grades_of, score, train
    docs = _table(spark, sf_dir, "documents")
    model = train(docs, grades_of(_table(spark, sf_dir, "labels")))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", "expected_grade", F.col("tail").alias("tail_probability"), (F.col("tail") >= 0.5).alias("kept"))


def op8_binary_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    from tablescope.llm.binary_packing import pack
    out = pack(_table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=1,
               added=True)
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                      "offset", "bucket")


def op9_snapshot_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.snapshots import render
    return render(_table(spark, sf_dir, "conversations"))


def op10_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.ngram_trie import score, train
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    trie = train(docs.where(~held_out))
    out = score(docs, trie).withColumnRenamed("id", "doc_id")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.hard_negatives import mine
    label = F.col("label").cast("long")
    return mine(_table(spark, sf_dir, "embeddings"), label=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def op12_gram_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.spelling import variants, word_counts
    return variants(word_counts(_table(spark, sf_dir, "documents")))


def op13_tiled_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablescope.llm.topk_search import search
    return search(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_spaced_seeds": op1_spaced_seeds,
    "op2_quantile_rules": op2_quantile_rules,
    "op3_dom_model": op3_dom_model,
    "op4_cross_parsing": op4_cross_parsing,
    "op5_prefix_doubling": op5_prefix_doubling,
    "op6_ordinal_quality": op6_ordinal_quality,
    "op8_binary_packing": op8_binary_packing,
    "op9_snapshot_chats": op9_snapshot_chats,
    "op10_ngram_trie": op10_ngram_trie,
    "op11_slot_negatives": op11_slot_negatives,
    "op12_gram_spelling": op12_gram_spelling,
    "op13_tiled_search": op13_tiled_search,
    "op7_partenum_join": op7_partenum_join,
}

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _seed_rows(key: str, table: str) -> str:
    masks = ((0, 1, 2, 4, 5, 7, 9), (0, 1, 3, 4, 6, 8, 9), (0, 2, 3, 5, 7, 8, 9))
    windows = f"(select {key}, ws, unnest(range(len(ws) - 9)) as p from {table} where len(ws) >= 10)"
    return " union all ".join(
        f"select {key}, ws, p, {m} as mask, array_to_string([{', '.join(f'ws[p + {i + 1}]' for i in mask)}], ' ') as seed from {windows}"
        for m, mask in enumerate(masks))


def _quantile_rules_sql() -> str:
    gamma, pseudo = "(1.005::double / 0.995::double)", 50.0
    measures = {"word_length": ("word_chars / n_words", "n_words", 4.0, True), "symbol_rate": ("(n_symbols + 0.5::double) / (n_words + 1)", "n_symbols", 2.0, False),
                "dup_line_rate": ("(n_dup_lines + 0.5::double) / (n_words + 1)", "n_dup_lines", 2.0, False),
                "repeat_rate": ("(n_repeat_words + 0.5::double) / (n_words + 1)", "n_repeat_words", 2.0, False)}
    rows = " union all ".join(
        f"select lang, source, '{m}' as measure, ceil(ln(x) / ln({gamma}))::int as bin "
        f"from (select lang, source, ({e})::double as x from m where not base_failed)" for m, (e, *_) in measures.items())

    def level(name, keys):
        over = f"partition by measure{keys}"
        return f"""
{name} as (select measure{keys}, max(a) as n, ln(pow({gamma}, min(case when b >= 0.25 * a then bin end) - 1)) as q1,
  ln(pow({gamma}, min(case when b >= 0.75 * a then bin end))) as q3
  from (select *, sum(n) over ({over} order by bin) as b, sum(n) over ({over}) as a from
        (select measure{keys}, bin, count(*) as n from s group by measure{keys}, bin)) group by measure{keys})"""
    pick = {q: f"(f.n * f.{q} + {pseudo} * (c.n * c.{q} + {pseudo} * w.{q}) / (c.n + {pseudo})) / (f.n + {pseudo})" for q in ("q1", "q3")}
    fences, tests = [], []
    for m, (e, count, fence, both) in measures.items():
        fences.append(f"max(case when measure = '{m}' then exp(q3 + (q3 - q1) * {fence}) end) as {m}_high")
        tests.append(f"({count} = 0 or ({e})::double <= {m}_high)")
        if both:
            fences.append(f"max(case when measure = '{m}' then exp(q1 - (q3 - q1) * {fence}) end) as {m}_low")
            tests.append(f"({e})::double >= {m}_low")
    return rf"""
with w as (select doc_id, lang, source, coalesce(text, '') as t, {WORDS.format(text="coalesce(text, '')")} as ws from documents),
g as (select *, case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) else [] end as h,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) as ls from w),
u as (select doc_id, unnest(h) as x, unnest(range(len(h))) as i from g where len(list_distinct(h)) < len(h)),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from
        (select doc_id, i, count(*) over (partition by doc_id, x) as c from u) where c > 1) group by doc_id),
k as (select g.doc_id, lang, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
        coalesce(r.n, 0)::bigint as n_repeat_words from g left join r on r.doc_id = g.doc_id),
m as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from k),
s as ({rows}),{level("f0", ", lang, source")},{level("c0", ", lang")},{level("w0", "")},
p as (select f.measure, f.lang, f.source, {pick["q1"]} as q1, {pick["q3"]} as q3 from f0 f join c0 c on c.measure = f.measure
        and c.lang is not distinct from f.lang join w0 w on w.measure = f.measure),
z as (select lang, source, {", ".join(fences)} from p group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and case when n_words > 0 then coalesce({" and ".join(tests)}, false) else false end as kept
from m left join z on z.lang is not distinct from m.lang and z.source is not distinct from m.source"""


def _vectors_sql(columns: str, where: str = "") -> str:
    return (f"select {columns}, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings where vec_id is not null "
            f"and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0{where}")


def _dot_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}.v, {b}.v)::bigint"


ORACLES = {
    "op11_slot_negatives": f"""
with v as ({_vectors_sql("vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label", " and label is not null")}),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, {_dot_sql("a", "c")} as score from v a join v c
        on a.vec_id % 50 = 0 and a.vec_id <> c.vec_id and len(a.v) = len(c.v)),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)::int as rank,
  n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.anchor_id = p.anchor_id and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) <= 3""",
    "op13_tiled_search": f"""
with v as ({_vectors_sql("vec_id")})
select query_id, rank, vec_id, score from (select q.vec_id as query_id, c.vec_id, {_dot_sql("q", "c")} as score,
  row_number() over (partition by q.vec_id order by {_dot_sql("q", "c")} desc, c.vec_id)::int as rank
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)) where rank <= 5""",
    "op1_spaced_seeds": rf"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as ws from documents),
t as (select distinct item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as ws from benchmark),
ds as ({_seed_rows("doc_id", "d")}), ts as ({_seed_rows("item_id", "t")}),
h as (select ds.doc_id, ts.item_id, ds.ws as dw, ts.ws as tw, ds.p - ts.p as s, ts.p as q from ds join ts using (mask, seed)),
b as (select *, greatest(q - 3, 0, -s) as a, least(q + 13, len(tw), len(dw) - s) as e, greatest(0, -s) as a2, least(len(tw), len(dw) - s) as e2 from h),
m as (select *, len(list_filter(range(a, e), lambda j: dw[j + s + 1] = tw[j + 1])) as near,
        len(list_filter(range(a2, e2), lambda j: dw[j + s + 1] = tw[j + 1])) as whole from b)
select doc_id, item_id, max(whole)::bigint as matched, max(len(tw))::bigint as item_words, count(*) as n_hits
from m where near * 100 >= 80 * (e - a) group by 1, 2""",
    "op2_quantile_rules": _quantile_rules_sql(),
    "op9_snapshot_chats": """
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as p,
        count(*) over (partition by conv_id) as n from t),
h as (select *, md5(string_agg(coalesce('+' || role, '-') || chr(1) || coalesce('+' || text, '-') || chr(2), '' order by p)
        over (partition by conv_id order by p rows unbounded preceding)) as h from o),
w as (select n, h, min(conv_id) as conv_id from h where p = n group by n, h),
k as (select conv_id, n from w where not exists (select 1 from h where h.p < h.n and h.p = w.n and h.h = w.h)),
r as (select h.conv_id, (p - 1) // 256 as segment, max(h.n) as n_turns, string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '')
        || chr(10) || '<|end|>' || chr(10), '' order by p) as text from h join k on k.conv_id = h.conv_id group by 1, 2)
select conv_id, segment::bigint as segment, n_turns::bigint as n_turns, text from r
union all select conv_id, 0, 1, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10)
from conversations where conv_id is null""",
    "op7_partenum_join": rf"""
with recursive w as (select doc_id, {WORDS.format(text=LOWERED)} as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
        else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) end as sh from w),
n as (select doc_id, len(sh) as n from s),
e as (select doc_id, unnest(sh) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r(v, c) as (select doc_id, doc_id from documents union select l.b, r.c from r join l on l.a = r.v)
select n.doc_id, n.n as n_shingles, m.c as component_id from n join (select v, min(c) as c from r group by v) m on m.v = n.doc_id""",
}
