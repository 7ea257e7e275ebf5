"""Ranked text search over a table."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions import expr as X
from tablescope.plans import blocks as B
from tablescope.session import cut_lineage

# BM25 parameters and the shortest kept token.
K1, LENGTH_WEIGHT, MIN_LENGTH, TOP = 1.5, 0.75, 3, 3


def token_array(value):
    """Lower case, punctuation to spaces, words of three characters or more."""
    words = F.split(F.regexp_replace(F.lower(value), r"(?U)[^\w\s]", " "), r"(?U)\s+")
    return F.filter(words, lambda w: F.char_length(w) >= MIN_LENGTH)


def tokenize(df: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per token of every whole document."""
    return df.select(X.ref(doc).alias("doc"), F.explode(token_array(X.ref(text))).alias("term"))


def document_lengths(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, length) straight from the rows: no token leaves its task."""
    return df.select(X.ref(doc).alias("doc"), F.size(token_array(F.coalesce(X.ref(text), F.lit("")))).cast("bigint").alias("length"))


def corpus_stats(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Number of documents and average length."""
    return document_lengths(df, doc, text).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))


def _idf(df_col, n):
    return F.log((n - df_col + 0.5) / (df_col + 0.5) + 1)


def term_stats(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Document frequency and idf per term; each row emits its distinct terms, so no (doc, term) shuffle."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    terms = df.select(F.explode(F.array_distinct(token_array(X.ref(text)))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq")).withColumn("idf", _idf(F.col("doc_freq"), n))


def _occurrences(tokens: str, word: str):
    return F.size(F.filter(tokens, lambda t: t == F.lit(word)))


def bm25_topk(df: DataFrame, doc: str, text: str, query: str, k: int = TOP) -> DataFrame:
    """The k best documents; a repeated query word counts again.

    Each row turns into its length and one count per query word, so the texts are read once and never
    shuffled; these few numbers per document are checkpointed for the second step, which follows when the corpus
    statistics (one row) are known and keeps a per-task top k. A lost executor loses none of them.
    """
    words = [w for w in re.sub(r"[^\w\s]", " ", query.lower()).split() if len(w) >= MIN_LENGTH]
    if not words:
        return X.lit_rows(df, [], "doc bigint, score double")
    distinct = list(dict.fromkeys(words))
    tokens = token_array(F.coalesce(X.ref(text), F.lit("")))
    docs = df.select(X.ref(doc).alias("doc"), tokens.alias("tokens")).select(
        "doc", F.size("tokens").cast("double").alias("length"),
        *[_occurrences("tokens", w).cast("double").alias(f"tf{i}") for i, w in enumerate(distinct)])
    docs = cut_lineage(docs)
    one = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"),
                   *[X.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(distinct))])
    # One row of corpus statistics, joined on a constant key.
    scored = docs.withColumn("key", F.lit(1)).join(F.broadcast(one.withColumn("key", F.lit(1))), "key")
    norm = K1 * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * X.div(F.col("length"), F.col("avg_length")))

    def part(i):
        tf = F.col(f"tf{i}")
        return F.when(tf > 0, _idf(F.col(f"df{i}"), F.col("n")) * tf * (K1 + 1) / (tf + norm) * words.count(distinct[i])).otherwise(0.0)
    score = reduce(lambda a, b: a + b, [part(i) for i in range(len(distinct))])
    return scored.select("doc", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc").limit(k)


def keyword_label(df: DataFrame, doc: str, text: str, labels: dict[str, list[str]], default: str) -> DataFrame:
    """The label with most whole-word keyword hits in each text; the earlier label wins ties."""
    value = F.lower(F.coalesce(X.ref(text), F.lit("")))

    def hits(words):
        return reduce(lambda a, b: a + b, [value.rlike(r"(?U)\b" + re.escape(w) + r"\b").cast("int") for w in words])
    counts = [F.struct(hits(words).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("label"))
              for i, (name, words) in enumerate(labels.items())]
    return df.select(X.ref(doc).alias("doc"), F.array_max(F.array(*counts)).alias("best")).select(
        "doc", F.when(F.col("best.hits") > 0, F.col("best.label")).otherwise(default).alias("label"),
        F.col("best.hits").cast("bigint").alias("hits"))
