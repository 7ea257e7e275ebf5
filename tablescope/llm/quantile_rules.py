"""Quality rules with adaptive thresholds from mergeable quantile sketches (operator 2), in DataFrame functions only.

The sketch of a measure is its histogram over logarithmic bins (relative error ``ERROR``): sketches merge by adding
counts, so one per (language, source) gives those of languages and of the whole by addition. A document is
rejected where a measure lies beyond the far fence of its group's quartiles. Quartiles and spread come from the sketches
alone: those of a group are drawn towards its language's, and these towards the whole's, by the weight of ``PSEUDO`` documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of a quantile; bins are powers of (1 + e) / (1 - e).
ERROR = 0.005
GAMMA = (1 + ERROR) / (1 - ERROR)
#: Weight of the coarser group's quartiles, in documents.
PSEUDO = 50.0
#: Measure: (expression, the count without which nothing is wrong, fence in interquartile ranges of the logarithm, whether too
#: little is a fault as well). Rates add half a fault and one word, so texts without faults still tell how much a count weighs.
MEASURES = {
    "word_length": ("word_chars / n_words", "n_words", 4.0, True),
    "symbol_rate": ("(n_symbols + 0.5) / (n_words + 1)", "n_symbols", 2.0, False),
    "dup_line_rate": ("(n_dup_lines + 0.5) / (n_words + 1)", "n_dup_lines", 2.0, False),
    "repeat_rate": ("(n_repeat_words + 0.5) / (n_words + 1)", "n_repeat_words", 2.0, False),
}
BREAKS = r"[\x20\x09-\x0D]+"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row.

    Words are runs without space, tab or line breaks. Null text is the empty text: all counts 0, base failed. Repeated rows
    and ids give a row each, an empty table none; other columns, whatever their names, are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("_t"))
    base = base.withColumn("_w", F.filter(F.split("_t", BREAKS, -1), lambda w: w != ""))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    base = base.select(
        "doc_id", "lang", "source", F.size("_w").alias("n_words"), F.length(F.concat_ws("", "_w")).alias("word_chars"),
        (F.size(F.split("_t", r"[#*$%&|<>]", -1)) - 1).alias("n_symbols"), lines.alias("_l"),
        # a window of five words as one number; shorter texts have none
        F.when(F.size("_w") >= 5, F.transform(
            F.arrays_zip(*[F.slice("_w", i + 1, F.size("_w") - 4).alias(f"a{i}") for i in range(5)]), lambda s: F.xxhash64(s)))
        .otherwise(F.array().cast("array<bigint>")).alias("_h"))
    # most texts repeat nothing: their windows are compared once; the others are sorted by window
    places = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _repeat_words(places)).otherwise(F.lit(0))
    out = base.select(
        "doc_id", "lang", "source", F.col("n_words").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), repeated.cast("long").alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _repeat_words(places: Column) -> Column:
    """Words covered by windows of five words that occur twice, from the sorted (window, position) pairs."""
    def equal(p, i, step):
        return F.coalesce(F.try_element_at(p, i + 1 + step)["h"] == F.element_at(p, i + 1)["h"], F.lit(False))

    def covered(p):
        # p: positions of repeated windows in order; each covers up to the next or five words
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
                           lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")))["n"]

    before = F.concat(F.slice(places, 1, 1), places)  # shifted by one
    marks = F.arrays_zip(places.alias("c"), before.alias("b"), F.slice(places, 2, F.size(places)).alias("n"))
    kept = F.transform(
        F.filter(marks, lambda m, i: m["c"].isNotNull() & (((i > 0) & (m["c"]["h"] == m["b"]["h"])) | F.coalesce(m["c"]["h"] == m["n"]["h"], F.lit(False)))),
        lambda m: m["c"]["i"])
    return covered(F.sort_array(kept))


def sketches(measured: DataFrame) -> DataFrame:
    """(measure, lang, source, bin, n): the sketch of each measure and group over documents that pass the base rules.

    Bin b holds the values in ``(GAMMA^(b-1), GAMMA^b]``. Rows of one bin are added up in the map tasks, so a source with a
    third of all rows sends one row per bin and task.
    """
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.ceil(F.log(F.expr(f"cast({e} as double)")) / math.log(GAMMA)).cast("int").alias("bin"))
                     for m, (e, *_) in MEASURES.items()])
    return measured.where("not base_failed").select("lang", "source", F.inline(rows)).groupBy("measure", "lang", "source", "bin").agg(
        F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups: counts added over what ``keys`` leaves out."""
    return sketch.groupBy("measure", *keys, "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(measure, keys, n, q1, q3): lower edge of the first and upper edge of the third quartile's bin; ``n`` of each measure's group."""
    part = Window.partitionBy("measure", *keys)
    c = sketch.withColumn("_below", F.sum("n").over(part.orderBy("bin"))).withColumn("_all", F.sum("n").over(part))

    def at(share, edge):
        return F.pow(F.lit(GAMMA), F.min(F.when(F.col("_below") >= share * F.col("_all"), F.col("bin"))) + edge)
    return c.groupBy("measure", *keys).agg(F.max("_all").alias("n"), at(0.25, -1).alias("q1"), at(0.75, 0).alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high): the fences of every group of the sketch, null-safe keys."""
    fine = quartiles(sketch, ["lang", "source"])
    coarse = quartiles(merged(sketch, ["lang"]), ["lang"]).select(
        F.col("measure").alias("_ml"), F.col("lang").alias("_lang"), F.col("n").alias("n_l"), F.col("q1").alias("q1_l"), F.col("q3").alias("q3_l"))
    whole = quartiles(merged(sketch, []), []).select(F.col("measure").alias("_m"), F.col("q1").alias("q1_w"), F.col("q3").alias("q3_w"))
    all_three = fine.join(coarse, (F.col("measure") == F.col("_ml")) & F.col("lang").eqNullSafe(F.col("_lang"))).join(
        F.broadcast(whole), F.col("measure") == F.col("_m"))  # one row per measure

    def drawn(q):
        of_language = (F.col("n_l") * F.log(f"{q}_l") + PSEUDO * F.log(f"{q}_w")) / (F.col("n_l") + PSEUDO)
        return (F.col("n") * F.log(q) + PSEUDO * of_language) / (F.col("n") + PSEUDO)
    chosen = all_three.select("measure", "lang", "source", drawn("q1").alias("q1"), drawn("q3").alias("q3"))
    out = []
    for m, (_, _, fence, both) in MEASURES.items():
        step = (F.col("q3") - F.col("q1")) * fence
        mine = F.col("measure") == m
        out.append(F.max(F.when(mine, F.exp(F.col("q3") + step))).alias(f"{m}_high"))
        if both:
            out.append(F.max(F.when(mine, F.exp(F.col("q1") - step))).alias(f"{m}_low"))
    return chosen.groupBy("lang", "source").agg(*out)


def apply_rules(measured: DataFrame) -> DataFrame:
    """``measured`` (the columns of ``measures``) with ``kept`` and the fences used; a row per row.

    ``measured`` is read twice (sketch, filter): hand in a checkpointed table. Sketches and fences have a row per group
    and bin; they are joined by shuffle unless Spark finds them small. Null languages and sources are groups
    of their own. Groups without a document that passes the base rules have no fence and no kept document. Repeated rows
    count as often as they occur and get one verdict; values on a fence are kept; an empty table gives no rows.
    Columns named like the fences are replaced.
    """
    fences = thresholds(sketches(measured)).withColumnRenamed("lang", "_fl").withColumnRenamed("source", "_fs")
    measured = measured.drop(*[c for c in fences.columns if c not in ("_fl", "_fs")])
    joined = measured.join(fences, F.col("lang").eqNullSafe(F.col("_fl")) & F.col("source").eqNullSafe(F.col("_fs")), "left").drop("_fl", "_fs")
    good = ~F.col("base_failed")
    for m, (e, count, _, both) in MEASURES.items():
        value = F.expr(f"case when n_words > 0 then cast({e} as double) end")
        good = good & ((F.col(count) == 0) | F.coalesce(value <= F.col(f"{m}_high"), F.lit(False)))
        if both:
            good = good & F.coalesce(value >= F.col(f"{m}_low"), F.lit(False))
    return joined.withColumn("kept", good)
