"""Chat formatting with cumulative-snapshot collapse (operator 9).

A client that logs a growing conversation after every turn leaves many prefixes of the longest log. Rolling hashes of
turn prefixes find them: a conversation whose whole hash equals a proper prefix hash of another is dropped by an
anti-join, of equal conversations the smallest id stays; the rest is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.plans.blocks import ordered
from tablescope.session import cut_lineage

#: Turns per block of the rolling hashes, and per rendered segment.
BLOCK = 256


def _numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, _rn): distinct turns in order; also of conversations too long for one task."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return ordered(rows.where(F.col("conv").isNotNull()).distinct(), ["conv"], ["turn", "role", "text"]).select("conv", "turn", "role", "text", "_rn")


def prefix_hashes(numbered: DataFrame) -> DataFrame:
    """``numbered`` with h1, h2 (128 bits of the conversation up to this turn) and n, the turns of the conversation.

    A prefix hash is the exclusive or of hashes of (place, role, text), so it rolls on by one turn, and blocks of turns
    are combined without a pass over the whole conversation.
    """
    turn = F.struct(F.col("_rn"), F.coalesce("role", F.lit("")), F.col("role").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())
    rows = numbered.withColumns({"x1": F.xxhash64(F.lit(1), turn), "x2": F.xxhash64(F.lit(2), turn),
                                 "block": F.floor((F.col("_rn") - 1) / BLOCK)})
    sums = rows.groupBy("conv", "block").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"), F.count(F.lit(1)).alias("k"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv", "block", *[F.coalesce(F.bit_xor(f"s{i}").over(earlier), F.lit(0)).alias(f"o{i}") for i in (1, 2)],
                          F.sum("k").over(Window.partitionBy("conv")).alias("n"))
    inside = Window.partitionBy("conv", "block").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("conv", "block", "turn", "role", "text", "_rn", *[F.bit_xor(f"x{i}").over(inside).alias(f"r{i}") for i in (1, 2)])
    return running.join(offsets, ["conv", "block"]).select(
        "conv", "turn", "role", "text", "_rn", "n", *[F.col(f"r{i}").bitwiseXOR(F.col(f"o{i}")).alias(f"h{i}") for i in (1, 2)])


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv): conversations that are no proper prefix of another and, of equal ones, have the smallest id.

    Prefixes are made distinct before the join, so a first turn shared by a third of all logs is one row.
    """
    whole = hashed.where(F.col("_rn") == F.col("n")).groupBy(F.col("n").alias("_rn"), "h1", "h2").agg(F.min("conv").alias("conv"))
    prefixes = hashed.where(F.col("_rn") < F.col("n")).select("_rn", "h1", "h2").distinct()
    return whole.join(prefixes, ["_rn", "h1", "h2"], "left_anti").select("conv")


def template(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n<|end|>\n"))


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, segment, n_turns, text): the maximal conversations as training text.

    A conversation is one row unless it has more than ``BLOCK`` turns: then every ``BLOCK`` turns are a segment, in
    order, so no row and no task grows with a conversation. ``n_turns`` counts the whole conversation.

    Turns are ordered by (turn, role, text), nulls first; repeated turns count once. A null role is rendered as
    ``unknown``, a null text as empty. A turn without conversation id cannot belong to a log: it is a conversation
    of its own, with null id, and takes no part in the collapse. Other columns are ignored; an empty table gives no rows.
    """
    hashed = cut_lineage(prefix_hashes(_numbered(turns, conv_col, turn_col, role_col, text_col)))
    kept = hashed.join(maximal(hashed), "conv", "left_semi")
    pieces = kept.groupBy("conv", F.floor((F.col("_rn") - 1) / BLOCK).alias("segment")).agg(
        F.max("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("_rn", template(F.col("role"), F.col("text")).alias("t")))).alias("ts"))
    out = pieces.select(F.col("conv").alias("conv_id"), "segment", "n_turns", F.array_join("ts.t", "").alias("text"))
    alone = turns.where(F.col(conv_col).isNull()).select(
        F.col(conv_col).alias("conv_id"), F.lit(0).cast("long").alias("segment"), F.lit(1).cast("long").alias("n_turns"),
        template(F.col(role_col), F.col(text_col)).alias("text"))
    return out.union(alone)
