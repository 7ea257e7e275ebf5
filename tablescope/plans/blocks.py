"""Shared plan shapes: one-pass aggregates, frequencies, exact order statistics, global order.

All of them are built so that no task and no driver call ever holds a whole column, series or
group: partial aggregation first, range partitioning for order, and only tables whose size is
bounded by columns x partitions are joined back by broadcast.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions import expr as X
from tablescope.session import cut_lineage

# Aggregate expressions per pass over a very wide table (keeps generated code compilable).
WIDE_CHUNK = 60
# percentile_approx accuracy: rank error n / ACCURACY decides how many rows are kept exactly.
ACCURACY = 20_000
# Groups up to this size are kept whole: the sketch's rank error matters only above.
EXACT_BELOW = 100_000
# Rows per key that one task may sort, and ranges into which a round of selection cuts them.
KEEP, CELLS = 100_000, 256
# Ranges of a round of selection over a whole table.
CUT_RANGES = 4096
# A bracket table of so many groups is broadcast (about 200 bytes each).
BROADCAST_BRACKETS = 50_000
# Strings longer than this enter frequency tables as SHA-256 when only counts are needed.
HASH_ABOVE = 64


def wide(df: DataFrame, metrics: dict[str, dict[str, Column]]) -> DataFrame:
    """One scan: ``{column: {metric: aggregate}}`` -> one row per column.

    A table with hundreds of columns is aggregated in chunks, each a one-row result.
    """
    names = list(metrics)
    parts = []
    for start in range(0, len(names), WIDE_CHUNK):
        chunk = names[start:start + WIDE_CHUNK]
        flat = {(i, m): agg.alias(f"m{i}_{m}") for i, c in enumerate(chunk) for m, agg in metrics[c].items()}
        one = df.agg(*flat.values())
        parts.append(one.select(X.rows(*[
            F.struct(F.lit(start + i).alias("position"), F.lit(c).alias("column"),
                     *[F.col(f"m{i}_{m}").alias(m) for m in metrics[c]])
            for i, c in enumerate(chunk)])))
    return reduce(DataFrame.unionByName, parts)


def short(v: Column) -> Column:
    """Long strings as a tagged SHA-256, so that whole documents are never shuffled for counting."""
    return F.when(F.length(v) > HASH_ABOVE, F.concat(F.lit("sha256:"), F.sha2(v, 256))).otherwise(v)


def row_key(df: DataFrame) -> list[Column]:
    """Grouping columns that are equal exactly when two rows are equal; long text enters hashed."""
    out = []
    for i, f in enumerate(df.schema.fields):
        v = X.ref(f.name)
        if isinstance(f.dataType, T.StringType):
            v = short(v)
        elif isinstance(f.dataType, (T.MapType, T.VariantType)):
            v = short(F.to_json(F.struct(v)))
        out.append(v.alias(f"k{i}"))
    return out


def unpivot_text(df: DataFrame, columns: list[str], hashed: bool = False) -> DataFrame:
    """(column, value) with every value as string; nested columns must not be passed."""
    def value(c):
        v = X.text(df, c)
        if hashed and isinstance(X.dtype(df, c), T.StringType):
            v = short(v)
        return v
    return df.select(X.rows(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns]))


def _family(kind: T.DataType) -> str:
    """Type in which a column's values are counted: 8-byte keys wherever possible, text only for text."""
    if isinstance(kind, X.INTEGER_TYPES):
        return "bigint"
    if isinstance(kind, X.FLOAT_TYPES):
        return "double"
    return kind.simpleString()


def freq(df: DataFrame, columns: list[str], hashed: bool = False) -> DataFrame:
    """FREQ: (column, value, n) over non-null values; hot values are pre-counted in the map tasks.

    Columns of one type are counted together in that type and turned into text afterwards, so each
    column is read once and numbers are shuffled as numbers.
    """
    families: dict[str, list[str]] = {}
    for c in columns:
        families.setdefault(_family(X.dtype(df, c)), []).append(c)
    parts = []
    for family, names in families.items():
        def value(c, family=family):
            if family == "string":
                return short(X.ref(c)) if hashed else X.ref(c)
            v = X.ref(c).cast(family)
            return v + F.lit(0.0) if family == "double" else v
        counts = (df.select(X.rows(*[F.struct(F.lit(c).alias("column"), value(c).alias("v")) for c in names]))
                  .where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")))
        parts.append(counts.select("column", F.col("v").cast("string").alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts)


def countable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, X.NESTED_TYPES)]


def long_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x) with x as double, nulls, NaN and non-numbers dropped."""
    return (df.select(X.rows(*[F.struct(F.lit(c).alias("column"), X.double(df, c).alias("x")) for c in columns]))
            .where(F.col("x").isNotNull()))


def _at_rank(rank: Column, upto: Column, n: Column) -> Column:
    """Do ``n`` rows that end at running count ``upto`` hold the 0-based rank?"""
    return (upto > rank) & (upto - n <= rank)


def refine_once(table: DataFrame, keys: list[str], ranks: list[Column], cells: int | None = None) -> DataFrame:
    """One round of selection on (keys, _v, _out, _n, _total): only cells that hold a wanted rank keep their values.

    ``_out`` marks a run of rows folded into one counter right after the value ``_v``. The values of a key are cut into
    ``cells`` ranges of about equally many distinct values; the weights of a range are added up exactly, so the range
    of every rank is known and all other ranges become one counter each.
    """
    cells = cells or CELLS
    grid = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    cuts = table.where(~F.col("_out")).groupBy(*keys).agg(F.percentile_approx("_v", grid, F.lit(10 * cells)).alias("_cuts"))
    rows = table.join(cuts, keys, "left").withColumn("_cell", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(0)))
    sums = rows.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_c"), F.first("_total").alias("_total"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("_upto", upto)
    wanted = reduce(lambda x, y: x | y, [_at_rank(r, F.col("_upto"), F.col("_c")) for r in ranks])
    rows = rows.join(sums.select(*keys, "_cell", wanted.alias("_wanted")), [*keys, "_cell"])
    columns = [*keys, "_v", "_out", "_n", "_total"]
    folded = rows.where(~F.col("_wanted")).groupBy(*keys, "_cell").agg(
        F.max("_v").alias("_v"), F.sum("_n").alias("_n"), F.first("_total").alias("_total")).withColumn("_out", F.lit(True))
    return cut_lineage(rows.where("_wanted").select(columns).unionByName(folded.select(columns)))


def refine(table: DataFrame, keys: list[str], ranks: list[Column]) -> DataFrame:
    """Rounds of ``refine_once`` until no key has more than ``KEEP`` rows, or a round gains nothing."""
    before = None
    while True:
        most = table.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if most <= KEEP or (before is not None and most >= before):
            return table
        before = most
        table = refine_once(table, keys, ranks)


def quantiles(long: DataFrame, keys: list[str], value: str, probs: dict[str, float],
              nearest: bool = False, few_groups: bool = True) -> DataFrame:
    """Exact linear-interpolated quantiles per key, at any size.

    1. A mergeable sketch brackets every wanted order statistic (rank error n / ACCURACY).
    2. One more pass keeps the exact frequencies inside the brackets and folds everything between
       two brackets into one counter: about n * probs / ACCURACY rows.
    3. Where a key could still hold more than ``KEEP`` of them, rounds of selection cut the brackets
       again, each to a small part of the last, until no more are left.
    4. A running count over that bounded table finds the exact order statistics.

    With ``few_groups`` (keys are column names or a fixed number of category levels), or up to ``BROADCAST_BRACKETS``
    groups, the bracket table, one row per group, is broadcast, so the rows are merged where they are
    read; otherwise Spark chooses the join from its size.
    """
    names = list(probs)
    eps = 4.0 / ACCURACY
    wanted = [max(probs[n] - eps, 0.0) for n in names] + [min(probs[n] + eps, 1.0) for n in names]
    k = len(names)
    x = F.col(value)
    brackets = (long.groupBy(*keys)
                .agg(F.percentile_approx(x, F.array(*[F.lit(float(p)) for p in wanted]), F.lit(ACCURACY)).alias("_q"),
                     F.min(x).alias("_min"), F.max(x).alias("_max"), F.count(x).alias("_total")))
    lo = {n: F.col("_min") if wanted[i] <= 0 else F.col("_q")[i] for i, n in enumerate(names)}
    hi = {n: F.col("_max") if wanted[k + i] >= 1 else F.col("_q")[k + i] for i, n in enumerate(names)}
    brackets = brackets.select(*keys, "_total", *[lo[n].alias(f"_lo_{n}") for n in names],
                               *[hi[n].alias(f"_hi_{n}") for n in names])
    brackets = cut_lineage(brackets)
    largest, n_groups = brackets.agg(F.max("_total"), F.count(F.lit(1))).first()
    largest, few_groups = largest or 0, few_groups or n_groups <= BROADCAST_BRACKETS
    inside = (F.col("_total") <= EXACT_BELOW) | reduce(lambda a, b: a | b, [(x >= F.col(f"_lo_{n}")) & (x <= F.col(f"_hi_{n}")) for n in names])
    folded = [F.when(F.col(f"_hi_{n}") < x, F.col(f"_hi_{n}")) for n in names]
    below = F.greatest(*folded) if len(folded) > 1 else folded[0]
    table = long.where(x.isNotNull()).join(F.broadcast(brackets) if few_groups else brackets, keys)
    table = (table.withColumn("_in", inside)
             .withColumn("_v", F.when(F.col("_in"), x).otherwise(below))
             .groupBy(*keys, "_v", (~F.col("_in")).alias("_out"))
             .agg(F.count(F.lit(1)).alias("_n"), F.first("_total").alias("_total")))

    def position(p):
        h = F.lit(float(p)) * (F.col("_total") - 1)
        return F.floor(h + 0.5).cast("double") if nearest else h

    # two ends of the sketch's error on both sides of every bracket bound what a key can keep
    if max(min(largest, EXACT_BELOW), largest * (2 * eps + 2 / ACCURACY) * k) > KEEP:
        ranks = [f(position(probs[n])) for n in names for f in (F.floor, F.ceil)]
        table = refine(cut_lineage(table), keys, ranks)
    order = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first(), "_out").rowsBetween(
        Window.unboundedPreceding, 0)
    table = table.withColumn("_upto", F.sum("_n").over(order))

    def at(idx):
        # A wanted rank inside a folded run would mean the sketch broke its error bound: stop, never guess.
        value_at = F.when(F.col("_out"), F.raise_error(F.lit("quantile outside its bracket"))).otherwise(F.col("_v"))
        return F.max(F.when(_at_rank(idx, F.col("_upto"), F.col("_n")), value_at))

    aggs = []
    for n in names:
        h = position(probs[n])
        aggs += [at(F.floor(h)).alias(f"_a_{n}"), at(F.ceil(h)).alias(f"_b_{n}"),
                 F.max(h - F.floor(h)).alias(f"_f_{n}")]
    found = table.groupBy(*keys).agg(F.max("_total").alias("_total"), *aggs)
    return found.select(*keys, F.col("_total").alias("n"), *[
        (F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).alias(n) for n in names])


def ordered(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None,
            running: dict[str, str] | None = None, totals: bool = False) -> DataFrame:
    """Global order without a single-task window (ORD).

    Rows are range-partitioned on (keys, order), so one key holding a third of all rows is spread
    over a third of the tasks. Windows run inside (keys, partition); the totals of the earlier
    partitions (at most keys + partitions rows) are added back. The range-partitioned rows are
    checkpointed first: both halves of the plan must see the same partition ids.

    Adds ``_rn`` (1-based row number per key), ``_before`` (weight strictly before the value's
    peers), ``_peers`` (weight of the peers), ``_total`` (weight of the key) and, for each
    ``running`` item ``name: column``, the running sum up to this row (with ``totals`` also
    ``name_total``, its sum over the key).
    ``keys`` must not be null.
    """
    running = running or {}
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id()))
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    local = [*keys, "_pid"]
    sums = base.groupBy(*local).agg(F.count(F.lit(1)).alias("_c"), F.sum(w).alias("_w"),
                                      *[F.sum(c).alias(f"_s_{name}") for name, c in running.items()])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    offsets = sums.select(
        *local,
        F.coalesce(F.sum("_c").over(before), zero).alias("_oc"),
        F.coalesce(F.sum("_w").over(before), zero).alias("_ow"),
        F.sum("_w").over(Window.partitionBy(*keys)).alias("_total"),
        *[F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0.0)).alias(f"_o_{name}") for name in running],
        *[F.sum(f"_s_{name}").over(Window.partitionBy(*keys)).alias(f"{name}_total") for name in running])
    by_row = Window.partitionBy(*local).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    by_value = Window.partitionBy(*local).orderBy(*order).rangeBetween(Window.unboundedPreceding, 0)
    peers = Window.partitionBy(*local, *order)
    out = (base.withColumn("_lr", F.row_number().over(Window.partitionBy(*local).orderBy(*order)))
           .withColumn("_peers", F.sum(w).over(peers))
           .withColumn("_lw", F.sum(w).over(by_value)))
    for name, c in running.items():
        out = out.withColumn(f"_r_{name}", F.sum(c).over(by_row))
    out = out.join(offsets, local)
    return out.select(
        *[c for c in df.columns],
        (F.col("_lr") + F.col("_oc")).cast("bigint").alias("_rn"),
        (F.col("_lw") + F.col("_ow") - F.col("_peers")).alias("_before"),
        "_peers", "_total",
        *[(F.coalesce(F.col(f"_r_{name}"), F.lit(0.0)) + F.col(f"_o_{name}")).alias(name) for name in running],
        *[f"{name}_total" for name in running if totals])


def avg_ranks(counts: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """Average rank of every value per key from a frequency table; adds ``rank``."""
    o = ordered(counts, keys, [value], weight=n)
    return o.withColumn("rank", F.col("_before") + (F.col("_peers") + 1) / F.lit(2.0))


def weighted_quantiles(counts: DataFrame, keys: list[str], value: str, weight: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key of a frequency table, by global order."""
    o = ordered(counts, keys, [value], weight=weight)
    h = {name: F.lit(float(p)) * (F.col("_total") - 1) for name, p in probs.items()}

    def at(i):
        return F.max(F.when((F.col("_before") <= i) & (F.col("_before") + F.col("_peers") > i), F.col(value)))
    found = o.groupBy(*keys).agg(*[a for name, i in h.items() for a in (
        at(F.floor(i)).alias(f"_a_{name}"), at(F.ceil(i)).alias(f"_b_{name}"), F.max(i - F.floor(i)).alias(f"_f_{name}"))])
    return found.select(*keys, *[(F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs])


def weighted_quantile(counts: DataFrame, keys: list[str], value: str, weight: str, prob: float, name: str) -> DataFrame:
    """One of ``weighted_quantiles``."""
    return weighted_quantiles(counts, keys, value, weight, {name: prob})


def weighted_cut(counts: DataFrame, value: str, weight: str, prob: float) -> float | None:
    """Exact linear-interpolated quantile of a whole frequency table, without sorting it: rounds of selection add up the
    weights of equal ranges and go on in the range that holds the rank, until few rows are left for the driver."""
    v, w = F.col(value), F.col(weight)
    counts = counts.select(v, w).where(v.isNotNull())
    lo, hi, total = counts.agg(F.min(v), F.max(v), F.sum(w)).first()
    if not total:
        return None
    at = prob * (total - 1)
    ranks = sorted({int(np.floor(at)), int(np.ceil(at))})

    def find(lo: float, hi: float, before: int, ranks: list[int]) -> dict[int, float]:
        inside = counts.where(v.between(lo, hi))
        step = F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * CUT_RANGES), F.lit(CUT_RANGES - 1)) if hi > lo else F.lit(0)
        parts = inside.groupBy(step.alias("_cell")).agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        out = {}
        for r in sorted(parts.collect(), key=lambda r: r["lo"]):
            mine = [x for x in ranks if before <= x < before + r["w"]]
            if mine and r["lo"] == r["hi"]:
                out |= dict.fromkeys(mine, r["lo"])
            elif mine and (r["n"] <= KEEP or (r["lo"], r["hi"]) == (lo, hi)):
                few = inside.where(v.between(r["lo"], r["hi"])).groupBy(value).agg(F.sum(w).alias("w")).toPandas().sort_values(value)
                place = np.searchsorted(before + few["w"].cumsum().to_numpy(), mine, side="right")
                out |= dict(zip(mine, few[value].to_numpy()[place].tolist(), strict=True))
            elif mine:
                out |= find(r["lo"], r["hi"], before, mine)
            before += r["w"]
        return out
    found = find(lo, hi, 0, ranks)
    low, high = found[ranks[0]], found[ranks[-1]]
    return low + (high - low) * (at - ranks[0])


def pair_rows(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(var_a, var_b, x, y), pairwise-complete."""
    return (df.select(X.rows(*[
        F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"),
                 X.double(df, a).alias("x"), X.double(df, b).alias("y")) for a, b in pairs]))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull()))


def _cross_products(columns: list[str], shift: list[float]):
    """Arrow batches of the columns to one row per pair and task: counts and sums over the rows in which both are numbers."""
    k = len(columns)
    first, second = np.triu_indices(k)

    def run(batches):
        total = np.zeros((7, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]) - np.array(shift)
            there = ~np.isnan(x)
            endless = np.isinf(x)
            x = np.where(there & ~endless, x, 0.0)
            m = there.astype(np.float64)
            xx = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, xx.T @ m, m.T @ xx, x.T @ x, endless.T.astype(np.float64) @ m])
        total[6] += total[6].T  # an infinite value makes the moments of its pairs undefined, as in any sum
        total[1:6, total[6] > 0] = np.nan
        yield pa.record_batch([pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)),
                               *[pa.array(t[first, second]) for t in total[:6]]], ["i", "j", "n", "sa", "sb", "saa", "sbb", "sab"])
    return run


def moments_of_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """GRAM of all pairs i <= j of ``columns``: (var_a, var_b, n, mean_a, mean_b, sxx, syy, sxy), each over the rows where both are numbers.

    One matrix product per Arrow batch with masks for the gaps, one row per pair and task, added up by Spark. Values are
    shifted by the columns' means first, so large values lose no digits. A row is never copied per pair.
    """
    numbers = df.select(*[X.double(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    means = _means(numbers)
    schema = "i int, j int, n double, sa double, sb double, saa double, sbb double, sab double"
    sums = numbers.mapInArrow(_cross_products(columns, means), schema).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]).where("n > 0")
    names, shift = F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(float(m)) for m in means])
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    return sums.select(
        F.get(names, "i").alias("var_a"), F.get(names, "j").alias("var_b"), n.cast("long").alias("n"),
        (F.get(shift, "i") + sa / n).alias("mean_a"), (F.get(shift, "j") + sb / n).alias("mean_b"),
        F.greatest(F.col("saa") - sa * sa / n, F.lit(0.0)).alias("sxx"), F.greatest(F.col("sbb") - sb * sb / n, F.lit(0.0)).alias("syy"),
        (F.col("sab") - sa * sb / n).alias("sxy"))


def _means(numbers: DataFrame) -> list[float]:
    """Mean of the finite values of every column, 0 without any: one row."""
    parts = [numbers.columns[i:i + WIDE_CHUNK] for i in range(0, len(numbers.columns), WIDE_CHUNK)]
    finite = [numbers.agg(*[F.avg(F.when(F.abs(c) < float("inf"), F.col(c))).alias(c) for c in part]).first() for part in parts]
    return [float(v) if v is not None and abs(v) < float("inf") else 0.0 for row in finite for v in row]


def pair_moments(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """GRAM per pair of the list: n, means, central sums of squares and products over the pairwise-complete rows."""
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    if not pairs:
        return X.lit_rows(df, [], "var_a string, var_b string, n bigint, mean_a double, mean_b double, sxx double, syy double, sxy double")
    at = {c: i for i, c in enumerate(columns)}
    all_of = moments_of_pairs(df, columns)
    wanted = X.lit_rows(df, [(*((a, b) if at[a] <= at[b] else (b, a)), at[a] > at[b]) for a, b in pairs], "var_a string, var_b string, turned boolean")
    both = all_of.join(F.broadcast(wanted), ["var_a", "var_b"])

    def side(x, y):
        return F.when(F.col("turned"), F.col(y)).otherwise(F.col(x))
    return both.select(*[side(x, y).alias(x) for x, y in (("var_a", "var_b"), ("var_b", "var_a"))], "n",
                       *[side(x, y).alias(x) for x, y in (("mean_a", "mean_b"), ("mean_b", "mean_a"), ("sxx", "syy"), ("syy", "sxx"))], "sxy")


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """Complete-case GRAM: the same sums over rows where *all* columns are numbers, i <= j."""
    return moments_of_pairs(df.select(*[X.double(df, c).alias(c) for c in columns]).dropna(), columns)


def blocks(positioned: DataFrame, keys: list[str], size: int, before: int, after: int) -> DataFrame:
    """Cut an ordered series (``_rn`` from ``ordered``) into blocks of ``size`` rows plus a halo.

    Rows within ``before`` / ``after`` of a block edge are copied to the neighbour as context
    (``_own`` false), so order-dependent work runs on bounded groups (keys, _block).
    ``before`` and ``after`` must not exceed ``size``.
    """
    i = F.col("_rn") - 1
    b = F.floor(i / F.lit(size)).cast("bigint")
    offset = F.pmod(i, F.lit(size))
    copies = F.filter(F.array(
        F.struct(b.alias("_block"), F.lit(True).alias("_own")),
        F.when(offset >= size - before, F.struct((b + 1).alias("_block"), F.lit(False).alias("_own"))),
        F.when((offset < after) & (b > 0), F.struct((b - 1).alias("_block"), F.lit(False).alias("_own")))),
        lambda s: s.isNotNull())
    return positioned.select("*", F.inline(copies)).where(F.col("_block") >= 0)
