"""Time series (TS1-TS11) over ``(series_key, ts, x)``.

One series may hold a third of all rows, so nothing here runs one task per series: rows get their
position from the global order, order-dependent work runs on blocks of at most BLOCK rows plus a
halo, and partial results are added up per series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions import expr as X
from tablescope.functions import series as SE
from tablescope.plans import blocks as B
from tablescope.session import cut_lineage

# Shortest series, most lags, the lag worth a note.
MIN_N, MAX_LAG, NOTABLE = 10, 40, 0.2
# Rows per block and rows of context the seasonal decomposition needs on either side.
BLOCK, STL_HALO = 100_000, 1_000
# Copies of one row that a task expands at a time.
COPY_CHUNK = 1_000_000
# Up to so many series' means are sent to all executors; more are joined by key.
BROADCAST_SERIES = 200_000
KEY = "series_key"


def value_columns(numeric: list[str], top: int | None = None) -> list[str]:
    """Value columns, calendar features first; the first ``top`` if given."""
    calendar = [c for c in numeric if c.endswith(("_year", "_month"))]
    return (calendar + [c for c in numeric if c not in calendar])[:top]


def series_status(df: DataFrame, ts: str, values: list[str], key: str | None = None) -> DataFrame:
    """Which series can be analysed: (series_key, value, n, status) with the complete rows of each value column and series, also those
    that ``series_prepare`` drops. status is ``too short`` below 10 complete rows, else ``ok``."""
    k = F.coalesce(X.text(df, key), F.lit("null")) if key else F.lit("all")
    complete = [X.count_if(X.timestamp(df, ts).isNotNull() & X.double(df, c).isNotNull()).alias(f"n{i}") for i, c in enumerate(values)]
    counts = df.groupBy(k.alias(KEY)).agg(*complete) if key else df.agg(*complete).withColumn(KEY, k)
    rows = X.rows(*[F.struct(F.lit(c).alias("value"), F.col(f"n{i}").alias("n")) for i, c in enumerate(values)])
    return counts.select(KEY, rows).withColumn("status", F.when(F.col("n") < MIN_N, "too short").otherwise("ok"))


def series_prepare(df: DataFrame, ts: str, value: str, key: str | None = None) -> DataFrame:
    """TS1: complete rows in time order with position ``rn`` and the series' ``n``; short series are dropped.

    Also carries ``mean`` and the running sums of the centred value and its square, on which the other
    operators build. Equal rows are merged before the global order and given back afterwards, so a third
    of the table being copies of one row does not end up in one task.
    """
    k = F.coalesce(X.text(df, key), F.lit("null")) if key else F.lit("all")
    rows = df.select(k.alias(KEY), X.timestamp(df, ts).alias("ts"), X.double(df, value).alias("x")).dropna()
    # every series is centred on its own mean: sums of squares of series on different levels must not cancel
    shifts = cut_lineage(rows.groupBy(KEY).agg(F.avg("x").alias("shift")))
    merged = rows.groupBy(KEY, "ts", "x").agg(F.count(F.lit(1)).alias("w"))
    merged = merged.join(F.broadcast(shifts) if shifts.count() <= BROADCAST_SERIES else shifts, KEY)
    merged = merged.withColumn("c", F.col("x") - F.col("shift")).drop("shift")
    merged = merged.withColumn("wc", F.col("w") * F.col("c")).withColumn("wc2", F.col("w") * F.col("c") ** 2)
    o = B.ordered(merged, [KEY], ["ts", "x"], weight="w", running={"sum_c": "wc", "sum_c2": "wc2"}, totals=True)
    o = o.where(F.col("_total") >= MIN_N)
    copies = F.sequence(F.lit(1).cast("bigint"), F.col("w"))
    if (o.agg(F.max("w").alias("w")).first()["w"] or 0) > COPY_CHUNK:
        # Long runs of copies are cut up and spread before they are expanded.
        starts = F.sequence(F.lit(1).cast("bigint"), F.col("w"), F.lit(COPY_CHUNK).cast("bigint"))
        o = o.withColumn("from", F.explode(starts)).repartition(KEY, F.col("_before") + F.col("from"))
        copies = F.sequence(F.col("from"), F.least(F.col("w"), F.col("from") + COPY_CHUNK - 1))
    o = o.withColumn("j", F.explode(copies))
    behind = F.col("w") - F.col("j")
    n, rn = F.col("_total").cast("double"), F.col("_before") + F.col("j")
    mean_c = F.col("sum_c_total") / n
    sum_c, sum_c2 = F.col("sum_c") - behind * F.col("c"), F.col("sum_c2") - behind * F.col("c") ** 2
    return o.select(KEY, "ts", "x", rn.cast("bigint").alias("rn"), F.col("_total").alias("n"), "c",
                    (F.col("x") - F.col("c") + mean_c).alias("mean"), (F.col("c") - mean_c).alias("dev"),
                    (sum_c - rn * mean_c).alias("drift"), sum_c.alias("sum_c"), sum_c2.alias("sum_c2"),
                    F.greatest(F.lit(0.0), F.col("sum_c2_total") - n * mean_c ** 2).alias("ss"), "sum_c_total", "sum_c2_total")


def series_metadata(s: DataFrame) -> DataFrame:
    """TS1: observations and time range per series."""
    return s.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def rolling_mean(s: DataFrame) -> DataFrame:
    """TS2: mean of the last max(3, n // 10) rows, full windows only.

    The window grows with the series, so it is the difference of two running sums w rows apart: an
    equi-join on (series, position) instead of one ordered window per series.
    """
    w = F.greatest(F.lit(3), F.floor(F.col("n") / 10)).cast("bigint")
    now = s.select(KEY, "ts", "rn", "mean", "drift", w.alias("w"))
    before = s.select(KEY, (F.col("rn") + w).alias("rn"), F.col("drift").alias("drift_before"))
    start = F.coalesce("drift_before", F.lit(0.0))
    return now.where(F.col("rn") >= F.col("w")).join(before, [KEY, "rn"], "left").select(
        KEY, "rn", "ts", "w", (F.col("mean") + (F.col("drift") - start) / F.col("w")).alias("rolling_mean"))


def _blocks(s: DataFrame, before, after=0, size: int = BLOCK) -> DataFrame:
    return B.blocks(s.withColumnRenamed("rn", "_rn"), [KEY], size, before, after)


def _same(value: str, n: int) -> pd.Series:
    return pd.Series([value] * n, dtype=object)


STATE = "start bigint, mean double, sd double, hi double, lo double"
STATES = [c.split()[0] for c in STATE.split(", ")]
SIDES = ("up", "down")


def _entries(maps: DataFrame) -> DataFrame:
    """Sums ``hi`` and ``lo`` at the entry of every block behind its source, and whether the block raises an alarm.

    Blocks behind one source are composed in order: a running total and a running maximum per side.
    """
    order = Window.partitionBy(KEY, "src").orderBy("_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = maps
    for side, enter in zip(SIDES, ("hi", "lo"), strict=True):
        out = out.withColumn(f"_c_{side}", F.coalesce(F.sum(f"total_{side}").over(before), F.lit(0.0)))
        own = F.max(F.col(f"end_{side}") - F.col(f"_c_{side}") - F.col(f"total_{side}")).over(before) + F.col(f"_c_{side}")
        out = out.withColumn(f"in_{enter}", F.greatest(F.col(enter) + F.col(f"_c_{side}"), own, F.lit(0.0)))
    peak = [F.greatest(F.col(f"peak_{side}"), F.col(f"in_{enter}") + F.col(f"high_{side}")) > SE.THRESHOLD for side, enter in zip(SIDES, ("hi", "lo"), strict=True)]
    return out.select(KEY, "_block", "src", "start", "mean", "sd", F.col("in_hi").alias("hi"), F.col("in_lo").alias("lo"), (peak[0] | peak[1]).alias("alarm"))


def cusum_change_points(s: DataFrame, block: int = BLOCK) -> DataFrame:
    """TS3: CUSUM alarms on z-scores; behind an alarm at row i, mean and sd are those of row i onward.

    The state behind an alarm depends only on the alarm's position, and a block without alarms changes the two sums by a
    map that can be composed. Blocks with alarms are sources: first guessed from runs on their own, then every stretch of
    blocks behind a source is composed from the source's state up to its first alarm, that block runs again from its true
    entry, and so on until no state changes. A quiet stretch takes one round whatever its length; where alarms are
    frequent, runs that share one alarm agree from there on, so two or three rounds are usual.
    """
    n_tail = (F.col("n") - F.col("_rn") + 1).cast("double")
    tail = (F.col("sum_c_total") - F.col("sum_c") + F.col("c")) / n_tail
    tail2 = (F.col("sum_c2_total") - F.col("sum_c2") + F.col("c") ** 2) / n_tail
    data = _blocks(s, 0, 0, block).select(
        KEY, "_block", F.col("_rn").alias("rn"), F.col("c").alias("x"), tail.alias("tail_mean"),
        F.sqrt(F.greatest(F.lit(0.0), tail2 - tail ** 2)).alias("tail_sd"))
    data = cut_lineage(data)
    keys = [KEY, "_block"]

    def run(pdf: pd.DataFrame):
        """Alarms of a block and the state behind it, from its entry state or, without one, from a start at its first row."""
        pdf = pdf.sort_values("rn")
        x, tm, ts_ = (pdf[c].to_numpy() for c in ("x", "tail_mean", "tail_sd"))
        first = int(pdf["rn"].iloc[0])
        row = pdf.iloc[0]
        state = (first, tm[0], ts_[0], 0.0, 0.0) if "start" not in pdf or pd.isna(row["start"]) else tuple(row[c] for c in STATES)
        return SE.cusum(x, tm, ts_, first, state)

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        found, state = run(pdf)
        return pd.DataFrame([[pdf[KEY].iloc[0], int(pdf["_block"].iloc[0]), len(found), int(state[0]), *map(float, state[1:])]], columns=[*keys, "found", *STATES])

    def change(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        values = SE.cusum_map(pdf.sort_values("rn")["x"].to_numpy(), row["mean"], row["sd"])
        return pd.DataFrame([[row[KEY], int(row["_block"]), *values]], columns=[*keys, *MAP])

    def alarms(pdf: pd.DataFrame) -> pd.DataFrame:
        found, _ = run(pdf)
        return pd.DataFrame({KEY: _same(pdf[KEY].iloc[0], len(found)), "rn": np.array(found, dtype="int64")})

    MAP = [f"{c}_{side}" for side in SIDES for c in ("total", "end", "high", "peak")]
    map_schema = f"{KEY} string, _block bigint, " + ", ".join(f"{c} double" for c in MAP)
    exit_schema = f"{KEY} string, _block bigint, found int, {STATE}"
    guess = cut_lineage(data.groupBy(*keys).applyInPandas(leave, exit_schema))
    exits = guess.where("found > 0 or _block = 0").drop("found")
    maps, entry = None, None
    while True:
        # every block takes its state from the nearest source before it
        by = Window.partitionBy(KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        source = guess.select(*keys).join(exits.select(*keys, F.struct(F.col("_block").alias("src"), *STATES).alias("state")), keys, "left")
        wanted = source.withColumn("state", F.last("state", ignorenulls=True).over(by)).where("state is not null").select(*keys, "state.*")
        if maps is None:
            todo = wanted.select(*keys, "start", "mean", "sd")
        else:  # a block's map depends on the last alarm alone
            todo = wanted.join(maps.select(*keys, "start"), [*keys, "start"], "left_anti").select(*keys, "start", "mean", "sd")
        todo = cut_lineage(todo)
        if not todo.isEmpty():
            fresh = data.select(*keys, "rn", "x").join(todo, keys).groupBy(*keys).applyInPandas(change, map_schema).join(todo.select(*keys, "start"), keys)
            maps = fresh if maps is None else maps.join(todo.select(*keys), keys, "left_anti").unionByName(fresh)
            maps = cut_lineage(maps)
        if maps is None:  # one block a series
            break
        now = cut_lineage(_entries(wanted.join(maps.drop("start"), keys)))
        first = now.where("alarm").groupBy(KEY, "src").agg(F.min("_block").alias("first"))
        reached = now.join(first, [KEY, "src"], "left").where(F.col("first").isNull() | (F.col("_block") <= F.col("first")))
        reached = cut_lineage(reached.withColumn("alarm", F.col("_block") == F.coalesce("first", F.lit(-1))).drop("first"))
        if entry is not None:
            again = reached.where("alarm").join(entry.where("alarm").select(*keys, "start", "hi", "lo"), [*keys, "start", "hi", "lo"], "left_anti")
        else:
            again = reached.where("alarm")
        again = cut_lineage(again.select(*keys, *STATES))
        ran = cut_lineage(data.join(again, keys).groupBy(*keys).applyInPandas(leave, exit_schema).drop("found"))
        settled = reached.where("not alarm").select(*keys).unionByName(ran.select(*keys))
        after = cut_lineage(exits.join(settled, keys, "left_anti").unionByName(ran))
        gone = exits.select(*keys, "start", "hi", "lo").exceptAll(after.select(*keys, "start", "hi", "lo"))
        new = after.select(*keys, "start", "hi", "lo").exceptAll(exits.select(*keys, "start", "hi", "lo"))
        entry, exits = reached, after
        if gone.isEmpty() and new.isEmpty():
            break
    # alarms lie in first blocks and in blocks that the composition says raise one
    start = guess.where("_block = 0 and found > 0").select(*keys)
    if entry is None:
        return data.join(start, keys).groupBy(*keys).applyInPandas(alarms, f"{KEY} string, rn bigint")
    at = start.unionByName(entry.where("alarm").select(*keys)).join(entry.select(*keys, *STATES), keys, "left")
    return data.join(at, keys).groupBy(*keys).applyInPandas(alarms, f"{KEY} string, rn bigint")


def acf(s: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """TS4: autocorrelations (divisor n) up to min(40, n // 3), with the white-noise bound.

    Lagged values come from windows inside blocks that carry the previous ``max_lag`` rows; every own
    row adds its products and the sums are combined per series.
    """
    w = Window.partitionBy(KEY, "_block").orderBy("_rn")
    b = _blocks(s.select(KEY, "rn", "n", "dev", "ss"), max_lag)
    b = b.withColumns({f"l{k}": F.lag("dev", k).over(w) for k in range(1, max_lag + 1)}).where("_own")
    sums = b.groupBy(KEY).agg(F.first("n").alias("n"), F.first("ss").alias("ss"),
                              *[F.sum(F.col("dev") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)])
    lags = [F.struct(F.lit(0).alias("lag"), F.col("ss").alias("s"))] + [
        F.struct(F.lit(k).alias("lag"), F.coalesce(F.col(f"s{k}"), F.lit(0.0)).alias("s")) for k in range(1, max_lag + 1)]
    out = sums.select(KEY, "n", "ss", X.rows(*lags)).where(F.col("lag") <= F.floor(F.col("n") / 3))
    value = F.when(F.col("lag") == 0, 1.0).otherwise(X.div(F.col("s"), F.col("ss")))
    return out.select(KEY, "n", "lag", value.alias("acf"), (1.96 / F.sqrt(F.col("n").cast("double"))).alias("bound")).withColumn(
        "notable", (F.col("lag") > 0) & F.coalesce(F.abs("acf") > NOTABLE, F.lit(False)))


def pacf(s: DataFrame, max_lag: int = MAX_LAG, lags: DataFrame | None = None) -> DataFrame:
    """TS5: Yule-Walker partial autocorrelations from the at most 41 autocorrelations of each series (``lags``, if known)."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        return pd.DataFrame({KEY: pdf[KEY], "lag": pdf["lag"], "pacf": SE.levinson(pdf["acf"].to_numpy())})
    return (acf(s, max_lag) if lags is None else lags).select(KEY, "lag", "acf").groupBy(KEY).applyInPandas(solve, f"{KEY} string, lag int, pacf double")


def _adf_lags(n: Column) -> Column:
    rule = F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25)))
    return F.greatest(F.lit(0), F.least(rule, F.floor(n / 2) - 2)).cast("int")


def adf_test(s: DataFrame) -> DataFrame:
    """TS6: augmented Dickey-Fuller with constant; the lag minimises AIC.

    Each block turns into one cross-product matrix; the sum per series holds every regression.
    """
    b = _blocks(s.select(KEY, "rn", "n", "dev").withColumn("lags", _adf_lags(F.col("n").cast("double"))), F.col("lags") + 1)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        lags, x = int(pdf["lags"].iloc[0]), pdf["dev"].to_numpy()
        design = SE.adf_design(x, lags)
        # Rows of the design belong to the positions behind the first lags + 1; keep the block's own.
        design = design[pdf["_own"].to_numpy()[lags + 1:]]
        gram = design.T @ design
        head = x[:lags + 1] if int(pdf["_rn"].iloc[0]) == 1 else np.zeros(0)
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "lags": [lags], "rows": [len(design)], "gram": [gram.ravel()], "head": [head]})

    parts = b.groupBy(KEY, "_block").applyInPandas(
        part, f"{KEY} string, lags int, rows bigint, gram array<double>, head array<double>")
    cells = parts.select(KEY, F.posexplode("gram").alias("i", "g")).groupBy(KEY, "i").agg(F.sum("g").alias("g"))
    facts = parts.groupBy(KEY).agg(F.max("lags").alias("lags"), F.sum("rows").alias("rows"),
                                   F.max(F.when(F.size("head") > 0, F.col("head"))).alias("head"))
    rows = cells.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("i", "g"))).alias("cells")).join(facts, KEY)

    def solve(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                p = r.lags + 3
                gram = np.array([c["g"] for c in r.cells]).reshape(p, p)
                try:
                    tau, lag = SE.adf_from_gram(gram, int(r.rows), np.array(r.head), int(r.lags))
                    out.append((getattr(r, KEY), tau, SE.adf_pvalue(tau), lag, SE.adf_pvalue(tau) < 0.05))
                except (ValueError, ZeroDivisionError, np.linalg.LinAlgError):
                    out.append((getattr(r, KEY), None, None, None, None))
            yield pd.DataFrame(out, columns=[KEY, "statistic", "pvalue", "lag", "stationary"]).astype({"lag": "Int32"})

    return rows.mapInPandas(solve, f"{KEY} string, statistic double, pvalue double, lag int, stationary boolean")


def _lag_products(s: DataFrame, lags: Column) -> DataFrame:
    """(series_key, lag, s): sums of dev(t) * dev(t - lag) for 1 .. ``lags`` of the series."""
    b = _blocks(s.withColumn("lags", lags.cast("int")), F.col("lags"))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        x, own = pdf["dev"].to_numpy(), pdf["_own"].to_numpy()
        lags = int(pdf["lags"].iloc[0])
        sums = SE.lagged_products(x, own, lags)
        return pd.DataFrame({KEY: _same(pdf[KEY].iloc[0], lags), "lag": np.arange(1, lags + 1), "s": sums})

    parts = b.groupBy(KEY, "_block").applyInPandas(part, f"{KEY} string, lag int, s double")
    return parts.groupBy(KEY, "lag").agg(F.sum("s").alias("s"))


def kpss_test(s: DataFrame) -> DataFrame:
    """TS7: KPSS around a level; lag count by the automatic rule of Hobijn et al. (1998)."""
    base = s.select(KEY, "rn", "n", "dev", "ss", "drift")
    n = F.col("n").cast("double")
    facts = base.groupBy(KEY).agg(F.first("n").alias("n"), F.first("ss").alias("ss"), F.sum(F.col("drift") ** 2).alias("eta"))
    first = _lag_products(base, F.floor(F.pow(n, F.lit(2.0 / 9.0)))).groupBy(KEY).agg(
        F.sum("s").alias("p0"), F.sum(F.col("s") * F.col("lag")).alias("p1"))
    facts = facts.join(first, KEY, "left").na.fill(0.0, ["p0", "p1"])
    # Means over n / 2 for the lagged products, over n for the squares.
    s0 = F.col("ss") / n + F.col("p0") / (n / 2)
    ratio = X.div(F.col("p1") / (n / 2), s0)
    gamma = 1.1447 * F.pow(ratio * ratio, F.lit(1.0 / 3.0))
    auto = F.least(F.floor(gamma * F.pow(n, F.lit(1.0 / 3.0))), F.col("n") - 1, F.lit(BLOCK))
    facts = cut_lineage(facts.withColumn("lags", F.coalesce(auto, F.lit(0)).cast("int")))
    # The lag count reaches the rows per (series, block), so a long series is not joined in one task.
    per_block = facts.select(KEY, "lags", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / BLOCK))).alias("b"))
    rows = base.withColumn("b", F.floor((F.col("rn") - 1) / BLOCK)).join(per_block, [KEY, "b"]).drop("b")
    long_run = _lag_products(rows, F.col("lags")).join(facts.select(KEY, "lags"), KEY).groupBy(KEY).agg(
        F.sum(F.col("s") * (1 - F.col("lag") / (F.col("lags") + 1.0))).alias("weighted"))
    f = facts.join(long_run, KEY, "left")
    variance = (F.col("ss") + 2 * F.coalesce("weighted", F.lit(0.0))) / n
    stat = X.div(F.col("eta") / (n * n), variance)
    k, p = SE.KPSS_STAT, SE.KPSS_P
    value = F.when(F.col("statistic") >= k[-1], p[-1])
    for i in (2, 1, 0):
        line = p[i] + (F.col("statistic") - k[i]) * ((p[i + 1] - p[i]) / (k[i + 1] - k[i]))
        value = value.when(F.col("statistic") >= k[i], line)
    return f.select(KEY, stat.alias("statistic"), "lags").withColumn("pvalue", F.when(F.col("statistic").isNotNull(), value.otherwise(p[0]))
                                                                     ).withColumn("stationary", F.col("pvalue") >= 0.05)


def stationarity(s: DataFrame) -> DataFrame:
    """TS8: stationary if both tests say so."""
    a = adf_test(s).select(KEY, F.col("pvalue").alias("adf_p"), F.col("stationary").alias("adf_stationary"))
    k = kpss_test(s).select(KEY, F.col("pvalue").alias("kpss_p"), F.col("stationary").alias("kpss_stationary"))
    both = F.coalesce(F.col("adf_stationary") & F.col("kpss_stationary"), F.lit(False))
    return a.join(k, KEY, "full").withColumn("stationary", both)


def stl_decompose(s: DataFrame, block: int = BLOCK) -> DataFrame:
    """TS9: trend, seasonal and residual with period min(13, max(2, n // 10)).

    Every smoother looks at a bounded neighbourhood, so a block with a halo of 1,000 rows gives the
    same values as the whole series.
    """
    b = _blocks(s.select(KEY, "ts", "x", "rn", "n"), STL_HALO, STL_HALO, block)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn").reset_index(drop=True)
        n, y = int(pdf["n"].iloc[0]), pdf["x"].to_numpy()
        trend, season = SE.stl(y, min(13, max(2, n // 10)), n)
        out = pdf[[KEY, "ts", "_rn", "x", "_own"]].assign(trend=trend, seasonal=season, resid=y - trend - season)
        return out[out["_own"]].drop(columns="_own").rename(columns={"_rn": "rn"})

    return b.groupBy(KEY, "_block").applyInPandas(
        part, f"{KEY} string, ts timestamp_ntz, rn bigint, x double, trend double, seasonal double, resid double")


def datetime_gaps(df: DataFrame, columns: list[str]) -> DataFrame:
    """TS10: median step and gaps above 1.5 times the median, per datetime column."""
    micros = [F.struct(F.lit(c).alias("column"), F.unix_micros(X.timestamp(df, c).cast("timestamp")).alias("t")) for c in columns]
    counts = df.select(X.rows(*micros)).where(F.col("t").isNotNull()).groupBy("column", "t").agg(F.count(F.lit(1)).alias("w"))
    o = cut_lineage(B.ordered(counts, ["column"], ["t"]).select("column", "t", "w", "_rn"))
    w = Window.partitionBy("column", "_block").orderBy("_rn")
    # Between two distinct times lies one step; w equal times have w - 1 steps of zero.
    moves = (B.blocks(o, ["column"], BLOCK, 1, 0).withColumn("step", F.col("t") - F.lag("t").over(w))
             .where("_own and step is not null").select("column", F.col("step").cast("double").alias("step"), F.lit(1).cast("bigint").alias("k")))
    still = o.where("w > 1").groupBy("column").agg(F.lit(0.0).alias("step"), F.sum(F.col("w") - 1).alias("k"))
    steps = moves.unionByName(still).groupBy("column", "step").agg(F.sum("k").alias("k"))
    median = B.weighted_quantile(steps, ["column"], "step", "k", 0.5, "median").select("column", (F.col("median") / 1000).alias("ms"))
    ms = F.col("ms")
    found = steps.join(F.broadcast(median), "column").where(ms > 0).groupBy("column", "ms").agg(
        F.coalesce(F.sum(F.when(F.floor(F.col("step") / 1000) > ms * 1.5, F.col("k"))), F.lit(0).cast("bigint")).alias("n_gaps"))
    day, hour, minute = 86_400_000, 3_600_000, 60_000

    def unit(size, label):
        return F.concat(F.floor(ms / size).cast("string"), F.lit(label))
    label = F.when(ms >= day, unit(day, "D")).when(ms >= hour, unit(hour, "H")).when(ms >= minute, unit(minute, "min")).otherwise(
        F.concat(ms.cast("string"), F.lit("ms")))
    return found.select("column", ms.alias("median_ms"), label.alias("inferred_frequency"), "n_gaps", (F.col("n_gaps") > 0).alias("has_gaps"))


def timeseries_findings(s: DataFrame, tests: DataFrame | None = None, lags: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """TS11: coded findings per series, from its stationarity tests, autocorrelations and change points where they are known."""
    st = stationarity(s) if tests is None else tests
    first = st.select(KEY, F.when(F.col("stationary"), "stationary").otherwise("not_stationary").alias("code"),
                      F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("detail"))
    lags = (acf(s) if lags is None else lags).where("notable").groupBy(KEY).agg(F.sort_array(F.collect_list("lag")).alias("lags"))
    second = lags.select(KEY, F.lit("autocorrelated").alias("code"), F.size("lags").cast("double").alias("value"),
                         F.array_join(F.slice("lags", 1, 5).cast("array<string>"), ", ").alias("detail"))
    third = (cusum_change_points(s) if changes is None else changes).groupBy(KEY).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        KEY, F.lit("change_points").alias("code"), "value", F.lit(None).cast("string").alias("detail"))
    return first.unionByName(second).unionByName(third)
