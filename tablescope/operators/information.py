"""Mutual information by nearest neighbours (ML2).

With a class as target: a point's radius is the distance to its k-th neighbour of the same class, and all points of any
class inside the radius are counted. With a number as target: the radius comes from the k-th neighbour in the plane of
feature and target (largest of both differences), and the points inside it are counted on either axis.
(Ross 2014; Kraskov, Stögbauer and Grassberger 2004.)

Everything works on distinct values with their counts, so a value that fills a third of a column is one row. Where a
point has k copies or more, its radius is 0 and its copies take the place of the k neighbours (Gao et al. 2017).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablescope.functions import expr as X
from tablescope.functions import stats as ST
from tablescope.plans import blocks as B
from tablescope.session import cut_lineage

# Neighbours of a point, fewest rows.
NEIGHBOURS, LEAST_ROWS = 3, 20
# Points at the radius itself are outside, also where a sum is rounded.
INSIDE = 1 - 1e-12
BLOCK = 100_000


def radius_in_class(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Adds ``r`` and ``near`` to ``counts(keys, x, w, kk)``: distance to the ``kk``-th other point of the key, and how many points that stands for.

    The neighbours of a value lie among the ``k`` distinct values on either side of it.
    """
    placed = B.blocks(B.ordered(counts, keys, ["x"]), keys, BLOCK, k, k)
    order = Window.partitionBy(*keys, "_block").orderBy("_rn")
    sides = [F.struct(F.abs(F.col("x") - f("x", j).over(order)).alias("d"), f("w", j).over(order).alias("w")) for f in (F.lag, F.lead) for j in range(1, k + 1)]
    rows = placed.withColumn("_nb", F.filter(F.array(*sides), lambda s: s["w"].isNotNull())).where("_own")
    zero = F.lit(0).cast("long")

    def within(d):
        return F.aggregate("_nb", zero, lambda a, s: a + F.when(s["d"] <= d, s["w"]).otherwise(zero))
    reached = F.transform(F.filter("_nb", lambda s: F.col("w") - 1 + within(s["d"]) >= F.col("kk")), lambda s: s["d"])
    r = F.when(F.col("w") > F.col("kk"), 0.0).otherwise(F.array_min(reached))
    return rows.select(*counts.columns, r.alias("r")).withColumn("near", F.when(F.col("r") == 0, F.col("w") - 1).otherwise(F.col("kk")))


def points_inside(values: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, inside): weight of ``values(keys, x, w)`` closer than ``r`` to ``queries(keys, id, x, r)``; with r = 0 at the same x.

    Values and both ends of every query are brought into one global order, in which running sums count.
    """
    none = F.lit(None).cast(queries.schema["id"].dataType)
    reach = F.col("r") * F.lit(INSIDE)
    data = values.select(*keys, F.col("x").alias("at"), F.lit(1).alias("turn"), F.col("w").cast("long").alias("w"), none.alias("id"), F.lit(0).alias("sign"))
    # turn 0 counts what is smaller than the end, turn 2 what is at most the end
    ends = F.inline(F.array(
        F.struct((F.col("x") + reach).alias("at"), F.when(F.col("r") > 0, 0).otherwise(2).alias("turn"), F.lit(1).alias("sign")),
        F.struct((F.col("x") - reach).alias("at"), F.when(F.col("r") > 0, 2).otherwise(0).alias("turn"), F.lit(-1).alias("sign"))))
    asked = queries.select(*keys, "id", ends).select(*keys, "at", "turn", F.lit(0).cast("long").alias("w"), "id", "sign")
    placed = B.ordered(data.union(asked), keys, ["at", "turn"], running={"upto": "w"})
    return placed.where("sign <> 0").groupBy(*keys, "id").agg(F.sum(F.col("sign") * F.col("upto")).cast("long").alias("inside"))


def _ranked(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy(F.lit(1)).orderBy(F.round("mi_score", 9).desc(), "feature")  # one row per feature
    return scores.where(F.col("n") >= LEAST_ROWS).withColumn("mi_score", F.greatest(F.lit(0.0), "mi_score")).withColumn("rank", F.row_number().over(order))


def with_classes(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(feature, n, mi_score, rank) of ``rows(feature, x, y)``, y a class; classes of a single row are left out."""
    counts = rows.groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("w"))
    sizes = counts.groupBy("feature", "y").agg(F.sum("w").alias("nc")).where("nc > 1")
    counts = cut_lineage(counts.join(sizes, ["feature", "y"]).withColumn("kk", F.least(F.lit(k), F.col("nc") - 1)))
    total = counts.groupBy("feature").agg(F.sum("w").alias("n"))
    near = cut_lineage(radius_in_class(counts, ["feature", "y"], k).withColumn("id", F.monotonically_increasing_id()))
    inside = points_inside(counts.groupBy("feature", "x").agg(F.sum("w").alias("w")), near, ["feature"])
    psi = [ST.digamma(F.col(c)) for c in ("near", "nc", "inside")]
    mean = near.join(inside, ["feature", "id"]).groupBy("feature").agg((F.sum(F.col("w") * (psi[0] - psi[1] - psi[2])) / F.sum("w")).alias("mean"))
    return _ranked(mean.join(F.broadcast(total), "feature").select("feature", "n", (ST.digamma(F.col("n")) + F.col("mean")).alias("mi_score")))


def with_numbers(rows: DataFrame, features: list[str], target: str, k: int = NEIGHBOURS) -> DataFrame:
    """(feature, n, mi_score, rank) of numeric columns without nulls; every column is divided by its standard deviation."""
    from tablescope.operators.ml import neighbours

    names = [*features, target]
    sd = rows.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(X.ref(c)).alias(f"s{i}") for i, c in enumerate(names)]).first()
    n = sd["n"]
    if n < LEAST_ROWS:
        return X.lit_rows(rows, [], "feature string, n bigint, mi_score double, rank int")

    def scaled(i: int) -> Column:
        return X.ref(names[i]) / F.lit(sd[f"s{i}"] or 1.0) + F.lit(0.0)
    parts = []
    for i, c in enumerate(features):
        points = rows.select(scaled(i).alias("x0"), scaled(len(features)).alias("x1")).groupBy("x0", "x1").agg(F.count(F.lit(1)).alias("w"))
        points = cut_lineage(points.withColumn("id", F.monotonically_increasing_id()))
        kk = min(k, n - 1)
        r = neighbours(points, ["x0", "x1"], kk, norm="max").groupBy("id").agg(F.max("dist").alias("r"))
        parts.append(points.join(r, "id").select(F.lit(c).alias("feature"), "id", "x0", "x1", "w", "r", F.when(F.col("r") == 0, F.col("w") - 1).otherwise(kk).alias("near")))
    near = cut_lineage(reduce(DataFrame.unionByName, parts))
    axes = near.select("feature", "id", "w", "r", F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"x{a}").alias("x")) for a in (0, 1)])))
    values = axes.groupBy("feature", "axis", "x").agg(F.sum("w").alias("w"))
    inside = points_inside(values, axes, ["feature", "axis"])
    psi = inside.groupBy("feature", "id").agg(F.sum(ST.digamma(F.col("inside"))).alias("psi"))
    mean = near.join(psi, ["feature", "id"]).groupBy("feature").agg((F.sum(F.col("w") * (ST.digamma(F.col("near")) - F.col("psi"))) / F.sum("w")).alias("mean"))
    return _ranked(mean.select("feature", F.lit(n).cast("long").alias("n"), (ST.digamma(F.lit(n)) + F.col("mean")).alias("mi_score")))
