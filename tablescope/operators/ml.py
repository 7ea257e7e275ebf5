"""Exploratory machine learning (ML1-ML9)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.context import PROBLEM_TYPES
from tablescope.functions import expr as X
from tablescope.functions import kmeans as K
from tablescope.functions import neighbours as N
from tablescope.operators import information as I
from tablescope.operators import multivariate as M
from tablescope.operators import univariate as U
from tablescope.plans import blocks as B
from tablescope.session import cut_lineage

# Fewest rows, cluster range, forest and neighbourhood sizes, share flagged.
KM_ROWS, KM_MAX, SEED = 20, 8, 42
# A fit stops when no centre moves further than this (in standard deviations).
KM_TOLERANCE = 5e-3
# Distinct vectors from which the fits start, rows of a task of an iterative fit.
KM_SAMPLE, PART_ROWS = 200_000, 500_000
AN_ROWS, TREES, TREE_ROWS, NEIGHBOURS, FLAGGED = 21, 100, 256, 20, 0.05
# Points per leaf of the neighbour search (a leaf of twice as many is split), rows of the driver-side sample that places cuts.
LEAF, CUT_SAMPLE = 2_000, 50_000
# Points per region of the outlier factor: at most, at least (where the cores need more regions); rows dealt to regions at
# a time; bytes of requests between regions that are broadcast.
REGION, LEAST_REGION, DEALT, ASKED = 50_000, 5_000, 500_000, 64 << 20


def validate_target(df: DataFrame, target: str | None, problem_type: str | None) -> DataFrame:
    """ML1: is the target usable, and if not, why."""
    schema = "target string, valid boolean, reason string"
    if not target or target not in df.columns:
        reason = "target missing" if not target else "target not in the table"
        return X.lit_rows(df, [(target, False, reason)], schema)
    n = F.col("n")
    bad_type = F.lit(problem_type not in PROBLEM_TYPES)
    reason = F.when(n == 0, "target is all null").when(bad_type, "problem type must be classification or regression")
    return df.agg(F.count(X.ref(target)).alias("n")).select(
        F.lit(target).alias("target"), reason.isNull().alias("valid"), reason.alias("reason"))


def _complete(df: DataFrame, columns: list[str], extra: list = ()) -> DataFrame:
    return df.select(*[X.double(df, c).alias(c) for c in columns], *extra).dropna()


def mutual_information(df: DataFrame, features: list[str], target: str, problem_type: str) -> DataFrame:
    """ML2: mutual information (nats) of every feature with the target by nearest neighbours, ranked.

    Rows in which a feature or the target is null take no part; under 20 rows there is no result.
    """
    features = [c for c in features if c != target]
    if not features:
        return X.lit_rows(df, [], "feature string, n bigint, mi_score double, rank int")
    if problem_type != "classification":
        return I.with_numbers(_complete(df, [*features, target]), features, target)
    rows = _complete(df, features, [X.text(df, target).alias("_y")])
    return I.with_classes(rows.select(X.rows(*[F.struct(F.lit(c).alias("feature"), (X.ref(c) + F.lit(0.0)).alias("x"), F.col("_y").alias("y")) for c in features])))


def _standardized(df: DataFrame, columns: list[str], keep: list[str] = ()) -> tuple[DataFrame, int]:
    """Complete rows with z-scores ``z0..`` (population sd) next to ``keep``; and their number."""
    n, mean, sd, _ = M.correlation_of_complete_rows(df, columns)
    z = [((X.double(df, c) - F.lit(float(mean[i]))) / F.lit(float(sd[i] or 1.0))).alias(f"z{i}") for i, c in enumerate(columns)]
    names = [f"z{i}" for i in range(len(columns))]
    return df.select(*[X.ref(c) for c in keep], *z).dropna(subset=names), int(n)


def _spread(df: DataFrame, n: int) -> DataFrame:
    """Iterative fits touch the rows many times: use every core even if the input is one file, and no more than
    ``PART_ROWS`` of ``n`` rows in a task. A table with enough partitions is left as it is."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def _start_sample(data: DataFrame, names: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, weights) of about ``KM_SAMPLE`` distinct vectors drawn by hash, all of them if there are few."""
    share = min(1.0, KM_SAMPLE / n)
    while True:
        # a table of few distinct vectors needs a larger share of them
        low = data if share >= 1 else data.where(F.xxhash64(F.lit(SEED), *names) < -(1 << 63) + int((1 << 64) * share))
        drawn = low.groupBy(*names).agg(F.count(F.lit(1)).alias("w")).orderBy(F.xxhash64(F.lit(SEED), *names), *names).limit(2 * KM_SAMPLE).toPandas()
        if share >= 1 or len(drawn) >= KM_SAMPLE // 4:
            return drawn[names].to_numpy(float).T.copy(), drawn["w"].to_numpy(float)
        share = min(1.0, 16 * share)


def _batch_sums(data: DataFrame, names: list[str], work, fields: list[str]) -> pd.DataFrame:
    """Adds up, over all Arrow batches and tasks, the rows (fit, cluster, fields) that ``work`` yields for the columns of a batch."""
    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                for fit, rows in work(x):
                    for cluster, row in enumerate(rows):
                        total[fit, cluster] = total.get((fit, cluster), 0.0) + row
        keys = sorted(total)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                               *[pa.array([float(total[k][i]) for k in keys], pa.float64()) for i in range(len(fields))]], ["fit", "cluster", *fields])
    types = ", ".join(f"{f} double" for f in fields)
    sums = data.select(*names).mapInArrow(run, f"fit int, cluster int, {types}").groupBy("fit", "cluster").agg(*[F.sum(f).alias(f) for f in fields])
    # one row per cluster
    return sums.toPandas().sort_values(["fit", "cluster"]).set_index("fit")


def _table_of(found: pd.DataFrame, fit: int) -> np.ndarray:
    return found.loc[[fit]].drop(columns="cluster").to_numpy(float)


def _fit(data: DataFrame, names: list[str], n: int, ks: list[int], rounds: int) -> dict[int, np.ndarray]:
    """Lloyd's centres for every k, from one job a round for all fits that still move.

    The starts are fits of a bounded sample; every round assigns all rows, and a fit ends when a round over
    all rows moves no centre further than ``KM_TOLERANCE``.
    """
    sc = data.sparkSession.sparkContext
    sample = sc.broadcast(_start_sample(data, names, n))
    centres = dict(sc.parallelize(ks, len(ks)).map(lambda k: (k, K.start(*sample.value, k, SEED, rounds, KM_TOLERANCE))).collect())
    sample.destroy()
    fields = ["n", *[f"s{i}" for i in range(len(names))]]
    moving = list(ks)
    for _ in range(rounds):
        if not moving:
            break
        now = {k: centres[k] for k in moving}

        def work(x, now=now):
            for k, c in now.items():
                yield k, K.sums(x, K.nearest(x, c)[0], len(c))
        found = _batch_sums(data, names, work, fields)
        for k in list(moving):
            new = K.moved(centres[k], _table_of(found, k))
            gap = np.sqrt(((new - centres[k]) ** 2).sum(axis=1).max())
            centres[k] = new
            if gap <= KM_TOLERANCE:
                moving.remove(k)
    return centres


def _judge(data: DataFrame, names: list[str], centres: dict[int, np.ndarray]) -> list[tuple[int, float, float | None]]:
    """(k, inertia, silhouette) over all rows: one pass for the clusters' sums, one for the rows' silhouettes."""
    fields = ["n", *[f"s{i}" for i in range(len(names))], "squares", "cost"]

    def describe(x):
        norm = (x * x).sum(axis=0)
        for k, c in centres.items():
            label, best = K.nearest(x, c)
            cost = np.maximum(norm + 2 * best, 0.0)
            yield k, np.column_stack([K.sums(x, label, len(c)), np.bincount(label, norm, len(c)), np.bincount(label, cost, len(c))])
    found = _batch_sums(data, names, describe, fields)
    tables = {k: _table_of(found, k) for k in centres}
    several = {k: c for k, c in centres.items() if (tables[k][:, 0] > 0).sum() > 1}

    def judge(x):
        for k, c in several.items():
            t = tables[k]
            yield k, [np.array([K.silhouettes(x, K.nearest(x, c)[0], t[:, :-2], t[:, -2]).sum()])]
    scores = _batch_sums(data, names, judge, ["silhouette"])["silhouette"] if several else {}
    return [(k, float(t[:, -1].sum()), float(scores[k] / t[:, 0].sum()) if k in several else None) for k, t in tables.items()]


def kmeans_sweep(df: DataFrame, columns: list[str]) -> DataFrame:
    """ML3: inertia and silhouette for k = 2 .. min(8, n // 5), all rows."""
    data, n = _standardized(df, columns)
    schema = "k int, inertia double, silhouette double"
    if n < KM_ROWS or len(columns) < 2:
        return X.lit_rows(df, [], schema)
    names = data.columns
    data = _spread(data, n).persist()
    try:
        out = _judge(data, names, _fit(data, names, n, list(range(2, min(KM_MAX, n // 5) + 1)), 100))
    finally:
        data.unpersist()
    return X.lit_rows(df, out, schema)


def kmeans_assign(df: DataFrame, columns: list[str], keep: list[str] = (), k: int | None = None, sweep: DataFrame | None = None) -> DataFrame:
    """ML4: every complete row with its cluster under the best k (by silhouette in ``sweep``)."""
    if k is None:
        best = (kmeans_sweep(df, columns) if sweep is None else sweep).orderBy(F.desc("silhouette"), "k").first()
        k = best["k"] if best else 2
    z, n = _standardized(df, columns, keep)
    names = [f"z{i}" for i in range(len(columns))]
    if n == 0:
        return z.withColumn("cluster", F.lit(0))
    data = _spread(z.select(*names), n).persist()
    try:
        centres = _fit(data, names, n, [k], 300)[k]
    finally:
        data.unpersist()
    gaps = F.array(*[reduce(lambda a, b: a + b, [(F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(names, centre, strict=True)]) for centre in centres])
    return z.withColumn("_gaps", gaps).withColumn("cluster", (F.array_position("_gaps", F.array_min("_gaps")) - 1).cast("int")).drop("_gaps")


def kmeans_best(df: DataFrame, columns: list[str], k: int | None = None, assigned: DataFrame | None = None) -> DataFrame:
    """ML4: cluster sizes of the best k (``assigned``: rows with their cluster, if known)."""
    sizes = (kmeans_assign(df, columns, k=k) if assigned is None else assigned).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return sizes.select("cluster", "n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).cast("int").alias("k"), X.pct2(F.col("n"), total).alias("pct"))


def cluster_projection(df: DataFrame, columns: list[str], k: int | None = None, assigned: DataFrame | None = None) -> DataFrame:
    """ML5: cluster members on the first two principal components (of the standardised columns)."""
    assigned = kmeans_assign(df, columns, k=k) if assigned is None else assigned
    _, _, _, corr = M.correlation_of_complete_rows(df, columns)
    values, vectors = np.linalg.eigh(corr)
    parts = []
    for p, i in enumerate(np.argsort(values)[::-1][:2]):
        v = vectors[:, i] * np.sign(vectors[np.abs(vectors[:, i]).argmax(), i])
        parts.append(reduce(lambda a, b: a + b, [F.col(f"z{j}") * F.lit(float(w)) for j, w in enumerate(v)]).alias(f"pc{p + 1}"))
    return assigned.select("cluster", *parts)


# ── anomalies: everything works on distinct standardised vectors with their multiplicity ──────

def _distinct(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str], int]:
    """Distinct vectors ``z0..`` with count ``w`` and a stable ``id``: a vector that fills a third of the
    table is one row from here on."""
    z, n = _standardized(df, columns)
    names = [f"z{i}" for i in range(len(columns))]
    v = z.groupBy(*names).agg(F.count(F.lit(1)).alias("w"))
    v = cut_lineage(v)  # first, as asking for the partitions of a table that is not settled makes it once more
    parts = df.sparkSession.sparkContext.defaultParallelism
    if v.rdd.getNumPartitions() < parts:  # few vectors
        v = cut_lineage(v.repartition(parts))
    return v.withColumn("id", F.monotonically_increasing_id()), names, n


def _worst(scored: DataFrame, value: str) -> DataFrame:
    """Adds ``anomaly``: above the linear-interpolated 95 % quantile of the rows (vectors weighted by count)."""
    return scored.withColumn("anomaly", F.col(value) > F.lit(B.weighted_cut(scored, value, "w", 1 - FLAGGED)))


def _forest(vectors: DataFrame, names: list[str]):
    """100 isolation trees on 256 rows each, drawn by hash; the node tables are at most 51,200 rows."""
    picked = TREES * TREE_ROWS
    copies = vectors.select(*names, "w", "id")
    # Rows of a repeated vector are as likely to be drawn as any other row: one hash per copy, at most
    # as many copies as could ever be drawn.
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("w"), F.lit(picked)).cast("int"))))
    # drawn by the vector's own values, so the sample is the same for any partitioning
    copies = copies.withColumn("h", F.xxhash64(F.lit(SEED), *names, "copy"))
    drawn = copies.orderBy("h", *names, "copy").limit(picked).withColumn(
        "place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("h", *names, "copy")))
    size = drawn.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    per_tree = min(TREE_ROWS, size)
    if size >= picked:
        dealt = drawn.withColumn("tree", F.pmod(F.col("place"), F.lit(TREES)))
    else:
        # Small table: every tree draws from all rows.
        each = drawn.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
        pick = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64("tree", "h"), "place"))
        dealt = each.withColumn("r", pick).where(F.col("r") <= per_tree)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("place")[names].to_numpy()
        nodes = N.isolation_tree(x, SEED * 1000 + tree)
        return pd.DataFrame([(tree, i, *node) for i, node in enumerate(nodes)],
                            columns=["tree", "node", "feature", "cut", "lower", "upper", "depth"])

    table = dealt.groupBy("tree").applyInPandas(
        build, "tree int, node int, feature int, cut double, lower int, upper int, depth double").toPandas()
    trees = []
    for _, t in table.groupby("tree"):
        t = t.sort_values("node")
        trees.append(tuple(t[c].to_numpy() for c in ("feature", "cut", "lower", "upper", "depth")))
    return trees, per_tree


def isolation_scores(vectors: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``score`` to the vectors."""
    trees, size = _forest(vectors, names)
    shared = vectors.sparkSession.sparkContext.broadcast((trees, size))

    def score(frames):
        forest, n = shared.value
        for pdf in frames:
            yield pdf.assign(score=N.isolation_score(forest, n, pdf[names].to_numpy()))

    kept = [f for f in vectors.schema.fields if f.name not in names]
    types = ", ".join([*[f"{c} double" for c in names], *[f"{f.name} {f.dataType.simpleString()}" for f in kept]])
    return vectors.select(*names, *[f.name for f in kept]).mapInPandas(score, f"{types}, score double")


def _drawn(rows: DataFrame, n: int, seed: int) -> pd.DataFrame:
    """About ``CUT_SAMPLE`` of ``n`` rows, by hash."""
    if n > CUT_SAMPLE:
        rows = rows.where(F.xxhash64("id", F.lit(seed)) < -(1 << 63) + (1 << 64) * CUT_SAMPLE // n)
    return rows.limit(2 * CUT_SAMPLE).toPandas()


def search_tree(vectors: DataFrame, names: list[str], leaf_size: int) -> tuple[N.KdTree, DataFrame]:
    """(tree, vectors with their ``leaf``): no leaf holds more than twice ``leaf_size`` distinct vectors.

    A bounded sample places the first cuts; leaves that turn out too large are cut again from samples of their own.
    The vectors are placed whenever they are read, so ``vectors`` must be settled.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    tree = N.KdTree(_drawn(vectors, n, SEED)[names].to_numpy(float), max(1, n // leaf_size))
    types = ", ".join(f"{c} double" for c in names)
    seed, fruitless = SEED, 0
    while fruitless < 20:
        seed += 1
        shared = spark.sparkContext.broadcast(tree)

        def place(frames, shared=shared):
            for pdf in frames:
                yield pdf.assign(leaf=shared.value.leaf_of(pdf[names].to_numpy()))

        placed = vectors.select(*names, "w", "id").mapInPandas(place, f"{types}, w bigint, id bigint, leaf bigint")
        large = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * leaf_size).collect()}
        if not large:
            return tree, placed
        # as many leaves a round as leave each of them a sample of its own
        large = dict(sorted(large.items(), key=lambda x: (-x[1], x[0]))[:max(1, CUT_SAMPLE // 32)])
        inside = placed.join(F.broadcast(spark.createDataFrame([(x,) for x in large], "leaf bigint")), "leaf")
        sample = _drawn(inside, sum(large.values()), seed)
        grown = [tree.split(leaf, part[names].to_numpy(float), large[leaf] // leaf_size + 1) for leaf, part in sample.groupby("leaf")]
        fruitless = 0 if any(grown) else fruitless + 1
    raise RuntimeError("points too close to be told apart")


def neighbours(vectors: DataFrame, names: list[str], k: int = NEIGHBOURS, leaf_size: int = LEAF, norm: str = "euclid") -> DataFrame:
    """Exact k nearest neighbours: (id, nid, w, dist), weights adding up to k; ``norm`` is euclid or max.

    Each vector first searches its own leaf; the distance found bounds a ball, and only the leaves whose points' box this
    ball reaches are searched as well. A leaf with too few points takes its bound from the box of the smallest
    part of the tree that has enough. Queries of a busy leaf are split into batches of two leaves' size, each with
    its own copy of the leaf.
    """
    spark = vectors.sparkSession
    tree, placed = search_tree(vectors, names, leaf_size)
    placed = cut_lineage(placed)
    edges = placed.groupBy("leaf").agg(F.sum("w").alias("w"), *[f(c).alias(f"{t}_{c}") for c in names for t, f in (("lo", F.min), ("hi", F.max))]).toPandas()
    lo, hi = (edges[[f"{t}_{c}" for c in names]].to_numpy(float) for t in ("lo", "hi"))
    tree.settle({leaf: (w, lo[i], hi[i]) for i, (leaf, w) in enumerate(zip(edges["leaf"].tolist(), edges["w"].tolist(), strict=True))}, k + 1)
    tree = spark.sparkContext.broadcast(tree)
    types = ", ".join(f"{c} double" for c in names)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, w = pdf[names].to_numpy(), pdf["id"].to_numpy(), pdf["w"].to_numpy()
        q, p, d = N.nearest(x, ids, x, ids, w, k, norm)
        return pd.DataFrame({"id": ids[q], "nid": ids[p], "w": w[p] - (ids[q] == ids[p]), "dist": d, "home": pdf["leaf"].iloc[0]})

    found = cut_lineage(placed.groupBy("leaf").applyInPandas(local, "id bigint, nid bigint, w bigint, dist double, home bigint"))
    reach = found.groupBy("id").agg(F.when(F.sum("w") >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("radius"))
    queries = placed.select(*names, "id", F.col("leaf").alias("home")).join(reach, "id", "left").na.fill(float("inf"), ["radius"])

    def route(frames):
        for pdf in frames:
            x, radius = pdf[names].to_numpy(), pdf["radius"].to_numpy(float, copy=True)
            open_ = np.isinf(radius)
            radius[open_] = tree.value.farthest(pdf["home"].to_numpy()[open_], x[open_], norm)
            row, leaf = tree.value.leaves_in_reach(x, radius)
            near = leaf != pdf["home"].to_numpy()[row]
            near[near] = tree.value.touches(x[row[near]], radius[row[near]], leaf[near], norm)
            yield pdf.iloc[row[near]].assign(leaf=leaf[near])[[*names, "id", "leaf"]]

    routed = cut_lineage(queries.mapInPandas(route, f"{types}, id bigint, leaf bigint"))
    batches = routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * leaf_size)).cast("int").alias("batches"))
    visitors = routed.join(batches, "leaf").withColumn("batch", F.pmod(F.xxhash64("id"), F.col("batches")).cast("int")).drop("batches")
    hosts = placed.join(batches, "leaf").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).drop("batches")

    def visit(host: pd.DataFrame, guest: pd.DataFrame) -> pd.DataFrame:
        if len(host) == 0 or len(guest) == 0:
            return pd.DataFrame({"id": [], "nid": [], "w": [], "dist": []})
        ids, w = host["id"].to_numpy(), host["w"].to_numpy()
        gids = guest["id"].to_numpy()
        q, p, d = N.nearest(guest[names].to_numpy(), gids, host[names].to_numpy(), ids, w, k, norm)
        return pd.DataFrame({"id": gids[q], "nid": ids[p], "w": w[p], "dist": d})

    remote = hosts.groupBy("leaf", "batch").cogroup(visitors.groupBy("leaf", "batch")).applyInPandas(
        visit, "id bigint, nid bigint, w bigint, dist double")
    every = found.drop("home").unionByName(remote)
    order = Window.partitionBy("id").orderBy("dist", "nid")
    before = F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (every.withColumn("before", before).where(F.col("before") < k)
            .select("id", "nid", F.least(F.col("w"), k - F.col("before")).alias("w"), "dist"))


def _dealt(vectors: DataFrame, names: list[str], size: int) -> tuple[DataFrame, int]:
    """(region, data) with the packed vectors of regions of about ``size`` points, several rows a region, and the number of regions."""
    tree, _ = search_tree(vectors, names, size)
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def deal(batches):
        held, rows = [], 0

        def out():
            x, w = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            leaf = shared.value.leaf_of(x)
            order = np.argsort(leaf, kind="stable")
            starts = N.runs(leaf[order])
            parts = [order[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            return pa.record_batch([pa.array([int(leaf[p[0]]) for p in parts], pa.int64()),
                                    pa.array([N.pack(**_coordinates(x[p]), w=w[p]) for p in parts], pa.binary())], ["region", "data"])
        for batch in batches:
            if batch.num_rows:
                held.append((np.column_stack([batch[c].to_numpy() for c in names]), batch["w"].to_numpy()))
                rows += batch.num_rows
                if rows >= DEALT:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()
    return vectors.select(*names, "w").mapInArrow(deal, "region bigint, data binary"), tree.leaves


def _coordinates(x: np.ndarray) -> dict[str, np.ndarray]:
    return {f"x{j}": np.ascontiguousarray(x[:, j]) for j in range(x.shape[1])}


def _points(found: dict[str, np.ndarray], m: int) -> np.ndarray:
    """The ``m`` coordinates of unpacked points; no rows where there are none."""
    return np.column_stack([found[f"x{j}"] for j in range(m)]) if found else np.zeros((0, m))


def _row(region: int, **data: bytes) -> pa.Table:
    return pa.table({"region": pa.array([region], pa.int64()), **{c: pa.array([v], pa.binary()) for c, v in data.items()}})


def lof_scores(vectors: DataFrame, names: list[str], k: int = NEIGHBOURS, leaf_size: int | None = None) -> DataFrame:
    """(z.., w, lof, id), ids of its own. The neighbours of a point are found again in each of three rounds (k-th distance,
    density, factor) and never written: a round writes one number a point.

    The vectors are dealt to regions, packed. A region searches itself first and tells the others the boxes of its points;
    then it asks, box by box, for the points of others that its balls can reach, and gets them with their number of the last round.
    """
    spark, m = vectors.sparkSession, len(names)
    size = leaf_size or min(REGION, max(LEAST_REGION, vectors.count() // (4 * spark.sparkContext.defaultParallelism)))
    dealt, parts = _dealt(vectors, names, size)

    def settle(key, table):
        found = N.unpack(table["data"].to_pylist())
        x = _points(found, m)
        order, cell, box = N.cells(x, N.CELL, N.BOX)
        x, w = x[order], found["w"][order]
        region = N.Region(x, w, cell, np.zeros((0, m)), w[:0], k)
        reach = N.kth(region, region.bounds())
        starts = N.runs(box)
        lo, hi = N.boxes(x, starts)
        told = N.pack(box=box[starts[:-1]], w=np.add.reduceat(w, starts[:-1]), **_coordinates(np.concatenate([lo, hi], axis=1)))
        return _row(key[0].as_py(), data=N.pack(**_coordinates(x), w=w, cell=cell, box=box, reach=reach), told=told)

    settled = cut_lineage(dealt.repartition(parts, "region").groupBy("region").applyInArrow(settle, "region bigint, data binary, told binary"))
    told = [(r["region"], N.unpack([r["told"]])) for r in settled.select("region", "told").collect()]
    corners = np.concatenate([_points(t, 2 * m) for _, t in told])
    every = spark.sparkContext.broadcast(N.Boxes(np.concatenate([np.full(len(t["w"]), r) for r, t in told]), np.concatenate([t["box"] for _, t in told]),
                                                 np.concatenate([t["w"] for _, t in told]), corners[:, :m], corners[:, m:]))

    def ask(batches):
        for batch in batches:
            for number, data in zip(batch["region"].to_pylist(), batch["data"].to_pylist(), strict=True):
                found = N.unpack([data])
                asks = [(to, N.pack(box=box, **_coordinates(np.concatenate([lo, hi], axis=1))))
                        for to, box, lo, hi in every.value.asks(number, _points(found, m), found["cell"], found["reach"], k)]
                if asks:
                    yield pa.record_batch([pa.array([a[0] for a in asks], pa.int64()), pa.array([number] * len(asks), pa.int64()),
                                           pa.array([a[1] for a in asks], pa.binary())], ["region", "asker", "wanted"])

    asked = settled.select("region", "data").mapInArrow(ask, "region bigint, asker bigint, wanted binary")
    asked = cut_lineage(asked.groupBy("region").agg(F.collect_list(F.struct("asker", "wanted")).alias("asks")))
    n_bytes = asked.agg(F.sum(F.aggregate("asks", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["wanted"])))).first()[0] or 0
    if n_bytes <= ASKED:
        asked = F.broadcast(asked)

    def answers(table: DataFrame, carried: list[str]) -> DataFrame:
        def answer(batches):
            for batch in batches:
                for data, asks in zip(batch["data"], batch["asks"], strict=True):
                    found = N.unpack([data.as_py()])
                    x, starts, out = _points(found, m), N.runs(found["box"]), []
                    at = {int(b): i for i, b in enumerate(found["box"][starts[:-1]])}
                    for one in asks.as_py():
                        wanted = N.unpack([one["wanted"]])
                        rows = []
                        for box, edge in zip(wanted["box"].tolist(), _points(wanted, 2 * m), strict=True):
                            a, b = starts[at[box]], starts[at[box] + 1]
                            rows.append(a + np.flatnonzero(((x[a:b] >= edge[:m]) & (x[a:b] <= edge[m:])).all(axis=1)))
                        rows = np.concatenate(rows)
                        if len(rows):
                            out.append((one["asker"], N.pack(**_coordinates(x[rows]), **{c: found[c][rows] for c in ("w", *carried)})))
                    if out:
                        yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["region", "data"])
        return table.select("region", "data").join(asked, "region").select("data", "asks").mapInArrow(answer, "region bigint, data binary")

    def round_(table: DataFrame, carried: list[str], work) -> DataFrame:
        """One more number for every point from ``work(region, own columns, the carried columns of own and others' points)``."""
        def meet(key, left, right):
            own, guests = N.unpack(left["data"].to_pylist()), N.unpack(right["data"].to_pylist())
            x = _points(own, m)
            region = N.Region(x, own["w"], own["cell"], _points(guests, m), guests["w"] if guests else own["w"][:0], k)
            both = {c: np.concatenate([own[c], guests[c][region.order]]) if guests else own[c] for c in carried}
            return _row(key[0].as_py(), data=N.pack(**own | work(region, own, both)))
        own, others = (t.select("region", "data").repartition(parts, "region").groupBy("region") for t in (table, answers(table, carried)))
        return cut_lineage(own.cogroup(others).applyInArrow(meet, "region bigint, data binary"))

    settled = round_(settled, [], lambda region, own, _: {"reach": N.kth(region, own["reach"], own["reach"])})
    settled = round_(settled, ["reach"], lambda region, own, both: {"lrd": N.density(region, own["reach"], np.sqrt(both["reach"]))})
    settled = round_(settled, ["lrd"], lambda region, own, both: {"lof": N.outlier_factor(region, own["reach"], both["lrd"])})

    def rows(batches):
        for batch in batches:
            for data in batch["data"].to_pylist():
                found = N.unpack([data])
                yield from pa.table([found[f"x{j}"] for j in range(m)] + [found["w"], found["lof"]], [*names, "w", "lof"]).to_batches(10_000)
    types = ", ".join(f"{c} double" for c in names)
    return settled.select("data").mapInArrow(rows, f"{types}, w bigint, lof double").withColumn("id", F.monotonically_increasing_id())


def isolation_forest(df: DataFrame, columns: list[str]) -> DataFrame:
    """ML6: score per distinct vector (with its row count ``w``); the worst 5 % of the rows are flagged."""
    vectors, names, n = _distinct(df, columns)
    if n < AN_ROWS:
        return X.lit_rows(df, [], "id bigint, w bigint, score double, anomaly boolean")
    return _worst(cut_lineage(isolation_scores(vectors, names)), "score")


def local_outlier_factor(df: DataFrame, columns: list[str], leaf_size: int | None = None) -> DataFrame:
    """ML7: exact LOF with 20 neighbours per distinct vector; the worst 5 % of the rows are flagged."""
    vectors, names, n = _distinct(df, columns)
    if n < AN_ROWS:
        return X.lit_rows(df, [], "id bigint, w bigint, lof double, anomaly boolean")
    return _worst(lof_scores(vectors, names, leaf_size=leaf_size).select("id", *names, "w", "lof"), "lof")


def anomaly_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Both detectors on the same vectors: (id, z.., w, score, iso, lof, lof_flag)."""
    vectors, names, n = _distinct(df, columns)
    if n < AN_ROWS:
        return X.lit_rows(df, [], "id bigint, w bigint, score double, iso boolean, lof double, lof_flag boolean")
    both = cut_lineage(isolation_scores(lof_scores(vectors, names), names))
    both = _worst(_worst(both, "score").withColumnRenamed("anomaly", "iso"), "lof").withColumnRenamed("anomaly", "lof_flag")
    return both.select("id", *names, "w", "score", "iso", "lof", "lof_flag")


def anomaly_consensus(df: DataFrame, columns: list[str], found: DataFrame | None = None) -> DataFrame:
    """ML8: rows flagged by each detector and by both (``found``: the ``anomaly_table``, if known)."""
    w = F.col("w")

    def rows(cond):
        return F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).cast("bigint")
    one = (anomaly_table(df, columns) if found is None else found).agg(F.sum(w).alias("total"), rows(F.col("iso")).alias("a"), rows(F.col("lof_flag")).alias("b"),
                                         rows(F.col("iso") & F.col("lof_flag")).alias("c"))
    return one.select(X.rows(*[F.struct(F.lit(name).alias("method"), F.col(c).alias("n_anomalies"), X.pct2(F.col(c), F.col("total")).alias("pct"))
                               for name, c in (("isolation_forest", "a"), ("local_outlier_factor", "b"), ("consensus", "c"))]))


def anomaly_score_histogram(df: DataFrame, columns: list[str], found: DataFrame | None = None) -> DataFrame:
    """ML9: isolation scores in 30 bins (normal) and 20 bins (flagged)."""
    s = cut_lineage(isolation_forest(df, columns)) if found is None else found.withColumnRenamed("iso", "anomaly")
    kinds = [U.binned(s.where(cond).select(F.lit(name).alias("column"), F.col("score").alias("x"), "w"), bins, "w")
             for name, cond, bins in (("normal", ~F.col("anomaly"), 30), ("anomaly", F.col("anomaly"), 20))]
    return kinds[0].unionByName(kinds[1])
