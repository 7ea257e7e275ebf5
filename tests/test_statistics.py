import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.functions.shapiro import shapiro
from tablescope.functions.special import beta_quantile
from tablescope.operators import bivariate as BI
from tablescope.operators import governance as G
from tablescope.operators import groups as GR
from tablescope.operators import inference as I
from tablescope.operators import ml as ML
from tablescope.operators import multivariate as M
from tablescope.operators import search as SR
from tablescope.operators import univariate as U


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_shapiro_wilk_published_example():
    w, p = shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.002)


def test_shapiro_groups_skip_sizes_outside_the_limits(spark):
    df = frame(spark, g=["a"] * 50 + ["b"] * 2, x=list(np.random.default_rng(0).normal(size=52)))
    rows = U.shapiro_wilk(df, ["g"]).collect()
    assert [r["g"] for r in rows] == ["a"] and rows[0]["pvalue"] > 0.05


def test_beta_quantile_closed_forms():
    a, b = np.array([1.0, 1.0, 5.0]), np.array([1.0, 10.0, 1.0])
    assert beta_quantile(0.3, a, b) == pytest.approx([0.3, 1 - 0.7 ** 0.1, 0.3 ** 0.2], abs=1e-9)


def test_qq_band_contains_a_normal_sample(spark):
    x = np.random.default_rng(3).normal(size=400)
    df = frame(spark, x=x)
    rows = U.qq_band(df, ["x"]).join(U.qq_points(df, ["x"]).select("i", "sample"), "i").collect()
    inside = np.mean([r["lower"] <= r["sample"] <= r["upper"] for r in rows])
    assert len(rows) == 400 and inside > 0.9


def test_pca_and_vif_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    x[:, 3] = x[:, 0] * 0.9 + 0.1 * x[:, 3]
    df = frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2], d=x[:, 3])
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    got = [r["explained_pct"] for r in M.pca(df, ["a", "b", "c", "d"]).collect()]
    assert got == pytest.approx(values / values.sum() * 100, abs=1e-8)
    expected = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert [r["vif"] for r in M.vif(df, ["a", "b", "c", "d"]).collect()] == pytest.approx(expected, rel=1e-8)
    scores = M.pca_scores(df, ["a", "b", "c", "d"]).agg(F.var_pop("pc1").alias("v")).first()["v"]
    assert scores == pytest.approx(values[0], rel=1e-8)


def test_constant_columns_give_zero_correlation(spark):
    df = frame(spark, a=[1.0] * 20, b=[float(i) for i in range(20)])
    assert BI.pearson_pairs(df, ["a", "b"]).first()["pearson_r"] == 0.0
    assert BI.spearman_pairs(df, ["a", "b"]).first()["spearman_rho"] == 0.0


def test_normality_gate_chooses_by_shape(spark):
    rng = np.random.default_rng(11)
    df = frame(spark, n=rng.normal(size=120), s=rng.exponential(size=120) ** 3, g=["u", "v"] * 60)
    got = {r["num"]: r["test"] for r in BI.num_cat_tests(df, ["n", "s"], ["g"]).collect()}
    assert got == {"n": "anova", "s": "kruskal_wallis"}


def test_normality_gate_reports_both_tests(spark):
    rng = np.random.default_rng(3)
    parts = {"large": rng.normal(size=6_000), "small": rng.exponential(size=300), "flat": np.full(20, 2.0), "pair": np.array([1.0, 9.0])}
    df = frame(spark, g=[k for k, v in parts.items() for _ in v], x=np.concatenate(list(parts.values())))

    def jb(x):
        z = (x - x.mean()) / x.std()
        return np.exp(-len(x) / 12 * ((z**3).mean() ** 2 + ((z**4).mean() - 3) ** 2 / 4))
    row = BI.normality_gate(df, ["x"], ["g"]).first()
    assert (row["n_groups"], row["test"], row["agree"]) == (3, "kruskal_wallis", True)
    assert row["lowest_jarque_bera"] == pytest.approx(min(jb(parts["large"]), jb(parts["small"])), rel=1e-6, abs=1e-12)
    assert row["n_shapiro"] <= 2 and row["lowest_p"] == row["lowest_shapiro"] < 0.05
    other = rng.normal(size=5_500)
    two = frame(spark, g=["large"] * 6_000 + ["other"] * 5_500, x=np.concatenate([parts["large"], other]))
    alone = BI.normality_gate(two, ["x"], ["g"]).first()
    assert alone["n_shapiro"] == 0 and alone["lowest_shapiro"] is None and alone["agree"]
    assert alone["lowest_p"] == alone["lowest_jarque_bera"] == pytest.approx(min(jb(parts["large"]), jb(other)), rel=1e-6)
    assert BI.normality_gate(df.limit(0), ["x"], ["g"]).count() == 0


def test_fdr_step_up(spark):
    p = [0.01, 0.04, 0.03, 0.002, 0.5]
    tests = frame(spark, pvalue=p, position=list(range(5)))
    got = {r["position"] for r in I.fdr_bh(tests).where("significant_fdr").collect()}
    assert got == {0, 1, 2, 3} or got == {0, 2, 3}
    order = np.argsort(p)
    k = max(i + 1 for i, j in enumerate(order) if p[j] <= (i + 1) / 5 * 0.05)
    assert got == set(order[:k].tolist())


def test_mutual_information_ranks_the_informative_feature_first(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 2000)
    df = frame(spark, good=y + rng.normal(scale=0.3, size=2000), noise=rng.normal(size=2000), y=[str(v) for v in y])
    rows = ML.mutual_information(df, ["noise", "good"], "y", "classification").orderBy("rank").collect()
    assert rows[0]["feature"] == "good" and rows[0]["mi_score"] > 0.3 > rows[1]["mi_score"]


def blobs():
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    x = np.concatenate([c + rng.normal(size=(200, 2)) for c in centres] + [rng.uniform(30, 40, size=(5, 2))])
    return x


def test_kmeans_finds_the_blobs(spark):
    x = blobs()[:600]
    df = frame(spark, a=x[:, 0], b=x[:, 1])
    sweep = ML.kmeans_sweep(df, ["a", "b"]).orderBy("k").collect()
    assert [r["k"] for r in sweep] == list(range(2, 9))
    assert max(sweep, key=lambda r: r["silhouette"])["k"] == 3
    assert sorted(r["n"] for r in ML.kmeans_best(df, ["a", "b"], k=3).collect()) == [200, 200, 200]


def test_kmeans_fits_share_their_rounds_and_tasks_stay_bounded(spark, monkeypatch):
    x = np.concatenate([blobs()[:600]] * 2 + [np.full((40, 2), 5.0)])
    df = frame(spark, a=x[:, 0], b=x[:, 1])
    rounds, parts, whole = [], [], ML._batch_sums

    def counted(data, *rest):
        rounds.append(1)
        parts.append(data.rdd.getNumPartitions())
        return whole(data, *rest)
    monkeypatch.setattr(ML, "_batch_sums", counted)
    monkeypatch.setattr(ML, "PART_ROWS", 100)
    sweep = {r["k"]: r for r in ML.kmeans_sweep(df, ["a", "b"]).collect()}
    assert len(rounds) < 2 * len(sweep) + 20  # one job a round for all seven fits, two to judge them
    assert min(parts) >= 13  # at most about a hundred rows a task
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    monkeypatch.setattr(ML, "_batch_sums", whole)
    labels = np.array([r["cluster"] for r in ML.kmeans_assign(df.coalesce(1), ["a", "b"], k=3).orderBy("z0", "z1").collect()])
    z = z[np.lexsort((z[:, 1], z[:, 0]))]
    centres = np.array([z[labels == c].mean(axis=0) for c in range(3)])
    assert abs(((z - centres[labels]) ** 2).sum() - sweep[3]["inertia"]) < 1e-2 * sweep[3]["inertia"]
    d = ((z[:, None] - z[None]) ** 2).sum(-1)
    size = np.bincount(labels)
    mean = np.stack([d[:, labels == c].sum(axis=1) / size[c] for c in range(3)], axis=1)
    at = np.arange(len(z))
    a = mean[at, labels] * size[labels] / (size[labels] - 1)
    mean[at, labels] = np.inf
    b = mean.min(axis=1)
    assert abs(((b - a) / np.maximum(a, b)).mean() - sweep[3]["silhouette"]) < 1e-6


def test_kmeans_of_few_distinct_vectors(spark):
    df = frame(spark, a=[0.0, 1.0, 1.0] * 20, b=[0.0, 2.0, 2.0] * 20)
    sweep = ML.kmeans_sweep(df, ["a", "b"]).collect()
    assert len(sweep) == 7 and all(abs(r["inertia"]) < 1e-9 and abs(r["silhouette"] - 1) < 1e-9 for r in sweep)
    assert sorted(r["n"] for r in ML.kmeans_best(df, ["a", "b"]).collect()) == [20, 40]


def test_balls_visit_only_leaves_whose_points_they_reach():
    from tablescope.functions import neighbours as N
    x = np.array([[float(v), 0.0] for v in (0, 0, 0, 0, 9, 9, 9, 9)])
    tree = N.KdTree(x, 2)
    leaf = tree.leaf_of(x)
    tree.settle({int(a): (4, x[leaf == a].min(axis=0), x[leaf == a].max(axis=0)) for a in set(leaf)}, 3)
    row, near = tree.leaves_in_reach(x, np.full(8, 5.0))
    kept = tree.touches(x[row], np.full(len(row), 5.0), near, "euclid")
    assert sorted(zip(row[kept].tolist(), near[kept].tolist(), strict=True)) == list(enumerate(leaf.tolist()))
    assert tree.touches(x[:1], np.array([9.0]), leaf[-1:], "max").all()


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, nn, axis=1)
    lrd = 1 / (np.maximum(dist, dist[nn][:, :, -1]).mean(axis=1) + 1e-10)
    return lrd[nn].mean(axis=1) / lrd


@pytest.mark.parametrize("leaf", [40, 10_000])
def test_lof_equals_brute_force_over_many_leaves(spark, leaf):
    x = blobs()
    df = frame(spark, a=x[:, 0], b=x[:, 1])
    got = np.sort([r["lof"] for r in ML.local_outlier_factor(df, ["a", "b"], leaf_size=leaf).collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    assert got == pytest.approx(np.sort(brute_lof(z, 20)), rel=1e-9)


def test_repeated_vectors_count_as_neighbours(spark):
    x = np.concatenate([np.zeros((400, 2)), np.random.default_rng(1).normal(size=(100, 2)) + 5])
    df = frame(spark, a=x[:, 0], b=x[:, 1])
    rows = ML.local_outlier_factor(df, ["a", "b"]).collect()
    assert len(rows) == 101 and sum(r["w"] for r in rows) == 500
    assert [r["lof"] for r in rows if r["w"] == 400] == [pytest.approx(1.0)]


def test_isolation_forest_flags_the_far_points(spark):
    x = blobs()
    df = frame(spark, a=x[:, 0], b=x[:, 1])
    rows = ML.isolation_forest(df, ["a", "b"]).orderBy(F.desc("score")).collect()
    assert all(r["z0"] > 2 for r in rows[:5]) and all(r["anomaly"] for r in rows[:5])
    flagged = sum(r["w"] for r in rows if r["anomaly"])
    assert 25 <= flagged <= 31
    both = {r["method"]: r["n_anomalies"] for r in ML.anomaly_consensus(df, ["a", "b"]).collect()}
    assert both["consensus"] <= min(both["isolation_forest"], both["local_outlier_factor"])
    hist = ML.anomaly_score_histogram(df, ["a", "b"]).groupBy("column").agg(F.count("*").alias("bins"), F.sum("n").alias("n")).collect()
    assert {r["column"]: r["bins"] for r in hist} == {"normal": 30, "anomaly": 20} and sum(r["n"] for r in hist) == len(x)


def test_hash_split_keeps_proportions_per_stratum(spark):
    df = spark.range(20_000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    out = G.train_valid_test_split(df, ["id"], "y").groupBy("y", "split").count().collect()
    total = {0: 18_000, 1: 2_000}
    for r in out:
        want = {"train": 0.7, "validation": 0.15, "test": 0.15}[r["split"]]
        assert r["count"] / total[r["y"]] == pytest.approx(want, abs=0.03)


def test_bm25_by_hand(spark):
    docs = ["apple banana apple", "banana cherry", "cherry date egg", "fig", None]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    top = SR.bm25_topk(df, "doc_id", "text", "Apple, cherry! cherry").collect()
    n, avg = 5, (3 + 2 + 3 + 1 + 0) / 5
    idf = lambda d: np.log((n - d + 0.5) / (d + 0.5) + 1)
    part = lambda tf, length, d: idf(d) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg))
    want = {0: part(2, 3, 1), 1: 2 * part(1, 2, 2), 2: 2 * part(1, 3, 2)}
    assert {r["doc"]: r["score"] for r in top} == pytest.approx(want)


def test_neighbours_and_counts_do_not_depend_on_blocks(spark, monkeypatch):
    from tablescope.operators import information as I
    monkeypatch.setattr(I, "BLOCK", 40)
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=700), 2)
    x[:230] = 0.25  # a third of the rows is one value
    y = np.where(x + rng.normal(scale=0.5, size=700) > 0.2, "a", "b").astype(object)
    y[5] = "alone"

    def psi(n):
        return sum(1 / np.arange(1, n)) - np.euler_gamma
    keep = y != "alone"
    total = 0.0
    for i in np.flatnonzero(keep):
        own = np.flatnonzero((y == y[i]) & (np.arange(700) != i))
        d = np.sort(np.abs(x[own] - x[i]))
        r = d[2]
        near = 3 if r > 0 else int((d == 0).sum())
        gap = np.abs(x[keep] - x[i])
        inside = int((gap < r * (1 - 1e-12)).sum()) if r > 0 else int((gap == 0).sum())
        total += psi(near) - psi(len(own) + 1) - psi(inside)
    want = psi(int(keep.sum())) + total / keep.sum()
    df = spark.createDataFrame([(float(a), b, float(-a)) for a, b in zip(x, y, strict=True)], "f double, y string, g double").repartition(6)
    got = {r["feature"]: r for r in ML.mutual_information(df, ["f", "g"], "y", "classification").collect()}
    assert got["f"]["mi_score"] == pytest.approx(max(want, 0), abs=1e-8) and got["g"]["mi_score"] == pytest.approx(max(want, 0), abs=1e-8)
    assert got["f"]["n"] == 699
    empty = ML.mutual_information(df.limit(5), ["f"], "g", "regression")
    assert empty.count() == 0 and ML.mutual_information(df, [], "y", "classification").count() == 0


@pytest.mark.parametrize("norm", ["euclid", "max"])
def test_neighbours_equal_brute_force_with_small_and_large_leaves(spark, monkeypatch, norm):
    monkeypatch.setattr(ML, "CUT_SAMPLE", 700)  # the first cuts come from a few rows: leaves are cut again
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(900, 2)), rng.normal(scale=1e-3, size=(600, 2)) + 5, rng.normal(scale=50, size=(20, 2))])
    w = np.where(np.arange(len(x)) % 50 == 0, 4, 1)
    df = spark.createDataFrame([(float(a), float(b), int(c), i) for i, ((a, b), c) in enumerate(zip(x, w, strict=True))], "z0 double, z1 double, w long, id long").repartition(5)
    _, placed = ML.search_tree(df, ["z0", "z1"], 10)
    sizes = [r["count"] for r in placed.groupBy("leaf").count().collect()]
    assert max(sizes) <= 20 and sum(sizes) == len(x)
    k = 25  # more than a leaf holds
    got = {}
    for r in ML.neighbours(df, ["z0", "z1"], k, 10, norm).collect():
        got.setdefault(r["id"], []).append((r["dist"], r["w"]))
    for i in range(len(x)):
        gap = np.abs(x - x[i])
        d = gap.max(1) if norm == "max" else np.sqrt((gap ** 2).sum(1))
        reach = np.sort(np.repeat(d, w - (np.arange(len(x)) == i)))[:k]
        mine = np.sort(np.repeat([a for a, _ in got[i]], [b for _, b in got[i]]))
        assert len(mine) == k and np.allclose(mine, reach)


def test_a_leaf_without_enough_points_has_a_finite_bound():
    from tablescope.functions.neighbours import KdTree
    x = np.random.default_rng(1).normal(size=(300, 2))
    tree = KdTree(x, 60)
    leaf = tree.leaf_of(x)
    tree.settle({int(v): (int((leaf == v).sum()), x[leaf == v].min(0), x[leaf == v].max(0)) for v in np.unique(leaf)}, 12)
    bound = tree.farthest(leaf, x, "euclid")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.isfinite(bound).all() and ((d <= bound[:, None]).sum(1) >= 12).all()
    assert np.median((d <= bound[:, None]).sum(1)) < 150


def test_split_cuts_every_stratum_to_the_row(spark):
    from tablescope.operators import governance as G
    sizes = {"huge": 2001, "some": 40, "three": 3, "two": 2, "one": 1, None: 7, "null": 10}
    rows = [(f"{s}{i}", s, 1.5) for s, n in sizes.items() for i in range(n)]
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "id string, s string, _h double").repartition(parts) if parts > 1 else spark.createDataFrame(rows, "id string, s string, x double")
        out = G.train_valid_test_split(df.select("id", "s"), ["id"], "s").collect()
        got = {}
        for r in out:
            got.setdefault(r["s"], []).append(r["split"])
        assert len(out) == len(rows)
        for s, n in sizes.items():
            small = [max(1, int(n * 0.15 + 0.5)) if n >= least else 0 for least in (3, 2)]
            assert [got[s].count(p) for p in ("validation", "test", "train")] == [*small, n - sum(small)], s
    first = {r["id"]: r["split"] for r in out}
    again = {r["id"]: r["split"] for r in G.train_valid_test_split(df.select("id", "s").repartition(3), ["id"], "s").collect()}
    assert first == again


def counted(df):
    """``df`` behind a function that counts the rows it hands on."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    return df.mapInArrow(run, df.schema), seen


def test_rank_tests_read_the_rows_once(spark):
    rng = np.random.default_rng(4)
    n = 400
    df, seen = counted(frame(spark, x=rng.normal(size=n).round(1), y=np.full(n, 0.1), g=list(rng.choice(["a", "b", "c"], n)), h=list(rng.choice(["u", "v"], n))))
    assert I.all_tests(df, ["x", "y"], ["g", "h"]).count() == 4
    assert seen.value <= 2 * n  # the levels of the groupings, and the counts of equal values
    before = seen.value
    BI.kruskal_wallis(df, ["x", "y"], ["g", "h"]).collect()
    assert seen.value - before == n


def test_moments_of_counts_equal_those_of_rows(spark):
    rng = np.random.default_rng(5)
    n = 900
    x = np.where(rng.random(n) < 0.1, None, rng.integers(0, 40, n) / 10 + 1e6)
    df = frame(spark, x=list(x), y=np.full(n, 0.1), g=list(rng.choice(["a", "b", None], n)), h=list(rng.choice(["u", "v", "w"], n)))
    long = GR.spread(GR.value_counts(df, ["x", "y"], ["g", "h"]), df, ["g", "h"])
    key = ["num", "cat", "grp"]
    got = {tuple(r[k] for k in key): r for r in GR.weighted_moments(long, 3).collect()}
    want = {tuple(r[k] for k in key): r for r in GR.moments(GR.grouped_long(df, ["x", "y"], ["g", "h"]), 3).collect()}
    assert got.keys() == want.keys() and len(want) == 10
    for k, w in want.items():
        for c in ("n", "mean", "std", "min", "max", "ss", "k"):
            assert got[k][c] == pytest.approx(w[c], rel=1e-6, abs=1e-12), (k, c)
        assert k[0] != "y" or got[k]["ss"] == got[k]["std"] == 0.0


def test_group_statistics_of_repeated_values_read_the_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 3_000
    df, seen = counted(frame(spark, x=rng.integers(0, 30, n) + 0.25, g=list(rng.choice(["a", "b", "c"], n))))
    got = {r["grp"]: r for r in BI.group_stats(df, ["x"], ["g"]).collect()}
    assert seen.value == n
    monkeypatch.setattr(BI, "MERGED", 10**9)  # quartiles from brackets
    assert {r["grp"]: r for r in BI.group_stats(df, ["x"], ["g"]).collect()} == got
    pdf = df.toPandas()
    for grp, x in pdf.groupby("g")["x"]:
        assert got[grp]["median"] == x.median() and got[grp]["mean"] == pytest.approx(x.mean())


def test_distinct_vectors_are_made_once(spark):
    rng = np.random.default_rng(8)
    n = 600
    df, seen = counted(frame(spark, a=rng.integers(0, 20, n) * 1.0, b=rng.integers(0, 9, n) * 1.0).repartition(3))
    ML.M.correlation_of_complete_rows(df, ["a", "b"])
    moments = seen.value  # rows read for means and deviations
    vectors, _, rows = ML._distinct(df, ["a", "b"])
    assert (rows, vectors.count()) == (n, len(df.distinct().collect()))
    assert seen.value == moments + moments + n + n  # the same, the vectors, and the line above


def test_metadata_tables_start_no_python_worker(spark, capsys):
    from tablescope.functions import expr as X
    rows = [("a", True, 1, 0.5, 2), (None, None, None, None, None)]
    df = X.lit_rows(spark.range(1), rows, "s string, b boolean, n bigint, x double, i int")
    df.explain()
    assert "LocalTableScan" in capsys.readouterr().out
    assert [tuple(r) for r in df.collect()] == rows and df.schema.simpleString() == "struct<s:string,b:boolean,n:bigint,x:double,i:int>"
    assert X.lit_rows(df, [], "s string, n bigint").collect() == []
