import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablescope.context import AcceptedFeature, AnalysisContext, CleaningAction
from tablescope.operators import cleaning as C
from tablescope.operators import features as FE
from tablescope.operators import quality as Q
from tablescope.operators import semantic as S
from tablescope.plans.pipeline import run_analysis
from tablescope.sources import files as SF
from tablescope.sources import sampling as SA


def test_typing_rules_in_order(spark):
    n = 200
    rows = [(i % 2, float(i % 2), None, "yes" if i % 2 else "no", str(dt.date(2024, 1, 1) + dt.timedelta(i)),
             "2024-01-01" if i % 2 else "word", float(i % 7), i, i % 20, i % 60, Decimal(i % 50), f"a long sentence about number {i} and more words",
             [i], dt.datetime(2024, 1, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "b01 int, f01 double, allnull string, yn string, iso string, halfdate string, lat double, `user id` bigint, "
                               "small_int int, big_int int, price decimal(10,2), longtext string, arr array<int>, ts timestamp_ntz")
    assert S.type_map(df, {"big_int": "categorical_ordinal"}) == {
        "b01": "boolean", "f01": "numeric_continuous", "allnull": "boolean", "yn": "boolean", "iso": "id", "halfdate": "categorical_nominal",
        "lat": "geographic", "user id": "id", "small_int": "numeric_discrete", "big_int": "categorical_ordinal", "price": "numeric_continuous",
        "longtext": "id", "arr": "unknown", "ts": "datetime"}


def test_iso_strings_and_text_below_the_id_share(spark):
    rows = [(str(dt.date(2024, 1, 1) + dt.timedelta(i % 50)), f"a long sentence about number {i % 70} and more") for i in range(100)]
    assert S.type_map(spark.createDataFrame(rows, "d string, t string")) == {"d": "datetime", "t": "text"}


def test_strip_handles_every_white_space(spark):
    df = spark.createDataFrame([(" a",), ("a\t",), (" a\n",), (None,)], "s string")
    assert [r["s"] for r in C.trim_whitespace(df, "s").collect()] == ["a", "a", "a", None]


def test_cleaning_is_idempotent_and_ignores_unknown_actions(spark):
    df = spark.createDataFrame([("N/A", 1), ("x ", 1), ("x ", 1), (None, 2)], "s string, i int")
    actions = [CleaningAction("replace_values", "s", {"match_mode": "exact_case_insensitive_trimmed", "values": ["n/a"]}),
               CleaningAction("trim_whitespace", "s"), CleaningAction("drop_duplicate_rows"), CleaningAction("what", "s"),
               CleaningAction("trim_whitespace", "i"), CleaningAction("exclude_column", "nope")]
    once = C.apply_cleaning(df, actions)
    key = lambda rows: sorted((str(r["s"]), r["i"]) for r in rows)
    assert key(once.collect()) == [("None", 1), ("None", 2), ("x", 1)]
    assert key(C.apply_cleaning(once, actions).collect()) == key(once.collect())


def test_features_follow_each_other_and_warn(spark):
    df = spark.createDataFrame([("2", 10.0, 0.0, 25.0, "2024-03-05"), ("x", 0.0, 5.0, 50.0, "bad")], "q string, p double, z double, d double, day string")
    out, warnings = FE.apply_features(df, [
        AcceptedFeature("rev", "revenue", ("q", "p"), "q * p"), AcceptedFeature("r", "ratio", ("p", "z"), "p / z"),
        AcceptedFeature("net", "discount", ("rev", "d"), "rev * (1 - d / 100)"), AcceptedFeature("m", "derived_feature", ("day",), "Month( day )"),
        AcceptedFeature("bad", "ratio", ("p", "nope"), "p / nope"), AcceptedFeature(None, "ratio", (), None)])
    a, b = out.collect()
    assert (a["rev"], a["r"], a["net"], a["m"]) == (20.0, None, 15.0, 3)
    assert (b["rev"], b["r"], b["net"], b["m"]) == (None, 0.0, None, None)
    assert warnings.count() == 2


def test_missing_clusters_join_equal_patterns_first(spark):
    df = spark.createDataFrame([(None, None, 1), (None, None, None), (1, 1, None), (1, 1, 1)], "a int, b int, c int")
    first = Q.missing_clusters(df).orderBy("step").first()
    assert {first["left_columns"], first["right_columns"]} == {"a", "b"} and first["height"] == 0.0


def test_duplicates_count_nulls_as_equal_and_hash_long_text(spark):
    long = "t" * 500
    df = spark.createDataFrame([(long, None), (long, None), (long + "x", None), (None, 1)], "t string, i int")
    r = Q.duplicate_rows(df).first()
    assert (r["n_rows"], r["n_duplicate_rows"], r["n_removed_by_dedup"], r["n_unique_rows"]) == (4, 2, 1, 2)


def test_sample_is_exact_and_independent_of_partitions(spark):
    df = spark.range(5000).withColumn("x", F.col("id") % 7)
    one = SA.sample_fixed(df.repartition(1), 100, 1000).collect()
    many = SA.sample_fixed(df.repartition(8), 100, 1000).collect()
    assert len(one) == 100 and {r["id"] for r in one} == {r["id"] for r in many}
    assert SA.sample_fixed(df, 100, 5000).count() == 5000


def test_content_hash_ignores_order_but_not_values(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    a = SF.content_hash(df).first()["content_hash"]
    assert SF.content_hash(df.orderBy(F.desc("id")).repartition(5)).first()["content_hash"] == a
    assert SF.content_hash(df.withColumn("x", F.col("x") + 1)).first()["content_hash"] != a


def test_lenient_csv_keeps_going(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b;c\n1;x;2024-01-02\nbad;y;2024-01-03\n2;z;2024-01-04;extra\n")
    df = SF.read_csv_lenient(spark, str(tmp_path / "a.csv"), "a int, b string, c date")
    assert [(r["a"], r["b"]) for r in df.collect()] == [(1, "x"), (None, "y"), (2, "z")]
    with pytest.raises(Exception):
        SF.read_csv_strict(spark, str(tmp_path / "a.csv"), "a int").collect()


def test_lenient_csv_types_every_cell(spark, tmp_path):
    lines = [f"{i},{i},{i / 2},true,2024-01-0{1 + i % 9},x{i},99999999999999999999" for i in range(30_000)]
    lines[25_000] = "25000,odd,1d,TRUE,2024-02-30,,7"
    lines[26_000] = "26000,5, 2.5 ,,2024-01-01 10:00:00,y,8,surplus"
    path = tmp_path / "late.csv"
    path.write_text("id,a,b,c,d,e,f\n" + "\n".join(lines) + "\n")
    df = SF.read_csv_lenient(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "a": "string", "b": "string", "c": "boolean", "d": "string", "e": "string", "f": "decimal(38,0)"}
    assert df.where("id = 25000").first()["a"] == "odd"
    df = SF.read_csv_lenient(spark, str(path), bad_share=0.001, keep_bad="odd_cells")
    assert dict(df.dtypes)["a"] == "bigint" and dict(df.dtypes)["b"] == "double" and dict(df.dtypes)["d"] == "date"
    rows = {r["id"]: r for r in df.where("odd_cells IS NOT NULL").collect()}
    assert set(rows) == {25_000, 26_000} and rows[25_000]["a"] is None and rows[26_000]["b"] == 2.5
    assert {tuple(c) for c in rows[25_000]["odd_cells"]} == {("a", "odd"), ("b", "1d"), ("d", "2024-02-30")}
    assert (None, lines[26_000]) in {tuple(c) for c in rows[26_000]["odd_cells"]}
    report = {r["column"]: r for r in SF.csv_report(spark, str(path), bad_share=0.001).collect()}
    assert (report["a"]["n_bad"], report["a"]["example"], report["e"]["n_filled"]) == (1, "odd", 29_999)
    assert report[None]["n_bad"] == 1 and report["id"]["n_rows"] == 30_000


def test_lenient_csv_of_edge_cases(spark, tmp_path):
    path = tmp_path / "edge.csv"
    path.write_text("a,a,t,z,n\n1,2,2024-01-01 10:00:00,2024-01-01T10:00:00Z,\n-3,1e3,2024-01-02,2024-01-01 10:00:00+02:00,\n")
    df = SF.read_csv_lenient(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "timestamp_ntz", "timestamp", "string"]
    assert [r[0] for r in df.collect()] == [1, -3]
    path.write_text("a,b\n")
    assert SF.read_csv_lenient(spark, str(path)).dtypes == [("a", "string"), ("b", "string")]
    path.write_text("")
    assert SF.read_csv_lenient(spark, str(path)).columns == []


def test_json_document_and_lines(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "l.json").write_text('{"a": 1}\n{"a": 2}\n')
    for name in ("d.json", "l.json"):
        assert sorted(r["a"] for r in SF.read_json(spark, str(tmp_path / name)).collect()) == [1, 2]


@pytest.mark.parametrize("target,valid", [(None, False), ("nowhere", False), ("target_null", False), ("target_valid", True)])
def test_target_selection(spark, target, valid):
    rows = [(float(1 + i % 5), float(5 - i % 5), 1.2 + 2.2 * (i % 5), float(1 - i % 2), None, "AB"[i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "num1 double, num2 double, num3 double, target_valid double, target_null double, cat1 string")
    res = run_analysis(df, AnalysisContext(target=target, problem_type="classification"), ["ml"])["ml"]
    assert "error" not in res and res["target"].first()["valid"] is valid
    assert ("mutual_information" in res) is valid


def test_a_failing_module_does_not_stop_the_others(spark, monkeypatch):
    from tablescope.plans import pipeline as P
    monkeypatch.setitem(P.MODULES, "bivariate", lambda r: 1 / 0)
    res = P.run_analysis(spark.range(30).toDF("n"), modules=["bivariate", "overview"])
    assert "ZeroDivisionError" in res["bivariate"]["error"].first()["error"] and res["overview"]["table"].first()["n_rows"] == 30


def test_a_failing_result_does_not_stop_its_module(spark, monkeypatch, tmp_path):
    from tablescope.plans import pipeline as P
    monkeypatch.setattr(P.O, "overview_flags", lambda *a, **k: 1 / 0)  # cannot be planned
    late = spark.range(5).select(F.raise_error(F.lit("late")).cast("string").alias("x"))  # planned, fails when run
    monkeypatch.setattr(P.O, "table_overview", lambda *a, **k: late)
    res = P.run_analysis(spark.range(30).toDF("n"), AnalysisContext(target="n", problem_type="regression"), ["overview"], sample=True)
    assert set(res["overview"]) == {"table", "columns", "error"}
    assert [r["result"] for r in res["overview"]["error"].collect()] == ["flags"]
    meta = res["meta"]["run"].first()
    assert (meta["n_rows"], meta["n_columns"], meta["sampled"], meta["sample_n"], meta["target"]) == (30, 1, False, 30, "n")
    rows = {(r["module"], r["result"]): r for r in P.summary(res).collect()}
    assert "late" in rows["overview", "table"]["error"] and rows["overview", "columns"]["n_rows"] == 1
    failed = P.write_analysis(res, str(tmp_path))
    assert set(failed) == {"overview/table"}
    log = spark.read.parquet(f"{tmp_path}/meta/results")
    assert log.where("error IS NULL").count() == len(rows) - 1 and log.where("seconds < 0").count() == 0
    assert res._kept
    res.release()
    assert not res._kept


def test_short_series_are_reported(spark):
    from tablescope.operators import timeseries as TS
    rows = [(i, "2024-01-%02d" % (1 + i % 28), float(i) if i < 12 else None, 1.0 if i < 9 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, day string, a double, b double")
    got = {(r["value"], r["n"], r["status"]) for r in TS.series_status(df, "day", ["a", "b"]).collect()}
    assert got == {("a", 12, "ok"), ("b", 9, "too short")}
    assert TS.series_status(df.limit(0), "day", ["a"]).first()["n"] == 0


def test_scatter_sample_of_a_small_table_is_the_table(spark):
    from tablescope.operators import bivariate as BI
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(50)] + [(None, 1.0)], "a double, b double")
    got = sorted((r["x"], r["y"]) for r in BI.scatter_sample(df, ["a", "b"]).collect())
    assert got == [(float(i), float(i % 7)) for i in range(50)]
    assert BI.scatter_sample(df, ["a", "b"], points=20).count() == 20


def test_contingency_of_many_levels(spark):
    from tablescope.operators import bivariate as BI
    df = spark.range(36_000).select((F.col("id") % 2).alias("row"), F.concat(F.lit("v"), (F.col("id") % 12_000).cast("string")).alias("level"))
    df = df.unionAll(spark.createDataFrame([(None, "v1"), (7, None), (9, "v11999")], "row long, level string"))
    levels = {r["position"]: r["level"] for r in BI.contingency_levels(df, "level").collect()}
    assert [levels[i] for i in range(12_000)] == sorted(f"v{i}" for i in range(12_000))
    blocks = BI.contingency_blocks(df, "row", "level", 700).collect()
    assert len(blocks) == 2 * 18 + 1 and {len(b["counts"]) for b in blocks} == {700, 100}
    for b in blocks:
        for i, n in enumerate(b["counts"]):
            v = int(levels[b["block"] * 700 + i][1:])
            assert n == (int(v == 11_999) if b["row"] == "9" else 3 if v % 2 == int(b["row"]) else 0)
    small = BI.contingency_table(df.where("level IN ('v1', 'v2')"), "row", "level")
    assert {tuple(r) for r in small.collect()} == {("0", 0, 3), ("1", 3, 0)} and small.columns == ["row", "v1", "v2"]
    assert BI.contingency_blocks(df.limit(0), "row", "level").count() == 0


def test_content_hash_tells_nulls_columns_and_maps_apart(spark):
    def h(rows, schema):
        return SF.content_hash(spark.createDataFrame(rows, schema)).first()["content_hash"]
    assert h([("x", None), (None, "y")], "a string, b string") != h([(None, "x"), ("y", None)], "a string, b string")
    assert h([("x", "y")], "a string, b string") != h([("x", "y")], "b string, a string")
    assert h([({"k": 1},)], "m map<string,int>") != h([({"k": 2},)], "m map<string,int>")
