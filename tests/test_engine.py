"""Operators on small hand-made tables: nulls, ties, empty groups, limits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.functions import scalar
from ashlar.operators import boundary, catalog, checks, lineage, profile, quality, reduce, resample, select, stages
from ashlar.sources import files


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def test_numeric_summary_counts_nan_as_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (float("nan"),), (None,)], "x double")
    (r,) = rows(profile.numeric_summary(df, ["x"]))
    assert (r["observed_n"], r["missing_n"], r["median"], r["n_unique"]) == (3, 2, 2.0, 3)
    assert math.isclose(r["skewness"], 0.9352195295828235)


def test_numeric_summary_of_nothing(spark):
    (r,) = rows(profile.numeric_summary(spark.createDataFrame([], "x double"), ["x"]))
    assert r["observed_n"] == 0 and r["mean"] is None and r["missing_pct"] == 0.0


def test_mode_tie_goes_to_the_smallest_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    (r,) = rows(profile.categorical_summary(df, ["c"]))
    assert (r["mode_category"], r["mode_frequency"], r["missing_n"], r["observed_values"]) == ("a", 2, 1, '["a","b"]')


def test_all_null_column_has_no_mode(spark):
    (r,) = rows(profile.categorical_summary(spark.createDataFrame([(None,)], "c string"), ["c"]))
    assert r["mode_category"] is None and r["cardinality"] == 0


def test_histogram_of_a_constant(spark):
    assert rows(profile.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 5))[0]["n"] == 2


def test_value_on_a_limit_is_not_flagged(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 7)], "x double")  # q1 2, q3 4, upper limit 7
    (r,) = rows(quality.method_counts(df, ["x"], "iqr"))
    assert (r["upper"], r["above_n"], r["flagged_n"]) == (7.0, 0, 0)


def test_flags_of_null_are_false(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "k int, x double")
    out = rows(quality.flagged(df, ["x"], {"x": [(">", 0.0)]}), "k")
    assert [r["x_domain"] for r in out] == [True, False, False] and not any(r["x_iqr"] for r in out)


def test_functional_dependents(spark):
    df = spark.createDataFrame([(1, "a", "a", "c"), (1, "a", "b", "c"), (2, "b", "b", "c"), (None, None, None, "c")], "s int, good string, bad string, constant string")
    out = {r["candidate"]: r["is_derivative"] for r in rows(quality.functional_dependents(df, "s", ["good", "bad", "constant"]))}
    assert out == {"good": True, "bad": False, "constant": False}


def test_branching_classes(spark):
    exact = spark.createDataFrame([("Nunca fumé", None), ("Sí", 1)], "l string, d int")
    assert rows(quality.branching(exact, "d", "l"))[0]["classification"] == "ESTRUCTURAL_DEMOSTRADO"
    none = spark.createDataFrame([("Nunca fumé", 1), ("Sí", None)], "l string, d int")
    assert rows(quality.branching(none, "d", "l"))[0]["classification"] == "NO_IDENTIFICABLE"


def test_null_cooccurrence_keeps_the_pairs_asked_for(spark):
    df = spark.createDataFrame([(None, 1, None, None), (None, 1, None, None), (1, None, 1, None), (1, 1, 1, None)], "q1 int, q4 int, q3 int, q5 int")
    out = rows(quality.null_cooccurrence(df, ["q1", "q3", "q4", "q5"], least_pct=80.0, top=50, always=[("q4", "q5")]))
    assert [(r["column_a"], r["column_b"], r["min_shared_pct"]) for r in out] == [("q1", "q3", 100.0), ("q4", "q5", 25.0)]


def test_label_days(spark):
    df = spark.createDataFrame([("1 día",), ("3  DÍAS ",), ("Dato perdido",)], "l string").select(scalar.days_of_label(F.col("l")).alias("d"))
    assert [r["d"] for r in df.collect()] == [1, 3, None]
    any_script = spark.createDataFrame([("  Ñandú   Ärger ",), (None,)], "l string").select(scalar.normal_label_any("l").alias("n"))
    assert [r["n"] for r in any_script.collect()] == ["nandu arger", None]


def test_split_matches_the_published_allocation(spark):
    n0, n1 = 38_993, 16_558  # 55,551 rows: 7,799 and 3,312 of them go to the test side
    df = spark.range(n0 + n1).select("id", (F.col("id") >= n0).cast("int").alias("y"))
    assert {r["y"]: r["test_n"] for r in rows(boundary.allocation(df, "y", 0.2))} == {0: 7799, 1: 3312}


def test_split_takes_the_least_hashes_of_each_class(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit("x").alias("other"))
    out = boundary.stratified_split(df, "id", "y")
    assert out.columns == ["id", "y", "other", "partition"] and out.count() == 1000
    for y in (0, 1):
        own = [(r["h"], r["partition"]) for r in out.where(F.col("y") == y).withColumn("h", boundary.hash_order("id", 42)).collect()]
        sides = [p for _, p in sorted(own)]
        assert sides == ["test"] * sides.count("test") + ["train"] * sides.count("train")
    assert out.where("partition = 'test'").count() == 200


def test_stages_read_train_only(spark):
    df = spark.createDataFrame([("train", 1.0, "a"), ("train", 3.0, "b"), ("train", None, None), ("test", 100.0, "z")], "partition string, x double, c string")
    assert rows(stages.fit_median(df, ["x"]))[0]["learned_value"] == 2.0
    done = stages.impute(df, stages.fit_median(df, ["x"]))
    assert [r["x"] for r in rows(done, "x")] == [1.0, 2.0, 3.0, 100.0]
    hot = stages.encode_onehot(df, stages.vocabulary(df, ["c"]))
    assert [r for r in rows(hot) if r["c"] == "z"][0]["c__a"] == 0 and hot.columns[-1] == "c__sin_dato"
    codes = stages.encode_ordinal(df, stages.ordinal_map(stages.vocabulary(df, ["c"]), {"c": ["b"]}), ["c"])
    assert {r["c"]: r["c_ord"] for r in rows(codes)} == {"a": 0, "b": -3, None: -1, "z": -2}


def test_colliding_names_raise(spark):
    df = spark.createDataFrame([("train", "a b"), ("train", "a_b")], "partition string, c string")
    with pytest.raises(ValueError):
        stages.encode_onehot(df, stages.vocabulary(df, ["c"]))


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([("train", 2.0), ("train", 2.0), ("test", 5.0)], "partition string, x double")
    assert [r["x"] for r in rows(stages.scale(df, stages.fit_scaler(df, ["x"])), "x")] == [0.0, 0.0, 3.0]


def test_category_text_and_order(spark):
    df = spark.createDataFrame([("10",), ("2.0",), ("x",), ("sin_dato",), ("2.5",)], "c string").select(scalar.category_text(F.col("c")).alias("c"))
    assert [r["c"] for r in df.orderBy(*scalar.category_order(F.col("c"), "sin_dato")).collect()] == ["2", "2.5", "10", "x", "sin_dato"]


def test_statistical_types(spark):
    cases = {
        "binary_categorical": (2, ["Sí", "No"]),
        "unknown_categorical": (3, ["Nunca", "Siempre", "Otro"]),
        "ordinal_categorical": (3, ["Ninguna", "1 vez", "Más de 3"]),
        "nominal_categorical": (3, ["Rojo", "Verde", "Azul"]),
    }
    df = spark.createDataFrame([(k, n, l) for k, (n, l) in cases.items()], "k string, n int, l array<string>")
    assert all(r["k"] == r["t"] for r in rows(df.select("k", catalog.statistical_type(F.col("n"), F.col("l")).alias("t"))))


def brute_information(x, y, k):
    h = lambda n: sum(1 / i for i in range(1, n + 1))
    total, hm, hy, hk = len(x), 0.0, 0.0, 0.0
    for i in range(total):
        own = sorted(abs(x[j] - x[i]) for j in range(total) if j != i and y[j] == y[i])
        kk = min(k, len(own))
        r = own[kk - 1]
        m = sum(abs(x[j] - x[i]) < r for j in range(total))  # as the radius was computed, so the k-th neighbour lies outside
        hm, hy, hk = hm + h(m - 1), hy + h(len(own)), hk + h(kk - 1)
    return max(0.0, h(total - 1) + (hk - hm - hy) / total)


def test_continuous_information(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200)
    x = rng.normal(size=200) + y
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y int")
    (r,) = rows(select.continuous_information(df, "id", "x", "y"))
    assert math.isclose(r["mi"], brute_information(x, y, 3), abs_tol=1e-9)


def test_components_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    c = reduce.fit(df, ["a", "b", "c", "d"])
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(c.variances, np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1])
    assert np.allclose(c.loadings @ c.loadings.T, np.eye(4))
    s = np.array([list(r) for r in c.scores(df, 2).collect()])
    assert np.allclose(np.sort(s[:, 0]), np.sort(z @ c.loadings[0]))
    t = rows(reduce.thresholds(c.variance_table(spark), [0.9]))[0]
    assert t["k"] == int(np.searchsorted(np.cumsum(c.variances) / c.variances.sum(), 0.9)) + 1


def test_oversampling_balances_and_interpolates(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i)], int(i < 5)) for i in range(23)], "id long, v array<double>, y int")
    out = resample.oversample(df, "id", "v", "y", 1, k=2)
    assert {r["target"]: r["n"] for r in rows(resample.class_balance(out))} == {0: 18, 1: 18}
    known = {r["id"]: np.array(r["v"]) for r in df.collect()}
    for r in out.where("sample_origin = 'synthetic'").collect():
        a, b, v = known[r["source_id"]], known[r["neighbour_id"]], np.array(r["v"])
        assert abs(np.linalg.norm(v - a) + np.linalg.norm(b - v) - np.linalg.norm(b - a)) < 1e-9


def test_checks_raise_together():
    c = checks.Checks().add("a", True).add("b", False)
    with pytest.raises(checks.CheckFailed, match="b"):
        c.require()


def test_promotion_keeps_the_old_table_on_failure(spark, tmp_path):
    path = str(tmp_path / "t")
    lineage.promote(spark.range(3), path)
    with pytest.raises(checks.CheckFailed):
        lineage.promote(spark.range(9), path, lambda df: checks.Checks().add("small", df.count() < 5))
    assert spark.read.parquet(path).count() == 3
    lineage.promote(spark.range(4), path, lambda df: checks.Checks().add("small", df.count() < 5))
    assert spark.read.parquet(path).count() == 4


def test_manifest_finds_changes(spark):
    m = lineage.manifest("b", {"t": spark.range(5)}, train_n=4)
    lineage.verify(m, {"t": spark.range(5).repartition(3)}).require()
    with pytest.raises(checks.CheckFailed):
        lineage.verify(m, {"t": spark.range(6)}).require()
    assert '"train_n": 4' in lineage.manifest_text(m)


def test_survey_file_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.csv").write_text("﻿record,q1,q4,texto_q1\n1,2,1.5,Sí\n2,,,Dato perdido\n", encoding="utf-8")
    path = files.locate(spark, str(tmp_path), "s.csv")
    df = files.read_survey(spark, path)
    assert df.dtypes == [("record", "bigint"), ("q1", "int"), ("q4", "double"), ("texto_q1", "string")]
    assert [r["q1"] for r in rows(df, "record")] == [2, None]
    files.write_snapshot(df.withColumn("partition", F.lit("train")), str(tmp_path / "out"))
    assert files.read_snapshot(spark, str(tmp_path / "out"), "train").count() == 2
    files.write_csv(df, str(tmp_path / "csv"), single=True, fifteen_digits=True)
    assert files.read_artifact(spark, str(tmp_path / "csv")).count() == 2
    with pytest.raises(files.SourceError):
        files.locate(spark, str(tmp_path), "none.csv")


def test_one_to_one_join_raises(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(checks.CheckFailed):
        checks.join_one_to_one(a, b, "k")


def test_quantiles_are_exact_in_few_bins(spark, monkeypatch):
    from ashlar.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", 5)
    monkeypatch.setattr(quantiles, "BINS", 4)
    far = [1e300 if i < 3 else -1.7e308 if i < 5 else float(i % 7) for i in range(101)]
    df = spark.createDataFrame([(float(i), far[i], None) for i in range(101)] + [(float("nan"), None, None)], "a double, b double, c double")
    ps = [0, 0.1, 0.25, 0.5, 0.75, 0.97, 1]
    out = quantiles.exact_quantiles(df, ["a", "b", "c"], ps)
    assert np.allclose(out["a"], np.quantile(np.arange(101.0), ps)) and out["c"] == [None] * len(ps)
    assert out["b"][1:6] == np.quantile(far, ps)[1:6].tolist() and (out["b"][0], out["b"][-1]) == (-1.7e308, 1e300)
    assert quantiles.distinct_values(df, ["a", "b", "c"]) == {"a": 101, "b": 9, "c": 0}


def test_continuous_information_does_not_depend_on_the_keys(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    x = np.round(rng.standard_normal(400) + y, 1)  # many ties
    found = []
    for factor in (1, 10**6, 10**8):
        df = spark.createDataFrame([(int(i) * factor, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y int")
        found.append(select.continuous_information(df, "id", "x", "y", rows_a_range=60).first()["mi"])
    assert max(found) - min(found) < 0.05 and min(found) > 0.02
    none = spark.createDataFrame([], "id long, x double, y int")
    assert select.continuous_information(none, "id", "x", "y").first()["mi"] == 0.0


def test_ranges_change_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(v), "a" if i % 3 else "b") for i, v in enumerate(rng.exponential(5, 500))]
    df = spark.createDataFrame(rows, "id long, x double, y string")
    one, many = (select.continuous_information(df, "id", "x", "y", rows_a_range=r).first()["mi"] for r in (10_000, 20))
    assert math.isclose(one, many, abs_tol=1e-9)


def test_oversampling_counts_usable_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.random(2).tolist() if i else None, 1) for i in range(5)] + [(10 + i, rng.random(2).tolist(), 0) for i in range(18)]
    out = resample.oversample(spark.createDataFrame(rows, "k long, v array<double>, y int"), "k", "v", "y", 1)
    assert {r["target"]: r["count"] for r in out.groupBy("target").count().collect()} == {0: 18, 1: 18}


def test_unequal_masks_give_no_joint_indicator(spark):
    from ashlar.operators import stages

    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    with pytest.raises(ValueError, match="different null masks in 1"):
        stages.joint_indicator(df, ["a", "b"], "m")


def test_a_vocabulary_too_large_for_a_plan_is_refused(spark, monkeypatch):
    from ashlar.operators import stages

    monkeypatch.setattr(stages, "MOST_CATEGORIES", 3)
    df = spark.range(5).select(F.col("id").cast("string").alias("c"), F.lit("train").alias("partition"))
    with pytest.raises(ValueError, match="more than 3"):
        stages.encode_onehot(df, stages.vocabulary(df, ["c"]))


def test_files_and_contracts(spark, tmp_path):
    text = lineage.write_manifest(spark, {"name": "é"}, f"file://{tmp_path}/m.json")
    assert (tmp_path / "m.json").read_text(encoding="utf-8") == text and files.read_json(spark, f"file://{tmp_path}/m.json") == {"name": "é"}
    lineage.pass_through(spark, f"file://{tmp_path}/m.json", f"file://{tmp_path}/copy.json").require()
    assert (tmp_path / "copy.json").read_bytes() == (tmp_path / "m.json").read_bytes()
    df = spark.range(3)
    m = lineage.stage_manifest("b", {"t": df}, {"scaled": False}, rows_dropped=True)
    assert m["operation_flags"] == {"scaled": False} and m["contract"]["rows_dropped"] and m["contract"]["fit_partition"] == "train"
    with pytest.raises(ValueError):
        lineage.stage_manifest("b", {}, {"scaled": 1})
    with pytest.raises(ValueError):
        lineage.stage_manifest("b", {}, {}, unheard_of=1)


def test_tables_side_by_side(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 3)], "k int, x int"), spark.createDataFrame([(2, 5), (1, 4)], "k int, y int")
    assert rows(checks.side_by_side("k", a, b), "k") == [{"k": 1, "x": 2, "y": 4}, {"k": 2, "x": 3, "y": 5}]
    with pytest.raises(checks.CheckFailed):
        checks.side_by_side("k", a, b.where("k = 1"))
    assert rows(checks.join_counts(a, b.where("k = 1"), "k"), "k")[1] == {"k": 2, "x": 3, "y": 0}
    bad = spark.createDataFrame([(1, 1, "train", 0), (1, 0, "side", 2)], "record int, target int, partition string, position int")
    assert [n for n, ok, _ in checks.valid_assignment(bad).rows if not ok] == ["unique_key", "contiguous_position", "known_sides"]
    assert catalog.unique_names(["b", "a", "b"]) == ["b", "a"]
