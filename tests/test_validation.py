import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import validation as v
from quarry.sources.tables import ROW_ID, with_row_id


def small(spark, n=200):
    rows = [(f"u{i}", 20 + (i * 37) % 50, ["FR", "US", "DE"][i % 3], i % 4 == 0) for i in range(n)]
    return with_row_id(spark.createDataFrame(rows, "id string, age int, country string, premium boolean"))


def test_identical_tables_score_100(spark):
    df = small(spark).cache()
    report = v.validate(df, df, ["id"])
    assert report.overall_score == 100.0 and report.failed_count == 0 and report.is_fidelity_target_met
    assert "score 100.00" in v.report_text(report)
    assert v.report_frame(spark, report).count() == report.passed_count


def test_missing_column_and_rows(spark):
    df = small(spark).cache()
    assert not v.schema_match(df, df.drop("age")).passed
    report = v.validate(df, df.limit(100), ["id"])
    assert report.statistical_tests == [] and not report.structural_tests[0].passed


def test_changed_anchor(spark):
    df = small(spark).cache()
    other = df.withColumn("id", F.when(F.col(ROW_ID) == 7, "changed").otherwise(F.col("id")))
    found = {t.column: t for t in v.anchors_exact(df, other, ["id", "age", "absent"])}
    assert not found["id"].passed and found["id"].metric == 1 and found["age"].passed and not found["absent"].passed


def test_number_types_do_not_matter(spark):
    df = small(spark)
    assert v.anchors_exact(df, df.withColumn("age", F.col("age").cast("double") * (1 + 1e-7)), ["age"])[0].passed


@pytest.mark.parametrize(("shift", "passes"), [(0.0, True), (2.0, False)])
def test_ks(spark, shift, passes):
    rng = np.random.default_rng(0)
    rows = [("x", s, float(x)) for s in (0, 1) for x in rng.normal(shift * s, 1, 2000)]
    r = v.two_sample_distances(spark.createDataFrame(rows, "column string, side int, v double")).first()
    assert v.ks_test("x", r["n0"], r["n1"], r["d"], 0.0, v.Thresholds()).passed == passes
    a, b = (np.sort([x for _, s, x in rows if s == k]) for k in (0, 1))
    every = np.concatenate([a, b])
    assert r["d"] == pytest.approx(np.abs(np.searchsorted(a, every, "right") / len(a) - np.searchsorted(b, every, "right") / len(b)).max())


def test_ks_pvalues():
    # of the 20 orders of two threes, two are as far apart as can be
    assert v.ks_pvalue(1.0, 3, 3) == pytest.approx(0.1)
    assert v.ks_pvalue(0.0, 5, 5) == 1.0
    assert v.ks_pvalue(0.5, 200, 300) < 1e-10
    assert v.ks_test("x", 1, 5, 0.3, 0, v.Thresholds()).passed
    assert v.ks_test("x", 2000, 2000, 0.07, 3.0, v.Thresholds()).passed
    assert not v.ks_test("x", 2000, 2000, 0.07, 0.0, v.Thresholds()).passed


@pytest.mark.parametrize(("shares", "passes"), [((71, 29), True), ((50, 50), False), ((70, 30, 1), False)])
def test_frequencies(spark, shares, passes):
    a = spark.createDataFrame([(x,) for x in "a" * 70 + "b" * 30], "c string")
    b = spark.createDataFrame([(x,) for x in "".join(k * n for k, n in zip("abc", shares, strict=False))], "c string")
    r = v.frequency_drift(a, b, "c").first()
    assert v.frequency_test(r, 0.03).passed == passes


def test_means():
    assert v.mean_test("x", 100.0, 101.9, 0.02).passed and not v.mean_test("x", 100.0, 103.0, 0.02).passed
    assert v.mean_test("x", 0.0, 0.01, 0.02).passed and v.mean_test("x", None, None, 0.02).passed


def test_formats(spark):
    good = spark.createDataFrame([(f"{i:08x}",) for i in range(100)], "h string")
    assert all(t.passed for t in v.format_tests(good, good, "h", "^[0-9a-f]{8}$"))
    same = good.withColumn("h", F.lit("00000000"))
    assert [t.passed for t in v.format_tests(good, same, "h", "^[0-9a-f]{8}$")] == [True, False, True]
    assert not v.format_tests(good, good.where("false"), "h", "^[0-9a-f]{8}$")[0].passed
    assert not v.format_tests(good, good, "h", "^[")[0].passed


def test_correlations(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, "ab"[i % 2]) for i in range(200)], "x double, y double, c string")
    kinds = v.comparison_kinds(df)
    strengths = v.pair_strengths(df, kinds, [("x", "y"), ("x", "c")])
    assert strengths["x", "y"] == pytest.approx(1.0) and strengths["x", "c"] < 0.01
    assert v.strongest_pairs(strengths, 0.15, 20) == [("x", "y")]
    assert v.correlation_test(("x", "y"), 1.0, 0.99, v.Thresholds()).passed
    assert not v.correlation_test(("x", "y"), 1.0, 0.9, v.Thresholds()).passed
    assert v.correlation_test(("x", "y"), 0.05, 0.9, v.Thresholds()).passed


def test_typing(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00+0000", "x", True, 1)], "d string, s string, b boolean, n int")
    assert v.comparison_kinds(df) == {"d": "datetime", "s": "categorical", "b": "categorical", "n": "numeric"}


def test_no_tests_score_0():
    assert v.score([], []) == 0.0
