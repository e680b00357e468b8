import math

import pytest
from pyspark.sql import functions as F

from quarry.model import ColumnType, TextClass
from quarry.operators import counting, profiling


def one(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_types_and_flags(spark):
    n = 200
    rows = [(f"u{i}", i % 50, ["a", "b", "c"][i % 3], i % 2 == 0, f"2024-01-{i % 28 + 1:02d}T10:00:00+0000", f"some text {i}") for i in range(n)]
    df = spark.createDataFrame(rows, "id string, age int, country string, premium boolean, at string, free string")
    found = {p.name: p for p in profiling.profile(df)}
    assert [found[c].column_type for c in df.columns] == [ColumnType.STRING, ColumnType.NUMERIC, ColumnType.CATEGORICAL, ColumnType.BOOLEAN, ColumnType.DATETIME, ColumnType.STRING]
    assert found["id"].is_anchor_candidate and not found["country"].is_anchor_candidate
    assert found["premium"].categorical_stats.top_values == {"False": 100, "True": 100}
    assert found["at"].datetime_stats.range_days == pytest.approx(27)
    assert all(len(p.examples) <= 5 for p in found.values())


def test_numeric_statistics(spark):
    r = profiling.numeric_stats(one(spark, [1.0, 2.0, 4.0, 9.0, None], "double"), ["x"]).first()
    assert (r["n"], r["mean"], r["min"], r["max"]) == (4, 4.0, 1.0, 9.0)
    assert (r["q25"], r["q50"], r["q75"]) == (1.75, 3.0, 5.25)
    assert r["std"] == pytest.approx(math.sqrt(38 / 3))
    assert r["skewness"] == pytest.approx(1.3309, abs=1e-3)


def test_nulls_constants_and_empty(spark):
    df = one(spark, [None, None], "double")
    p = profiling.profile(df)[0]
    assert p.n_null == 2 and p.n_unique == 0 and p.numeric_stats.mean == 0.0 and p.examples == []
    p = profiling.profile(one(spark, [5.0] * 4, "double"))[0]
    assert p.numeric_stats.skewness is None and p.numeric_stats.std == 0.0
    p = profiling.profile(one(spark, [], "string"))[0]
    assert p.n_total == 0 and not p.is_anchor_candidate and p.cardinality == 0.0


def test_year_is_no_date(spark):
    df = one(spark, ["2024", "2025"] * 20, "string")
    assert profiling.profile(df)[0].column_type == ColumnType.STRING


@pytest.mark.parametrize(
    ("make", "kind"),
    [
        (lambda i: f"user{i}@example.com", TextClass.EMAIL),
        (lambda i: f"https://example.com/{i}", TextClass.URL),
        (lambda i: f"12345678-1234-4234-8234-{i:012d}", TextClass.UUID),
        (lambda i: f"+1 (555) 000-{i:04d}", TextClass.PHONE),
        (lambda i: f"word {i}", TextClass.NONE),
    ],
)
def test_text_class(spark, make, kind):
    assert profiling.profile(one(spark, [make(i) for i in range(40)], "string"))[0].regex_pattern == kind


def test_text_class_needs_most_values(spark):
    values = [f"user{i}@example.com" for i in range(94)] + ["x"] * 6
    assert profiling.profile(one(spark, values, "string"))[0].regex_pattern == TextClass.NONE


def test_running_counts_do_not_depend_on_partitions(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 500).cast("double").alias("x"))
    wanted = None
    for n in (1, 7, 64):
        counts = counting.value_counts(counting.long_values(df.repartition(n), ["x"]), ["column"])
        rows = sorted((r["v"], r["upto_n"], r["all_n"]) for r in counting.running_counts(counts, ["column"], ["n"]).collect())
        assert rows == [(float(v), 6 * (v + 1), 3000) for v in range(500)]
        wanted = wanted or rows
        assert rows == wanted


def test_top_values_break_ties_by_value(spark):
    df = one(spark, ["b", "a", "c", "c"], "string")
    top = profiling.top_values(profiling.labelled_counts(df)).orderBy("rank").collect()
    assert [r["v"] for r in top] == ["c", "a", "b"]
