"""Comparing a table with its reconstruction: structural and statistical tests, and a score from 0 to 100."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import label, parsed_timestamp, seconds
from quarry.model import TestResult, ValidationReport
from quarry.operators.counting import running_counts
from quarry.operators.dependency import cramers_v, eta_squared, pearson
from quarry.operators.jobs import together
from quarry.operators.profiling import kinds_of, moments, text_ratios
from quarry.sources.tables import ROW_ID


@dataclass
class Thresholds:
    ks_pvalue_min: float = 0.05
    ks_pvalue_min_relaxed: float = 0.01
    skew_relax: float = 2.0
    ks_large_n: int = 1000
    ks_distance_max: float = 0.05
    ks_distance_max_relaxed: float = 0.10
    mean_tolerance: float = 0.02
    correlation_tolerance: float = 0.05
    frequency_tolerance: float = 0.03
    min_correlation: float = 0.15
    weak_correlation: float = 0.1
    max_pairs: int = 20
    datetime_share: float = 0.9


# --- typing, which is the validator's own --------------------------------------------------------------------------


def comparison_kinds(df: DataFrame, share: float = 0.9) -> dict[str, str]:
    """numeric, datetime (also texts that mostly parse) or categorical, for each column."""
    kinds = kinds_of(df)
    texts = [c for c, k in kinds.items() if k == "string"]
    dates = {r["column"]: r["dates"] for r in text_ratios(df, texts).collect()} if texts else {}
    out = {}
    for c, k in kinds.items():
        if k == "string":
            k = "datetime" if (dates.get(c) or 0) >= share else "categorical"
        out[c] = "categorical" if k == "boolean" else k
    return out


def as_number(df: DataFrame, column: str, kind: str) -> Column:
    """A column as a double: numbers, or Unix seconds of dates; null where it can't be read."""
    base = kinds_of(df)[column]
    if kind == "datetime":
        return seconds(parsed_timestamp(F.col(column)) if base == "string" else F.col(column))
    v = F.col(column).try_cast("double")
    return F.when(~F.isnan(v), v)


# --- structural ----------------------------------------------------------------------------------------------------


def row_count(a: DataFrame, b: DataFrame) -> TestResult:
    n, m = together(a.count, b.count)
    return TestResult("row_count", n == m, float(m), float(n), details=f"{n} and {m} rows")


def schema_match(a: DataFrame, b: DataFrame) -> TestResult:
    x, y = set(kinds_of(a)), set(kinds_of(b))
    return TestResult("schema_match", x == y, details=f"missing: {sorted(x - y)}; extra: {sorted(y - x)}")


def differs(x: Column, y: Column, numeric: bool) -> Column:
    """Null-safe inequality; numbers may differ by 1e-5 of the second plus 1e-8, whatever their types."""
    if numeric:
        u, v = x.cast("double"), y.cast("double")
        near = F.abs(u - v) <= 1e-8 + 1e-5 * F.abs(v)
        return ~(x.isNull() & y.isNull() | F.coalesce(near | F.isnan(u) & F.isnan(v) | (u == v), F.lit(False)))
    return ~x.cast("string").eqNullSafe(y.cast("string"))


def anchor_differences(a: DataFrame, b: DataFrame, columns: list[str], key: str = ROW_ID) -> DataFrame:
    """(column, differing): rows that differ, or that only one side has, for each column, in one equi-join."""
    kinds = kinds_of(a)
    x = a.select(F.col(key).alias("__k"), F.lit(True).alias("__a"), *(F.col(c).alias(f"__a_{i}") for i, c in enumerate(columns)))
    y = b.select(F.col(key).alias("__k"), F.lit(True).alias("__b"), *(F.col(c).alias(f"__b_{i}") for i, c in enumerate(columns)))
    joined = x.join(y, "__k", "full")
    alone = F.col("__a").isNull() | F.col("__b").isNull()
    rows = [F.struct(F.lit(c).alias("column"), F.count_if(alone | differs(F.col(f"__a_{i}"), F.col(f"__b_{i}"), kinds[c] == "numeric")).alias("differing")) for i, c in enumerate(columns)]
    return joined.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def anchors_exact(a: DataFrame, b: DataFrame, columns: list[str]) -> list[TestResult]:
    there = [c for c in columns if c in a.columns and c in b.columns]
    found = {r["column"]: r["differing"] for r in anchor_differences(a, b, there).collect()} if there else {}
    return [TestResult(f"anchor_exact[{c}]", found.get(c) == 0, float(found[c]) if c in found else None, 0.0, c, "" if c in found else "the column is missing") for c in columns]


# --- statistical ---------------------------------------------------------------------------------------------------


def two_sample_distances(values: DataFrame) -> DataFrame:
    """values (column, side, v), side 0 or 1: (column, n0, n1, d) by running counts of distinct values."""
    counts = values.groupBy("column", "v").agg(F.sum(1 - F.col("side")).alias("n0"), F.sum(F.col("side").cast("long")).alias("n1"))
    run = running_counts(counts, ["column"], ["n0", "n1"])
    gap = F.abs(F.col("upto_n0") / F.col("all_n0") - F.col("upto_n1") / F.col("all_n1"))
    return run.groupBy("column").agg(F.max("all_n0").alias("n0"), F.max("all_n1").alias("n1"), F.max(F.when((F.col("all_n0") > 0) & (F.col("all_n1") > 0), gap)).alias("d"))


def both_sides(a: DataFrame, b: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column, side, v) of the numeric and datetime columns of both tables."""
    parts = []
    for side, df in enumerate((a, b)):
        pairs = F.array(*(F.struct(F.lit(c).alias("column"), as_number(df, c, k).alias("v")) for c, k in kinds.items()))
        parts.append(df.select(F.explode(pairs).alias("p")).select("p.column", F.lit(side).alias("side"), "p.v").where("v is not null"))
    return parts[0].union(parts[1])


def ks_pvalue(d: float, n: int, m: int) -> float:
    """Exact two-sided p-value for small samples, by counting lattice paths that stay within the distance."""
    if d <= 0:
        return 1.0
    if max(n, m) > 2000:
        # the asymptotic series
        e = math.sqrt(n * m / (n + m)) * d
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * e * e) for k in range(1, 101))))
    g = math.gcd(n, m)
    limit = round(d * n * m / g) * g
    # share of the paths from (0, 0) to (i, j) that stay inside, weighted to keep the numbers small
    row = [1.0] + [0.0] * m
    for j in range(1, m + 1):
        row[j] = row[j - 1] if j * n < limit else 0.0
    for i in range(1, n + 1):
        row[0] = row[0] if i * m < limit else 0.0
        for j in range(1, m + 1):
            inside = abs(i * m - j * n) < limit
            row[j] = (row[j] * i / (i + j) + row[j - 1] * j / (i + j)) if inside else 0.0
    return min(1.0, max(0.0, 1 - row[m]))


def ks_test(column: str, n: int | None, m: int | None, d: float | None, skew: float, t: Thresholds) -> TestResult:
    name = f"ks_test[{column}]"
    if min(n or 0, m or 0) < 2 or d is None:
        return TestResult(name, True, column=column, details="skipped: too few values")
    relaxed = abs(skew) > t.skew_relax
    if min(n, m) >= t.ks_large_n:
        limit = t.ks_distance_max_relaxed if relaxed else t.ks_distance_max
        return TestResult(name, d <= limit, d, limit, column, "distance")
    p, limit = ks_pvalue(d, n, m), t.ks_pvalue_min_relaxed if relaxed else t.ks_pvalue_min
    return TestResult(name, p >= limit, p, limit, column, "p-value")


def mean_test(column: str, x: float | None, y: float | None, tolerance: float) -> TestResult:
    name = f"mean_within_tolerance[{column}]"
    if x is None or y is None:
        return TestResult(name, x is None and y is None, None, tolerance, column, "no values")
    off = abs(y - x) / abs(x) if x else abs(y - x)
    return TestResult(name, off <= tolerance, off, tolerance, column)


def frequency_drift(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(column, missing, extra, max_drift, worst): values on one side only, and the largest difference of shares."""
    sides = []
    for side, df in (("a", a), ("b", b)):
        v = label(F.col(column), kinds_of(df)[column])
        counts = df.where(F.col(column).isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        sides.append(counts.crossJoin(counts.agg(F.sum("n").alias("t"))).select("v", (F.col("n") / F.col("t")).alias(side)))
    x, y = F.col("a"), F.col("b")
    drift = F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
    joined = sides[0].join(sides[1], "v", "full")
    worst = F.max(F.struct(drift.alias("d"), "v"))
    return joined.agg(F.count_if(y.isNull()).alias("missing"), F.count_if(x.isNull()).alias("extra"), F.coalesce(F.max(drift), F.lit(0.0)).alias("max_drift"), worst["v"].alias("worst")).select(
        F.lit(column).alias("column"), "missing", "extra", "max_drift", "worst"
    )


def frequency_test(r, tolerance: float) -> TestResult:
    same = not r["missing"] and not r["extra"]
    return TestResult(f"categorical_freq[{r['column']}]", same and r["max_drift"] <= tolerance, r["max_drift"], tolerance, r["column"], f"worst: {r['worst']}; missing {r['missing']}, extra {r['extra']}")


def format_compliance(df: DataFrame, column: str, regex: str) -> DataFrame:
    """(n, matching, unique_ratio, mean_length) of the non-null values."""
    t = F.col(column).cast("string")
    return df.agg(
        F.count(t).alias("n"), F.avg(t.rlike(regex).cast("double")).alias("matching"), F.try_divide(F.count_distinct(t), F.count(t)).alias("unique_ratio"), F.avg(F.length(t)).alias("mean_length")
    )


def format_tests(a: DataFrame, b: DataFrame, column: str, regex: str) -> list[TestResult]:
    try:
        x, y = together(*(format_compliance(df, column, regex).first for df in (a, b)))
    except Exception as e:
        # the pattern is part of the recipe and may not compile; other errors say nothing about the data
        if "pattern" not in str(e).lower():
            raise
        return [TestResult(f"random_format_regex[{column}]", False, column=column, details=str(e)[:200])]
    if not y["n"]:
        return [TestResult(f"random_format_regex[{column}]", False, column=column, details="no values")]
    off = abs((x["mean_length"] or 0.0) - y["mean_length"])
    return [
        TestResult(f"random_format_regex[{column}]", y["matching"] == 1.0, y["matching"], 1.0, column),
        TestResult(f"random_format_unique[{column}]", y["unique_ratio"] >= 0.99, y["unique_ratio"], 0.99, column),
        TestResult(f"random_format_length[{column}]", off <= 1, off, 1.0, column),
    ]


def pair_strengths(df: DataFrame, kinds: dict[str, str], pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Pearson (absolute), Cramér's V or the correlation ratio of each pair; dates count as numbers."""
    numbers = {c for c, k in kinds.items() if k in ("numeric", "datetime")}
    wide = df.select(*(as_number(df, c, k).alias(c) if c in numbers else F.col(c) for c, k in kinds.items()))
    both = [p for p in pairs if set(p) <= numbers]
    tables = [cramers_v(wide, a, b) for a, b in pairs if a not in numbers and b not in numbers]
    mixed = [p for p in pairs if len(numbers & set(p)) == 1]
    by_category: dict[str, list[str]] = {}
    for a, b in mixed:
        c, x = (a, b) if b in numbers else (b, a)
        by_category.setdefault(c, []).append(x)
    linear, tabled, *ratios = together(
        lambda: pearson(wide, both).collect() if both else [],
        lambda: reduce(DataFrame.union, tables).collect() if tables else [],
        *(eta_squared(wide, c, xs).collect for c, xs in by_category.items()),
    )
    out = {(r["col_a"], r["col_b"]): abs(r["r"]) if r["n"] >= 2 and r["r"] is not None and r["r"] == r["r"] else 0.0 for r in linear}
    out |= {(r["col_a"], r["col_b"]): r["v"] for r in tabled}
    ratio = {(r["category"], r["number"]): (r["eta2"] if r["large_groups"] >= 2 else 0.0) for found in ratios for r in found}
    return out | {(a, b): ratio[(a, b) if b in numbers else (b, a)] for a, b in mixed}


def strongest_pairs(strengths: dict[tuple[str, str], float], least: float, k: int) -> list[tuple[str, str]]:
    return [p for p, s in sorted(strengths.items(), key=lambda x: -x[1]) if s >= least][:k]


def correlation_test(pair: tuple[str, str], x: float, y: float, t: Thresholds) -> TestResult:
    name, column = f"correlation_preserved[{pair[0]},{pair[1]}]", f"{pair[0]},{pair[1]}"
    if x < t.weak_correlation:
        return TestResult(name, True, None, t.correlation_tolerance, column, "skipped: weak in the original")
    return TestResult(name, abs(x - y) <= t.correlation_tolerance, abs(x - y), t.correlation_tolerance, column)


# --- all together --------------------------------------------------------------------------------------------------


def score(structural: list[TestResult], statistical: list[TestResult]) -> float:
    """Structural tests count twice."""
    total = 2 * len(structural) + len(statistical)
    passed = 2 * sum(t.passed for t in structural) + sum(t.passed for t in statistical)
    return round(100 * passed / total, 2) if total else 0.0


def report(structural: list[TestResult], statistical: list[TestResult]) -> ValidationReport:
    every = structural + statistical
    passed = sum(t.passed for t in every)
    return ValidationReport(score(structural, statistical), passed, len(every) - passed, structural, statistical)


def numeric_tests(a: DataFrame, b: DataFrame, numbers: dict[str, str], t: Thresholds) -> list[TestResult]:
    """Distances of the distributions of numbers and dates, and of the means of numbers."""
    if not numbers:
        return []
    as_numbers = [df.select(*(as_number(df, c, k).alias(c) for c, k in numbers.items())) for df in (a, b)]
    found = together(two_sample_distances(both_sides(a, b, numbers)).collect, *(moments(df, list(numbers)).collect for df in as_numbers))
    distances, x, y = ({r["column"]: r for r in rows} for rows in found)
    out = []
    for c, k in numbers.items():
        d = distances.get(c)
        out.append(ks_test(c, *((d["n0"], d["n1"], d["d"]) if d else (0, 0, None)), x[c]["skewness"] or 0.0, t))
        if k == "numeric":
            out.append(mean_test(c, x[c]["mean"], y[c]["mean"], t.mean_tolerance))
    return out


def pair_tests(a: DataFrame, b: DataFrame, kinds: dict[str, str], pairs: list[tuple[str, str]], t: Thresholds) -> list[TestResult]:
    """The strongest associations of the first table, held against the second."""
    if len(pairs) <= t.max_pairs:
        strengths, again = together(*(lambda df=df: pair_strengths(df, kinds, pairs) if pairs else {} for df in (a, b)))
        chosen = strongest_pairs(strengths, t.min_correlation, t.max_pairs)
    else:
        strengths = pair_strengths(a, kinds, pairs)
        chosen = strongest_pairs(strengths, t.min_correlation, t.max_pairs)
        again = pair_strengths(b, kinds, chosen) if chosen else {}
    return [correlation_test(p, strengths[p], again[p], t) for p in chosen]


def validate(a: DataFrame, b: DataFrame, anchors: list[str] | None = None, thresholds: Thresholds | None = None, formats: dict[str, str] | None = None) -> ValidationReport:
    """The whole comparison.  Anchors are compared row by row, by ``__row_id``; without equal row counts there are no
    statistical tests.  Both tables are read several times: cache them."""
    t, formats = thresholds or Thresholds(), formats or {}
    exact = [c for c in anchors or [] if c not in formats]
    counted, compared, found_kinds = together(lambda: row_count(a, b), lambda: anchors_exact(a, b, exact) if exact else [], lambda: comparison_kinds(a, t.datetime_share))
    structural = [counted, schema_match(a, b), *compared]
    if not structural[0].passed:
        return report(structural, [])
    kinds = {c: k for c, k in found_kinds.items() if c in b.columns and c not in (anchors or []) and c not in formats and k != "other"}
    names, regexes = list(kinds), {c: regex for c, regex in formats.items() if c in a.columns and c in b.columns}
    pairs = [(p, q) for i, p in enumerate(names) for q in names[i + 1 :]]
    parts = [lambda: numeric_tests(a, b, {c: k for c, k in kinds.items() if k != "categorical"}, t)]
    parts += [lambda c=c: [frequency_test(frequency_drift(a, b, c).first(), t.frequency_tolerance)] for c, k in kinds.items() if k == "categorical"]
    parts += [lambda c=c, regex=regex: format_tests(a, b, c, regex) for c, regex in regexes.items()]
    parts.append(lambda: pair_tests(a, b, kinds, pairs, t))
    return report(structural, [test for tests in together(*parts) for test in tests])


def report_text(r: ValidationReport, rows: int = 20) -> str:
    """Failed tests first."""
    tests = sorted([*r.structural_tests, *r.statistical_tests], key=lambda t: (t.passed, t.test_name))
    number = lambda x: "-" if x is None else f"{x:.4g}"
    lines = [f"score {r.overall_score:.2f} of 100: {r.passed_count} passed, {r.failed_count} failed, target {'met' if r.is_fidelity_target_met else 'missed'}"]
    lines += [f"{'ok  ' if t.passed else 'FAIL'} {t.test_name}: {number(t.metric)} (limit {number(t.threshold)}) {t.details}".rstrip() for t in tests[:rows]]
    return "\n".join(lines)


def report_frame(spark, r: ValidationReport) -> DataFrame:
    """A row per test."""
    rows = [(kind, t.test_name, t.column, t.passed, t.metric, t.threshold) for kind, tests in (("structural", r.structural_tests), ("statistical", r.statistical_tests)) for t in tests]
    return spark.createDataFrame(rows, "kind string, test_name string, column string, passed boolean, metric double, threshold double")
