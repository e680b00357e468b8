import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.model import ColumnProfile, Correlation
from quarry.operators import dependency as d


def counts(df):
    n = df.count()
    return [(c, df.select(c).where(F.col(c).isNotNull()).distinct().count(), n) for c in df.columns]


def test_bijection_is_reported_once(spark):
    names = {"US": "United States", "FR": "France", "DE": "Germany"}
    df = spark.createDataFrame([(c, names[c]) for c in ["US"] * 200 + ["FR"] * 100 + ["DE"] * 50], "country_code string, country_name string")
    found = d.functional_dependencies(df, counts(df))
    assert [(x.determinant, x.dependent, x.is_bijection, x.mapping_size) for x in found] == [("country_code", "country_name", True, 3)]


def test_unique_columns_determine_nothing(spark):
    df = spark.createDataFrame([(f"u{i}", ["FR", "US"][i % 2]) for i in range(100)], "id string, country string")
    assert d.functional_dependencies(df, counts(df)) == []


def test_nulls_and_support(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 2), (None, 5)], "k string, v int")
    r = d.dependencies(df, ["k"]).first()
    assert r["holds"] and r["is_bijection"] and r["mapping_size"] == 2 and r["support"] == 3
    few = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert not d.dependencies(few, ["k"]).first()["holds"]


def test_choice_takes_the_smallest_mapping():
    from quarry.model import FunctionalDependency as FD

    found = [FD("z", "x", False, 5), FD("b", "x", False, 3), FD("a", "x", False, 3)]
    assert d.choose_dependency(found, "x").determinant == "a"
    assert d.choose_dependency(found, "y") is None


def test_cramers_v(spark):
    rng = random.Random(1)
    same = spark.createDataFrame([(x, x) for x in (rng.choice("abc") for _ in range(600))], "x string, y string")
    assert d.cramers_v(same, "x", "y").first()["v"] > 0.99
    apart = spark.createDataFrame([(rng.choice("abc"), rng.choice("xyz")) for _ in range(5000)], "x string, y string")
    assert d.cramers_v(apart, "x", "y").first()["v"] < 0.1
    constant = spark.createDataFrame([("a", c) for c in "xyz"], "x string, y string")
    assert d.cramers_v(constant, "x", "y").first()["v"] == 0
    empty = spark.createDataFrame([], "x string, y string")
    assert d.cramers_v(empty, "x", "y").first()["v"] == 0


def test_two_by_two_takes_the_correction(spark):
    cells = {("a", "x"): 12, ("a", "y"): 5, ("b", "x"): 3, ("b", "y"): 9}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "x string, y string")
    n, r, c = 29, {"a": 17, "b": 12}, {"x": 15, "y": 14}
    wanted = sum((abs(o - r[k[0]] * c[k[1]] / n) - 0.5) ** 2 / (r[k[0]] * c[k[1]] / n) for k, o in cells.items())
    assert d.cramers_v(df, "x", "y").first()["chi2"] == pytest.approx(wanted)


def test_pearson_and_eta(spark):
    rng = random.Random(2)
    rows = [(float(i), 2.0 * i + rng.gauss(0, 10), "even" if i % 2 == 0 else "odd") for i in range(1000)]
    df = spark.createDataFrame(rows, "x double, y double, g string")
    assert d.pearson(df, [("x", "y")]).first()["r"] > 0.9
    eta = {r["number"]: r["eta2"] for r in d.eta_squared(df, "g", ["x"]).collect()}
    assert eta["x"] < 0.01
    one = d.eta_squared(df.where("g = 'odd'"), "g", ["x"]).first()
    assert one["eta2"] == 0 and one["groups"] == 1


def test_direction_goes_to_the_finer_column():
    profiles = {n: ColumnProfile(n, "object", "categorical", 100, u, 0) for n, u in (("a", 3), ("b", 9), ("c", 3))}
    found = [Correlation("a", "b", "cramers_v", 0.5), Correlation("a", "c", "cramers_v", 0.9)]
    assert d.strongest_partner("a", found, set(), profiles).col_b == "c"
    assert d.strongest_partner("b", found, set(), profiles) is None
    assert d.strongest_partner("c", found, set(), profiles) is None
    assert d.strongest_partner("a", found, {"c"}, profiles).col_b == "b"
    assert d.strongest_partner("b", found, set(), profiles, relaxed=True) is not None


def test_pearson_pvalue():
    # the density of r without association is (1 - r^2)^((n - 4) / 2), here integrated by small steps
    for n, r in ((5, 0.3), (10, -0.7), (50, 0.1), (50, 0.9), (400, 0.05), (400, 0.3)):
        x = np.linspace(0, np.pi / 2, 200_001)
        # r = sin(x) takes the ends' singularity away
        density = np.cos(x) ** (n - 3)
        whole = np.trapezoid(density, x)
        above = x >= np.arcsin(abs(r))
        assert d.pearson_pvalue(r, n) == pytest.approx(np.trapezoid(density[above], x[above]) / whole, rel=1e-3, abs=1e-9)
    assert d.pearson_pvalue(0.0, 10) == 1 and d.pearson_pvalue(1.0, 10) == 0 and d.pearson_pvalue(0.5, 2) == 1
