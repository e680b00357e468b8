"""Functional dependencies between columns, and associations: Pearson, Cramér's V, correlation ratio."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import label
from quarry.model import ColumnProfile, ColumnType, Correlation, FunctionalDependency
from quarry.operators.jobs import together
from quarry.operators.profiling import kinds_of

MAX_RATIO = 0.5
MIN_SUPPORT = 2
THRESHOLD = 0.3
#: Patterns use weaker associations than a report shows.
PATTERN_THRESHOLD = 0.05


# --- functional dependencies ---------------------------------------------------------------------------------------


def dependencies(df: DataFrame, determinants: list[str], dependents: list[str] | None = None, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(determinant, dependent, holds, is_bijection, mapping_size, support) for each ordered pair.

    One shuffle per determinant serves all dependents: in each of its groups a dependent's smallest and largest value are
    equal.  Rows with a null on either side don't count.  A dependency is a bijection if the groups' values are distinct."""
    kinds = kinds_of(df)
    names = [c for c in (dependents or list(kinds)) if kinds[c] != "other"]
    parts = []
    for a in determinants:
        others = [b for b in names if b != a]
        if not others:
            continue
        groups = df.where(F.col(a).isNotNull()).groupBy(a).agg(
            *(x for i, b in enumerate(others) for x in (F.min(b).alias(f"__lo{i}"), F.max(b).alias(f"__hi{i}"), F.count(b).alias(f"__n{i}")))
        )
        rows = []
        for i, b in enumerate(others):
            there = F.col(f"__n{i}") > 0
            rows.append(
                F.struct(
                    F.lit(b).alias("dependent"),
                    F.coalesce(F.bool_and(F.when(there, F.col(f"__lo{i}") == F.col(f"__hi{i}"))), F.lit(False)).alias("holds"),
                    F.count_if(there).alias("mapping_size"),
                    F.coalesce(F.sum(f"__n{i}"), F.lit(0)).alias("support"),
                    F.count_distinct(F.when(there, F.col(f"__lo{i}"))).alias("values"),
                )
            )
        parts.append(groups.agg(F.array(*rows).alias("r")).select(F.lit(a).alias("determinant"), F.inline("r")))
    if not parts:
        return df.sparkSession.createDataFrame([], "determinant string, dependent string, holds boolean, is_bijection boolean, mapping_size long, support long")
    found = reduce(DataFrame.union, parts)
    holds = F.col("holds") & (F.col("support") >= min_support)
    return found.select("determinant", "dependent", holds.alias("holds"), (holds & (F.col("values") == F.col("mapping_size"))).alias("is_bijection"), "mapping_size", "support")


def candidates(counts: list[tuple[str, int, int]], max_ratio: float = MAX_RATIO) -> list[str]:
    """Of (column, distinct, total), the columns that may determine others: at least two values, not too many."""
    return [c for c, unique, total in counts if unique >= 2 and total and unique / total <= max_ratio]


def functional_dependencies(df: DataFrame, counts: list[tuple[str, int, int]], max_ratio: float = MAX_RATIO) -> list[FunctionalDependency]:
    """What holds, in column order; of a bijection only the direction that comes first."""
    names = [c for c, *_ in counts]
    place = {c: i for i, c in enumerate(names)}
    found = dependencies(df, candidates(counts, max_ratio), names).where("holds").collect()
    out, reverse = [], set()
    for r in sorted(found, key=lambda r: (place[r["determinant"]], place[r["dependent"]])):
        if (r["determinant"], r["dependent"]) in reverse:
            continue
        if r["is_bijection"]:
            reverse.add((r["dependent"], r["determinant"]))
        out.append(FunctionalDependency(r["determinant"], r["dependent"], r["is_bijection"], r["mapping_size"]))
    return out


def choose_dependency(found: list[FunctionalDependency], column: str) -> FunctionalDependency | None:
    mine = [d for d in found if d.dependent == column]
    return min(mine, key=lambda d: (d.mapping_size, d.determinant), default=None)


def lookup_table(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """(key, value): the dependent's value for each value of the determinant."""
    there = df.where(F.col(determinant).isNotNull() & F.col(dependent).isNotNull())
    return there.groupBy(F.col(determinant).alias("key")).agg(F.min(dependent).alias("value"))


# --- associations --------------------------------------------------------------------------------------------------


def pearson(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, n, r): all pairs in one pass, over rows where both are there."""
    out = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
        out.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.count(x).alias("n"), F.corr(x, y).alias("r")))
    return df.agg(F.array(*out).alias("p")).select(F.inline("p"))


def pearson_pvalue(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs without association: 1 - r^2 has a beta distribution with the
    parameters (n - 2) / 2 and 1/2 there.  Its lower tail by the continued fraction of the incomplete beta function."""
    if n < 3:
        return 1.0
    a, b, x = (n - 2) / 2, 0.5, max(0.0, 1 - r * r)
    if x <= 0 or x >= 1:
        return float(x >= 1)

    def tail(a: float, b: float, x: float) -> float:
        front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
        tiny = 1e-300
        value = numerator = 1.0
        denominator = 0.0
        # modified Lentz steps; the terms alternate between two forms
        for i in range(500):
            m = i // 2
            term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            denominator = 1 / (1 + term * denominator or tiny)
            numerator = 1 + term / numerator or tiny
            value *= numerator * denominator
            if i and abs(1 - numerator * denominator) < 1e-14:
                break
        return front * (value - 1)

    # the fraction converges quickly below the mean; above it, the other tail is taken
    return tail(a, b, x) if x < (a + 1) / (a + b + 2) else 1 - tail(b, a, 1 - x)


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """(col_a, col_b, n, chi2, v): from the cells that occur, as empty ones follow from the margins; a table of two by two
    takes the continuity correction.  Degenerate tables have v 0."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("o"))
    rows = cells.groupBy("x").agg(F.sum("o").alias("r"))
    columns = cells.groupBy("y").agg(F.sum("o").alias("c"))
    full = cells.join(rows, "x").join(columns, "y")
    o, r, c = (F.col(x).cast("double") for x in ("o", "r", "c"))
    t = full.agg(
        F.sum("o").cast("double").alias("n"), F.count_distinct("x").alias("k"), F.count_distinct("y").alias("l"),
        F.sum(o * o / (r * c)).alias("s"), F.min(F.struct("x", "y", "o", "r", "c")).alias("cell"),
    )
    n, k, l = F.col("n"), F.col("k"), F.col("l")
    plain = n * (F.col("s") - 1)
    # two by two: all four cells are off their expectation by the same amount
    off = F.abs(F.col("cell.o") - F.col("cell.r") * F.col("cell.c") / n)
    corrected = F.pow(off - F.least(off, F.lit(0.5)), 2)
    inverse = n * (1 / F.col("cell.r") + 1 / (n - F.col("cell.r"))) * (1 / F.col("cell.c") + 1 / (n - F.col("cell.c")))
    usable = (k >= 2) & (l >= 2)
    chi2 = F.when(usable & (k == 2) & (l == 2), corrected * inverse).when(usable, F.greatest(plain, F.lit(0.0))).otherwise(0.0)
    v = F.when(usable, F.least(F.sqrt(chi2 / (n * (F.least(k, l) - 1))), F.lit(1.0))).otherwise(0.0)
    return t.select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.coalesce(n, F.lit(0.0)).cast("long").alias("n"), chi2.alias("chi2"), v.alias("v"))


def eta_squared(df: DataFrame, category: str, numbers: list[str]) -> DataFrame:
    """(category, number, groups, large_groups, eta2): shares of variance between the category's groups, for all numbers
    in one shuffle; 0 for fewer than two groups or without variance."""
    groups = df.where(F.col(category).isNotNull()).groupBy(category).agg(
        *(x for i, c in enumerate(numbers) for x in (F.count(c).alias(f"n{i}"), F.avg(F.col(c).cast("double")).alias(f"m{i}"), F.var_pop(F.col(c).cast("double")).alias(f"v{i}")))
    )
    out = []
    for i, c in enumerate(numbers):
        n, m, v = (F.col(f"{x}{i}") for x in "nmv")
        total, first, second = F.sum(n), F.sum(n * m), F.sum(n * m * m)
        between = second - first * first / total
        whole = between + F.sum(n * v)
        out.append(
            F.struct(
                F.lit(c).alias("number"), F.count_if(n > 0).alias("groups"), F.count_if(n > 1).alias("large_groups"),
                F.when((F.count_if(n > 0) >= 2) & (whole > 0), F.greatest(between / whole, F.lit(0.0))).otherwise(0.0).alias("eta2"),
            )
        )
    return groups.agg(F.array(*out).alias("r")).select(F.lit(category).alias("category"), F.inline("r"))


def correlations(df: DataFrame, profiles: list[ColumnProfile], threshold: float = THRESHOLD) -> list[Correlation]:
    """Associations of at least the threshold, between columns that are neither anchors nor empty."""
    use = [p for p in profiles if not p.is_anchor_candidate and p.n_null < p.n_total]
    numbers = [p.name for p in use if p.column_type == ColumnType.NUMERIC]
    categories = [p.name for p in use if p.column_type in (ColumnType.CATEGORICAL, ColumnType.BOOLEAN)]
    pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
    tables = [cramers_v(df, a, b) for i, a in enumerate(categories) for b in categories[i + 1 :]]
    linear, tabled, *ratios = together(
        lambda: pearson(df, pairs).collect() if pairs else [],
        lambda: reduce(DataFrame.union, tables).collect() if tables else [],
        *(eta_squared(df, c, numbers).collect for c in categories if numbers),
    )
    strength: dict[tuple[str, str], tuple[str, float, float | None]] = {}
    for r in linear:
        if r["n"] >= 3 and r["r"] is not None and r["r"] == r["r"]:
            strength[r["col_a"], r["col_b"]] = ("pearson", min(abs(r["r"]), 1.0), pearson_pvalue(r["r"], r["n"]))
    for r in tabled:
        strength[r["col_a"], r["col_b"]] = ("cramers_v", r["v"], None)
    for r in (r for found in ratios for r in found):
        if r["large_groups"] >= 2:
            strength[r["number"], r["category"]] = ("anova", min(r["eta2"], 1.0), None)
    out = []
    names = [p.name for p in use]
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            for pair in ((a, b), (b, a)):
                if pair in strength and strength[pair][1] >= threshold:
                    out.append(Correlation(*pair, *strength[pair]))
    return out


def strongest_partner(column: str, found: list[Correlation], anchors: set[str], profiles: dict[str, ColumnProfile], relaxed: bool = False) -> Correlation | None:
    """The strongest association through which ``column`` may be generated.  The partner is no anchor and has more
    distinct values (then the later name), so that no two columns wait for each other."""
    best = None
    for c in found:
        if column not in (c.col_a, c.col_b):
            continue
        other = c.col_b if c.col_a == column else c.col_a
        mine, theirs = profiles.get(column), profiles.get(other)
        allowed = relaxed or mine is None or theirs is None or (mine.n_unique, column) < (theirs.n_unique, other)
        if other not in anchors and allowed and (best is None or c.strength > best.strength):
            best = c
    return best


def directions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(target, partner) for each pair: the column with fewer distinct values (then the earlier name) is the target."""
    kinds = kinds_of(df)
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), label(F.col(c), kinds[c]).alias("v")) for c in columns))
    counts = df.select(F.explode(pairs).alias("p")).select("p.*").where("v is not null").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    a, b = (counts.select(F.col("column").alias(x), F.col("n").alias(f"n_{x}")) for x in ("target", "partner"))
    # a pair of columns per row, not of rows
    smaller = F.struct("n_target", "target") < F.struct("n_partner", "partner")
    return a.join(b, smaller).select("target", "partner", "n_target", "n_partner")


