"""Fitting of distributions and Kolmogorov distances, for many columns or buckets at once.

Parameters are closed forms of one aggregation.  The distance of the empirical distribution function from a fitted one
is a maximum over running counts of distinct values, so ties are exact and no window holds more than a piece.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import exponential_cdf, finite, normal_cdf, power_cdf, uniform_cdf
from quarry.model import Distribution
from quarry.operators.counting import running_counts, value_counts
from quarry.operators.shapiro import shapiro_w

MIN_VALUES = 8
SHAPIRO_MAX = 5000
#: In order of preference if qualities are equal.
FAMILIES = ("normal", "exponential", "exponential_reversed", "uniform", "power_law")


def parameters(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts (keys, v, n) of finite values to (keys, count, mean, std, lo, hi, a): std is that of the population, and a
    the exponent of a power law on [lo, hi], the maximum likelihood over values above lo."""
    n, v = F.col("n"), F.col("v")
    base = counts.groupBy(*keys).agg(F.sum("n").alias("count"), (F.sum(n * v) / F.sum("n")).alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    joined = counts.join(base, keys) if keys else counts.crossJoin(base)
    # centred, so that large values with small spread lose nothing
    inside = (F.col("hi") > F.col("lo")) & (v > F.col("lo"))
    log = F.log(F.when(inside, (v - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    spread = joined.groupBy(*keys).agg(
        F.max("count").alias("count"), F.max("mean").alias("mean"), F.max("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sqrt(F.sum(n * F.pow(v - F.col("mean"), 2)) / F.sum("n")).alias("std"),
        (-F.sum(F.when(inside, n)) / F.sum(n * log)).alias("a"),
    )
    return spread.select(*keys, "count", "mean", "std", "lo", "hi", "a")


def distances(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parameters, d_*): the Kolmogorov distance of each family's fit; null where a family can't be fitted."""
    fitted = parameters(counts, keys)
    run = running_counts(counts, keys, ["n"])
    joined = run.join(fitted, keys) if keys else run.crossJoin(fitted)
    v, lo, hi, mean, std = (F.col(c) for c in ("v", "lo", "hi", "mean", "std"))
    wide = hi > lo
    above, below = F.col("upto_n") / F.col("all_n"), (F.col("upto_n") - F.col("n")) / F.col("all_n")

    def gap(cdf):
        return F.greatest(above - cdf, cdf - below)

    # mirrored: the distance of hi - v from its own fit, whose running counts are those from above
    mirrored = exponential_cdf(hi - v, F.lit(0.0), hi - mean)
    gaps = {
        "normal": F.when(std > 0, gap(normal_cdf(v, mean, std))),
        "exponential": F.when(mean > lo, gap(exponential_cdf(v, lo, mean - lo))),
        "exponential_reversed": F.when(hi > mean, F.greatest((1 - below) - mirrored, mirrored - (1 - above))),
        "uniform": F.when(wide, gap(uniform_cdf(v, lo, hi - lo))),
        "power_law": F.when(wide & (F.col("a") > 0), gap(power_cdf(v, F.col("a"), lo, hi - lo))),
    }
    worst = joined.groupBy(*keys).agg(*(F.max(g).alias(f"d_{f}") for f, g in gaps.items()))
    return fitted.join(worst, keys) if keys else fitted.crossJoin(worst)


def qualities(fits: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Appends ``q_*``, one minus distance: 1 for a constant as a normal, half for a degenerate power law, else 0."""
    out = fits
    for f in families:
        q = 1 - F.col(f"d_{f}")
        if f == "normal":
            q = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(q)
        if f == "power_law":
            q = F.when((F.col("a") > 50) | (F.col("a") < 0.02), q * 0.5).otherwise(q)
        out = out.withColumn(f"q_{f}", F.coalesce(q, F.lit(0.0)))
    return out


def best(fits: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Appends ``family`` and ``quality``: the best, the earlier of equals."""
    out = qualities(fits, families)
    top = F.greatest(*(F.col(f"q_{f}") for f in families))
    family = F.lit(families[-1])
    for f in reversed(families):
        family = F.when(F.col(f"q_{f}") == top, F.lit(f)).otherwise(family)
    return out.withColumn("quality", top).withColumn("family", family)


def finite_counts(values: DataFrame, keys: list[str]) -> DataFrame:
    return value_counts(values.where(finite(F.col("v"))), keys)


def describe(row, family: str) -> tuple[Distribution, dict]:
    """The distribution and its parameters, from a row of ``parameters``."""
    lo, hi, mean = row["lo"], row["hi"], row["mean"]
    if family == "normal":
        return Distribution.NORMAL, {"mean": mean, "std": row["std"]}
    if family == "exponential":
        return Distribution.EXPONENTIAL, {"loc": lo, "scale": mean - lo, "reversed": False}
    if family == "exponential_reversed":
        return Distribution.EXPONENTIAL, {"loc": 0.0, "scale": hi - mean, "reversed": True, "mirror_max": hi}
    if family == "uniform":
        return Distribution.UNIFORM, {"loc": lo, "scale": hi - lo}
    return Distribution.POWER_LAW, {"a": row["a"], "loc": lo, "scale": hi - lo}


def detect(values: DataFrame, use_shapiro: bool = True) -> dict[str, dict]:
    """values (column, v): for each column with enough finite values, its distribution, parameters and quality.

    With ``use_shapiro``, the normal's quality may come from Shapiro-Wilk: of all values if there are few, and of a
    bounded sample by hash once it has won anyway."""
    found = finite_counts(values, ["column"]).cache()
    rows = qualities(distances(found, ["column"])).where(F.col("count") >= MIN_VALUES).collect()
    out = {}
    for row in rows:
        q = {f: row[f"q_{f}"] for f in FAMILIES}
        w = None
        if use_shapiro and row["std"] > 0 and (row["count"] <= SHAPIRO_MAX or max(q, key=q.get) == "normal"):
            w = shapiro_w(_sample(found, row["column"]))
            if row["count"] <= SHAPIRO_MAX:
                q["normal"] = max(q["normal"], w)
        family = max(FAMILIES, key=lambda f: q[f])
        kind, params = describe(row, family)
        quality = max(q[family], w) if w is not None and family == "normal" else q[family]
        out[row["column"]] = {"distribution": kind, "params": params, "fit_quality": quality}
    found.unpersist()
    return out


def _sample(counts: DataFrame, column: str) -> np.ndarray:
    """Up to ``SHAPIRO_MAX`` values of a column, each occurrence by a hash of value and number."""
    one = counts.where(F.col("column") == column).select("v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(SHAPIRO_MAX)))).alias("k"))
    return np.array([r[0] for r in one.orderBy(F.xxhash64("v", "k")).limit(SHAPIRO_MAX).select("v").collect()])
