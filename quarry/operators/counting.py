"""Distinct values with counts, and running counts over them: the base of quantiles and of Kolmogorov distances.

A window over all values in order would put them into one task.  Here each key's values are cut at approximate
quantiles into ``PIECES``; sums over pieces are few and run over in a small window, and within a piece values run in a
window of their own.  The cuts decide only how evenly work is spread, never the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECES = 64


def long_values(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """(column, v): the non-null values of the columns below each other, cast to one type."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("v")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.v").where("v is not null")


def value_counts(values: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, v, n)."""
    return values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def running_counts(counts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """counts (keys, v, sums): appends, for each of ``sums``, ``upto_*`` (of values up to v) and ``all_*``.  Rows with a
    null key are left out."""
    for key in keys:
        counts = counts.where(F.col(key).isNotNull())
    # the sums are mentioned so that all uses of ``counts`` read the same columns, and Spark makes them only once
    v = F.when(F.least(*(F.col(s) for s in sums), F.lit(0)) >= 0, F.col("v"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(v, [i / PIECES for i in range(1, PIECES)], 1000).alias("__cuts"))
    cuts = cuts.withColumn("__coarse", F.filter("__cuts", lambda c, i: i % 8 == 7))
    cut = counts.join(cuts, keys) if keys else counts.crossJoin(cuts)
    # a value's piece by two short looks: among every eighth cut, then among the seven between two of these
    eighth = F.size(F.filter("__coarse", lambda c: c < F.col("v")))
    fine = F.filter(F.slice("__cuts", F.col("__eighth") * 8 + 1, F.lit(7)), lambda c: c < F.col("v"))
    placed = cut.withColumn("__eighth", eighth).withColumn("__piece", F.col("__eighth") * 8 + F.size(fine)).drop("__cuts", "__coarse", "__eighth")
    by_piece = placed.groupBy(*keys, "__piece").agg(*(F.sum(s).alias(f"__p_{s}") for s in sums))
    pieces = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = pieces.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_piece.select(
        *keys,
        "__piece",
        *(F.coalesce(F.sum(f"__p_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums),
        *(F.sum(f"__p_{s}").over(pieces).alias(f"all_{s}") for s in sums),
    )
    within = Window.partitionBy(*keys, "__piece").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.join(offsets, [*keys, "__piece"])
    for s in sums:
        run = run.withColumn(f"upto_{s}", F.sum(s).over(within) + F.col(f"__o_{s}"))
    return run.drop("__piece", *(f"__o_{s}" for s in sums))


def quantiles(counts: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """(keys, one column per name): quantiles with linear interpolation, exact, from (keys, v, n)."""
    run = running_counts(counts, keys, ["n"])
    below = F.col("upto_n") - F.col("n")

    def at(rank):
        return F.max(F.when((below <= rank) & (rank < F.col("upto_n")), F.col("v")))

    out = []
    for name, p in probabilities.items():
        rank = (F.col("all_n") - 1) * F.lit(float(p))
        out += [at(F.floor(rank)).alias(f"__lo_{name}"), at(F.ceil(rank)).alias(f"__hi_{name}"), F.max(rank - F.floor(rank)).alias(f"__f_{name}")]
    found = run.groupBy(*keys).agg(*out)
    lo, hi, f = (lambda n: F.col(f"__lo_{n}")), (lambda n: F.col(f"__hi_{n}")), (lambda n: F.col(f"__f_{n}"))
    return found.select(*keys, *((lo(n) + (hi(n) - lo(n)) * f(n)).alias(n) for n in probabilities))
