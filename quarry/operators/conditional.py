"""Distributions of one column given another: buckets of the pivot, and what the target looks like in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import label
from quarry.model import Distribution
from quarry.operators.counting import long_values, quantiles, value_counts
from quarry.operators.fitting import MIN_VALUES, best, describe, distances, finite_counts
from quarry.operators.profiling import kinds_of

BUCKETS = 10


def quantile_edges(df: DataFrame, pivot: str, buckets: int = BUCKETS) -> list[float]:
    """Distinct quantile edges of a numeric pivot, ends included."""
    probabilities = {f"e{i}": i / buckets for i in range(buckets + 1)}
    row = quantiles(value_counts(long_values(df, [pivot]), ["column"]), ["column"], probabilities).first()
    return sorted({row[name] for name in probabilities}) if row else []


def detection_bucket(v: Column, edges: list[float]) -> Column:
    """0, 1...: bins are closed on the right, and the first one on both sides."""
    inner = F.array(*map(F.lit, edges[1:-1])) if len(edges) > 2 else F.array().cast("array<double>")
    return F.size(F.filter(inner, lambda e: e < v))


def lookup_bucket(v: Column, edges: list[float]) -> Column:
    """0, 1...: bins are closed on the left, the last one on both sides; values outside belong to the nearest bin."""
    inner = F.array(*map(F.lit, edges[1:-1])) if len(edges) > 2 else F.array().cast("array<double>")
    return F.coalesce(F.size(F.filter(inner, lambda e: e <= v)), F.lit(0))


def bucketed(df: DataFrame, pivot: str, edges: list[float] | None) -> DataFrame:
    """Rows with a pivot, with their bucket: a number for numeric pivots, else the value's text."""
    kind = kinds_of(df)[pivot]
    there = df.where(F.col(pivot).isNotNull())
    if edges is not None:
        return there.withColumn("bucket", detection_bucket(F.col(pivot).cast("double"), edges))
    return there.withColumn("bucket", label(F.col(pivot), kind))


def frequencies(rows: DataFrame, target: str) -> DataFrame:
    """(bucket, v, n, share) of a categorical target."""
    kind = kinds_of(rows)[target]
    counts = value_counts(rows.where(F.col(target).isNotNull()).select("bucket", label(F.col(target), kind).alias("v")), ["bucket"])
    totals = counts.groupBy("bucket").agg(F.sum("n").alias("total"))
    return counts.join(totals, "bucket").select("bucket", "v", "n", (F.col("n") / F.col("total")).alias("share"))


def numeric_fits(rows: DataFrame, target: str) -> DataFrame:
    """(bucket, parameters, family, quality) of a numeric target: the better of normal and uniform."""
    counts = finite_counts(rows.select("bucket", F.col(target).cast("double").alias("v")), ["bucket"])
    return best(distances(counts, ["bucket"]), ("normal", "uniform"))


def conditional_buckets(df: DataFrame, pivot: str, target: str, buckets: int = BUCKETS) -> list[dict]:
    """A description per bucket: its range or value, and frequencies or a distribution of the target.  Buckets with few
    numeric values keep the values themselves."""
    if pivot == target:
        raise ValueError("a column can't be its own pivot")
    kinds = kinds_of(df)
    pairs = df.select(pivot, target).where(F.col(pivot).isNotNull() & F.col(target).isNotNull())
    edges = quantile_edges(pairs, pivot, buckets) if kinds[pivot] == "numeric" else None
    if edges is not None and len(edges) < 2:
        edges = None
        pairs = pairs.withColumn(pivot, F.col(pivot).cast("string"))
    rows = bucketed(pairs, pivot, edges)
    found: dict = {}
    if kinds[target] == "numeric":
        for r in numeric_fits(rows, target).collect():
            kind, params = describe(r, r["family"])
            found[r["bucket"]] = {"distribution": kind.value, "distribution_params": params, "count": r["count"]}
        few = [b for b, x in found.items() if x["count"] < MIN_VALUES]
        if few:
            # fewer than MIN_VALUES values each
            small = rows.where(F.col("bucket").isin(few)).groupBy("bucket").agg(F.sort_array(F.collect_list(F.col(target).cast("double"))).alias("values"))
            for r in small.collect():
                found[r["bucket"]] = {"distribution": Distribution.EMPIRICAL.value, "distribution_params": {"values": list(r["values"])}, "count": len(r["values"])}
    else:
        for r in frequencies(rows, target).collect():
            entry = found.setdefault(r["bucket"], {"distribution": Distribution.CATEGORICAL_FREQ.value, "distribution_params": {"frequencies": {}}, "count": 0})
            entry["distribution_params"]["frequencies"][r["v"]] = r["share"]
            entry["count"] += r["n"]
    out = []
    for bucket in sorted(found):
        entry = found[bucket]
        if "frequencies" in entry["distribution_params"]:
            entry["distribution_params"]["frequencies"] = dict(sorted(entry["distribution_params"]["frequencies"].items(), key=lambda x: (-x[1], x[0])))
        where = {"bucket_value": bucket} if edges is None else {"bucket_range": [edges[bucket], edges[bucket + 1]]}
        out.append(where | entry)
    return out
