"""Profiles of a stream: counts and moments that grow with the rows that have come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_moments(stream: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_total, n_null, mean, std, min, max) so far; write it with output mode ``complete`` or ``update``.  The
    state is one row per column."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))
    long = stream.select(F.explode(pairs).alias("p")).select("p.column", "p.v")
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("v").isNull()).alias("n_null"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
