"""Column profiles: one fused aggregation for counts, moments and text classes, one long table for distinct values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import TEXT_CLASSES, label, parsed_timestamp, seconds
from quarry.model import CategoricalStats, ColumnProfile, ColumnType, DatetimeStats, NumericStats, TextClass
from quarry.operators.counting import long_values, quantiles, value_counts
from quarry.sources.tables import ROW_ID

CATEGORICAL_RATIO = 0.05
MATCH_RATIO = 0.95
TOP = 20
EXAMPLES = 5


def base_kind(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "string" if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else "other"


def kinds_of(df: DataFrame) -> dict[str, str]:
    return {f.name: base_kind(f.dataType) for f in df.schema if f.name != ROW_ID}


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, min, max, skewness, kurtosis) over non-null values: one pass.  Skewness and excess kurtosis
    carry the sample correction, and are null for fewer than 3 (4) values or without variance."""
    aggregates = []
    for c in columns:
        v = F.col(c).cast("double")
        aggregates.append(
            F.struct(
                F.lit(c).alias("column"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
                F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("std_pop"),
            )
        )
    rows = df.agg(F.array(*aggregates).alias("rows")).select(F.inline("rows"))
    n = F.col("n").cast("double")
    varied = F.col("variance") > 0
    skew = F.when((n >= 3) & varied, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n >= 4) & varied, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return rows.select("column", "n", "mean", "std", "min", "max", "std_pop", skew.alias("skewness"), kurt.alias("kurtosis"))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``moments`` with exact quartiles q25, q50 and q75."""
    quartiles = quantiles(value_counts(long_values(df, columns), ["column"]), ["column"], QUARTILES)
    return moments(df, columns).join(quartiles, "column", "left")


def labelled_counts(df: DataFrame) -> DataFrame:
    """(column, v, n): every distinct non-null value of every column, as text, with its count."""
    kinds = kinds_of(df)
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), label(F.col(c), k).alias("v")) for c, k in kinds.items() if k != "other"))
    values = df.select(F.explode(pairs).alias("p")).select("p.column", "p.v").where("v is not null")
    return value_counts(values, ["column"])


def top_values(counts: DataFrame, k: int = TOP) -> DataFrame:
    """(column, v, n, rank): the most frequent values of each column; ties by value.  The cut is made before the shuffle
    as well."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "v"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def column_counts(df: DataFrame) -> DataFrame:
    """(column, n_total, n_null, n_unique, is_unique)."""
    kinds = kinds_of(df)
    counts = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_total"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in kinds)).alias("r"))
    distinct = labelled_counts(df).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    joined = counts.select(F.inline("r")).join(distinct, "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    unique = (F.col("n_total") > 0) & (F.col("n_null") == 0) & (F.col("n_unique") == F.col("n_total"))
    return joined.select("column", "n_total", "n_null", "n_unique", unique.alias("is_unique"))


def datetime_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min_s, max_s, range_days): of timestamps, or of texts that parse as such, in Unix seconds."""
    kinds = kinds_of(df)
    out = []
    for c in columns:
        s = seconds(parsed_timestamp(F.col(c)) if kinds[c] == "string" else F.col(c))
        out.append(F.struct(F.lit(c).alias("column"), F.min(s).alias("min_s"), F.max(s).alias("max_s")))
    return df.agg(F.array(*out).alias("r")).select(F.inline("r")).withColumn("range_days", (F.col("max_s") - F.col("min_s")) / 86400.0)


def text_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, dates, email, url, uuid, phone): shares of the non-null texts; null if there are none."""
    out = []
    for c in columns:
        t = F.col(c)
        share = lambda ok: F.avg(F.when(t.isNotNull(), F.coalesce(ok, F.lit(False)).cast("double")))  # noqa: B023, E731
        out.append(F.struct(F.lit(c).alias("column"), share(parsed_timestamp(t).isNotNull()).alias("dates"), *(share(t.rlike(p)).alias(n) for n, p in TEXT_CLASSES.items())))
    return df.agg(F.array(*out).alias("r")).select(F.inline("r"))


def text_class(ratios: DataFrame) -> DataFrame:
    """(column, regex_pattern) by the first class that enough values match."""
    choice: Column = F.lit("none")
    for name in reversed(TEXT_CLASSES):
        choice = F.when(F.col(name) >= MATCH_RATIO, F.lit(name)).otherwise(choice)
    return ratios.select("column", choice.alias("regex_pattern"))


def column_types(df: DataFrame) -> DataFrame:
    """(column, column_type) by type, then by share of dates, then by share of distinct values."""
    kinds = kinds_of(df)
    texts = [c for c, k in kinds.items() if k == "string"]
    fixed = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    counts = column_counts(df)
    ratios = text_ratios(df, texts).select("column", "dates") if texts else None
    joined = counts.join(ratios, "column", "left") if ratios is not None else counts.withColumn("dates", F.lit(None).cast("double"))
    kind = fixed[F.col("column")]
    few = (F.col("n_total") > 0) & (F.col("n_unique") / F.col("n_total") < CATEGORICAL_RATIO)
    chosen = F.when(kind.isin("boolean", "numeric", "datetime"), kind).when(F.col("dates") >= MATCH_RATIO, "datetime").when(few, "categorical").otherwise("string")
    return joined.select("column", chosen.alias("column_type"))


def examples(counts: DataFrame) -> DataFrame:
    """(column, values): up to five distinct values of each column of ``labelled_counts``, those with the smallest hashes."""
    # the ranking is cut before the shuffle as well
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.xxhash64("column", "v"), "v"))
    chosen = counts.select("column", "v").withColumn("r", rank).where(F.col("r") <= EXAMPLES)
    return chosen.groupBy("column").agg(F.sort_array(F.collect_list("v")).alias("values"))


def _dtype(field: T.StructField, nulls: int) -> str:
    kind = base_kind(field.dataType)
    if kind == "boolean":
        return "bool" if not nulls else "object"
    if kind == "numeric":
        whole = isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        return "int64" if whole and not nulls else "float64"
    return "datetime64[us]" if kind == "datetime" else "object"


def profile(df: DataFrame) -> list[ColumnProfile]:
    """Profiles of all columns, in order.  Only aggregates come to the driver.  The table is read for moments and text
    classes and for its distinct values, which serve counts, top values, quartiles and examples: cache it."""
    from datetime import datetime, timedelta

    kinds = kinds_of(df)
    names = list(kinds)
    numbers = [c for c in names if kinds[c] == "numeric"]
    texts = [c for c in names if kinds[c] == "string"]
    counts = labelled_counts(df).cache()
    distinct = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    top: dict[str, dict[str, int]] = {}
    for r in top_values(counts).orderBy("column", "rank").collect():
        top.setdefault(r["column"], {})[r["v"]] = r["n"]
    nulls = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in names)).first()
    n = nulls["__n"]
    numeric: dict = {}
    if numbers:
        as_numbers = counts.where(F.col("column").isin(numbers)).select("column", F.col("v").cast("double").alias("v"), "n")
        numeric = {r["column"]: r for r in moments(df, numbers).join(quantiles(as_numbers, ["column"], QUARTILES), "column", "left").collect()}
    ratios = text_ratios(df, texts) if texts else None
    dates = {r["column"]: r["dates"] for r in ratios.collect()} if texts else {}
    classes = {r["column"]: r["regex_pattern"] for r in text_class(ratios).collect()} if texts else {}
    when = [c for c in names if kinds[c] == "datetime" or (dates.get(c) or 0) >= MATCH_RATIO]
    spans = {r["column"]: r for r in datetime_stats(df, when).collect()} if when else {}
    shown = {r["column"]: list(r["values"]) for r in examples(counts).collect()}
    counts.unpersist()
    out = []
    for c in names:
        unique, missing = distinct.get(c, 0), nulls[c]
        kind = ColumnType.STRING
        if kinds[c] in ("boolean", "numeric", "datetime"):
            kind = ColumnType(kinds[c])
        elif c in when:
            kind = ColumnType.DATETIME
        elif kinds[c] == "string" and n and unique / n < CATEGORICAL_RATIO:
            kind = ColumnType.CATEGORICAL
        p = ColumnProfile(
            c, _dtype(df.schema[c], missing), kind, n, unique, missing, examples=shown.get(c, []), source_type=kinds[c],
            is_anchor_candidate=kinds[c] == "other" or n > 0 and unique == n and missing == 0,
        )
        if kind == ColumnType.NUMERIC:
            r = numeric.get(c)
            zero = NumericStats(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
            good = r is not None and r["n"] and math.isfinite(r["mean"])
            p.numeric_stats = NumericStats(r["mean"], r["std"] or 0.0, r["min"], r["max"], r["q25"], r["q50"], r["q75"], r["skewness"], r["kurtosis"]) if good else zero
        elif kind in (ColumnType.CATEGORICAL, ColumnType.BOOLEAN):
            p.categorical_stats = CategoricalStats(top.get(c, {}), unique)
        elif kind == ColumnType.DATETIME:
            r, epoch = spans[c], datetime(1970, 1, 1)
            lo, hi = ((epoch + timedelta(microseconds=round(x * 1e6)) if x is not None else epoch) for x in (r["min_s"], r["max_s"]))
            p.datetime_stats = DatetimeStats(lo, hi, r["range_days"] or 0.0)
        elif kinds[c] == "string":
            p.regex_pattern = TextClass(classes.get(c, "none"))
        out.append(p)
    return out


def profile_frame(df: DataFrame) -> DataFrame:
    """Profiles as rows: column, column_type, n_total, n_null, n_unique, is_unique."""
    return column_counts(df).join(column_types(df), "column")
