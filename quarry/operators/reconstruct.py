"""Regenerating a table from anchors and patterns: one expression per column, no shuffle, no Python per row.

Every random draw is a digest of the table's seed key, the column and the number of the draw, so the result doesn't
depend on partitions, on the order of columns, or on which rows are generated together.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import random
from quarry.functions.columns import label
from quarry.model import DOMAIN_SUFFIX, LOCAL_SUFFIX, ColumnProfile, ColumnType, Distribution, Pattern, PatternType, Recipe
from quarry.operators.conditional import lookup_bucket
from quarry.operators.formats import join_email
from quarry.operators.patterns import ordered
from quarry.operators.profiling import kinds_of
from quarry.sources.tables import ROW_ID

#: Lookup tables above this size are joined instead of inlined.
INLINE_LOOKUP = 1000


def literal_array(values: list, kind: str) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")


def draw(key: Column, column: str, kind: Distribution | str, params: dict[str, Any]) -> Column:
    """A value of a distribution: a double, or text for frequencies and listed values."""
    kind = Distribution(kind)
    number = lambda name, default: F.lit(float(params.get(name, default)))
    if kind == Distribution.NORMAL:
        v = random.normal(key, column, F.lit(float(params.get("mean", params.get("loc", 0.0)))), F.lit(float(params.get("std", params.get("scale", 0.0)))))
        if params.get("clip"):
            lo, hi = params["clip"]
            v = F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi)))
        return v
    if kind == Distribution.EXPONENTIAL:
        v = random.exponential(key, column, number("loc", 0.0), number("scale", 1.0))
        return number("mirror_max", 0.0) - v if params.get("reversed") else v
    if kind == Distribution.UNIFORM:
        scale = float(params.get("scale", 1.0))
        return random.uniform_between(key, column, number("loc", 0.0), F.lit(scale)) if scale > 0 else number("loc", 0.0)
    if kind == Distribution.POWER_LAW:
        a = float(params.get("a", 1.0))
        return random.power_law(key, column, F.lit(a if a > 0 else 1.0), number("loc", 0.0), number("scale", 1.0))
    if kind == Distribution.CATEGORICAL_FREQ:
        shares = {k: float(v) for k, v in (params.get("frequencies") or {}).items()}
        if not shares:
            return F.lit(None).cast("string")
        total = sum(shares.values())
        weights = [v / total for v in shares.values()] if total > 0 else [1 / len(shares)] * len(shares)
        upto, run = [], 0.0
        for w in weights:
            run += w
            upto.append(run)
        return random.pick(key, column, literal_array(list(shares), "string"), literal_array(upto, "double"))
    values = [None if v is None else str(v) for v in params.get("values") or []]
    return random.pick_even(key, column, literal_array(values, "string")) if values else F.lit(None).cast("string")


def timestamp_text(v: Column) -> Column:
    """Unix seconds as ISO text, kept between 1970 and 3000."""
    return F.date_format(timestamp(v), "yyyy-MM-dd'T'HH:mm:ssZ")


def timestamp(v: Column) -> Column:
    # 32503680000 is the first second of the year 3000
    inside = F.least(F.greatest(v.cast("double"), F.lit(0.0)), F.lit(32503680000.0))
    return F.timestamp_micros((inside * 1_000_000).cast("long"))


def as_column(v: Column, profile: ColumnProfile) -> Column:
    """A value as the column's type: whole numbers are rounded half to even, texts are read as booleans."""
    if profile.column_type == ColumnType.NUMERIC:
        number = v.try_cast("double")
        return F.bround(number, 0).cast("long") if profile.dtype.lower().startswith("int") else number
    if profile.column_type == ColumnType.BOOLEAN:
        return F.when(v.isNotNull(), F.lower(F.trim(v.cast("string"))).isin("true", "1", "yes", "1.0"))
    return v.cast("string")


def _numeric(v: Column, profile: ColumnProfile) -> Column:
    stats = profile.numeric_stats
    return F.least(F.greatest(v.try_cast("double"), F.lit(stats.min)), F.lit(stats.max)) if stats else v


def _distribution(key: Column, p: Pattern, profile: ColumnProfile) -> Column:
    params = p.distribution_params or {}
    v = draw(key, p.column, p.distribution, params)
    if params.get("unit") == "seconds_since_epoch":
        return timestamp_text(v) if params.get("from_string") or profile.dtype == "object" else timestamp(v)
    if profile.column_type == ColumnType.NUMERIC:
        v = _numeric(v, profile)
    return as_column(v, profile)


def _conditional(key: Column, p: Pattern, profile: ColumnProfile, source: Column, source_kind: str) -> Column:
    buckets = p.conditional_buckets
    if "bucket_range" in buckets[0]:
        edges = [float(buckets[0]["bucket_range"][0]), *(float(b["bucket_range"][1]) for b in buckets)]
        place = lookup_bucket(source.try_cast("double"), edges)
    else:
        names = literal_array([str(b["bucket_value"]) for b in buckets], "string")
        place = F.greatest(F.array_position(names, label(source, source_kind)) - 1, F.lit(0))
        place = F.coalesce(place, F.lit(0))
    out: Column | None = None
    for i, b in enumerate(buckets):
        v = draw(key, p.column, b["distribution"], b["distribution_params"]).cast("string")
        out = F.when(place == i, v) if out is None else out.when(place == i, v)
    if profile.column_type == ColumnType.NUMERIC:
        out = _numeric(out, profile)
    return as_column(out, profile)


def _levels(patterns: list[Pattern]) -> list[list[Pattern]]:
    """Patterns that only need earlier levels, so that a level is one projection."""
    depth: dict[str, int] = {}
    for p in ordered(patterns, break_cycles=True):
        depth[p.column] = max((depth[d] + 1 for d in p.dependencies if d in depth), default=0)
    out: list[list[Pattern]] = [[] for _ in range(max(depth.values(), default=-1) + 1)]
    for p in patterns:
        out[depth[p.column]].append(p)
    return out


def reconstruct(recipe: Recipe, anchors: DataFrame, keep_row_id: bool = True, nulls: bool = False) -> DataFrame:
    """The table in schema order, with ``__row_id``.  With ``nulls``, drawn columns are null as often as in the original.  The seed key is the first anchor column and the row id, so that
    equal anchors don't make equal rows.  Columns without a pattern are copied if they are anchors, and null else."""
    spark: SparkSession = anchors.sparkSession
    profiles = {p.name: p for p in recipe.schema_columns}
    key_parts = [F.col(ROW_ID).cast("string")] if ROW_ID in anchors.columns else []
    if recipe.anchor_columns:
        key_parts.insert(0, F.coalesce(F.col(recipe.anchor_columns[0]).cast("string"), F.lit("")))
    key = F.concat_ws("#", F.lit(recipe.metadata.table_name), *key_parts)
    out = anchors.withColumn("__key", key)
    anchor_names = set(anchors.columns)
    for level in _levels(recipe.patterns):
        made, joins = [], []
        kinds = kinds_of(out)
        for p in level:
            profile = profiles[p.column]
            kind = p.pattern_type
            if kind == PatternType.ANCHOR_DIRECT:
                continue
            if kind == PatternType.EMAIL_SPLIT:
                spec = p.format_spec
                v = join_email(F.col(p.column + LOCAL_SUFFIX), F.col(p.column + DOMAIN_SUFFIX), spec["domain_dict"], spec.get("separator", "@"))
            elif kind == PatternType.RANDOM_FORMAT:
                v = random.formatted(F.col("__key"), p.column, p.format_spec)
            elif kind == PatternType.DISTRIBUTION:
                v = _distribution(F.col("__key"), p, profile)
            elif kind in (PatternType.FUNCTIONAL_DEP, PatternType.LOOKUP):
                if p.source_column not in kinds:
                    v = as_column(F.lit(None).cast("string"), profile)
                else:
                    name = label(F.col(p.source_column), kinds[p.source_column])
                    table = {str(k): (None if x is None else str(x)) for k, x in (p.lookup_table or {}).items()}
                    if len(table) > INLINE_LOOKUP:
                        joins.append((p, name, table))
                        continue
                    keys, values = literal_array(list(table), "string"), literal_array(list(table.values()), "string")
                    v = as_column(F.try_element_at(values, F.nullif(F.array_position(keys, name).cast("int"), F.lit(0))), profile)
            elif p.source_column in kinds:
                v = _conditional(F.col("__key"), p, profile, F.col(p.source_column), kinds[p.source_column])
            else:
                # the source was lost with a broken cycle: its buckets together
                v = _conditional(F.col("__key"), p, profile, F.lit(None).cast("string"), "string")
            if nulls and kind in (PatternType.DISTRIBUTION, PatternType.CONDITIONAL_DISTRIBUTION, PatternType.RANDOM_FORMAT) and profile.n_null:
                v = F.when(random.uniform(F.col("__key"), p.column, "null") >= profile.null_ratio, v)
            made.append(v.alias(p.column))
        out = out.select("*", *made) if made else out
        for p, name, table in joins:
            rows = spark.createDataFrame(list(table.items()), "__k string, __v string")
            joined = out.withColumn("__name", name).join(rows, F.col("__name") == F.col("__k"), "left")
            out = joined.withColumn(p.column, as_column(F.col("__v"), profiles[p.column])).drop("__name", "__k", "__v")
    columns = []
    for p in recipe.schema_columns:
        columns.append(F.col(p.name) if p.name in out.columns or p.name in anchor_names else as_column(F.lit(None).cast("string"), p).alias(p.name))
    row = [ROW_ID] if keep_row_id and ROW_ID in anchors.columns else []
    return out.select(*row, *columns)
