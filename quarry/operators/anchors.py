"""Which columns must be stored as they are, and the table that stores them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.model import DOMAIN_SUFFIX, LOCAL_SUFFIX, ColumnProfile, Pattern, PatternType
from quarry.operators.formats import split_email
from quarry.operators.profiling import column_counts
from quarry.sources.tables import ROW_ID


def anchor_names(profiles: list[ColumnProfile], patterns: list[Pattern] | None = None, manual: list[str] | None = None, random_format: list[str] | None = None) -> list[str]:
    """Real anchor columns, in schema order: those named, those that are unique, and those without another pattern.
    Columns that are generated by a format are none, even if named; neither are split addresses."""
    names = [p.name for p in profiles]
    if unknown := set(manual or []) - set(names):
        raise ValueError(f"there are no columns {sorted(unknown)}")
    by_column = {p.column: p for p in patterns or []}
    made = set(random_format or []) | {p.column for p in patterns or [] if p.pattern_type == PatternType.RANDOM_FORMAT}
    split = {p.column for p in patterns or [] if p.pattern_type == PatternType.EMAIL_SPLIT}

    def needed(p: ColumnProfile) -> bool:
        pattern = by_column.get(p.name)
        return p.name in (manual or []) or p.is_anchor_candidate or patterns is not None and (pattern is None or pattern.pattern_type == PatternType.ANCHOR_DIRECT)

    return [p.name for p in profiles if p.name not in made | split and needed(p)]


def email_columns(patterns: list[Pattern]) -> dict[str, list[str]]:
    return {p.column: p.format_spec["domain_dict"] for p in patterns if p.pattern_type == PatternType.EMAIL_SPLIT}


def random_format_regexes(patterns: list[Pattern]) -> dict[str, str]:
    return {p.column: p.format_spec["regex"] for p in patterns if p.pattern_type == PatternType.RANDOM_FORMAT}


def extract(df: DataFrame, anchors: list[str], patterns: list[Pattern]) -> tuple[DataFrame, list[str]]:
    """The anchor table, with row ids, and its column names: real ones, then the two of each split address."""
    out, added = df, []
    for column, domains in email_columns(patterns).items():
        out = split_email(out, column, domains)
        added += [column + LOCAL_SUFFIX, column + DOMAIN_SUFFIX]
    columns = [*anchors, *added]
    return out.select(*([ROW_ID] if ROW_ID in df.columns else []), *columns), columns


def unique_columns(df: DataFrame) -> list[str]:
    found = {r["column"] for r in column_counts(df).where("is_unique").select("column").collect()}
    return [c for c in df.columns if c in found]


def for_validation(anchors: list[str], columns: list[str]) -> list[str]:
    """Anchor names as columns of the original table: the two of a split address become the address, once."""
    out: list[str] = []
    for a in anchors:
        base = next((a.removesuffix(s) for s in (LOCAL_SUFFIX, DOMAIN_SUFFIX) if a.endswith(s) and a not in columns), a)
        if base not in out:
            out.append(base)
    return out


def identity(df: DataFrame) -> DataFrame:
    """(column, is_anchor) of each column by uniqueness alone."""
    return column_counts(df).select("column", F.col("is_unique").alias("is_anchor"))
