"""Entry points: compress a table to recipe and anchors, rebuild it, compare the two."""

from __future__ import annotations

import logging
import os
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quarry.model import ColumnType, Recipe, RecipeMetadata, ValidationReport
from quarry.operators import anchors as anchoring
from quarry.operators import patterns as patterning
from quarry.operators import validation
from quarry.operators.jobs import together
from quarry.operators.profiling import profile
from quarry.operators.reconstruct import reconstruct
from quarry.sources import html, recipes, tables

log = logging.getLogger(__name__)


@dataclass
class CompressionResult:
    recipe_path: str
    anchor_path: str
    original_size_bytes: int
    recipe_size_bytes: int
    anchor_size_bytes: int
    compression_ratio: float
    elapsed_seconds: float
    n_rows: int
    n_columns: int
    anchor_columns: list[str]
    n_patterns: int
    html_profile_path: str | None = None
    recipe: Recipe | None = None


@dataclass
class ReconstructionResult:
    output_path: str
    n_rows: int
    elapsed_seconds: float


@dataclass
class ValidationBundle:
    report: ValidationReport
    elapsed_seconds: float
    anchor_columns: list[str] = field(default_factory=list)


def describe(df: DataFrame, manual_anchors: list[str] | None = None, random_format: list[str] | None = None, aggressive_uuid: bool = False, use_shapiro: bool = True, relaxed: bool = False):
    """Profiles, patterns, anchor names and evidence of a table with row ids.  Anchors and patterns settle each other:
    patterns are built for the anchors that uniqueness suggests, and again if they ask for other anchors; the second
    time reuses what the first one has measured."""
    profiles = profile(df)
    evidence = patterning.Evidence(df, profiles, use_shapiro)
    first = anchoring.anchor_names(profiles, None, manual_anchors, random_format)
    found = patterning.build(evidence, first, random_format, aggressive_uuid, relaxed)
    final = anchoring.anchor_names(profiles, found, manual_anchors, random_format)
    if set(final) != set(first):
        found = patterning.build(evidence, final, random_format, aggressive_uuid, relaxed)
    return profiles, found, final, evidence


def planned_tests(profiles, n_rows: int) -> list[dict]:
    out = [{"test": "row_count", "expected": n_rows}, {"test": "schema_match", "columns": [p.name for p in profiles]}]
    return out + [{"test": "ks", "column": p.name} for p in profiles if p.column_type in (ColumnType.NUMERIC, ColumnType.DATETIME)]


def compress_table(
    df: DataFrame,
    output_dir: str,
    table_name: str,
    original_bytes: int,
    manual_anchors: list[str] | None = None,
    random_format: list[str] | None = None,
    codec: str = "zstd",
    level: int | None = 19,
    html_profile: bool = False,
    aggressive_uuid: bool = False,
    anchor_files: int | None = None,
    use_shapiro: bool = True,
    relaxed: bool = False,
) -> CompressionResult:
    """Writes ``recipes/<table>.md`` and ``anchors/<table>_anchors.parquet`` below ``output_dir``."""
    if codec not in tables.CODECS:
        raise ValueError(f"unknown codec {codec!r}")
    began = time.perf_counter()
    rows = tables.with_row_id(df).cache()
    profiles, found, names, evidence = describe(rows, manual_anchors, random_format, aggressive_uuid, use_shapiro, relaxed)
    n = profiles[0].n_total if profiles else rows.count()
    page = None
    if html_profile:
        try:
            page = html.write_profile(profiles, f"{output_dir}/profiling_reports/{table_name}.html", table_name)
        except OSError as e:  # a report is not worth losing the rest
            log.warning("no HTML profile: %s", e)
    stored, columns = anchoring.extract(rows, names, found)
    recipe_path, anchor_path = f"{output_dir}/recipes/{table_name}.md", f"{output_dir}/anchors/{table_name}_anchors.parquet"
    size = tables.write_anchors(stored.orderBy(tables.ROW_ID), anchor_path, codec, level, anchor_files)
    metadata = RecipeMetadata(table_name, n, original_bytes, size, compression_ratio=original_bytes / max(size, 1))
    relative = anchor_path if "://" in anchor_path else os.path.relpath(os.path.abspath(anchor_path), os.path.dirname(os.path.abspath(recipe_path)))
    recipe = Recipe(metadata, profiles, columns, relative, found, evidence.correlations or [], evidence.dependencies or [], planned_tests(profiles, n))
    recipes.write(recipe, recipe_path)
    rows.unpersist()
    total = recipe.metadata.recipe_size_bytes + size
    recipe.metadata.compression_ratio = original_bytes / total if total else 0.0
    return CompressionResult(
        recipe_path, anchor_path, original_bytes, recipe.metadata.recipe_size_bytes, size, recipe.metadata.compression_ratio,
        time.perf_counter() - began, n, len(profiles), columns, len(found), page, recipe,
    )


def compress(spark: SparkSession, input_csv: str, output_dir: str, table_name: str | None = None, **options) -> CompressionResult:
    if "://" not in input_csv and not os.path.exists(input_csv):
        raise FileNotFoundError(input_csv)
    name = table_name or os.path.basename(input_csv.rstrip("/")).rsplit(".", 1)[0]
    return compress_table(tables.read_csv(spark, input_csv), output_dir, name, tables.folder_size(spark, input_csv), **options)


def rebuild(spark: SparkSession, recipe_path: str, anchors_path: str | None = None) -> DataFrame:
    recipe = recipes.read(recipe_path)
    return reconstruct(recipe, tables.read_anchors(spark, anchors_path or recipes.anchor_path(recipe, recipe_path)))


def decompress(spark: SparkSession, recipe_path: str, output_csv: str, anchors_path: str | None = None, single_file: bool = True) -> ReconstructionResult:
    if not os.path.exists(recipe_path):
        raise FileNotFoundError(recipe_path)
    began = time.perf_counter()
    df = rebuild(spark, recipe_path, anchors_path)
    tables.write_csv(df, output_csv, single_file)
    return ReconstructionResult(output_csv, recipes.read(recipe_path).metadata.n_rows, time.perf_counter() - began)


def compare(a: DataFrame, b: DataFrame, anchor_columns: list[str] | None = None, formats: dict[str, str] | None = None, thresholds: validation.Thresholds | None = None) -> ValidationBundle:
    began = time.perf_counter()
    a, b = together(lambda: tables.with_row_id(a).cache(), lambda: tables.with_row_id(b).cache())
    names = anchoring.unique_columns(a) if anchor_columns is None else anchor_columns
    names = [c for c in anchoring.for_validation(names, a.columns) if c != tables.ROW_ID]
    report = validation.validate(a, b, names, thresholds, formats)
    a.unpersist()
    b.unpersist()
    return ValidationBundle(report, time.perf_counter() - began, names)


def validate_pair(spark: SparkSession, original_csv: str, reconstructed_csv: str, anchor_columns: list[str] | None = None, recipe_path: str | None = None) -> ValidationBundle:
    """Compares two CSV tables.  With the recipe, its anchors and formats are used."""
    for path in (original_csv, reconstructed_csv):
        if "://" not in path and not os.path.exists(path):
            raise FileNotFoundError(path)
    a = tables.read_csv(spark, original_csv)
    b = tables.read_csv(spark, reconstructed_csv, a.schema)
    formats: dict[str, str] = {}
    if recipe_path:
        recipe = recipes.read(recipe_path)
        formats = anchoring.random_format_regexes(recipe.patterns)
        anchor_columns = recipe.anchor_columns if anchor_columns is None else anchor_columns
    return compare(a, b, anchor_columns, formats)
