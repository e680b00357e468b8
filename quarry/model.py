"""Documents that the engine keeps on the driver: profiles, patterns, recipes and reports.

They hold descriptions, never rows, so their size depends on the number of columns and not on the data.  ``to_dict``
and ``from_dict`` are inverse to each other and give plain JSON values.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from datetime import datetime
from enum import Enum
from typing import Any


class ColumnType(str, Enum):
    NUMERIC = "numeric"
    CATEGORICAL = "categorical"
    DATETIME = "datetime"
    STRING = "string"
    BOOLEAN = "boolean"


class Distribution(str, Enum):
    NORMAL = "normal"
    EXPONENTIAL = "exponential"
    UNIFORM = "uniform"
    POWER_LAW = "power_law"
    CATEGORICAL_FREQ = "categorical_freq"
    EMPIRICAL = "empirical"


class TextClass(str, Enum):
    EMAIL = "email"
    PHONE = "phone"
    URL = "url"
    UUID = "uuid"
    NONE = "none"


class PatternType(str, Enum):
    DISTRIBUTION = "distribution"
    LOOKUP = "lookup"
    FUNCTIONAL_DEP = "functional_dep"
    CONDITIONAL_DISTRIBUTION = "conditional_distribution"
    ANCHOR_DIRECT = "anchor_direct"
    RANDOM_FORMAT = "random_format"
    EMAIL_SPLIT = "email_split"


def _plain(value: Any) -> Any:
    if isinstance(value, Enum):
        return value.value
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value


class Document:
    """Strict fields: an unknown one is an error."""

    def to_dict(self) -> dict[str, Any]:
        return _plain(asdict(self))

    @classmethod
    def from_dict(cls, data: dict[str, Any]):
        known = {f.name for f in fields(cls)}
        if extra := set(data) - known:
            raise ValueError(f"{cls.__name__} has no fields {sorted(extra)}")
        return cls(**data)


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass
class NumericStats(Document):
    mean: float
    std: float
    min: float
    max: float
    q25: float
    q50: float
    q75: float
    skewness: float | None = None
    kurtosis: float | None = None

    def __post_init__(self):
        _need(self.min <= self.max and self.q25 <= self.q50 <= self.q75, "numeric statistics are out of order")


@dataclass
class CategoricalStats(Document):
    top_values: dict[str, int]
    n_categories: int

    def __post_init__(self):
        _need(self.n_categories >= 0, "a number of categories can't be negative")


@dataclass
class DatetimeStats(Document):
    min: datetime
    max: datetime
    range_days: float

    def __post_init__(self):
        self.min, self.max = (datetime.fromisoformat(x) if isinstance(x, str) else x for x in (self.min, self.max))
        _need(self.min <= self.max and self.range_days >= 0, "datetime statistics are out of order")


@dataclass
class ColumnProfile(Document):
    name: str
    dtype: str
    column_type: ColumnType
    n_total: int
    n_unique: int
    n_null: int
    numeric_stats: NumericStats | None = None
    categorical_stats: CategoricalStats | None = None
    datetime_stats: DatetimeStats | None = None
    regex_pattern: TextClass = TextClass.NONE
    is_anchor_candidate: bool = False
    examples: list[Any] = field(default_factory=list)
    #: ``string`` if the values were text, whatever the semantic type.
    source_type: str = ""

    def __post_init__(self):
        self.column_type, self.regex_pattern = ColumnType(self.column_type), TextClass(self.regex_pattern)
        for name, kind in (("numeric_stats", NumericStats), ("categorical_stats", CategoricalStats), ("datetime_stats", DatetimeStats)):
            if isinstance(getattr(self, name), dict):
                setattr(self, name, kind.from_dict(getattr(self, name)))
        _need(0 <= self.n_unique <= self.n_total and 0 <= self.n_null <= self.n_total, f"counts of {self.name} don't fit each other")
        _need(len(self.examples) <= 5, "a profile has five examples at most")

    @property
    def cardinality(self) -> float:
        return self.n_unique / self.n_total if self.n_total else 0.0

    @property
    def null_ratio(self) -> float:
        return self.n_null / self.n_total if self.n_total else 0.0


@dataclass
class Correlation(Document):
    col_a: str
    col_b: str
    correlation_type: str
    strength: float
    p_value: float | None = None

    def __post_init__(self):
        _need(self.correlation_type in ("pearson", "cramers_v", "anova"), f"unknown correlation {self.correlation_type}")
        _need(0 <= self.strength <= 1, "a strength is between 0 and 1")


@dataclass
class FunctionalDependency(Document):
    determinant: str
    dependent: str
    is_bijection: bool
    mapping_size: int

    def __post_init__(self):
        _need(self.determinant != self.dependent, "a column can't determine itself")


#: What a random format's specification must tell.
FORMAT_KEYS = ("regex", "prefix", "suffix", "body_type", "body_length")


@dataclass
class Pattern(Document):
    column: str
    pattern_type: PatternType
    distribution: Distribution | None = None
    distribution_params: dict[str, Any] | None = None
    source_column: str | None = None
    lookup_table: dict[str, Any] | None = None
    conditional_buckets: list[dict[str, Any]] | None = None
    format_spec: dict[str, Any] | None = None
    fidelity_estimate: float = 1.0
    dependencies: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.pattern_type = kind = PatternType(self.pattern_type)
        if self.distribution is not None:
            self.distribution = Distribution(self.distribution)
        _need(0 <= self.fidelity_estimate <= 1, "a fidelity is between 0 and 1")
        _need(kind != PatternType.DISTRIBUTION or self.distribution is not None, f"{self.column}: no distribution")
        looks_up = kind in (PatternType.LOOKUP, PatternType.FUNCTIONAL_DEP)
        _need(not looks_up or self.source_column is not None, f"{self.column}: no source column")
        _need(kind != PatternType.FUNCTIONAL_DEP or self.lookup_table is not None, f"{self.column}: no lookup table")
        conditional = kind == PatternType.CONDITIONAL_DISTRIBUTION
        _need(not conditional or bool(self.source_column and self.conditional_buckets), f"{self.column}: no source column or buckets")
        if kind == PatternType.RANDOM_FORMAT:
            _need(bool(self.format_spec) and all(k in self.format_spec for k in FORMAT_KEYS), f"{self.column}: an incomplete format")
        if kind == PatternType.EMAIL_SPLIT:
            spec = self.format_spec or {}
            _need(bool(spec.get("separator")) and isinstance(spec.get("domain_dict"), list) and bool(spec["domain_dict"]), f"{self.column}: no separator or domains")


@dataclass
class RecipeMetadata(Document):
    table_name: str
    n_rows: int
    original_size_bytes: int
    anchor_size_bytes: int
    recipe_size_bytes: int = 0
    compression_ratio: float = 0.0
    fidelity_target: float = 0.95
    seed_strategy: str = "sha256_column_key_draw"
    version: str = "1.0"

    def __post_init__(self):
        _need(min(self.n_rows, self.original_size_bytes, self.anchor_size_bytes, self.recipe_size_bytes) >= 0, "sizes can't be negative")


LOCAL_SUFFIX, DOMAIN_SUFFIX = "__local", "__domain_idx"


@dataclass
class Recipe(Document):
    metadata: RecipeMetadata
    schema_columns: list[ColumnProfile]
    anchor_columns: list[str]
    anchor_file: str
    patterns: list[Pattern]
    correlations: list[Correlation] = field(default_factory=list)
    functional_dependencies: list[FunctionalDependency] = field(default_factory=list)
    validation_tests: list[dict[str, Any]] = field(default_factory=list)

    def __post_init__(self):
        if isinstance(self.metadata, dict):
            self.metadata = RecipeMetadata.from_dict(self.metadata)
        for name, kind in (("schema_columns", ColumnProfile), ("patterns", Pattern), ("correlations", Correlation), ("functional_dependencies", FunctionalDependency)):
            setattr(self, name, [kind.from_dict(x) if isinstance(x, dict) else x for x in getattr(self, name)])
        names = {c.name for c in self.schema_columns}
        mails = {p.column for p in self.patterns if p.pattern_type == PatternType.EMAIL_SPLIT}
        made = {c + s for c in mails for s in (LOCAL_SUFFIX, DOMAIN_SUFFIX)}
        if unknown := set(self.anchor_columns) - names - made:
            raise ValueError(f"anchor columns {sorted(unknown)} are not in the schema")


@dataclass
class TestResult(Document):
    __test__ = False

    test_name: str
    passed: bool
    metric: float | None = None
    threshold: float | None = None
    column: str | None = None
    details: str = ""


@dataclass
class ValidationReport(Document):
    overall_score: float
    passed_count: int
    failed_count: int
    structural_tests: list[TestResult] = field(default_factory=list)
    statistical_tests: list[TestResult] = field(default_factory=list)

    @property
    def is_fidelity_target_met(self) -> bool:
        return self.overall_score / 100 >= 0.95
