"""Column expressions that several operators share.  All of them stay inside the engine: no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes of texts, in order of preference; \w and \d take any script's letters and digits.
TEXT_CLASSES = {
    "email": r"(?U)^[\w.\-+]+@[\w.\-]+\.\w{2,}$",
    "url": r"(?U)^https?://[^\s]+$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "phone": r"(?U)^[+\d][\d\s\-().]{6,}$",
}
# Addresses that can be split into local part and domain, the known random formats, and id-like names.
SPLIT_EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
BCRYPT = r"^(\$bcrypt\$\d+[a-z]?\$\d+\$)([0-9a-f]+)(\$)$"
UUID_V4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
HEX_HASH = r"^[0-9a-f]{32,128}$"
ID_LIKE_NAME = r"(?i)^(id|uuid|uid|pk|.*_id|.*_uuid|.*_uid|.*_pk)$"

#: A year alone casts to a timestamp, so a text must look like a date first.
ISO_SHAPE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+\-]\d{2}:?\d{2})?)?\s*\z"


def finite(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def parsed_timestamp(text: Column) -> Column:
    """Null where the text isn't a date."""
    return F.when(text.rlike(ISO_SHAPE), F.try_to_timestamp(text))


def seconds(ts: Column) -> Column:
    """Unix seconds of a timestamp, with or without time zone, as a double."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; the error is below 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column, mean: Column, std: Column) -> Column:
    return 0.5 * (1 + erf((x - mean) / (std * 1.4142135623730951)))


def exponential_cdf(x: Column, loc: Column, scale: Column) -> Column:
    return 1 - F.exp(-F.greatest(x - loc, F.lit(0.0)) / scale)


def uniform_cdf(x: Column, loc: Column, scale: Column) -> Column:
    return F.least(F.greatest((x - loc) / scale, F.lit(0.0)), F.lit(1.0))


def power_cdf(x: Column, a: Column, loc: Column, scale: Column) -> Column:
    return F.pow(uniform_cdf(x, loc, scale), a)


def label(c: Column, kind: str) -> Column:
    """The text that stands for a value as a key: booleans as True and False, whole doubles with .0."""
    if kind == "boolean":
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def json_safe(c: Column) -> Column:
    """Null for numbers that JSON has no form for."""
    return F.when(finite(c), c)
