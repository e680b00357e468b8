"""Reproducible randomness: draws are digests of what they are for, so they depend on no partition, order or engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(key: Column, column: str, draw: int | str = 0) -> Column:
    """SHA-256, in hex, of the row's key, the column and the number of the draw."""
    return F.sha2(F.concat_ws("|", F.lit(column), key.cast("string"), F.lit(str(draw))), 256)


def uniform_of(hex_digest: Column) -> Column:
    """In [0, 1), from the first 52 bits."""
    return F.conv(F.substring(hex_digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform(key: Column, column: str, draw: int | str = 0) -> Column:
    return uniform_of(digest(key, column, draw))


def standard_normal(key: Column, column: str) -> Column:
    """Box-Muller on two draws."""
    radius = F.sqrt(-2 * F.log(1 - uniform(key, column, 0)))
    return radius * F.cos(6.283185307179586 * uniform(key, column, 1))


def row_seed(key: Column, salt: str = "") -> Column:
    """The first 32 bits of the SHA-256 of salt and key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), 1, 8), 16, 10).cast("long")


def normal(key: Column, column: str, mean, std) -> Column:
    return mean + standard_normal(key, column) * std


def exponential(key: Column, column: str, loc, scale) -> Column:
    return loc - F.log(1 - uniform(key, column)) * scale


def uniform_between(key: Column, column: str, loc, scale) -> Column:
    return loc + uniform(key, column) * scale


def power_law(key: Column, column: str, a, loc, scale) -> Column:
    return loc + F.pow(uniform(key, column), 1 / a) * scale


def pick(key: Column, column: str, values: Column, cumulative: Column) -> Column:
    """The value whose share of the cumulative frequencies (up to 1) the draw falls into."""
    u = uniform(key, column)
    below = F.size(F.filter(cumulative, lambda c: c <= u))
    return F.try_element_at(values, F.least(below, F.size(values) - 1) + 1)


def pick_even(key: Column, column: str, values: Column) -> Column:
    return F.try_element_at(values, F.floor(uniform(key, column) * F.size(values)).cast("int") + 1)


def _hex(key: Column, column: str, length: int) -> Column:
    blocks = [digest(key, column, f"h{i}") for i in range(-(-length // 64))]
    return F.substring(F.concat(*blocks), 1, length)


# The letters of each kind of body.
POOLS = {
    "ascii_lower": "abcdefghijklmnopqrstuvwxyz",
    "digits": "0123456789",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
}


def formatted(key: Column, column: str, spec: dict) -> Column:
    """A value of a random format: prefix, a body of so many characters of a kind, suffix."""
    kind, length = spec["body_type"], int(spec["body_length"])
    if kind == "uuid_v4":
        h = _hex(key, column, 32)
        variant = F.substr(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
        body = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    elif kind == "hex":
        body = _hex(key, column, length)
    elif kind in POOLS:
        pool = POOLS[kind]
        bits = _hex(key, column, 4 * length)
        at = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.conv(F.substr(bits, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % len(pool))
        body = F.array_join(F.transform(at, lambda i: F.substr(F.lit(pool), i + 1, F.lit(1))), "") if length else F.lit("")
    else:
        raise ValueError(f"unknown kind of body {kind!r}")
    return F.concat(F.lit(spec.get("prefix") or ""), body, F.lit(spec.get("suffix") or ""))
