"""Random formats (hashes, UUIDs, bcrypt-like strings) and splitting of e-mail addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import BCRYPT, HEX_HASH, ID_LIKE_NAME, SPLIT_EMAIL, UUID_V4
from quarry.model import DOMAIN_SUFFIX, LOCAL_SUFFIX
from quarry.sources.tables import ROW_ID

#: In order of preference.
FORMATS = {"bcrypt_hash": BCRYPT, "uuid_v4_anchor": UUID_V4, "hex_hash": HEX_HASH}
MATCH_RATIO = 0.95
MAX_DOMAINS = 256


def looks_like_id(column: str) -> bool:
    return re.match(ID_LIKE_NAME, column) is not None


def format_matches(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, one share per format, one first match per format), over all non-null values, in one pass."""
    order = F.col(ROW_ID) if ROW_ID in df.columns else None
    out = []
    for c in columns:
        text = F.col(c).cast("string")
        parts = [F.lit(c).alias("column"), F.count(text).alias("n")]
        for name, pattern in FORMATS.items():
            hit = text.rlike(pattern)
            parts.append(F.avg(hit.cast("double")).alias(name))
            value = F.when(hit, text)
            first = F.min_by(value, F.when(hit, order)) if order is not None else F.min(value)
            parts.append(first.alias(f"first_{name}"))
        out.append(F.struct(*parts))
    return df.agg(F.array(*out).alias("r")).select(F.inline("r"))


def specification(name: str, value: str) -> dict:
    """Prefix, suffix, kind and length of the body, and a pattern, from one value of the format."""
    if name == "uuid_v4_anchor":
        return {"prefix": "", "suffix": "", "body_type": "uuid_v4", "body_length": 36, "regex": UUID_V4, "detected_as": name}
    if name == "bcrypt_hash":
        prefix, body, suffix = re.match(BCRYPT, value).groups()
    else:
        prefix, body, suffix = "", value, ""
    regex = f"^{re.escape(prefix)}[0-9a-f]{{{len(body)}}}{re.escape(suffix)}$"
    return {"prefix": prefix, "suffix": suffix, "body_type": "hex", "body_length": len(body), "regex": regex, "detected_as": name}


def random_formats(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Specifications of the columns in which enough values match a known format."""
    if not columns:
        return {}
    out = {}
    for r in format_matches(df, columns).collect():
        for name in FORMATS:
            if r["n"] and r[name] >= MATCH_RATIO:
                out[r["column"]] = specification(name, r[f"first_{name}"])
                break
    return out


def email_domains(df: DataFrame, column: str) -> DataFrame:
    """(n, ratio, domains): the share of addresses among non-null values, and the distinct domains of the matches, of
    which no more than ``MAX_DOMAINS`` + 1 are kept."""
    text = F.col(column).cast("string")
    rows = df.where(text.isNotNull()).select(text.alias("t"), text.rlike(SPLIT_EMAIL).alias("ok"))
    counted = rows.groupBy(F.when(F.col("ok"), F.substring_index("t", "@", -1)).alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("domain").isNotNull(), F.col("n"))) / F.sum("n")).alias("ratio"))
    kept = counted.where("domain is not null").orderBy("domain").limit(MAX_DOMAINS + 1)
    return total.crossJoin(kept.agg(F.array_sort(F.collect_list("domain")).alias("domains")))


def email_split(df: DataFrame, column: str) -> dict | None:
    """Separator and domains if the column can be split, else None."""
    r = email_domains(df, column).first()
    if not r["n"] or (r["ratio"] or 0) < MATCH_RATIO or not 0 < len(r["domains"]) <= MAX_DOMAINS:
        return None
    return {"separator": "@", "domain_dict": list(r["domains"])}


def split_email(df: DataFrame, column: str, domains: list[str]) -> DataFrame:
    """Appends the local part and the number of the domain.  Without a known domain the number is 0, which loses what
    stood there; null has a null local part."""
    text = F.col(column).cast("string")
    at = F.array_position(F.array(*map(F.lit, domains)), F.substring_index(text, "@", -1)) - 1
    index = F.when(text.contains("@") & (at >= 0), at).otherwise(0).cast("smallint" if len(domains) <= 256 else "int")
    local = F.when(text.contains("@"), F.regexp_extract(text, r"(?s)^(.*)@", 1)).otherwise(text)
    return df.withColumn(column + LOCAL_SUFFIX, local).withColumn(column + DOMAIN_SUFFIX, index)


def join_email(local: Column, index: Column, domains: list[str], separator: str = "@") -> Column:
    place = F.when((index >= 0) & (index < len(domains)), index).otherwise(0)
    return F.when(local.isNotNull() & index.isNotNull(), F.concat(local, F.lit(separator), F.element_at(F.array(*map(F.lit, domains)), place.cast("int") + 1)))
