"""Generated tables of users and orders, for demonstrations, tests and benchmarks.

Rows follow from their number alone, by digests, so a table can be made by any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import random
from quarry.operators.reconstruct import draw, timestamp_text

# The shares of countries, sources, currencies and states, and the moments that tables end at.
COUNTRIES = {"US": 0.50, "FR": 0.20, "DE": 0.10, "UK": 0.05, "CA": 0.05, "ES": 0.03, "IT": 0.03, "JP": 0.02, "BR": 0.01, "AU": 0.01}
SOURCES = {"US": {"web": 0.5, "mobile": 0.3, "referral": 0.2}, "FR": {"web": 0.3, "mobile": 0.5, "referral": 0.2}}
OTHER_SOURCES = {"web": 0.4, "mobile": 0.25, "referral": 0.35}
CURRENCIES = {"USD": 0.60, "EUR": 0.20, "GBP": 0.10, "CAD": 0.05, "JPY": 0.05}
STATES = {"delivered": 0.80, "shipped": 0.10, "pending": 0.05, "cancelled": 0.03, "returned": 0.01, "failed": 0.01}
NOW = 1779105600.0  # 2026-05-18T12:00Z
USERS_FROM, ORDERS_FROM = 1577836800.0, 1704067200.0  # the first seconds of 2020 and 2024
DAY = 86400.0


def _key() -> Column:
    return F.col("n").cast("string")


def _choice(column: str, shares: dict[str, float]) -> Column:
    return draw(_key(), column, "categorical_freq", {"frequencies": shares})


def users(spark: SparkSession, n: int) -> DataFrame:
    """id, email, password_hash, created_at, country, age, premium, last_login, signup_source."""
    domain = _choice("domain", {"example.com": 0.4, "example.net": 0.3, "example.org": 0.3})
    created = F.greatest(F.lit(NOW) - random.exponential(_key(), "created", 0, 365 * DAY), F.lit(USERS_FROM))
    age = F.round(F.least(F.greatest(random.normal(_key(), "age", 34, 12), F.lit(18.0)), F.lit(99.0))).cast("int")
    rows = spark.range(n).select(F.col("id").alias("n")).withColumns({"country": _choice("country", COUNTRIES), "age": age, "created": created})
    chance = 0.07 + F.when(F.col("age") >= 30, 0.05).otherwise(0.0) + F.when(F.col("country") == "US", 0.03).otherwise(0.0)
    source = F.when(F.col("country") == "US", _choice("source", SOURCES["US"])).when(F.col("country") == "FR", _choice("source", SOURCES["FR"])).otherwise(_choice("source", OTHER_SOURCES))
    rows = rows.withColumn("premium", random.uniform(_key(), "premium") < chance)
    days = F.when(F.col("premium"), 7.0).otherwise(60.0)
    login = F.greatest(F.lit(NOW) - random.exponential(_key(), "login", 0, days * DAY), F.col("created"))
    return rows.select(
        random.formatted(_key(), "id", {"body_type": "uuid_v4", "body_length": 36}).alias("id"),
        F.concat(random.formatted(_key(), "local", {"body_type": "ascii_lower", "body_length": 6}), "n", F.lit("@"), domain).alias("email"),
        random.formatted(_key(), "hash", {"prefix": "$bcrypt$2b$12$", "suffix": "$", "body_type": "hex", "body_length": 64}).alias("password_hash"),
        timestamp_text(F.col("created")).alias("created_at"), "country", "age", "premium", timestamp_text(login).alias("last_login"), source.alias("signup_source"),
    )


def orders(spark: SparkSession, n: int, products: int = 500) -> DataFrame:
    """order_id, customer_id, product_sku, category, quantity, unit_price_cents, currency, status, ordered_at, shipped_at."""
    # twenty products hold sixty per cent
    u = random.uniform(_key(), "sku")
    product = F.when(u < 0.6, F.floor(u / 0.6 * 20)).otherwise(20 + F.floor((u - 0.6) / 0.4 * (products - 20))).cast("int")
    rows = spark.range(n).select(F.col("id").alias("n")).withColumn("product", product)
    letters = F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("product") % 26 + 1, F.lit(1))
    sku = F.concat(F.lit("PRD-"), F.lpad((F.col("product") * 7919 % 1000000).cast("string"), 6, "0"), F.lit("-"), letters, letters)
    category = F.concat(F.lit("category "), F.col("product") % 10)
    quantity = F.round(F.least(F.greatest(F.exp(random.normal(_key(), "quantity", 1.5, 0.8)), F.lit(1.0)), F.lit(50.0))).cast("int")
    factor = 0.4 + F.col("product") % 10 * 0.26
    price = F.least(F.greatest(random.normal(_key(), "price", 2000 * factor, 750 * factor), F.lit(99.0)), F.lit(99999.0)).cast("int")
    ordered = F.greatest(F.lit(NOW) - random.exponential(_key(), "ordered", 0, 180 * DAY), F.lit(ORDERS_FROM))
    rows = rows.withColumn("status", _choice("status", STATES)).withColumn("ordered", ordered)
    shipped = F.when(F.col("status").isin("shipped", "delivered", "returned"), timestamp_text(F.col("ordered") + random.exponential(_key(), "shipped", 0, 3 * DAY)))
    uuid = {"body_type": "uuid_v4", "body_length": 36}
    return rows.select(
        random.formatted(_key(), "order", uuid).alias("order_id"), random.formatted(_key(), "customer", uuid).alias("customer_id"), sku.alias("product_sku"),
        category.alias("category"), quantity.alias("quantity"), price.alias("unit_price_cents"), _choice("currency", CURRENCIES).alias("currency"), "status",
        timestamp_text(F.col("ordered")).alias("ordered_at"), shipped.alias("shipped_at"),
    )
