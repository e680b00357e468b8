import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import random
from quarry.model import ColumnProfile, NumericStats, Pattern, Recipe, RecipeMetadata
from quarry.operators import conditional, reconstruct as r
from quarry.sources.tables import ROW_ID


def anchor_table(spark, n):
    return spark.range(n).select(F.col("id").alias(ROW_ID), F.concat(F.lit("u"), F.col("id")).alias("id"), (F.col("id") % 4).cast("long").alias("code"))


def recipe(*rules, profiles=()):
    own = {p.name: p for p in profiles}
    columns = ["id", "code", *(x.column for x in rules)]
    kinds = {"code": ("int64", "numeric")}
    schema = [own.get(c) or ColumnProfile(c, *kinds.get(c, ("object", "string")), 1, 1, 0) for c in columns]
    return Recipe(RecipeMetadata("t", 0, 0, 0), schema, ["id", "code"], "", [Pattern("id", "anchor_direct"), Pattern("code", "anchor_direct"), *rules])


def test_seed(spark):
    rows = spark.createDataFrame([("abc",), ("42",)], "k string").select(random.row_seed(F.col("k"))).collect()
    assert [x[0] for x in rows] == [int(hashlib.sha256(k).hexdigest()[:8], 16) for k in (b"abc", b"42")]
    number = spark.createDataFrame([(42,)], "k int").select(random.row_seed(F.col("k"))).first()[0]
    assert number == rows[1][0]
    assert spark.createDataFrame([("a",)], "k string").select(random.row_seed(F.col("k"), "s")).first()[0] == int(hashlib.sha256(b"sa").hexdigest()[:8], 16)


def numeric(name, lo, hi, dtype="float64"):
    return ColumnProfile(name, dtype, "numeric", 1, 1, 0, numeric_stats=NumericStats(lo, 1, lo, hi, lo, lo, hi))


def test_distributions(spark):
    rules = [
        Pattern("n", "distribution", distribution="normal", distribution_params={"mean": 34, "std": 12}),
        Pattern("e", "distribution", distribution="exponential", distribution_params={"loc": 1, "scale": 5, "reversed": False}),
        Pattern("u", "distribution", distribution="uniform", distribution_params={"loc": 2, "scale": 0}),
        Pattern("c", "distribution", distribution="categorical_freq", distribution_params={"frequencies": {"x": 7, "y": 3}}),
        Pattern("v", "distribution", distribution="empirical", distribution_params={"values": ["p", "q"]}),
        Pattern("none", "distribution", distribution="categorical_freq", distribution_params={"frequencies": {}}),
        Pattern("t", "distribution", distribution="uniform", distribution_params={"loc": 1e9, "scale": 1e6, "unit": "seconds_since_epoch", "from_string": True}),
    ]
    profiles = [numeric("n", 18, 99, "int64"), numeric("e", 0, 1000), numeric("u", 0, 10)]
    df = r.reconstruct(recipe(*rules, profiles=profiles), anchor_table(spark, 4000)).cache()
    s = df.agg(F.avg("n"), F.min("n"), F.max("n"), F.avg("e"), F.min("u"), F.max("u"), F.avg((F.col("c") == "x").cast("int")), F.count("none"), F.count_distinct("v")).first()
    assert s[0] == pytest.approx(35, abs=1) and s[1] >= 18 and s[2] <= 99
    assert s[3] == pytest.approx(6, abs=0.4) and (s[4], s[5]) == (2, 2)
    assert s[6] == pytest.approx(0.7, abs=0.04) and s[7] == 0 and s[8] == 2
    assert df.schema["n"].dataType.simpleString() == "bigint"
    assert re.fullmatch(r"2001-09-\d\dT\d\d:\d\d:\d\d\+0000", df.first()["t"])


def test_result_does_not_depend_on_partitions(spark):
    rules = [Pattern("n", "distribution", distribution="normal", distribution_params={"mean": 0, "std": 1}), Pattern("h", "random_format", format_spec={"regex": "", "prefix": "", "suffix": "", "body_type": "hex", "body_length": 70})]
    made = recipe(*rules, profiles=[numeric("n", -9, 9)])
    found = [sorted(tuple(x) for x in r.reconstruct(made, anchor_table(spark, 500).repartition(n)).collect()) for n in (1, 7, 64)]
    assert found[0] == found[1] == found[2]
    assert len({x[-1] for x in found[0]}) == 500


def test_lookup_chain_and_conditional(spark):
    rules = [
        Pattern("big", "functional_dep", source_column="name", lookup_table={"one": "ONE", "two": "TWO"}, dependencies=["name"]),
        Pattern("name", "functional_dep", source_column="code", lookup_table={"1": "one", "2": "two"}, dependencies=["code"]),
        Pattern(
            "cond", "conditional_distribution", source_column="name", dependencies=["name"],
            conditional_buckets=[{"bucket_value": "one", "distribution": "empirical", "distribution_params": {"values": ["A"]}}, {"bucket_value": "two", "distribution": "empirical", "distribution_params": {"values": ["B"]}}],
        ),
    ]
    rows = {x["code"]: (x["name"], x["big"], x["cond"]) for x in r.reconstruct(recipe(*rules), anchor_table(spark, 4)).collect()}
    assert rows == {0: (None, None, "A"), 1: ("one", "ONE", "A"), 2: ("two", "TWO", "B"), 3: (None, None, "A")}


def test_large_lookup_is_joined(spark, monkeypatch):
    monkeypatch.setattr(r, "INLINE_LOOKUP", 1)
    rules = [Pattern("name", "functional_dep", source_column="code", lookup_table={"1": "one", "2": "two"}, dependencies=["code"])]
    rows = {x["code"]: x["name"] for x in r.reconstruct(recipe(*rules), anchor_table(spark, 4)).collect()}
    assert rows == {0: None, 1: "one", 2: "two", 3: None}


def test_bucket_edges(spark):
    edges = [0.0, 5.0, 10.0, 15.0]
    df = spark.createDataFrame([(x,) for x in (-3.0, 4.0, 5.0, 10.0, 15.0, 99.0, None)], "v double")
    assert [x[0] for x in df.select(conditional.lookup_bucket(F.col("v"), edges)).collect()] == [0, 0, 1, 2, 2, 2, 0]
    closed_right = [x[0] for x in df.where("v is not null").select(conditional.detection_bucket(F.col("v"), edges)).collect()]
    assert closed_right == [0, 0, 0, 1, 2, 2]


def test_formats(spark):
    one = spark.range(300).select(F.col("id").cast("string").alias("k"))
    make = lambda kind, n=8: {x[0] for x in one.select(random.formatted(F.col("k"), "c", {"prefix": "<", "suffix": ">", "body_type": kind, "body_length": n})).collect()}
    assert all(re.fullmatch("<[0-9a-f]{80}>", v) for v in make("hex", 80))
    assert all(re.fullmatch("<[a-z]{8}>", v) for v in make("ascii_lower"))
    assert all(re.fullmatch("<[0-9]{8}>", v) for v in make("digits"))
    assert all(re.fullmatch("<[A-Za-z0-9]{8}>", v) for v in make("alnum"))
    ids = make("uuid_v4", 36)
    assert len(ids) == 300 and all(re.fullmatch("<[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", v) for v in ids)
    with pytest.raises(ValueError):
        make("other")


def test_casts(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-0.5,), (None,)], "v double")
    whole = ColumnProfile("v", "int64", "numeric", 1, 1, 0)
    assert [x[0] for x in df.select(r.as_column(F.col("v"), whole)).collect()] == [2, 4, 0, None]
    flags = spark.createDataFrame([("True",), (" yes ",), ("0",), (None,)], "v string")
    boolean = ColumnProfile("v", "bool", "boolean", 1, 1, 0)
    assert [x[0] for x in flags.select(r.as_column(F.col("v"), boolean)).collect()] == [True, True, False, None]


def test_no_rows(spark):
    df = r.reconstruct(recipe(), anchor_table(spark, 0))
    assert df.count() == 0 and df.columns == [ROW_ID, "id", "code"]
