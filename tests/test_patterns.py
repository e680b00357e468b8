import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.model import ColumnProfile, Pattern, PatternType, Recipe, RecipeMetadata
from quarry.operators import anchors, formats, patterns
from quarry.plans.pipeline import describe
from quarry.sources import recipes, tables


def described(spark, rows, schema, **options):
    df = tables.with_row_id(spark.createDataFrame(rows, schema))
    profiles, found, names, _ = describe(df, **options)
    return df, {p.column: p for p in found}, names


def sha(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def uuid4(i):
    h = sha(i)
    return f"{h[:8]}-{h[8:12]}-4{h[13:16]}-a{h[17:20]}-{h[20:32]}"


def test_random_formats(spark):
    rows = [(f"$bcrypt$2b$12${sha(i)}$", sha(i), uuid4(i), uuid4(i), i) for i in range(200)]
    _, found, names = described(spark, rows, "password_hash string, token string, user_id string, session string, n int")
    kinds = {c: p.pattern_type for c, p in found.items()}
    assert kinds == {"password_hash": PatternType.RANDOM_FORMAT, "token": PatternType.RANDOM_FORMAT, "user_id": PatternType.ANCHOR_DIRECT, "session": PatternType.RANDOM_FORMAT, "n": PatternType.ANCHOR_DIRECT}
    assert found["password_hash"].format_spec["prefix"] == "$bcrypt$2b$12$" and found["password_hash"].format_spec["body_length"] == 64
    assert found["session"].format_spec["body_type"] == "uuid_v4"
    assert names == ["user_id", "n"]
    _, found, names = described(spark, rows, "password_hash string, token string, user_id string, session string, n int", aggressive_uuid=True)
    assert found["user_id"].pattern_type == PatternType.RANDOM_FORMAT and names == ["n"]


def test_email_split(spark):
    domains = ["example.com", "example.net", "example.org"]
    rows = [(f"user{i}@{domains[i % 3]}",) for i in range(500)]
    df, found, names = described(spark, rows, "email string")
    assert found["email"].pattern_type == PatternType.EMAIL_SPLIT and found["email"].format_spec["domain_dict"] == domains and names == []
    stored, columns = anchors.extract(df, names, list(found.values()))
    assert columns == ["email__local", "email__domain_idx"]
    back = stored.select(formats.join_email(F.col("email__local"), F.col("email__domain_idx"), domains).alias("e"))
    assert {r["e"] for r in back.collect()} == {r[0] for r in rows}
    assert anchors.for_validation(columns, ["email"]) == ["email"]


def test_email_split_is_refused(spark):
    many = spark.createDataFrame([(f"u@d{i}.com",) for i in range(500)], "e string")
    assert formats.email_split(many, "e") is None
    half = spark.createDataFrame([(f"u{i}@a.com" if i % 2 else f"word {i}",) for i in range(500)], "e string")
    assert formats.email_split(half, "e") is None
    assert formats.email_split(half.where("false"), "e") is None


def test_split_of_odd_addresses(spark):
    df = spark.createDataFrame([("a@b@x.com",), ("plain",), (None,), ("c@unknown.org",)], "e string")
    rows = [tuple(r) for r in formats.split_email(df, "e", ["x.com", "y.com"]).select("e__local", "e__domain_idx").collect()]
    assert rows == [("a@b", 0), ("plain", 0), (None, 0), ("c", 0)]


def test_priority_of_rules(spark):
    names = {"US": "United States", "FR": "France", "DE": "Germany"}
    rows = [(f"id{i}", c := list(names)[(i * i) % 7 % 3], names[c], float(20 + (i * 37) % 50), i % 3 == 0, None) for i in range(300)]
    _, found, anchors_ = described(spark, rows, "key string, code string, name string, age double, flag boolean, nothing string")
    assert anchors_ == ["key"]
    assert found["name"].pattern_type == PatternType.FUNCTIONAL_DEP and found["name"].lookup_table == names
    assert found["code"].pattern_type in (PatternType.DISTRIBUTION, PatternType.CONDITIONAL_DISTRIBUTION)
    assert found["age"].pattern_type == PatternType.DISTRIBUTION
    assert found["nothing"].pattern_type == PatternType.DISTRIBUTION


def test_manual_anchors(spark):
    rows = [(i % 3, f"x{i % 2}") for i in range(200)]
    _, found, names = described(spark, rows, "a int, b string", manual_anchors=["b"])
    assert "b" in names and found["b"].pattern_type == PatternType.ANCHOR_DIRECT
    with pytest.raises(ValueError):
        described(spark, rows, "a int, b string", manual_anchors=["zzz"])


def test_forced_format_that_is_unknown_falls_through(spark):
    rows = [(f"w{i % 4}",) for i in range(200)]
    _, found, _ = described(spark, rows, "a string", random_format=["a"])
    assert found["a"].pattern_type != PatternType.RANDOM_FORMAT


def rule(column, *needs):
    return Pattern(column, "functional_dep" if needs else "anchor_direct", source_column=needs[0] if needs else None, lookup_table={} if needs else None, dependencies=list(needs))


def test_order_and_cycles():
    assert [p.column for p in patterns.ordered([rule("c", "b"), rule("b", "a"), rule("a")])] == ["a", "b", "c"]
    ring = [rule("a", "b"), rule("b", "a")]
    with pytest.raises(ValueError):
        patterns.ordered(ring)
    assert {p.column for p in patterns.ordered(ring, break_cycles=True)} == {"a", "b"}
    with pytest.raises(ValueError):
        patterns.ordered([rule("a", "missing")], strict=True)
    assert patterns.ordered([]) == []


def recipe():
    profiles = [ColumnProfile("id", "object", "string", 3, 3, 0, is_anchor_candidate=True), ColumnProfile("x", "object", "categorical", 3, 1, 0)]
    rules = [Pattern("x", "functional_dep", source_column="id", lookup_table={"é": "ü"}, dependencies=["id"]), Pattern("id", "anchor_direct")]
    return Recipe(RecipeMetadata("t", 3, 100, 20), profiles, ["id"], "../anchors/t.parquet", rules)


def test_recipe_round_trip(tmp_path):
    r = recipe()
    text = recipes.render(r)
    assert [line[3:] for line in text.splitlines() if line.startswith("## ")] == list(recipes.SECTIONS)
    path = recipes.write(r, str(tmp_path / "recipes" / "t.md"))
    again = recipes.read(path)
    assert again.to_dict() | {"patterns": None} == r.to_dict() | {"patterns": None, "metadata": r.metadata.to_dict() | {"recipe_size_bytes": 0}}
    assert [p.column for p in again.patterns] == ["id", "x"]
    assert r.metadata.recipe_size_bytes == len(text.encode())
    assert recipes.anchor_path(again, path) == str(tmp_path / "anchors" / "t.parquet")
    with pytest.raises(ValueError):
        recipes.parse(text.replace("## SCHEMA", "## OTHER"))


def test_model_refuses_what_does_not_fit():
    with pytest.raises(ValueError):
        Pattern("x", "distribution")
    with pytest.raises(ValueError):
        Pattern("x", "random_format", format_spec={"prefix": ""})
    with pytest.raises(ValueError):
        Pattern("x", "email_split", format_spec={"separator": "@", "domain_dict": []})
    with pytest.raises(ValueError):
        Pattern.from_dict({"column": "x", "pattern_type": "anchor_direct", "other": 1})
    with pytest.raises(ValueError):
        Recipe(RecipeMetadata("t", 1, 1, 1), [], ["nowhere"], "", [])
