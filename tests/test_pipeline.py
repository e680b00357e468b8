import os

import pytest
from pyspark.sql import functions as F

from quarry import cli, examples
from quarry.plans import pipeline
from quarry.sources import recipes, tables


@pytest.fixture(scope="module")
def users(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "users.csv")
    tables.write_csv(examples.users(spark, 4000), path)
    return path


def test_users_compress_and_come_back(spark, users, tmp_path):
    made = pipeline.compress(spark, users, str(tmp_path), "users", anchor_files=1, html_profile=True)
    kinds = {p.column: p.pattern_type.value for p in made.recipe.patterns}
    assert kinds["id"] == "anchor_direct" and kinds["email"] == "email_split" and kinds["password_hash"] == "random_format"
    assert kinds["created_at"] == "distribution" and "conditional_distribution" in kinds.values()
    assert made.compression_ratio >= 5 and os.path.exists(made.html_profile_path)
    assert made.recipe.correlations
    out = str(tmp_path / "back.csv")
    assert pipeline.decompress(spark, made.recipe_path, out).n_rows == 4000
    bundle = pipeline.validate_pair(spark, users, out, recipe_path=made.recipe_path)
    assert bundle.report.overall_score >= 90
    assert all(t.passed for t in bundle.report.structural_tests)
    again = [tuple(r) for r in pipeline.rebuild(spark, made.recipe_path).orderBy("__row_id").collect()]
    assert again == [tuple(r) for r in pipeline.rebuild(spark, made.recipe_path).orderBy("__row_id").collect()]


def test_orders_with_nulls(spark, tmp_path):
    df = examples.orders(spark, 3000)
    made = pipeline.compress_table(df, str(tmp_path), "orders", 500_000)
    kinds = {p.column: p.pattern_type.value for p in made.recipe.patterns}
    assert kinds["category"] == "functional_dep" and kinds["order_id"] == "anchor_direct"
    back = pipeline.rebuild(spark, made.recipe_path)
    assert back.count() == 3000
    mapping = {(r["product_sku"], r["category"]) for r in df.select("product_sku", "category").distinct().collect()}
    rebuilt = {(r["product_sku"], r["category"]) for r in back.select("product_sku", "category").distinct().collect()}
    assert {x for x in rebuilt if x[1] is not None} <= mapping


def test_codecs(spark, tmp_path):
    df = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    sizes = {c: tables.write_anchors(df, str(tmp_path / c), c, level) for c, level in (("snappy", None), ("gzip", 9), ("zstd", 19), ("lz4", None), ("none", None))}
    assert sizes["zstd"] < sizes["none"]
    assert tables.read_anchors(spark, str(tmp_path / "zstd")).count() == 2000
    for codec in ("brotli", "other"):
        with pytest.raises(ValueError):
            tables.write_anchors(df, str(tmp_path / codec), codec)
    savings = tables.anchor_savings(df, ["h"], 200_000, str(tmp_path / "s"))
    assert savings["anchor_csv_bytes"] == 2000 * 65 + 2 and savings["ratio"] > 1


def test_csv_keeps_dates_as_text(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b,c,d\n1,2024-01-15T08:30:00+0000,true,1.5\n2,2024-01-16T08:30:00+0000,false,\n")
    df = tables.read_csv(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "string", "boolean", "double"]


def test_row_ids(spark):
    df = spark.range(1000).repartition(7)
    numbered = tables.with_row_id(df)
    assert sorted(r["__row_id"] for r in numbered.collect()) == list(range(1000))
    assert tables.with_row_id(numbered) is numbered
    assert tables.with_row_id(spark.range(0)).count() == 0


def test_command_line(users, tmp_path, capsys):
    assert cli.main(["compress", "--input", str(tmp_path / "none.csv"), "--output", str(tmp_path)]) == 2
    assert cli.main(["run-poc", "--input", users, "--output", str(tmp_path), "--table-name", "users"]) == 0
    told = capsys.readouterr().out
    assert "rows" in told and "score" in told
    recipe = str(tmp_path / "recipes" / "users.md")
    assert recipes.read(recipe).metadata.n_rows == 4000
    assert cli.main(["decompress", "--recipe", recipe, "--output", str(tmp_path / "o.csv")]) == 0
    assert cli.main(["validate", "--original", users, "--reconstructed", str(tmp_path / "o.csv"), "--recipe", recipe]) == 0
    assert cli.main(["fingerprint", "--recipe", recipe, "--original", users, "--output", str(tmp_path / "pictures")]) == 0
    assert len(os.listdir(tmp_path / "pictures")) == 3
    assert cli.main(["fingerprint", "--recipe", str(tmp_path / "none.md"), "--output", str(tmp_path)]) == 2
    assert cli.main(["compress", "--input", users, "--output", str(tmp_path), "--codec", "zip"]) == 1
    assert cli.listed("a, b,,") == ["a", "b"] and cli.listed(None) is None and cli.size_text(2048) == "2.00 KB"
