import os

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipeline  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, DIR).cache()
        seen[name] = {(r["doc_id"]) for r in out.select("doc_id").collect()}
        if name != "encode":
            assert out.columns == columns
        docs = out
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mix", "encode"]
    for a, b in zip(names, names[1:], strict=False):
        assert seen[b] <= seen[a]
    assert seen["encode"] == seen["mix"]


def test_run_repeats_rows_by_copies(spark):
    rows = pipeline.run(spark, DIR).select("doc_id", "n_tokens", "ids").collect()
    assert rows and all(len(r["ids"]) == r["n_tokens"] for r in rows)
    copies = {}
    for r in rows:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 2


def test_mix_stage_counts_repeated_rows(spark):
    rows = [(1, "a b c", "s", "en", 5), (1, "a b c", "s", "en", 5), (1, "x y z", "s", "en", 5), (None, "q r s", "s", "en", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    out = pipeline.mix_stage(spark, df, DIR)
    assert out.columns == df.columns and out.count() == 6


ODD = [
    (1, None, "en", "s", 0, "k", 1, "i"), (2, "", None, "s", None, None, 2, None), (None, "no id here", "en", None, 1, "k", 3, "i"), (3, "same Text", "en", "s", 9, "k", 4, "i"),
    (4, "same text", "en", "t", 9, "k", 5, "i"), (4, "same text", "en", "t", 9, "k", 5, "i"), (5, "word " * 30000, "en", "t", 9, "k", 6, "i"), (6, " \t\n", "en", "t", 9, "k", 7, "i"),
]


@pytest.mark.parametrize(("name", "stage"), pipeline.STAGES)
def test_odd_documents(spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, ids string"
    df = spark.createDataFrame(ODD, schema)
    out = stage(spark, df, DIR).collect()
    if name == "encode":
        assert len(out) == len(ODD)
    else:
        assert all(tuple(r) in ODD for r in out)
    if name == "exact_dedup":
        assert sorted(r["doc_id"] or 0 for r in out) == [0, 2, 4, 5, 6]
    empty = stage(spark, df.where("false"), DIR)
    assert empty.count() == 0 and (name == "encode" or empty.columns == df.columns)
