import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing, quality


def prose(rng, n):
    return " ".join(rng.choice(["the", "house", "river", "walked", "slowly", "bright", "morning", "under", "stone", "garden"]) + rng.choice(["", "s", "ed"]) for _ in range(n))


def labelled(n=600, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randint(20, 200))
        grade = i % 3
        if grade == 0:
            text = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in text.split()) if i % 2 else " ".join(w for w in text.split()[:4] for _ in range(20))
        elif grade == 1:
            text = " ".join(w if rng.random() > 0.1 else "idiot" for w in text.split())
        docs.append((i, text, "kept?"))
        labels.append((i, int(grade > 0), int(grade == 1)))
    return docs, labels


def test_held_out_accuracy_and_order(spark):
    docs, labels = labelled()
    df = spark.createDataFrame(docs, "doc_id long, text string, other string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(df, marked.where("doc_id < 400"))
    rows = {r["doc_id"]: r for r in quality.grade(df, model).where("doc_id >= 400").collect()}
    assert np.mean([rows[i]["kept"] == (i % 3 > 0) for i in rows]) >= 0.97
    means = [np.mean([rows[i]["expected_grade"] for i in rows if i % 3 == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    assert all(0 <= r["p_at_least_2"] <= r["p_at_least_1"] <= 1 for r in rows.values())
    assert quality.train(df, marked.where("doc_id < 400"))[1].tolist() == model[1].tolist()


def test_scores_do_not_depend_on_company():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=quality.WIDTH + quality.INDICATORS)
    texts = [b"", b"a", b"ab", b"some words here " * 50, "é日本".encode(), b"x" * 5000]
    together = quality.scores(texts, weights)
    assert together == pytest.approx([quality.scores([t], weights)[0] for t in texts])
    for t, s in zip(texts, together, strict=True):
        slots, values = quality._sparse(t)
        assert s == pytest.approx((weights[slots] * values).sum())


def test_without_usable_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1, 0)], [(1, None, 0), (2, 1, 0), (None, 0, 0)]):
        model = quality.train(df, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert model is None
        assert all(r["kept"] and r["expected_grade"] is None for r in quality.grade(df, model).collect())
    assert quality.grade(df.withColumn("kept", F.lit(1)), None).schema["kept"].dataType.simpleString() == "boolean"


def test_nulls_and_empty_texts_get_grades(spark):
    docs, labels = labelled(60)
    df = spark.createDataFrame(docs, "doc_id long, text string, other string")
    model = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert quality.grade(odd, model).where("expected_grade is not null").count() == 3
    assert quality.grade(odd.where("false"), model).count() == 0


# --- mixing --------------------------------------------------------------------------------------------------------


def targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, rest, open_ = {}, share * sum(sizes.values()), set(sizes)
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > limit * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in open_}
        out |= {s: limit * sizes[s] for s in over}
        rest -= sum(limit * sizes[s] for s in over)
        open_ -= over
    return out


def check(rows, got):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    total, biggest = {}, {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
        biggest[s] = max(biggest.get(s, 0), size(t))
    wanted = targets(total)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in got) == sorted((i is None, i, size(t)) for i, t, _ in rows)
    for s, t in taken.items():
        assert abs(t - wanted[s]) <= max(biggest[s] / 2, 1)


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["hot", "hot", "b", "c", "é", "Z", None])) for i in range(1500)]
    rows += [(2000, None, "b"), (2001, "", "empty"), (None, "a b c", "b"), (5, "x y", "c"), (5, "x y", "c"), (3000, "w " * 20000, "hot"), (3001, "tab\tnew\nline\x0bv\x0cf\rr one", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, target int")
    got = mixing.mix(df).collect()
    check(rows, got)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rates_tilt_by_size(spark):
    rows = [(i, "w " * (i % 40 + 1), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mix(df).groupBy("source").agg(F.sum(F.col("rate") * F.col("size")).alias("m"), F.max("target").alias("t"), F.max("rate").alias("x")).collect():
        assert r["m"] == pytest.approx(r["t"], rel=1e-6) and r["x"] <= 2


def test_one_source_and_no_rows(spark):
    df = spark.createDataFrame([(i, "a b c d", "only") for i in range(50)], "doc_id long, text string, source string")
    assert mixing.mix(df).agg(F.sum("taken")).first()[0] == 300
    assert mixing.mix(df.where("false")).count() == 0
    nothing = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(nothing).collect()] == [0]
