import hashlib
import random

import pytest

from quarry.llm import exact_dedup as x

SCHEMA = "doc_id long, text string, key string"


def brute(rows):
    groups = {}
    for i, (d, t, *_) in enumerate(rows):
        norm = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        groups.setdefault(norm, []).append((d is not None, d or 0, i))
    out = []
    for norm, members in groups.items():
        keep = max(members)
        for has, d, i in members:
            out.append((d if has else None, keep[1] if keep[0] else None, len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of():
    rng = random.Random(4)
    rows = [(i, rng.choice(["Same text", "same TEXT", "É", "é", "", None, "x" * 50000]), "k") for i in range(300)]
    rows += [(i, f"unique {i}", "k") for i in range(300, 400)] + [(None, "same text", "k"), (None, "nobody", "k"), (7, "Same text", "k"), (7, "Same text", "k")]
    return rows


@pytest.mark.parametrize("key_bits", [64, 2])
@pytest.mark.parametrize("capacity", [200, 1 << 20])
def test_against_brute_force(spark, key_bits, capacity):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = x.assign(df, key_bits=key_bits, capacity=capacity).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("key_bits", [64, 1])
def test_hot_keys_are_folded(spark, monkeypatch, key_bits):
    """Every key of three entries or more is folded, by two tasks at least; colliding keys included."""
    monkeypatch.setattr(x, "FOLD", 2)
    rows = [(d, t if i % 3 else "hot Text", k) for i, (d, t, k) in enumerate(rows_of())]
    df = spark.createDataFrame(rows, SCHEMA).repartition(40)
    entries = x.write_segments(df, "doc_id", "text", key_bits).df.where("__seg_row = __seg_entry").select("__seg_key", "__seg_entry", "text", "__seg_count", "__seg_keep_id", "__seg_keep")
    left, folded = x._folded(entries)
    assert folded.where("`into` != __seg_entry").count() > 0 and left.count() < entries.count()
    got = x.assign(df, key_bits=key_bits).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(rows)
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})


def test_rows_that_stay_keep_their_columns(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(3)
    left = x.deduplicate(df)
    assert left.columns == df.columns and left.count() == len({(t or "").encode().lower() for _, t, _ in rows_of()})


def test_empty_and_clashing_names(spark):
    assert x.assign(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a", 2, 3), (2, "A", 4, 5)], "doc_id long, text string, __seg_row int, keep_id int")
    assert [tuple(r) for r in x.deduplicate(df).collect()] == [(2, "A", 4, 5)]
    assert {r["keep_id"] for r in x.assign(df).collect()} == {2}


def test_directory_doubles_and_splits():
    sizes = {0: 10, 1: 10, 2: 10, 3: 10, 8: 35, 15: 3}
    d = x.Directory(sizes, 4, 20)
    assert len(d.slots) == 1 << d.depth
    assert sum({id(b): b.size for b in d.slots}.values()) == sum(sizes.values())
    assert all(b.size <= 20 or b.depth == 4 for b in d.slots)
    owners = d.owners()
    assert owners == sorted(owners) and owners[0] == 0
    assert [d.slots[p << d.depth >> 4].prefix << (4 - d.slots[p << d.depth >> 4].depth) <= p for p in range(16)] == [True] * 16
    assert x.Directory({}, 4, 20).depth == 0
