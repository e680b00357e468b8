import hashlib
import random

import numpy as np
import pytest

from quarry.llm import suffix_dedup as s


def brute(texts, width, keep_first=False):
    seen = {}
    for d, t in texts:
        for p in range(len(t) - width + 1):
            seen.setdefault(t[p : p + width], []).append((d, p))
    out = {}
    for d, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            places = seen[t[p : p + width]]
            if len(places) > 1 and not (keep_first and min(places) == (d, p)):
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60), prose(45), prose(120)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 80))]
        if i % 2 == 0:
            parts += [passages[0], prose(rng.randint(0, 30))]
        if i % 7 == 0:
            parts += [passages[1]]
        if i % 11 == 0:
            parts += [passages[2], passages[2][:150]]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "ab" * 700), (103, "x" * 1000), (104, ""), (105, "short"), (106, passages[2][7:230])]
    return rows


@pytest.mark.parametrize("group", [256, 3])
@pytest.mark.parametrize("keep_first", [False, True])
def test_against_brute_force(spark, monkeypatch, group, keep_first):
    monkeypatch.setattr(s, "GROUP", group)
    monkeypatch.setattr(s, "PART_BYTES", 600)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in s.digests(df, keep_first=keep_first).collect()}
    assert got == brute([(i, t.encode()) for i, t in rows], 200, keep_first)


def test_nulls_and_repeated_rows(spark):
    long = "abc def " * 3 + "".join(chr(97 + i * i % 26) for i in range(400))
    df = spark.createDataFrame([(1, None), (2, long), (2, long), (None, "other " + long), (3, "tiny")], "doc_id long, text string")
    got = s.digests(df).collect()
    assert len(got) == 5
    by = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in got}
    assert by[1, 0] == 0 and by[2, len(long)] == len(long) and by[None, len(long) + 6] >= len(long) and by[3, 4] == 0
    assert s.digests(df.where("false")).count() == 0


def test_many_equal_rows_and_null_ids(spark):
    """Two hundred equal rows without an id list their places once; texts without ids are told apart."""
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    hot, shared = prose(900), prose(300)
    rows = [(None, hot)] * 200 + [(None, prose(305)) for _ in range(50)] + [(None, prose(40) + shared), (4, shared + prose(60)), (5, hot[100:400] + prose(50))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    docs = s._keyed(df, "doc_id", "text")
    units = docs.groupBy("h1", "h2").agg({"did": "min"}).withColumnRenamed("min(did)", "did")
    _, with_places = s.removed_intervals(docs, units)
    assert with_places.df.count() == 4
    assert max(len(r["places"]) for r in with_places.df.collect()) < 60
    wanted = brute(list(enumerate(t.encode() for _, t in rows)), 200)
    by_text = {(len(t), hashlib.sha256(t.encode()).hexdigest()): wanted[i] for i, (_, t) in enumerate(rows)}
    got = s.remove_repeats(df).collect()
    assert sorted((r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got) == sorted(wanted.values())
    assert len(by_text) == 54


@pytest.mark.parametrize("width", [1, 3, 8, 21])
def test_ranks_order_prefixes(width):
    raw = np.frombuffer(bytes(random.Random(width).choice(b"ab\0") for _ in range(300)), np.uint8)
    ranks = s.prefix_ranks(raw, width)
    prefix = [bytes(raw[i : i + width]).ljust(width, b"\0") for i in range(len(raw))]
    order = sorted(set(prefix))
    if 0 not in raw:
        assert [order.index(p) for p in prefix] == ranks.tolist()
    inside = range(len(raw) - width + 1)
    assert all((prefix[i] < prefix[j]) == (ranks[i] < ranks[j]) and (prefix[i] == prefix[j]) == (ranks[i] == ranks[j]) for i in inside for j in list(inside)[::17])


def test_previous_factors():
    rng = random.Random(3)
    raw = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), np.uint8)
    width = 7
    valid = np.arange(len(raw)) <= len(raw) - width
    text = bytes(raw)
    later = s.repeated_starts(raw, valid, width, keep_first=True)
    every = s.repeated_starts(raw, valid, width)
    for p in np.flatnonzero(valid):
        piece = text[p : p + width]
        assert later[p] == (text.find(piece) < p)
        assert every[p] == (text.find(piece) < p or text.find(piece, p + 1) >= 0)


def test_smaller_neighbours():
    order = np.random.default_rng(0).permutation(500)
    before, after = s.smaller_neighbours(order, np.arange(500))
    for i in range(500):
        smaller = np.flatnonzero(order < order[i])
        assert before[i] == max([-1, *smaller[smaller < i]]) and after[i] == min([500, *smaller[smaller > i]])
