import random
import re

import numpy as np
import pytest
import xxhash

from quarry.llm import simhash as s
from quarry.llm.components import connected_components


def brute_fingerprint(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, " \t\n", "one", "One two", "a b c", "a b c d e f g", "É b C\x0bd\x0c é", "w " * 70000, "x y z"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("n", [3, 5])
def test_fingerprints(text, n):
    assert s.fingerprint(s.shingle_hashes(text, n)) == brute_fingerprint(text, n)


def components(ids, fps, budget):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, f in zip(ids, fps, strict=True):
            for j, g in zip(ids, fps, strict=True):
                if (f ^ g).bit_count() <= budget and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_join_finds_every_link(spark, budget):
    rng = random.Random(budget)
    base = [rng.getrandbits(64) for _ in range(25)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(8)}
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    found, _ = connected_components(s.links(spark.createDataFrame(rows, "node long, fp long"), budget))
    label = {r["vertex"]: r["component"] for r in found.collect()}
    wanted = components([i for i, _ in rows], [f % (1 << 64) for _, f in rows], budget)
    assert {i: label.get(i, i) for i, _ in rows} == wanted


def test_small_batches_of_pairs(monkeypatch):
    monkeypatch.setattr(s, "PAIRS_AT_ONCE", 8)
    rng = np.random.default_rng(0)
    words = np.unique(rng.integers(0, 1 << 10, 300).astype(np.uint64))
    roots = s.trie_self_join(words, np.zeros(len(words), int), 10, 1).roots()
    label = components(list(range(len(words))), [int(w) for w in words], 1)
    assert [label[i] for i in range(len(words))] == roots.tolist()


def test_assign(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.upper()) for i, t in enumerate(base[:4])]
    rows += [(200 + i, t.replace(" ", "  ", 3) + " extra") for i, t in enumerate(base)] + [(300, None), (301, ""), (302, " "), (None, base[0]), (0, base[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    got = s.assign(df).collect()
    assert len(got) == len(rows)
    fps = {t: brute_fingerprint(t, 3) for _, t in rows}
    known = [(i, t) for i, t in rows if i is not None]
    wanted = components([i for i, _ in known], [fps[t] for _, t in known], 2)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == wanted[r["doc_id"]]
        else:
            assert r["component_id"] == 0
    assert {r["fingerprint"] for r in got} == {f"{f:016x}" for f in fps.values()}
    assert s.assign(df.where("false")).count() == 0


def edited(text, k, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), k):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def test_near_duplicates(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(1000 + i, edited(t, 2, rng)) for i, t in enumerate(base[:30])]  # overlap of about 0.94
    rows += [(2000 + i, edited(t, 25, rng)) for i, t in enumerate(base[30:60])]  # below one half
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in s.deduplicate(df).collect()}
    assert set(range(60)) <= left and {i for i, _ in rows if i >= 2000} <= left
    assert len([i for i in left if 1000 <= i < 2000]) <= 1
    assert s.deduplicate(df.where("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(500, 1000 + i) for i in range(300)]
    found, _ = connected_components(spark.createDataFrame(chain + star + [(7, 7), (3, 2)], "a long, b long"))
    label = {r["vertex"]: r["component"] for r in found.collect()}
    assert {label[i] for i in range(201)} == {0} and {label[i] for i in [500, *range(1000, 1300)]} == {500}
    assert found.count() == len(label)
    none, _ = connected_components(spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0
