"""Near-duplicates against all pairs of shingle sets, without tolerance."""

import random

import numpy as np
import pytest

from quarry.llm import simhash as s

WORDS = [f"w{i}" for i in range(5000)]


def edited(text, k, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), k):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def all_pairs(rows, words=5, similarity=0.8):
    """(id, component) by every pair."""
    sets = [(i, set(s.shingle_hashes(t, words).tolist())) for i, t in rows]
    label = {i: i for i, _ in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a == b or len(a & b) / len(a | b) >= similarity:
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return {i: root(i) for i, _ in sets if root(i) != i}


def near(spark, rows):
    found = s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    return {r["id"]: r["component"] for r in found}


def family(rng, n, edits):
    base = " ".join(rng.choice(WORDS) for _ in range(200))
    return [edited(base, rng.choice(edits), rng) for _ in range(n)]


def test_family_of_links_around_the_threshold(spark):
    rng = random.Random(1)
    rows = list(enumerate(family(rng, 300, [1, 2, 3, 4, 5]) + family(rng, 60, [3]) + family(rng, 60, [2, 4])))
    assert near(spark, rows) == all_pairs(rows)


def test_a_dominant_shingle_does_not_make_copies(spark):
    rng = random.Random(4)
    hum = "la " * 300
    texts = [hum + " ".join(rng.choice(WORDS) for _ in range(100)) for _ in range(8)]
    # the same shingles, but repeated very differently
    tune = "a b c d e "
    texts += [tune * 3, tune * 200, "la " * 50, "la " * 500]
    rows = list(enumerate(texts))
    wanted = all_pairs(rows)
    assert wanted == {9: 8, 11: 10} and near(spark, rows) == wanted
