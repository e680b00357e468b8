import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import vamana as v

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    ok = [(i, np.array(e, np.float64)) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            found = sorted(((-(x * y).sum(), i) for i, y in ok if i != q and len(x) == len(y)))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def table(spark, n=1200, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, d))
    x = (centres[rng.integers(0, 30, n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, [float(c) for c in e], "s") for i, e in enumerate(x)]
    rows[3] = (3, None, "s")
    rows[20] = (20, [0.0] * d, "s")
    rows[40] = (40, [float("nan")] * d, "s")
    rows[41] = (41, [None] * d, "s")
    rows[42] = (42, [float("inf")] + [1.0] * (d - 1), "s")
    return rows


def test_recall_ranks_and_scores(spark):
    rows = table(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in v.nearest(df, F.col("vec_id") % 20 == 0, 20, shard_rows=300).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    wanted = brute(rows, 20)
    assert set(got) == set(wanted)
    hits = total = 0
    vectors = {i: np.array(e, np.float64) for i, e, _ in rows if e and None not in e}
    for q, found in got.items():
        found.sort()
        assert [k for k, *_ in found] == list(range(1, 21))
        assert all(q != i for _, i, _ in found)
        assert all((a[2], -a[1]) >= (b[2], -b[1]) for a, b in zip(found, found[1:], strict=False))
        assert all(s == pytest.approx((vectors[q] * vectors[i]).sum(), abs=1e-12) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in wanted[q]})
        total += 20
    assert hits / total >= 0.95
    # the shared vector: ties go to the smallest ids
    assert [i for _, i, _ in got[200]] == [i for i, _ in wanted[200]]


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [0.5, 0.0], ""), (2, [2.0, 0.0], ""), (2, [2.0, 0.0], ""), (3, [1.0, 1.0, 1.0], "")], SCHEMA)
    got = [tuple(r) for r in v.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 0.5)]
    assert v.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert v.nearest(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_pruned_edges_are_not_covered():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    graph, start = v.build_graph(x, degree=12, beam=32)
    assert graph.shape == (400, 12) and 0 <= start < 400
    assert all(i not in graph[i] for i in range(400))
    seen, todo = {start}, [start]
    while todo:
        for j in graph[todo.pop()]:
            if j >= 0 and j not in seen:
                seen.add(j)
                todo.append(j)
    assert len(seen) >= 396
    rows, scores = v.search_graph(x, graph, start, x[:50], 5)
    exact = np.argsort(-(x[:50].astype(np.float64) @ x.astype(np.float64).T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(rows, exact, strict=True)]) >= 0.9


def found_and_wanted(x, queries, k):
    graph, start = v.build_graph(x)
    rows, scores = v.search_graph(x, graph, start, x[queries], k)
    exact = x[queries].astype(np.float64) @ x.astype(np.float64).T
    return rows, scores, np.argsort(-exact, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 21, 22, 40, 95, 96, 97, 200])
def test_small_shards_are_whole(n):
    x = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
    rows, scores, exact = found_and_wanted(x, np.arange(n), 21)
    for got, own, wanted in zip(rows, scores, exact, strict=True):
        assert got[got >= 0].tolist() == wanted.tolist()
        assert np.isfinite(own[got >= 0]).all()


@pytest.mark.parametrize(("n", "spread", "scale"), [(1000, 1.5, 1.0), (3000, 1.5, 1.0), (3000, 0.5, 1.0), (3000, 0.0, 1e20), (3000, 0.0, 1e-20)])
def test_recall_with_unequal_norms_and_sizes(n, spread, scale):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(n, 16)) * rng.lognormal(sigma=spread, size=(n, 1)) * scale).astype(np.float32)
    rows, _, exact = found_and_wanted(x, np.arange(0, n, 10), 20)
    assert all(len(set(r.tolist())) == 20 for r in rows)
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(rows, exact, strict=True)]) >= 0.95


def test_doubles_and_large_components_keep_their_scores(spark):
    x = np.random.default_rng(3).normal(size=(30, 4))
    x[10:20] *= 1e100
    rows = [(i, [float(c) for c in e], "") for i, e in enumerate(x)]
    got = v.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), F.col("vec_id") % 20 == 0, 20).collect()
    wanted = brute(rows, 20)
    for q in wanted:
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [i for _, i, _ in own] == [i for i, _ in wanted[q]]
        assert [s for *_, s in own] == pytest.approx([s for _, s in wanted[q]], rel=1e-12)
