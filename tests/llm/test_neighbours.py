"""Approximate nearest neighbours against all products, on given, odd and skewed vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tachygraph.llm import neighbours
from tachygraph.llm.neighbours import Graph, balanced_centroids, nearest

SCHEMA = "vec_id long, embedding array<float>"


def product(a, b):
    """From the first component on; ``sum`` would correct for rounding."""
    out = 0.0
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


def brute(rows, k=20, every=20):
    """{query row's place: its nearest (score, vec_id)}, by all products in double precision."""
    ok = [(p, i, v) for p, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, _, v in ok), default=0)
    full = {p: list(map(float, v)) + [0.0] * (width - len(v)) for p, _, v in ok}
    out = {}
    for p, i, _ in ok:
        if i is not None and i % every == 0:
            scores = [(product(full[p], full[o]), j, o) for o, j, _ in ok if o != p]
            out[p] = (i, [(s, j) for s, j, _ in sorted(scores, key=lambda x: (-x[0], -math.inf if x[1] is None else x[1], x[2]))[:k]])
    return out


def as_lists(got):
    out = {}
    for r in got.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return out


def recall(spark, rows, k=20):
    got = as_lists(nearest(spark.createDataFrame(rows, SCHEMA), k=k))
    want = {i: top for i, top in brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], k).values()}
    assert {i: [r for r, _, _ in x] for i, x in got.items()} == {i: list(range(1, len(x) + 1)) for i, x in want.items()}
    hits = sum(len({j for _, _, j in got[i]} & {j for _, j in want[i]}) for i in want)
    return hits / sum(map(len, want.values()))


def test_exact_when_all_is_one_list(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=8).astype("float32").tolist()) for i in range(130)]
    got = as_lists(nearest(spark.createDataFrame(rows, SCHEMA)))
    for i, top in brute(rows).values():
        assert [(s, j) for _, s, j in got[i]] == top


def test_recall_on_given_vectors(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert recall(spark, rows) >= 0.9


def test_recall_with_norms_that_differ_and_a_hot_vector(spark, monkeypatch):
    """A third of all rows are one vector, in short lists and small cells, and inner products are not angles."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 32)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 64)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    rows = [(i, ((centres[i % 12] + 0.2 * rng.normal(size=6)) * rng.uniform(0.2, 5)).astype("float32").tolist()) for i in range(800)]
    rows += [(800 + i, [1.0, 2.0, 0.5, -1.0, 0.0, 3.0]) for i in range(400)]
    assert recall(spark, rows) >= 0.9
    got = as_lists(nearest(spark.createDataFrame(rows, SCHEMA)))
    want = {i: top for i, top in brute(rows).values()}
    #: The hot vector's own queries tie with hundreds; the smallest ids win.
    exact = [i for i in want if i >= 800 and [(s, j) for _, s, j in got[i]] == want[i]]
    assert len(exact) >= 0.9 * sum(i >= 800 for i in want)


def test_sample_smaller_than_the_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 200)
    monkeypatch.setattr(neighbours, "LIST_ROWS", 64)
    rng = np.random.default_rng(4)
    centres = 4 * rng.normal(size=(10, 8))
    rows = [(i, (centres[i % 10] + rng.normal(size=8)).astype("float32").tolist()) for i in range(1500)]
    assert recall(spark, rows) >= 0.9


def test_odd_rows(spark):
    v = [1.0, 0.5]
    rows = [
        (0, v), (0, v), (0, [2.0, 2.0]), (None, [3.0, 3.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]),
        (140, [1.0]), (7, v), (8, v), (-20, [1e30, -1e30]), (9, [1.0, 0.5, 4.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("uid", "list", "shard", "v", "rank", "score")})
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(df).select("query_id", "rank", F.coalesce("vec_id", F.lit(-999)).alias("vec_id"), "score").collect())
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = sorted((i, k, -999 if j is None else j, s) for i, top in brute(exact).values() for k, (s, j) in enumerate(top, 1))
    assert got == want and {q for q, *_ in got} == {0, 140, -20}


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0, 2.0])], [(1, [1.0]), (2, [2.0])]])
def test_none_to_find(spark, rows):
    got = nearest(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 0 and got.columns == ["query_id", "rank", "vec_id", "score"]


def test_fewer_candidates_than_asked_for(spark):
    got = as_lists(nearest(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], SCHEMA)))
    assert [j for _, _, j in got[0]] == [1, 2, 3, 4]


def test_balanced_leaves():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(900, 4)), 9 + 0.01 * rng.normal(size=(600, 4))])
    c = balanced_centroids(x, 50)
    sizes = np.bincount(np.argmin(neighbours._gaps(x, c), 1), minlength=len(c))
    assert len(c) >= 30 and sizes.max() <= 150
    assert len(balanced_centroids(np.ones((500, 3)), 10)) == 1


def test_graph_finds_near_centroids():
    rng = np.random.default_rng(6)
    g = Graph(rng.normal(size=(600, 10)))
    q = rng.normal(size=(100, 10))
    far, true = g.search(q, 1.1), np.sqrt(neighbours._gaps(q, g.c))
    wanted = true <= true.min(1)[:, None] * 1.1
    assert (np.isfinite(far) & wanted).sum() / wanted.sum() > 0.97
    assert np.allclose(far[np.isfinite(far)], true[np.isfinite(far)])
