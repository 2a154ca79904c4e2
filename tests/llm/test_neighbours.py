"""Nearest neighbours against brute force: exact scores and order, recall, every defined case."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skilloom.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.1"


def cosine(a, b):
    dot = lambda x, y: math.fsum(p * q for p, q in zip(x, y, strict=True))
    return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))


def naive(rows, k=5, every=50):
    """Of every asking row (by position): (vec_id, score) of the k nearest other rows; ties (to twelve digits) by id."""
    fine = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    lengths = [len(v) for _, v in fine]
    dims = min(set(lengths), key=lambda n: (-lengths.count(n), n), default=0)
    fine = [r for r in fine if len(r[1]) == dims]
    for n, (i, v) in enumerate(fine):
        if i is not None and i % every == 0:
            near = [(cosine(v, w), j) for m, (j, w) in enumerate(fine) if m != n]
            yield i, sorted(((j, s) for s, j in near), key=lambda h: (-round(h[1], 12), h[0] is None, h[0] or 0))[:k]


def answered(df):
    """Sorted (query, ids by rank, scores)."""
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
    return got


def held(df):
    return [(r["vec_id"], r["embedding"]) for r in df.collect()]


def same(got, want):
    """Every rank of every query as often and with the same ids and scores as brute force has them."""
    wanted = {}
    for q, hits in want:
        for rank, hit in enumerate(hits, 1):
            wanted.setdefault((q, rank), []).append(hit)
    assert got.keys() == wanted.keys()
    for key, hits in wanted.items():
        for (i, s), (j, t) in zip(sorted(got[key], key=repr), sorted(hits, key=repr), strict=True):
            assert i == j and abs(s - t) < 1e-12, key


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of every defined case; a third of all rows is one vector, some of them with ids that ask."""
    rng = random.Random(4)
    vectors = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(300)]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0], 1) for i in range(150)]
    rows += [(50, vectors[50], 0), (50, vectors[50], 0), (50, vectors[51], 0), (None, vectors[50], 0), (None, vectors[52], 0), (2000, [2 * x for x in vectors[7]], 0),
             (3000, None, 0), (3050, [], 0), (3100, [0.0] * 16, 0), (3150, [None] * 16, 0), (3200, [float("nan")] * 16, 0), (3250, [float("inf")] * 16, 0),
             (3300, [1.0] * 15, 0), (-50, [-0.0, *vectors[9][1:]], 0), (3350, [1e-40] * 16, 0), (3400, [3e38] * 16, 0)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("leaf", "ids", "block", "shard", "mark", "copies", "rank", "score", "query_id")})


def test_all_leaves_give_the_exact_answer(odd):
    """With full recall asked for, and blocks and shards far smaller than a leaf, the answer is that of brute force."""
    want = list(naive(held(odd)))
    for sizes in ({}, {"block_rows": 7, "block_queries": 2}):
        same(answered(nb.neighbours(odd, recall=1.0, sample=200, **sizes)), want)


def test_few_rows(spark, odd):
    for n in (0, 1, 2, 4):
        few = spark.createDataFrame([(50 * i, [1.0, float(i), 2.0], 0) for i in range(n)], SCHEMA)
        same(answered(nb.neighbours(few)), list(naive(held(few))))
    assert nb.neighbours(odd.filter("vec_id % 50 > 0")).collect() == []
    assert nb.neighbours(odd.filter("embedding is null")).columns == ["query_id", "rank", "vec_id", "score"]


def test_recall_and_order_on_the_given_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = held(vectors)
    got, hit, n = answered(nb.op13_best_bin_neighbours(spark, SF)), 0, 0
    v = np.array([r[1] for r in rows], float)
    ids = np.array([r[0] for r in rows])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[q]
        near[q] = -2
        best = set(ids[np.argsort(-near)[:5]].tolist())
        found = [got[ids[q], rank][0] for rank in range(1, 6)]
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(near[ids == i][0] - s) < 1e-12 for i, s in found)
        hit, n = hit + len(best & {i for i, _ in found}), n + 5
    assert hit / n >= 0.9


def test_fewer_leaves_where_vectors_cluster():
    """Best bins first: on clustered vectors a few leaves hold the neighbours; on a leaf list in any order they would not."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3
    v = nb.units(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)))
    tree = nb.Tree().fit(v)
    leaf, asks = tree.place(v), v[:100]
    true = [leaf[np.argsort(-(v @ q))[1:6]].tolist() for q in asks]
    visits = nb.widened(tree, asks, true, 0.95)
    assert visits < tree.n_leaves / 5
    inside = [sum(x in list(tree.best_bins(q))[:visits] for x in t) for q, t in zip(asks, true, strict=True)]
    fewer = [sum(x in list(tree.best_bins(q))[:visits - 1] for x in t) for q, t in zip(asks, true, strict=True)]
    assert sum(inside) >= 475 > sum(fewer)
    for q in asks[:5]:
        assert sorted(tree.best_bins(q)) == list(range(tree.n_leaves))
        assert next(tree.best_bins(q)) == tree.place(q[None])[0]


def test_dealing_keeps_blocks_bounded():
    rng = random.Random(6)
    counts = {i: rng.choice([0, 1, 5, 30, 99, 100, 101, 1000]) for i in range(200)}
    placed, load = nb.dealt(counts, 100), {}
    for leaf, (first, wide) in placed.items():
        for b in range(first, first + wide):
            load[b] = load.get(b, 0) + counts[leaf] / wide
    assert placed.keys() == counts.keys() and max(load.values()) <= 100
    assert len(load) <= 2 * sum(counts.values()) / 100 + 2
