"""Exact k-means against a version in Python whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skilloom.llm import centroids as ct

SCHEMA = "vec_id long, embedding array<float>, label int"


def naive(rows, k=8, rounds=10, dims=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of rows (vec_id, vector of float32 values)."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(members[n]) for x in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = {c: sum(d for _, n, d in found if n == c) for _, c, _ in found}
    return [(i, c, d, total[c], sum(total.values()), centres[c]) for i, c, d in found]


def rows_of(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], list(r["centroid"])) for r in df.collect()), key=repr)


def held(df):
    return [(r["vec_id"], r["embedding"]) for r in df.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, other lengths, non-finite components, repeated rows, null ids, ties, with columns that clash."""
    rng = random.Random(2)
    vectors = [[rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(64)] for _ in range(40)]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(3, vectors[3], 1), (3, vectors[3], 1), (100, vectors[3], 1), (None, vectors[5], None), (None, vectors[6], 2)]
    rows += [(101, None, 0), (102, [], 0), (103, vectors[0][:63], 0), (104, [*vectors[0], 1.0], 0), (105, [None, *vectors[0][1:]], 0),
             (106, [float("nan"), *vectors[0][1:]], 0), (107, [float("inf"), *vectors[0][1:]], 0), (108, [-0.0] * 64, 0), (109, [1e-30] * 64, 0), (110, [-1e-30] * 64, 0)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("v", "to_pivot", "cluster", "distance", "hash", "number", "n", "x")})


def test_odd_rows(odd):
    assert rows_of(ct.clustered(odd)) == sorted(naive(held(odd)), key=repr)


def test_given_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert rows_of(ct.clustered(vectors)) == sorted(naive(held(vectors)), key=repr)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_and_equal_vectors(spark, odd, n):
    few = spark.createDataFrame([(i, [0.5] * 64, 0) for i in range(n)], SCHEMA)
    assert rows_of(ct.clustered(few)) == sorted(naive(held(few)), key=repr)
    many = few.union(spark.createDataFrame([(7, [0.5] * 64, 0)] * 30, SCHEMA))  # equal starting centroids: empty clusters stay
    assert rows_of(ct.clustered(many)) == sorted(naive(held(many)), key=repr)
    assert rows_of(ct.clustered(odd.filter("embedding is null"))) == []


def test_too_large_components(spark):
    df = spark.createDataFrame([(1, [1e9] * 64, 0)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        ct.clustered(df).collect()
    near = spark.createDataFrame([(i, [(-1.0) ** i * 131072.0] * 64, 0) for i in range(9)], SCHEMA)
    assert rows_of(ct.clustered(near)) == sorted(naive(held(near)), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**31), st.sampled_from([1, 5, 1024, 2**26]), st.integers(1, 9), st.integers(1, 6))
def test_bounds_never_exceed_distances(seed, size, k, p):
    rng = np.random.default_rng(seed)
    v, c, pivots = (rng.integers(-size, size + 1, (n, 8)) for n in (60, k, p))
    v[:5] = c[rng.integers(0, k, 5)]
    exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v], object)
    search = ct.Ptolemaic(pivots, c)
    to_pivot = np.sqrt(np.stack([ct.squared(v, q) for q in pivots], axis=1).astype(float))
    assert (search.squared_bounds(to_pivot) <= exact.astype(float)).all()
    number, best, checked = search.nearest(v, to_pivot)
    assert [(int(b), int(n)) for b, n in zip(best, number, strict=True)] == [min((d, n) for n, d in enumerate(row)) for row in exact]
    assert len(v) <= checked <= len(v) * k


def test_pivots_save_distances():
    """Near the pivots almost nothing is left to compute; centroids that are pivots are decided by cached distances alone."""
    rng = np.random.default_rng(1)
    pivots = rng.integers(-1000, 1000, (8, 64))
    v = pivots[rng.integers(0, 8, 2000)] + rng.integers(-60, 60, (2000, 64))
    to_pivot = np.sqrt(np.stack([ct.squared(v, q) for q in pivots], axis=1).astype(float))
    for centres in (pivots, pivots + rng.integers(-5, 5, (8, 64))):
        assert ct.Ptolemaic(pivots, centres).nearest(v, to_pivot)[2] < 1.05 * len(v)
