r"""Exact centroid clustering (Lloyd's rounds in whole numbers), filtered by Ptolemaic pivots.

Each vector keeps its exact squared distances to fixed pivots (the starting
centroids), computed once and written with it.  By Ptolemy's inequality any
pair of pivots p, q bounds the distance of a vector x to a centroid c from
below: ``|d(x,p) d(c,q) - d(x,q) d(c,p)| / d(p,q)``.  A round takes the largest
bound over all pairs, rounded down by more than floating point can err, checks
the most promising centroid exactly and then every other one whose bound does
not exceed the best exact distance so far.  So assignments, ties to the
smaller number included, are exactly those of a full search.

A round is one pass without a shuffle of vectors: a task sends one row of
sums for each of its centroids, Spark adds them up in decimals, and only the
centroids (k times dims numbers) reach the driver.  Nothing else depends on the
number of rows.

Components become ``floor(scale * x)``.  Defined cases: vectors that are null,
have another number of components, or hold null or non-finite ones are left
out; a component whose integer exceeds 2^27 in size raises an error (a squared
distance must fit a long); rows with a null ``vec_id`` are clustered, but start
a centroid only when there are too few others; repeated rows each count, equal
hashes order by the vector; with fewer than k vectors there are as many
centroids as vectors; equal starting vectors give no pivot pair (their
bound is 0, so they are checked); an empty table gives an empty result; extra
input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Production parameters: components, factor before rounding down, centroids, rounds, seed of the hash that picks the starting ones.
DIMS, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Largest size of an integer component.
LARGEST = 1 << 27
#: By how much a bound is rounded down, far more than the few roundings of 2^-53 that it takes.
SLACK = 1e-12
#: Vectors that are compared at once.
CHUNK = 4096


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of int) of the vectors that take part."""
    fits = "forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))"
    part = f"floor({scale}D * cast(x as double))"
    whole = (f"transform(embedding, x -> if(abs({scale}D * cast(x as double)) > {LARGEST}D, "
             f"cast(raise_error('a component is too large for exact distances') as int), cast({part} as int)))")
    return vectors.filter(f"size(embedding) = {dims} and {fits}").select("vec_id", F.expr(whole).alias("v"))


def squared(v: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v to a point, in 64-bit whole numbers."""
    apart = v - point
    return np.einsum("ij,ij->i", apart, apart)


class Ptolemaic:
    """Finds nearest centroids through lower bounds from pivot pairs."""

    def __init__(self, pivots: np.ndarray, centroids: np.ndarray) -> None:
        self.centroids = centroids
        between = np.sqrt(np.array([squared(pivots, p) for p in pivots], float))
        self.pairs = [(a, b, between[a, b]) for a in range(len(pivots)) for b in range(a) if between[a, b] > 0]
        self.to_pivot = np.sqrt(np.array([squared(pivots, c) for c in centroids], float))  # a row for each centroid

    def squared_bounds(self, to_pivot: np.ndarray) -> np.ndarray:
        """Numbers that no squared distance from a vector (rows) to a centroid (columns) falls below."""
        best = np.zeros((len(to_pivot), len(self.centroids)))
        for a, b, apart in self.pairs:
            left = to_pivot[:, a, None] * self.to_pivot[None, :, b]
            right = to_pivot[:, b, None] * self.to_pivot[None, :, a]
            np.maximum(best, (np.abs(left - right) - SLACK * (left + right)) / (apart * (1 + SLACK)), out=best)
        return best * best * (1 - SLACK)

    def nearest(self, v: np.ndarray, to_pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of every row, and how many distances were computed."""
        bounds = self.squared_bounds(to_pivot)
        number = bounds.argmin(axis=1)
        best, checked = np.zeros(len(v), np.int64), len(v)
        for c, centroid in enumerate(self.centroids):
            own = number == c
            best[own] = squared(v[own], centroid)
        first = number.copy()
        for c, centroid in enumerate(self.centroids):
            open_ = np.flatnonzero((bounds[:, c] <= best) & (first != c))
            checked += len(open_)
            found = squared(v[open_], centroid)
            better = (found < best[open_]) | (found == best[open_]) & (c < number[open_])
            best[open_[better]], number[open_[better]] = found[better], c
        return number, best, checked


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            yield batch.slice(i, CHUNK)


def with_pivots(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, v and to_pivot: the exact squared distances to every pivot."""
    dims = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            v = _matrix(part.column("v"), dims)
            cached = np.stack([squared(v, p) for p in pivots], axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(cached), pa.list_(pa.int64()))], [*part.schema.names, "to_pivot"])

    return points.mapInArrow(run, f"vec_id {points.schema['vec_id'].dataType.simpleString()}, v array<int>, to_pivot array<bigint>")


def new_centroids(points: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of the vectors nearest to each centroid; a centroid without vectors stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, n, sums = Ptolemaic(pivots, centroids), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for part in _chunks(batches):
            v = _matrix(part.column("v"), dims)
            number, _, _ = search.nearest(v, np.sqrt(_matrix(part.column("to_pivot"), len(pivots)).astype(float)))
            n += np.bincount(number, minlength=k)
            for c in range(k):
                sums[c] += v[number == c].sum(axis=0)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))],
                                         ["number", "n", "sums"])

    parts = points.select("v", "to_pivot").mapInArrow(run, "number int, n bigint, sums array<bigint>")
    total = parts.selectExpr("number", "n", "posexplode(sums) as (at, part)").groupBy("number", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))
    out = centroids.copy()
    for row in total.collect():  # k times dims rows
        out[row["number"], row["at"]] = int(row["total"]) // row["n"]
    return out


def assigned(points: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Ptolemaic(pivots, centroids)
        for part in _chunks(batches):
            number, best, _ = search.nearest(_matrix(part.column("v"), dims), np.sqrt(_matrix(part.column("to_pivot"), len(pivots)).astype(float)))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])

    return points.mapInArrow(run, f"vec_id {points.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint")


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (array of long) of every vector that takes part."""
    whole = whole_vectors(vectors, dims, scale)
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.select("v", by_hash.alias("hash")).orderBy(F.asc_nulls_last("hash"), "v").limit(k).collect()
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return vectors.sparkSession.createDataFrame([], empty)
    pivots = centroids = np.array([r["v"] for r in first], np.int64)
    points = materialize(with_pivots(whole, pivots), "points")
    for _ in range(rounds):
        centroids = new_centroids(points, pivots, centroids)
    found = materialize(assigned(points, pivots, centroids), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # k rows
    facts = [(c, sums[c], sum(sums.values()), centroids[c].tolist()) for c in sums]
    about = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op12_ptolemaic_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256).alias("centroid_sha256"))


def _oracle() -> str:
    """DuckDB SQL for the query: every round is a search of all centroids."""
    ctes = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
            "x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept)",
            f"s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < {K})",
            "m0 AS MATERIALIZED (SELECT c, unnest(v) AS m, generate_subscripts(v, 1) AS i FROM s)"]
    for t in range(ROUNDS + 1):
        ctes += [f"d{t} AS (SELECT r, c, sum((x - m) * (x - m))::HUGEINT AS d FROM x JOIN m{t} USING (i) GROUP BY r, c)",
                 f"a{t} AS MATERIALIZED (SELECT r, min(d * {K} + c) AS best FROM d{t} GROUP BY r)"]
        if t < ROUNDS:
            ctes += [f"n{t} AS (SELECT best % {K} AS c, i, sum(x)::HUGEINT AS total, count(*) AS n FROM a{t} JOIN x USING (r) GROUP BY 1, 2)",
                     f"m{t + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce((total - ((total % n) + n) % n) // n, m.m) AS m FROM m{t} m LEFT JOIN n{t} USING (c, i))"]
    return "WITH " + ",\n".join(ctes) + f""",
z AS (SELECT c, sha256(string_agg(m::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{ROUNDS} GROUP BY c),
f AS (SELECT vec_id, (best % {K})::INTEGER AS cluster, (best // {K})::BIGINT AS distance FROM a{ROUNDS} JOIN kept USING (r))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM f JOIN z ON c = cluster"""


QUERIES = {"op12_ptolemaic_centroids": op12_ptolemaic_centroids}
ORACLES = {"op12_ptolemaic_centroids": _oracle()}
