r"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first with calibrated leaf visits.

* **Tree.**  Fitted on a bounded sample (about ``SAMPLE`` distinct vectors, by
  a hash of the vector): k-means splits a node into ``BRANCH`` children until a
  leaf holds ``LEAF`` sample vectors or fewer.  The tree has at most as many
  leaves as the sample has vectors, so it is sent along with the tasks.
* **Index.**  Every vector descends to the nearest child until it reaches a
  leaf.  Equal vectors become one entry that keeps its k + 1 smallest ids
  (limited in each task before the shuffle), which is all that any answer can
  need, so a vector that fills a third of the rows is one entry.
* **Search.**  A query takes leaves out of a priority queue: it descends to
  the nearest child, files the others by their distance, and goes on with the
  best of all filed bins.
* **Calibration.**  For a bounded sample of queries the true neighbours are
  found by brute force over all entries, and the number of visited leaves is
  widened until their recall reaches ``RECALL``.  All queries use that number,
  and go on while the visited leaves hold too few entries for k answers.
* **Blocks.**  Leaves are dealt into blocks of about ``BLOCK_ROWS`` entries and
  queries into shards of about ``BLOCK_QUERIES`` by the leaf they fall in; large
  leaves are split, small ones share.  A task meets one block with one shard,
  and entries go only to shards that ask for them.  Each task returns the k
  best of a query in its block, a window merges them.

Scores are cosines in double precision, summed in the order of components, so
equal vectors score alike wherever they lie; a matrix product only picks what
is scored (with a margin above its rounding).

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those of another length than most have (of
equally frequent lengths, the smallest counts); a null id asks nothing and ties
behind all others; repeated rows are candidates for each other, and each asks
and is answered; with k candidates or fewer all are returned; a table without
usable vectors or queries gives an empty result; extra input columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Production parameters: neighbours, every how many ids ask, recall to reach in calibration, queries to calibrate with (about).
NEAREST, EVERY, RECALL, CALIBRATION = 5, 50, 0.95, 256
#: Vectors (about) that the tree is fitted on, children of a node, sample vectors of a leaf, rounds of k-means.
SAMPLE, BRANCH, LEAF, ROUNDS = 8192, 8, 32, 8
#: Entries of a block and queries of a shard; queries that are scored at once.
BLOCK_ROWS, BLOCK_QUERIES, CHUNK = 1024, 1024, 128
#: How far a matrix product of unit vectors may be off the exact cosine, with much to spare.
MARGIN = 1e-11


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def units(v: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by their largest component first, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices, each sum taken in the order of components."""
    total = lambda x: np.cumsum(x, axis=1)[:, -1]
    a, b = (v / np.exp2(np.floor(np.log2(np.abs(v).max(axis=1, keepdims=True)))) for v in (a, b))  # powers of two change no digit
    return total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))


@dataclass
class Tree:
    """Nodes by number; inner nodes list their children, leaves are numbered."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)  # number of the leaf, -1 for an inner node
    n_leaves: int = 0
    matrix: np.ndarray | None = None

    def add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def fit(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, rounds: int = ROUNDS) -> Tree:
        """Splits a sample of unit vectors (one row at least) by k-means, level by level."""
        rng, todo = np.random.default_rng(0), [(self.add(sample.mean(axis=0)), sample)]
        while todo:
            at, members = todo.pop()
            parts = kmeans(members, branch, rounds, rng) if len(members) > leaf else []
            if len(parts) < 2:
                self.leaf[at] = self.n_leaves
                self.n_leaves += 1
                continue
            for part in parts:
                child = self.add(part.mean(axis=0))
                self.children[at].append(child)
                todo.append((child, part))
        return self

    def stacked(self) -> np.ndarray:
        if self.matrix is None:
            self.matrix = np.stack(self.centres)
        return self.matrix

    def place(self, v: np.ndarray) -> np.ndarray:
        """The leaf of every row: down to the nearest child each time."""
        out, todo = np.zeros(len(v), np.int32), [(0, np.arange(len(v)))]
        centres = self.stacked()
        half = (centres * centres).sum(axis=1) / 2
        while todo:
            at, rows = todo.pop()
            if self.leaf[at] >= 0:
                out[rows] = self.leaf[at]
                continue
            below = np.array(self.children[at])
            to = (v[rows] @ centres[below].T - half[below]).argmax(axis=1)
            todo += [(int(below[i]), rows[to == i]) for i in np.unique(to)]
        return out

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """All leaves of the tree, best bin first."""
        apart = self.stacked() - query
        distance = np.einsum("ij,ij->i", apart, apart)
        bins = [(0.0, 0)]
        while bins:
            _, at = heapq.heappop(bins)
            while self.leaf[at] < 0:
                near, *others = sorted((distance[c], c) for c in self.children[at])
                for other in others:
                    heapq.heappush(bins, other)
                at = near[1]
            yield self.leaf[at]


def kmeans(v: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Parts of v, none empty: rows by their nearest of up to k centres."""
    centres = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        to = (v @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
        centres = np.stack([v[to == c].mean(axis=0) for c in np.unique(to)])
    to = (v @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
    return [v[to == c] for c in np.unique(to)]


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and embedding of the vectors that take part, and their length (0: there are none)."""
    fine = ("forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity')) "
            "and exists(embedding, x -> x <> 0)")
    fit = vectors.select("vec_id", "embedding").filter(f"embedding is not null and {fine}")
    most = fit.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = most["dims"] if most else 0
    return fit.filter(F.size("embedding") == dims), dims


def _share(columns: str, n: int, rows: int) -> str:
    """SQL that holds for about n of so many rows, chosen by a hash of columns."""
    return f"pmod(xxhash64({columns}), {1 << 30}L) < {-(-(n << 30) // rows)}L" if n < rows else "true"


def fitted(fit: DataFrame, dims: int, rows: int, sample: int = SAMPLE) -> Tree:
    """A tree for a bounded sample of distinct vectors."""
    part = fit.filter(_share("embedding", sample, rows)).select("embedding").distinct().orderBy("embedding")
    return Tree().fit(units(matrix(part.toArrow()["embedding"], dims)))


def entries(fit: DataFrame, dims: int, tree: Tree, keep: int) -> DataFrame:
    """leaf, embedding and ids (the ``keep`` smallest, nulls last) of every distinct vector."""
    id_type = fit.schema["vec_id"].dataType.simpleString()
    part_type = fit.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.place(units(matrix(batch.column("embedding"), dims)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(leaf)], ["vec_id", "embedding", "leaf"])

    placed = fit.mapInArrow(run, f"vec_id {id_type}, embedding {part_type}, leaf int")
    order = "row_number() over (partition by embedding order by vec_id nulls last)"
    least = placed.selectExpr("*", f"{order} as at").filter(F.col("at") <= keep)
    return least.groupBy("embedding").agg(F.min("leaf").alias("leaf"), F.array_sort(F.collect_list(F.struct("at", "vec_id"))).alias("ids")).select(
        "leaf", "embedding", F.col("ids.vec_id").alias("ids"))


def dealt(counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """First block and number of blocks of every leaf: leaves up to ``size`` rows share blocks of about that many, larger ones get blocks of their own."""
    out, block, held = {}, 0, 0
    for leaf, n in sorted(counts.items()):
        need = -(-n // size)
        if held and (held + n > size):
            block, held = block + 1, 0
        out[leaf] = (block, max(1, need))
        if need > 1:
            block, held = block + need, 0
        else:
            held += n
    return out


def _blocks(spark: SparkSession, counts: dict[int, int], size: int, name: str) -> DataFrame:
    """leaf, first and number of blocks as a table that is as small as the tree."""
    return spark.createDataFrame([(leaf, a, n) for leaf, (a, n) in dealt(counts, size).items()], f"leaf int, {name} int, n_{name} int")


def _counts(df: DataFrame) -> dict[int, int]:
    """Rows of each leaf."""
    return {r["leaf"]: r["count"] for r in df.groupBy("leaf").count().collect()}


def best_of_block(queries: np.ndarray, rows: np.ndarray, k: int, allowed: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every query (by position): positions and exact cosines of rows that can be among its k + 1 nearest entries, nearest first.

    ``allowed`` (queries by rows) says which rows a query may see.
    """
    unit_queries, unit_rows, most = units(queries), units(rows), min(k + 1, len(rows))
    for i in range(0, len(queries), CHUNK):
        near = unit_queries[i:i + CHUNK] @ unit_rows.T
        if allowed is not None:
            near[~allowed[i:i + CHUNK]] = -np.inf
        least = np.partition(near, len(rows) - most, axis=1)[:, len(rows) - most] - MARGIN
        for j, (scores, bound) in enumerate(zip(near, least, strict=True), i):
            at = np.flatnonzero((scores >= bound) & (scores > -np.inf))
            if len(at):
                exact = cosines(np.broadcast_to(queries[j], (len(at), queries.shape[1])), rows[at])
                order = np.argsort(-exact, kind="stable")
                yield j, at[order], exact[order]


def answers(queries: np.ndarray, own: list, rows: np.ndarray, ids: list[list], k: int,
            allowed: np.ndarray | None = None) -> Iterator[tuple[int, object, float, int]]:
    """(query, id, score, row) of the k nearest ids of every query among the rows, where a row has several ids; a query's own id is left
    out once from the row that equals it."""
    for j, at, scores in best_of_block(queries, rows, k, allowed):
        hits = []
        for row, score in zip(at.tolist(), scores.tolist(), strict=True):
            named = list(ids[row])
            if own[j] in named and np.array_equal(queries[j], rows[row]):
                named.remove(own[j])
            hits += [(-score, i is None, i, row) for i in named]
        for score, _, i, row in sorted(hits, key=lambda h: (h[0], h[1], h[2] or 0))[:k]:
            yield j, i, -score, row


def widened(tree: Tree, queries: np.ndarray, true_leaves: list[list[int]], recall: float) -> int:
    """The fewest leaves to visit so that so large a share of the true neighbours lies in them."""
    visited = []  # for every true neighbour, after how many leaves it is found
    for query, leaves in zip(queries, true_leaves, strict=True):
        number = {leaf: n for n, leaf in enumerate(tree.best_bins(query), 1)}
        visited += [number[leaf] for leaf in leaves]
    visited.sort()
    return visited[max(0, math.ceil(recall * len(visited)) - 1)] if visited else 1


def calibrated(index: DataFrame, asks: DataFrame, dims: int, tree: Tree, k: int, n_asks: int, recall: float = RECALL, queries: int = CALIBRATION) -> int:
    """Leaves to visit, from the true neighbours of a bounded sample of queries among all entries."""
    chosen = asks.filter(_share("vec_id, embedding", queries, n_asks)).select("vec_id", "embedding").toArrow()
    if not chosen.num_rows:
        return tree.n_leaves
    own, wanted = chosen["vec_id"].to_pylist(), matrix(chosen["embedding"], dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = batch.column("leaf").to_pylist()
                found = [(j, i, score, leaf[row]) for j, i, score, row in
                         answers(wanted, own, matrix(batch.column("embedding"), dims), batch.column("ids").to_pylist(), k)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 4, kinds, strict=True)],
                                                 ["query", "vec_id", "score", "leaf"])

    id_type = asks.schema["vec_id"].dataType
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int32()]
    near = index.mapInArrow(run, f"query int, vec_id {id_type.simpleString()}, score double, leaf int")
    order = "row_number() over (partition by query order by score desc, vec_id nulls last)"
    leaves: list[list[int]] = [[] for _ in own]
    for r in near.selectExpr("query", "leaf", f"{order} as at").filter(F.col("at") <= k).collect():
        leaves[r["query"]].append(r["leaf"])
    return widened(tree, units(wanted), leaves, recall)


def asked(asks: DataFrame, dims: int, tree: Tree, counts: dict[int, int], visits: int, k: int, block_rows: int, block_queries: int) -> DataFrame:
    """A row for every query and block that it visits: block, shard, query_id, mark, copies, embedding and the leaves to look at."""
    blocks = dealt(counts, block_rows)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.place(units(matrix(batch.column("embedding"), dims)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, seen = [], [], []
            for n, query in enumerate(units(matrix(batch.column("embedding"), dims)) if batch.num_rows else []):
                todo: dict[int, list[int]] = {}
                entries_, taken = 0, 0
                for leaf in tree.best_bins(query):
                    if taken >= visits and entries_ > k:
                        break
                    taken += 1
                    if leaf in counts:
                        entries_ += counts[leaf]
                        first, wide = blocks[leaf]
                        for block in range(first, first + wide):
                            todo.setdefault(block, []).append(leaf)
                rows += [n] * len(todo)
                at += todo
                seen += todo.values()
            if rows:
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at, pa.int32()), pa.array(seen, pa.list_(pa.int32()))], [*names, "block", "leaves"])

    kinds = {f.name: f.dataType.simpleString() for f in asks.schema}
    placed = asks.mapInArrow(home, ", ".join(f"{n} {t}" for n, t in (kinds | {"leaf": "int"}).items()))
    of_leaf = _blocks(asks.sparkSession, _counts(placed), block_queries, "shard")
    sharded = placed.join(F.broadcast(of_leaf), "leaf").selectExpr(
        "vec_id as query_id", "xxhash64(embedding) as mark", "copies", "embedding", "shard + cast(pmod(xxhash64(vec_id, embedding), n_shard) as int) as shard")
    names = sharded.columns
    return sharded.mapInArrow(visit, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sharded.schema) + ", block int, leaves array<int>")


def neighbours(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, recall: float = RECALL, sample: int = SAMPLE,
               block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every row whose id is divisible by ``every``."""
    spark, (fit, dims) = vectors.sparkSession, usable(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dims:
        return empty
    asks = materialize(fit.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "embedding").agg(F.count("*").alias("copies")), "queries")
    n_asks = asks.count()
    if not n_asks:
        return empty
    tree = fitted(fit, dims, fit.count(), sample)
    index = materialize(entries(fit, dims, tree, k + 1), "index")
    counts = _counts(index)
    visits = calibrated(index, asks, dims, tree, k, n_asks, recall)
    todo = materialize(asked(asks, dims, tree, counts, visits, k, block_rows, block_queries), "visits")
    rows = (index.join(F.broadcast(_blocks(spark, counts, block_rows, "block")), "leaf")
            .selectExpr("leaf", "embedding", "ids", "block + cast(pmod(xxhash64(embedding), n_block) as int) as block")
            .join(todo.selectExpr("block as asked", "shard + 0 as shard").distinct(), F.col("block") == F.col("asked")).drop("asked"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            numbers, leaf = np.unique(left["leaf"].to_numpy(), return_inverse=True)
            seen = right["leaves"].combine_chunks()
            query = np.repeat(np.arange(len(seen)), seen.value_lengths().to_numpy(zero_copy_only=False))
            looked, wanted = seen.flatten().to_numpy(), np.zeros((len(seen), len(numbers)), bool)
            there = np.isin(looked, numbers)
            wanted[query[there], np.searchsorted(numbers, looked[there])] = True
            about = [right[c].to_pylist() for c in ("query_id", "mark", "copies")]
            found = [(about[0][j], about[1][j], about[2][j], i, score) for j, i, score, _ in
                     answers(matrix(right["embedding"], dims), about[0], matrix(left["embedding"], dims), left["ids"].to_pylist(), k, wanted[:, leaf])]
        columns = zip(*found, strict=True) if found else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "mark", "copies", "vec_id", "score"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    met = rows.groupBy("block", "shard").cogroup(todo.groupBy("block", "shard")).applyInArrow(
        meet, "query_id long, mark long, copies long, vec_id long, score double")
    order = "row_number() over (partition by query_id, mark order by score desc, vec_id nulls last)"
    best = met.selectExpr("*", f"{order} as rank").filter(F.col("rank") <= k)
    return best.selectExpr("query_id", "rank", "vec_id", "score", "explode(sequence(1L, copies)) as copy").drop("copy")


def op13_best_bin_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_best_bin_neighbours": op13_best_bin_neighbours}
ORACLES: dict[str, str] = {}
