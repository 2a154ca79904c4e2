r"""SimHash near-duplicates, searched with BK-trees.

Fingerprints come from one pass over the texts; equal fingerprints become one
node.  Two fingerprints that differ in at most 3 of 64 bits agree in two whole
blocks when the bits are cut into five, so every node is filed under its ten
pairs of blocks (25 or 26 bits each) and only keys with two nodes or more are
searched.  A key's nodes are dealt into shards of bounded size; the BK-tree of
a shard is sent to every other shard of its key, and a query follows only
edges whose distance lies within the radius of its own distance to the parent.
Nothing is left out: any two shards of a key meet once.

A search reports, for each node, one hit in every group of already linked
nodes, which keeps all connections without listing all pairs of a group.
Groups are found by alternating large-star and small-star steps over the
links, each written to the shared folder.

Defined cases: null and empty texts have fingerprint zero, linked like any
other; repeated rows and exact copies share a node; a null ``doc_id`` counts
only where its group has no other; an empty table gives an empty result; extra
input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, ascii_words, materialize, per_text, table, whole_text

#: Production parameters: words of a shingle, seed of its hash, bits that may differ, nodes of a shard.
WORDS, SEED, RADIUS, SHARD = 3, 42, 3, 1024
#: Five blocks of bits (first bit, width).
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def simhash(text: str, words: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit number: a bit is set if it is in over half of the shingles' hashes."""
    found = ascii_words(text)
    if not found:
        return 0
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[:n].tolist(), ends[min(words, len(found)) - 1:].tolist(), strict=True)
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), ">u8", n))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of big-endian hashes; zero without any."""
    n, set_in = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        set_in += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n).view(">i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], words: int = WORDS) -> DataFrame:
    """``keep`` and ``fingerprint`` (long) of every document."""

    def make() -> Callable[[list[str]], dict]:
        return lambda texts: {"fingerprint": [simhash(t, words) for t in texts]}

    return per_text(docs, keep, whole_text(), make, {"fingerprint": "long"})


class BKTree:
    """Numbers by Hamming distance: a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if self.values:
            at = 0
            while True:
                step = (value ^ self.values[at]).bit_count()
                if step not in self.children[at]:
                    self.children[at][step] = len(self.values)
                    break
                at = self.children[at][step]
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Positions (in order of adding) of the values within the radius."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                yield at
            todo += [child for step, child in self.children[at].items() if d - radius <= step <= d + radius]


class Groups:
    """Groups of positions that are linked so far."""

    def __init__(self) -> None:
        self.up: list[int] = []
        self.number = 0

    def add(self) -> int:
        self.up.append(len(self.up))
        self.number += 1
        return len(self.up) - 1

    def top(self, at: int) -> int:
        while self.up[at] != at:
            self.up[at] = self.up[self.up[at]]
            at = self.up[at]
        return at

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[b] = a
            self.number -= 1


def shard_links(tree_side: list[int], query_side: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect whatever values within the radius connect: inside one shard (no query side) or from one to the other."""
    tree, groups, links = BKTree(), Groups(), []

    def hits(value: int, among: int) -> list[int]:
        found: dict[int, int] = {}
        for at in tree.within(value, radius):
            found.setdefault(groups.top(at), at)
            if len(found) == among:
                break
        return list(found.values())

    for value in tree_side:
        near = hits(value, groups.number)
        own = groups.add()
        tree.add(value)
        for at in near:
            groups.join(at, own)
            if not query_side:
                links.append((value, tree.values[at]))
    for value in query_side:
        links += [(value, tree.values[at]) for at in hits(value, groups.number)]
    return links


def _keys(fingerprint: str) -> Column:
    """The ten pairs of blocks of a fingerprint, each with the number of its pair."""
    cut = [f"(shiftrightunsigned({fingerprint}, {64 - at - width}) & {(1 << width) - 1}L)" for at, width in BLOCKS]
    return F.expr("array(" + ", ".join(f"({i}L << 32) | ({cut[a]} << 13) | {cut[b]}" for i, (a, b) in enumerate(combinations(range(5), 2))) + ")")


def links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b) with a > b: enough links between distinct fingerprints to connect all that the radius connects."""
    if radius > 3:
        raise ValueError("five blocks find up to 3 differing bits")
    filed = nodes.select("fingerprint", F.explode(_keys("fingerprint")).alias("key"))
    shared = filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = (filed.join(shared, "key")
             .selectExpr("key", "fingerprint", f"cast(ceil(n / {shard}) as int) as shards")
             .selectExpr("key", "fingerprint", "shards", "cast(pmod(xxhash64(fingerprint), shards) as int) as own")
             .selectExpr("key", "fingerprint", "own", "explode(sequence(0, shards - 1)) as other")
             .selectExpr("key", "fingerprint", "own", "least(own, other) as a", "greatest(own, other) as b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])

        def found() -> list[tuple[int, int]]:
            return shard_links(*sides, radius) if at and (sides[1] or at[1] == at[2]) else []

        for batch in batches:
            out = []
            for key, value, own, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, a, b) != at:
                    out += found()
                    at, sides = (key, a, b), ([], [])
                sides[own != a].append(value & 0xFFFFFFFFFFFFFFFF)
            if out:
                yield as_batch(out)
        if last := found():
            yield as_batch(last)

    def as_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(pairs, np.uint64).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both.max(axis=1)), pa.array(both.min(axis=1))], ["a", "b"])

    met = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return met.mapInArrow(run, "a long, b long").distinct()


def connected(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, for links (a, b) with a > b."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(pairs.select("a", "b"), "links")
    seen = state(now)
    while seen[0]:
        both = now.union(now.selectExpr("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        large = both.join(least, "a").filter("b > a").selectExpr("b as a", "m as b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("inline(if(b = m, array(struct(a, m)), array(struct(b as a, m), struct(a, m)))) as (a, b)")
        now = materialize(small.distinct(), "links")
        before, seen = seen, state(now)
        if seen == before:
            break
    return now.selectExpr("a as node", "b as root")


def labelled(rows: DataFrame, first: Column, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, component) of every distinct fingerprint of ``rows``; component: the least ``first`` among all rows it reaches."""
    nodes = materialize(rows.groupBy("fingerprint").agg(F.min(first).alias("first")), "nodes")
    roots = connected(links(nodes, radius))
    with_root = nodes.join(roots.union(roots.selectExpr("root", "root").distinct()).withColumnRenamed("node", "fingerprint"), "fingerprint")
    smallest = with_root.groupBy("root").agg(F.min("first").alias("component"))
    linked = with_root.join(smallest, "root").select("fingerprint", "component")
    return nodes.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component", "first").alias("component"))


def components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every document."""
    rows = materialize(fingerprints(docs, ["doc_id"]), "fingerprints")
    labels = materialize(labelled(rows, F.col("doc_id"), radius), "labels")  # as a plain input Spark may split the join where one fingerprint is frequent
    return rows.join(labels, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document (its standard columns) of each component: the one with the smallest doc_id, of repeated rows any one."""
    seen = materialize(fingerprints(docs.select(*DOCUMENT_COLUMNS, F.monotonically_increasing_id().alias("row")), [*DOCUMENT_COLUMNS, "row"]),
                       "deduplication")
    first = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "row")
    kept = labelled(seen.select("fingerprint", "doc_id", "row"), first, radius).select("component.row").distinct()
    return seen.join(kept, "row", "left_semi").select(*DOCUMENT_COLUMNS)


def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash_bktree": op6_simhash_bktree}
ORACLES: dict[str, str] = {}
