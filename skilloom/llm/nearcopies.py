"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

One pass over the texts gives each its set of shingle hashes' own hash (the
mark; equal sets are one node), a SimHash of them and MinHash band keys.
Candidates come from two searches: nodes whose SimHashes the BK-trees of
``simhash`` link (3 of 64 bits or fewer), and nodes that share a band key, since
a similarity of 0.8 often means more than 3 bits.  Each node is tied to the
smallest of its fingerprint or key, so a key of any size gives as many ties as
it has nodes, and the ties' components hold every candidate pair.  Texts of
components with two nodes or more are then compared in full: a component's nodes are dealt into shards of bounded size,
any two shards meet once, and every pair of nodes that meet is decided by the
exact similarity of their shingle sets.  Links that hold are connected as in
``simhash``.

What may be missed is a pair over 3 bits apart without a common band key that
no other ties bring together: at a similarity of 0.8 at most one pair in 2900
(20 bands of 5), above that fewer.  No pair under 0.8 is linked by itself.

Defined cases: null and empty texts have no shingles and are copies of each
other; a text of fewer than five words is one shingle; a null ``doc_id`` is
kept only where its group has no other; repeated rows leave one; an empty
table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, ascii_words, materialize, per_text, whole_text
from .simhash import Groups, connected, links as bit_links, majority

#: Production parameters: words of a shingle, least similarity, seed of the hashes.
WORDS, SIMILARITY, SEED = 5, 0.8, 42
#: MinHash bands and the hashes of each.
BANDS, ROWS = 20, 5
#: Bounds of a shard: nodes, shingles.
SHARD, SHARD_SHINGLES = 1024, 1 << 20
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; none without words."""
    found = ascii_words(text)
    if not found:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[:n].tolist(), ends[min(words, len(found)) - 1:].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, n))


def mark(found: np.ndarray) -> int:
    """A signed 64-bit number for a set of shingles, the same for equal sets."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def bands(found: np.ndarray) -> np.ndarray:
    """The signed band keys of a set of shingles; none for the empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        mixed = (found[i:i + 1024] ^ _MIX[0][:, None]) * _MIX[1][:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    cut = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(cut)], np.uint64).view(np.int64)


def signatures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``mark``, ``shingles`` (their number), ``fingerprint`` and ``bands`` of every document."""

    def make() -> Callable[[list[str]], dict]:
        def columns(texts: list[str]) -> dict:
            sets = [shingles(t) for t in texts]
            return {"mark": [mark(s) for s in sets], "shingles": [len(s) for s in sets],
                    "fingerprint": [majority(s.astype(">u8")) for s in sets], "bands": [bands(s) for s in sets]}

        return columns

    return per_text(docs, keep, whole_text(), make, {"mark": "long", "shingles": "long", "fingerprint": "long", "bands": "array<long>"})


def near_fingerprints(nodes: DataFrame) -> DataFrame:
    """Ties (a, b) with a > b of the nodes (mark, fingerprint) whose SimHashes are equal or linked by BK-trees."""
    least = materialize(nodes.groupBy("fingerprint").agg(F.min("mark").alias("least")), "fingerprints")
    same = nodes.join(least, "fingerprint").filter("mark > least").selectExpr("mark as a", "least as b")
    ends = [least.selectExpr(f"fingerprint as {side}", f"least as of_{side}") for side in "ab"]
    near = bit_links(least.select("fingerprint")).join(ends[0], "a").join(ends[1], "b")
    return same.union(near.selectExpr("greatest(of_a, of_b) as a", "least(of_a, of_b) as b"))


def candidates(nodes: DataFrame) -> DataFrame:
    """(mark, component, shingles) of the nodes (mark, shingles, fingerprint, bands) whose fingerprints are near or that share a band
    key, directly or through others.  The node without shingles is near no other."""
    filed = nodes.select("mark", F.explode("bands").alias("key"))
    shared = filed.groupBy("key").agg(F.min("mark").alias("least"), F.max("mark").alias("most")).filter("least < most")
    ties = filed.join(materialize(shared.select("key", "least"), "shared"), "key").filter("mark > least").selectExpr("mark as a", "least as b")
    tied = connected(ties.union(near_fingerprints(nodes.filter("shingles > 0").select("mark", "fingerprint"))).distinct())
    whole = tied.union(tied.selectExpr("root", "root").distinct()).toDF("mark", "component")
    return nodes.select("mark", "shingles").join(whole, "mark")


def shard_links(tree_side: list[tuple[int, np.ndarray]], query_side: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that connect whatever similar pairs connect: inside one shard (no query side) or from one to the other."""
    sizes = np.array([len(s) for _, s in tree_side], np.int64)
    every = np.concatenate([s for _, s in tree_side]) if tree_side else np.empty(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(tree_side)), sizes)[order]
    groups, links = Groups(), []
    for _ in tree_side:
        groups.add()

    def near(found: np.ndarray, before: int) -> list[int]:
        """Positions under ``before`` of the tree side that are similar to the set."""
        first, last = np.searchsorted(every, found, "left"), np.searchsorted(every, found, "right")
        width = last - first
        total = int(width.sum())
        at = np.repeat(first - np.append(0, np.cumsum(width)[:-1]), width) + np.arange(total)
        shared = np.bincount(owner[at], minlength=len(sizes))[:before]
        return np.flatnonzero(shared / (len(found) + sizes[:before] - shared) >= SIMILARITY).tolist()

    def one_of_each(hits: list[int]) -> list[int]:
        return list({groups.top(at): at for at in hits}.values())

    for own, (name, found) in enumerate(tree_side):
        for at in one_of_each(near(found, own)):
            groups.join(at, own)
            if not query_side:
                links.append((name, tree_side[at][0]))
    for name, found in query_side:
        links += [(name, tree_side[at][0]) for at in one_of_each(near(found, len(sizes)))]
    return links


def links(members: DataFrame, texts: DataFrame, shard: int = SHARD, most: int = SHARD_SHINGLES) -> DataFrame:
    """(a, b) with a > b: similar pairs of ``members`` (mark, component, shingles), whose texts are in ``texts`` (mark, text)."""
    sized = members.groupBy("component").agg(F.expr(f"cast(ceil(greatest(count(*) / {shard}, sum(shingles) / {most})) as int)").alias("shards"))
    dealt = (members.join(materialize(sized, "sized"), "component").join(texts, "mark")
             .selectExpr("component", "mark", "text", "shards", "cast(pmod(xxhash64(mark), shards) as int) as own")
             .selectExpr("component", "mark", "text", "own", "explode_outer(sequence(0, shards - 1)) as other")
             .selectExpr("component", "mark", "text", "own", "least(own, other) as a", "greatest(own, other) as b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])

        def found() -> list[tuple[int, int]]:
            return shard_links(*sides) if at and (sides[1] or at[1] == at[2]) else []

        for batch in batches:
            out = []
            for component, name, text, own, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (component, a, b) != at:
                    out += found()
                    at, sides = (component, a, b), ([], [])
                sides[own != a].append((name, shingles(text)))
            if out:
                yield as_batch(out)
        if last := found():
            yield as_batch(last)

    def as_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(pairs, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both.max(axis=1)), pa.array(both.min(axis=1))], ["a", "b"])

    met = dealt.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b")
    return met.mapInArrow(run, "a long, b long").distinct()


def deduplicated(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One document (its standard columns) of each group of near copies: the one with the smallest doc_id, of repeated rows any one."""
    numbered = docs.select(*DOCUMENT_COLUMNS, F.monotonically_increasing_id().alias("row"))
    seen = materialize(signatures(numbered, [*DOCUMENT_COLUMNS, "row"]), "deduplication")
    first = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "row")
    same = [F.first(c).alias(c) for c in ("shingles", "fingerprint", "bands")]
    nodes = materialize(seen.groupBy("mark").agg(F.min(first).alias("first"), *same), "nodes")
    members = materialize(candidates(nodes), "members")
    one = members.select("mark").join(nodes.selectExpr("mark", "first.row as row"), "mark")
    texts = seen.select("row", whole_text().alias("text")).join(one, "row").select("mark", "text")
    roots = connected(links(members, texts, shard))
    with_root = nodes.select("mark", "first").join(roots.union(roots.selectExpr("root", "root").distinct()).toDF("mark", "root"), "mark")
    alone = nodes.join(with_root, "mark", "left_anti").select("first.row")
    kept = with_root.groupBy("root").agg(F.min("first").alias("first")).select("first.row").union(alone)
    return seen.join(kept, "row", "left_semi").select(*DOCUMENT_COLUMNS)
