"""Packing by power-of-two decomposition: a document is cut into pieces of binary lengths, each of them a sequence.

A document of n tokens (with its end token) becomes floor(n / longest) pieces
of the longest length and one piece for each binary digit of the rest, longest
first.  Equal lengths share a bucket; a training batch takes all its sequences
from one bucket, so no sequence holds two documents, no token is dropped, and
nothing is padded.  Each piece depends on its own document only: one pass over
the texts, without a shuffle, at any size.

Defined cases: null and empty texts are one end token (a piece of length 1);
repeated rows are packed again, in sequences of their own; texts of any length
are encoded whole; extra input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocabulary
from .common import per_text, table, whole_text

#: Production parameters: tokens of the longest sequence, id after each document.
LONGEST, END = 2048, 1


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that sum to n, none over ``longest`` (a power of two itself), longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, longest: int = LONGEST, end: int = END, path: str | None = None, ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length) and, if
    ``ids``, the little-endian 32-bit token ids."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest sequence must be a power of two")
    path = path or vocabulary.default_path()

    def make() -> Callable[[list[str]], dict]:
        encode, last = vocabulary.encoder(path).encode_to_numpy, np.array([end], "<u4")

        def columns(texts: list[str]) -> dict:
            out: dict[str, list] = {"starts": [], "lengths": [], "sums": [], "doc_tokens": [], "ids": []}
            for text in texts:
                data = np.concatenate([encode(text, allowed_special="all").astype("<u4"), last]).tobytes()
                n = len(data) // 4
                lengths = binary_lengths(n, longest)
                at = np.append(0, np.cumsum(lengths)) * 4
                view = memoryview(data)
                out["starts"].append(at[:-1] // 4)
                out["lengths"].append(lengths)
                out["sums"].append([zlib.crc32(view[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])
                out["doc_tokens"].append(n)
                out["ids"].append(data if ids else None)
            return out

        return columns

    whole = per_text(docs, ["doc_id"], whole_text(), make,
                     {"starts": "array<long>", "lengths": "array<long>", "sums": "array<long>", "doc_tokens": "long", "ids": "binary"})
    out = whole.selectExpr("doc_id", "doc_tokens", "ids", "inline(arrays_zip(starts, lengths, sums))").withColumnsRenamed(
        {"starts": "start", "lengths": "length", "sums": "ids_crc32"}).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"),
        F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("ids"))
    return out if ids else out.drop("ids")


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write packed sequences by bucket: every folder ``bucket=k`` holds sequences of 2^k tokens only."""
    packed.write.partitionBy("bucket").parquet(path)


def op7_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"), ids=False)


QUERIES = {"op7_binary_packing": op7_binary_packing}
ORACLES: dict[str, str] = {}
