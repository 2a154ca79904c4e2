"""What the training-data operators share: tables, intermediate tables, ASCII words."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skilloom.session import materialize  # noqa: F401  (re-exported for the operators)

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession, given: int | None) -> int:
    """The number of blocks to deal rows out to: as given, else the session's number of shuffle partitions."""
    return given or int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_words(text: str) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Numbering:
    """Numbers words in the order in which they first occur."""

    def __init__(self) -> None:
        self.of: dict[bytes, int] = defaultdict(itertools.count().__next__)

    def __len__(self) -> int:
        return len(self.of)

    def numbers(self, words: Iterable[bytes], n: int) -> np.ndarray:
        return np.fromiter(map(self.of.__getitem__, words), np.int64, n)


#: Arrow types of the columns that ``per_text`` adds.
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()),
         "binary": pa.binary()}


def per_text(df: DataFrame, keep: list[str], text: Column, make: Callable[[], Callable[[list[str]], dict]], fields: dict[str, str],
             chunk: int = 256) -> DataFrame:
    """``keep`` and new columns ``fields`` (name to type) for every row, in one pass in Arrow batches without a shuffle.

    ``make()`` is called once in each task; what it returns gets ``chunk``
    texts at a time and gives the new columns' values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for i in range(0, batch.num_rows, chunk):
                part = batch.slice(i, chunk)
                new = fn(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], *(pa.array(new[k], ARROW[t]) for k, t in fields.items())],
                                                 [*keep, *fields])

    source = df.select(*keep, text.alias("__text"))
    schema = T.StructType([*(source.schema[k] for k in keep), *(T.StructField(k, T._parse_datatype_string(t)) for k, t in fields.items())])
    return source.mapInArrow(run, schema)
