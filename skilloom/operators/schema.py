"""Declared shapes of nested records, compiled to columns: what is wrong with a record (with paths), and the record as it is stored.

A shape is plain data (:class:`Text`, :class:`OneOf`, :class:`Many`,
:class:`Record`).  From it follow the type that JSON is read with, one array of
violations per record (``education[2].degree.max``), and the accepted form
(trimmed, defaults filled in).  Records are judged in place; no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from skilloom.functions import js

PATHS = "array<string>"
#: Where the reader puts JSON that it cannot read.
UNREAD = "_unread"


@dataclass(frozen=True)
class Text:
    """A string; bounds are in UTF-16 units before trimming."""

    low: int = 0
    high: int | None = None
    optional: bool = False
    trim: bool = True


@dataclass(frozen=True)
class OneOf:
    """One of some strings; with a default it may be left out."""

    allowed: tuple[str, ...]
    default: str | None = None


@dataclass(frozen=True)
class Record:
    """Named fields, and rules across them: path below the record to a condition that tells a violation."""

    fields: Mapping[str, Shape]
    checks: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)
    optional: bool = False


@dataclass(frozen=True)
class Many:
    """A list; when it may be left out, that is an empty one."""

    item: Shape
    low: int = 0
    high: int | None = None
    optional: bool = True


Shape = Text | OneOf | Record | Many


def type_of(shape: Shape) -> T.DataType:
    if isinstance(shape, Record):
        return T.StructType([T.StructField(n, type_of(s)) for n, s in shape.fields.items()])
    return T.ArrayType(type_of(shape.item)) if isinstance(shape, Many) else T.StringType()


def within(shape: Shape, dtype: T.DataType) -> Shape:
    """The part of a shape that a typed column has fields for."""
    if isinstance(shape, Record):
        return Record({n: within(s, dtype[n].dataType) for n, s in shape.fields.items() if n in dtype.names}, shape.checks, shape.optional)
    return Many(within(shape.item, dtype.elementType), shape.low, shape.high, shape.optional) if isinstance(shape, Many) else shape


def _sized(n: Column, low: int, high: int | None, say: Callable[[str], str], suffix: str = "") -> list[Column]:
    out = [F.when(n < low, say("min" + suffix))] if low else []
    return out if high is None else [*out, F.when(n > high, say("max" + suffix))]


def _found(value: Column, shape: Shape, name: str) -> tuple[list[Column], list[Column]]:
    """Violations as single strings (null: none), and as arrays of them from lists."""
    say = lambda rule: f"{name}.{rule}" if name else rule
    missing = [F.when(value.isNull(), say("missing"))]
    if isinstance(shape, Text):
        return [*([] if shape.optional else missing), *_sized(js.utf16_length(value), shape.low, shape.high, say)], []
    if isinstance(shape, OneOf):
        return [*([] if shape.default is not None else missing), F.when(~value.isin(*shape.allowed), say("enum"))], []
    if isinstance(shape, Many):
        at = lambda i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]."))
        inner = F.flatten(F.transform(value, lambda x, i: F.transform(violations(x, shape.item), lambda v: F.concat(at(i), v))))
        return [*([] if shape.optional else missing), *_sized(F.size(value), shape.low, shape.high, say, "_items")], [inner]
    singles, lists = [], []
    for part, inner in shape.fields.items():
        one, more = _found(value[part], inner, say(part))
        singles, lists = singles + one, lists + more
    singles += [F.when(wrong(value), say(path)) for path, wrong in shape.checks.items()]
    there = value.isNotNull()
    return ([*([] if shape.optional else missing), *[F.when(there, s) for s in singles]], [F.when(there, x) for x in lists])


def violations(value: Column, shape: Shape, name: str = "") -> Column:
    """Paths of all that is wrong with ``value``, in the order of the shape, lists last; empty if it is accepted."""
    singles, lists = _found(value, shape, name)
    empty = F.array().cast(PATHS)
    return F.concat(F.array_compact(F.array(*singles)).cast(PATHS), *[F.coalesce(x, empty) for x in lists])


def accepted(value: Column, shape: Shape) -> Column:
    """The record as it is stored: texts trimmed, defaults filled in, lists that were left out empty."""
    if isinstance(shape, Text):
        return js.trim(value) if shape.trim else value
    if isinstance(shape, OneOf):
        return value if shape.default is None else F.coalesce(value, F.lit(shape.default))
    if isinstance(shape, Many):
        return F.transform(F.coalesce(value, F.array().cast(type_of(shape))), lambda x: accepted(x, shape.item))
    return F.when(value.isNotNull(), F.struct(*[accepted(value[n], s).alias(n) for n, s in shape.fields.items()]))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that stands in the plan once, also where the optimizer moves a filter below the projection that makes the value."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def checked(df: DataFrame, column: str, shape: Record, out: str = "violations") -> DataFrame:
    """Add ``out`` for a column of JSON texts, which becomes the record (null if it can't be read), or of typed records."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StringType):
        read = F.from_json(column, type_of(shape).add(UNREAD, "string"), {"columnNameOfCorruptRecord": UNREAD})
        df = df.withColumn(column, _once(read, lambda r: F.when(r[UNREAD].isNull(), r.dropFields(UNREAD))))
        none = F.when(F.col(column).isNull(), F.array(F.lit("json.invalid")))
        return df.withColumn(out, F.coalesce(none, _once(F.col(column), lambda r: violations(r, shape))))
    return df.withColumn(out, _once(F.col(column), lambda r: violations(r, within(shape, dtype))))


def split(spark: SparkSession, judged: DataFrame, path: str, column: str = "violations") -> tuple[DataFrame, DataFrame]:
    """Accepted rows (without ``column``) and rejected ones: written once under ``path`` by verdict, each read from its own files."""
    judged.withColumn("accepted", F.size(column) == 0).write.partitionBy("accepted").parquet(path)
    rows = spark.read.schema(judged.schema.add("accepted", "boolean")).parquet(path)
    return rows.filter("accepted").drop("accepted", column), rows.filter("not accepted").drop("accepted")
