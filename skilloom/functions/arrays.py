"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def explode_structs(df: DataFrame, array: Column | str, *keys: str) -> DataFrame:
    """One row per element with the element's fields beside ``keys``.

    A plain ``explode`` makes the optimizer add ``size(array) > 0`` below the
    projection that computes the array, which repeats (and nests) the whole
    extraction expression inside a filter.  The outer form adds no such filter;
    empty arrays are dropped afterwards instead.
    """
    return (df.select(*keys, F.explode_outer(array).alias("_e")).filter(F.col("_e").isNotNull())
            .select(*keys, "_e.*"))


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with a bar behind which the optimizer cannot repeat the expressions of the named columns.

    A filter or a projection that uses a column twice otherwise evaluates a
    derived text twice, since both are pushed down to where it is made.
    """
    made = F.array(F.struct(*names))
    return df.select(*[c for c in df.columns if c not in names], F.explode_outer(made).alias("_made")).select(
        *[F.col(f"_made.{c}").alias(c) if c in names else F.col(c) for c in df.columns])
