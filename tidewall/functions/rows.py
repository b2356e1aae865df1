"""Turning an array column into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(col: Column) -> Column:
    """A costly column that later steps read as a value.

    Spark pushes a filter below the projection that computes its column by copying the expression
    into the filter, so a test on a scan result would run the scan twice, and a test on something built
    from it many times more. The partition number is not a deterministic expression, and Spark
    leaves projections that hold one in place. Put filters on other columns before the scan.
    """
    return F.when(F.spark_partition_id() >= 0, col)


def inline_rows(df: DataFrame, keys: list, array: Column, present: str) -> DataFrame:
    """One row per struct of a computed array; ``present`` names a field that is never null.

    The inner form makes Spark add a filter on the array's size, which it pushes below the projection
    that computes the array, so the whole computation runs twice. The outer form followed by a
    test of a field does not.
    """
    return df.select(*keys, F.inline_outer(array)).where(F.col(present).isNotNull())


def position_rows(df: DataFrame, keys: list, array: Column, index: str, value: str) -> DataFrame:
    """One row per element of a computed array, with its position."""
    return df.select(*keys, F.posexplode_outer(array).alias(index, value)).where(F.col(index).isNotNull())
