"""Ragged sequences: array columns instead of flat values with offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.base import LONG, Operator


class SparseTruncIndices(Operator):
    """(begin, end) cut to at most `length`."""

    def __init__(self, length: int):
        self.length = length

    def lower(self, ctx, s):
        return F.struct(s["begin"].alias("begin"), F.least(s["begin"] + self.length, s["end"]).alias("end"))


class SparseLen(Operator):
    gives = LONG

    def lower(self, ctx, v):
        return F.size(v).cast("long")


class SparseTrunc(Operator):
    def __init__(self, length: int):
        self.length = length

    def lower(self, ctx, v):
        return F.slice(v, 1, self.length)


class SparseTruncPad(Operator):
    """Exactly `length` values: cut, or filled with `value` of the array's element type."""

    def __init__(self, length: int, value: float = 0.0, element: str = "double"):
        self.length, self.value, self.element = length, value, element

    def lower(self, ctx, v):
        cut = F.slice(v, 1, self.length)
        return F.concat(cut, F.array_repeat(F.lit(self.value).cast(self.element), (F.lit(self.length) - F.size(cut)).cast("int")))


class SparseMapSequences(Operator):
    """A function of the whole array, such as a higher-order one; empty arrays reach it too."""

    def __init__(self, fn: Callable[[Column], Column] | Operator):
        self.fn = fn

    def lower(self, ctx, v):
        return self.fn.lower(ctx, v) if isinstance(self.fn, Operator) else self.fn(v)


def array_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def sparse_values(df: DataFrame, key: str, column: str) -> DataFrame:
    """The flat values, (key, position, value); rows with empty arrays vanish."""
    return df.select(key, F.posexplode(column).alias("position", "value"))


def sparse_indices(df: DataFrame, key: str, column: str, blocks: int = 64) -> DataFrame:
    """(key, begin, end) of each row's values in the flat sequence ordered by key.

    Offsets are summed inside blocks of neighbouring keys first, so that no task orders all rows: keys are integers, a
    block is a range of them, and the table of blocks' sums is small.
    """
    size = F.size(column).cast("long")
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = max(1, ((high or 0) - (low or 0)) // blocks + 1)
    rows = df.select(key, F.greatest(size, F.lit(0)).alias("n")).withColumn("block", F.floor((F.col(key) - F.lit(low or 0)) / width))
    sums = rows.groupBy("block").agg(F.sum("n").alias("s"))
    before = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("before"))
    end = F.sum("n").over(Window.partitionBy("block").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("end", end).join(F.broadcast(before), "block")  # `blocks` rows at most
    return out.select(key, (F.col("before") + F.col("end") - F.col("n")).alias("begin"), (F.col("before") + F.col("end")).alias("end"))
