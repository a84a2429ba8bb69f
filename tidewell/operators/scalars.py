"""Operators without state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import ieee
from tidewell.operators.base import DOUBLE, STRING, Operator


class Stack(Operator):
    """dim=1: an array of K values becomes a row of the (N, K) matrix, an array column. dim=0 is `stack_long`."""

    def __init__(self, dim: int = 1):
        if dim != 1:
            raise ValueError("dim 0 changes rows: use stack_long")

    def lower(self, ctx, *args):
        return args[0] if len(args) == 1 else F.array(*args)


def stack_long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """dim=0: a row for each column and row, (position, key, value)."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.col(c).alias("value")) for i, c in enumerate(columns)]))
    return df.select(key, each.alias("e")).select("e.position", key, "e.value")


class Cat(Operator):
    """dim=1: arrays end to end. dim=0 is `cat_rows`."""

    def __init__(self, dim: int = 1):
        if dim != 1:
            raise ValueError("dim 0 changes rows: use cat_rows")

    def lower(self, ctx, *args):
        return F.concat(*args) if len(args) > 1 else F.flatten(args[0])


def cat_rows(*frames: DataFrame, ordinal: str = "position") -> DataFrame:
    """dim=0: rows one input after the other, with the input's ordinal."""
    out = None
    for i, df in enumerate(frames):
        part = df.withColumn(ordinal, F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


class NanToNum(Operator):
    takes, gives = (DOUBLE,), DOUBLE

    def __init__(self, nan: float | None = 0.0, posinf: float | None = None, neginf: float | None = None):
        self.nan, self.posinf, self.neginf = nan, posinf, neginf

    def lower(self, ctx, x):
        return ieee.nan_to_num(x, self.nan, self.posinf, self.neginf)


class Clamp(Operator):
    def __init__(self, min, max):  # noqa: A002
        if min is None or max is None:
            raise ValueError("both bounds are needed")
        self.min, self.max = min, max

    def lower(self, ctx, x):
        return ieee.clamp(x, self.min, self.max)


class Unsqueeze(Operator):
    """dim=1: a value becomes an array of one."""

    def __init__(self, dim: int):
        if dim != 1:
            raise ValueError("only dim 1 has a meaning for a row")

    def lower(self, ctx, x):
        return F.array(x)


class ToStr(Operator):
    """Text as Python writes it. Integers and booleans stay in the JVM, other numbers go through an Arrow batch."""

    gives = STRING

    def __init__(self, kind: T.DataType | None = None):
        self.kind = kind

    def lower(self, ctx, x):
        if isinstance(self.kind, (T.DoubleType, T.FloatType)):
            return float_text(x.cast("double"))
        if isinstance(self.kind, T.BooleanType):
            return F.when(x, "True").when(~x, "False")
        return x.cast("string")


def float_text(x: Column) -> Column:
    @F.pandas_udf("string")
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda f: None if f is None else str(float(f)))

    # NULL and NaN are one thing in a pandas column of doubles; only numbers go there
    plain = F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)
    return F.when(x.isNull(), F.lit(None).cast("string")).when(F.isnan(x), "nan").otherwise(text(plain))


class SplitToDict(Operator):
    """An array of len(names) values becomes a struct; another length is an error."""

    def __init__(self, names: list[str]):
        if len(set(names)) != len(names):
            raise ValueError("names must differ")
        self.names = list(names)

    def lower(self, ctx, v):
        right = F.size(v) == len(self.names)
        checked = F.when(right, v).otherwise(F.raise_error(F.lit(f"expected {len(self.names)} values")).cast("array<double>"))
        return F.struct(*[F.get(checked, F.lit(i)).alias(n) for i, n in enumerate(self.names)])


class CombineDicts(Operator):
    """Structs merged into one; a name that occurs twice is an error when the operator is built."""

    def __init__(self, *names: list[str]):
        flat = [n for part in names for n in part]
        if len(set(flat)) != len(flat):
            raise ValueError(f"duplicate names in {flat}")
        self.names = [list(part) for part in names]
        self.takes = (None,) * len(names)

    def lower(self, ctx, *args):
        return F.struct(*[a.getField(n).alias(n) for a, part in zip(args, self.names) for n in part])


def combine_maps(*maps: Column) -> Column:
    """Maps merged into one; a key that occurs twice is an error when the rows are read."""
    return F.map_concat(*maps)
