"""Dictionary encoders: a fit is a distributed count of keys, a transform a lookup.

Counts stay a DataFrame (key, count). A dictionary of at most SMALL keys becomes a literal map; a larger one is written
once, so that a fit stays what it was, and joined: broadcast while it has at most BROADCAST keys, by shuffle beyond.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.base import DOUBLE, LONG, STRING
from tidewell.operators.scalers import Estimator
from tidewell.sources.store import frozen

SMALL, BROADCAST = 64, 100_000


def NoThreshold() -> Callable[[DataFrame], DataFrame]:  # noqa: N802
    """Keeps every key."""
    return lambda counts: counts


def MinThreshold(threshold: int) -> Callable[[DataFrame], DataFrame]:  # noqa: N802
    """Keeps keys that occur `threshold` times or more."""
    return lambda counts: counts.where(F.col("count") >= threshold)


def RatioThreshold(threshold: float) -> Callable[[DataFrame], DataFrame]:  # noqa: N802
    """Keeps keys that make up `threshold` of all occurrences or more."""

    def keep(counts):
        total = counts.agg(F.sum("count")).first()[0]
        return counts.where(F.col("count") / F.lit(total) >= threshold) if total else counts

    return keep


def TopK(k: int) -> Callable[[DataFrame], DataFrame]:  # noqa: N802
    """Keeps the k most frequent keys, of equal counts the smaller key (integers as text)."""
    if k < 0:
        raise ValueError("k is 0 or more")
    return lambda counts: counts.orderBy(F.desc("count"), F.col("key").cast("string")).limit(k)


def ranked(counts: DataFrame) -> DataFrame:
    """counts with rank, from 1: by count, then by the key's text. Partitions are ranges of that order, however many keys
    share a count; a row's rank is its place in its partition and the sizes of those before, a row a partition."""
    order = [F.desc("count"), F.col("key").cast("string")]
    rows = counts.select("key", "count").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = frozen(rows.withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("m")).collect())
    upto = 0
    offsets = []
    for p, m in sizes:
        offsets.append((p, upto))
        upto += m
    before = counts.sparkSession.createDataFrame(offsets, "part long, before long")
    out = rows.withColumn("part", part).join(F.broadcast(before), "part")
    return out.select("key", "count", (F.col("before") + place + 1).alias("rank"))


def passing(rank, padding_idx: int, unknown_idx: int, when: Callable):
    """The id of a rank: dense ids that pass over the two reserved ones."""
    i = rank - 1
    for reserved in sorted({p for p in (padding_idx, unknown_idx) if p >= 0}):
        i = when(i >= reserved, i + 1, i)
    return i


def identifiers(counts: DataFrame, padding_idx: int = 0, unknown_idx: int = 1) -> DataFrame:
    """(key, id): dense ids by rank that pass over the two reserved ones."""
    i = passing(F.col("rank"), padding_idx, unknown_idx, lambda c, a, b: F.when(c, a).otherwise(b))
    return ranked(counts).select("key", i.cast("long").alias("id"))


class Lookup(Estimator):
    """What the encoders share: the counted, thinned dictionary and the way to a row's value."""

    key_kind = STRING
    takes: tuple = (STRING,)
    gives = LONG
    absent: float | int = 0

    def __init__(self, eliminator=None):
        self.eliminator = eliminator or NoThreshold()
        self.table: DataFrame | None = None
        self.small: dict | None = {}
        self.keys = 0

    def count(self, df: DataFrame, x: Column | str) -> DataFrame:
        x = F.col(x) if isinstance(x, str) else x
        return df.select(x.cast(self.key_kind).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("count"))

    def fit(self, df: DataFrame, x: Column | str) -> "Lookup":
        return self.finish(self.count(df, x))

    def finish(self, counts: DataFrame) -> "Lookup":
        kept = self.eliminator(counts).select("key", "count")
        head = kept.limit(SMALL + 1).collect()
        if len(head) <= SMALL:
            self.small, self.table, self.keys = self.few({r[0]: r[1] for r in head}), None, len(head)
        else:
            self.hold(frozen(self.values(kept).select("key", "value")))
        return self

    def hold(self, table: DataFrame) -> None:
        """Takes a written table (key, value) for the dictionary: as a literal map if it is small."""
        self.keys = table.count()
        few = self.keys <= SMALL
        self.small, self.table = ({r[0]: r[1] for r in table.collect()}, None) if few else (None, table)

    def values(self, counts: DataFrame) -> DataFrame:
        """(key, value)"""
        raise NotImplementedError

    def few(self, counts: dict) -> dict:
        """What `values` gives, for at most SMALL keys."""
        raise NotImplementedError

    def lower(self, ctx, x):
        x, other = x.cast(self.key_kind), F.lit(self.absent).cast(self.gives)
        if self.small is not None:
            if not self.small:
                return other
            pairs = [F.lit(v) for k, val in sorted(self.small.items(), key=lambda p: str(p[0])) for v in (k, val)]
            return F.coalesce(F.try_element_at(F.create_map(*pairs), x), other).cast(self.gives)
        if ctx.df is None:
            raise ValueError("a dictionary of this size is joined: use transform()")
        ctx.joined += 1
        key, value = f"_key{ctx.joined}", f"_value{ctx.joined}"
        right = self.table.select(F.col("key").alias(key), F.col("value").alias(value))
        right = F.broadcast(right) if self.keys <= BROADCAST else right
        ctx.df = ctx.df.join(right, x == F.col(key), "left").drop(key)
        return F.coalesce(F.col(value), other).cast(self.gives)

    def dictionary_size(self) -> int:
        return self.keys + 2

    def state(self):
        """Plain values; a large dictionary is a table of its own, `table`, which whoever saves the state writes beside it."""
        return {"small": None if self.small is None else sorted(self.small.items()), "absent": self.absent, "keys": self.keys}

    def load(self, state, table: DataFrame | None = None):
        self.absent, self.keys = state["absent"], state["keys"]
        if state["small"] is None:
            self.hold(table)
        else:
            self.small, self.table = {k: v for k, v in state["small"]}, None
        return self


class CountLookup(Lookup):
    """How often the key occurred, 0 for others."""

    def values(self, counts):
        return counts.select("key", F.col("count").alias("value"))

    def few(self, counts):
        return counts


class RatioLookup(Lookup):
    """The key's share of the occurrences of all kept keys, 0 for others."""

    gives = DOUBLE

    def values(self, counts):
        total = counts.agg(F.sum("count")).first()[0] or 1
        return counts.select("key", (F.col("count") / F.lit(total)).alias("value"))

    def few(self, counts):
        total = sum(counts.values()) or 1
        return {k: n / total for k, n in counts.items()}


class IndexLookup(Lookup):
    """The key's id: by frequency, dense, without the two reserved ids; `unknown_idx` for others."""

    def __init__(self, eliminator=None, padding_idx: int = 0, unknown_idx: int = 1):
        super().__init__(eliminator)
        self.padding_idx, self.absent = padding_idx, unknown_idx

    def values(self, counts):
        return identifiers(counts, self.padding_idx, self.absent).withColumnRenamed("id", "value")

    def few(self, counts):
        order = sorted(counts, key=lambda k: (-counts[k], str(k).encode()))
        return {k: passing(i, self.padding_idx, self.absent, lambda c, a, b: a if c else b) for i, k in enumerate(order, 1)}


class IntCountLookup(CountLookup):
    """`keep`: a fit on no rows leaves the old dictionary."""

    key_kind, takes = LONG, (LONG,)

    def __init__(self, eliminator=None, keep: bool = False):
        super().__init__(eliminator)
        self.keep = keep

    def finish(self, counts):
        return self if self.keep and not counts.head(1) else super().finish(counts)


class IntRatioLookup(RatioLookup):
    key_kind, takes = LONG, (LONG,)


class IntIndexLookup(IndexLookup):
    """Ids of integers; of equal counts the one whose text is smaller comes first ('10' before '2')."""

    key_kind, takes = LONG, (LONG,)
