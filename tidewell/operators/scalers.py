"""Scalers: a fit is a few aggregates of one pass, a transform is arithmetic on literals.

An estimator names its aggregates (`aggregates`), takes their values (`finish`) and lowers to a Column. Spark's partial
aggregation combines the parts, so results don't depend on the partitioning. All scalers of a stage share one `agg`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import ieee
from tidewell.operators.base import DOUBLE, Operator


class Estimator(Operator):
    """An operator that is fitted first."""


class Scaler(Estimator):
    takes, gives = (DOUBLE,), DOUBLE

    def aggregates(self, x: Column) -> dict[str, Column]:
        raise NotImplementedError

    #: Whether it needs passes of its own, and no aggregates of a shared one.
    alone = False
    #: A column whose groups are aggregated each for itself; `over_groups` then joins their aggregates.
    by: str | None = None

    def over_groups(self) -> dict:
        """For each aggregate the function that joins the groups' ones."""
        raise NotImplementedError

    def finish(self, stats: dict) -> None:
        raise NotImplementedError

    def fit(self, df: DataFrame, x: Column | str) -> "Scaler":
        fit_together(df, [(self, (F.col(x) if isinstance(x, str) else x).cast("double"))])
        return self

    def state(self) -> dict:
        return {k: v for k, v in vars(self).items() if not k.startswith("_")}

    def load(self, state: dict) -> "Scaler":
        vars(self).update(state)
        return self


def fit_together(df: DataFrame, scalers: list[tuple[Scaler, Column]]) -> None:
    """Fits scalers, each on its column: one pass for those without groups and one for those of each grouping column."""
    for by in dict.fromkeys(s.by for s, _ in scalers):
        own = [(s, x) for s, x in scalers if s.by == by]
        wanted = [c.alias(f"{i}:{n}") for i, (s, x) in enumerate(own) for n, c in s.aggregates(x).items()]
        if by is None:
            got = df.agg(*wanted)
        else:
            named = [(i, n, c) for i, (s, _) in enumerate(own) for n, c in s.over_groups().items()]
            per = df.groupBy(by).agg(*wanted)
            got = per.agg(*[c(F.col(f"`{i}:{n}`")).alias(f"{i}:{n}") for i, n, c in named])
        got = got.first().asDict()
        for i, (s, _) in enumerate(own):
            s.finish({n.partition(":")[2]: v for n, v in got.items() if n.partition(":")[0] == str(i)})


class MeanScale(Scaler):
    """(x - mean) / (max - min). `batch`: a column whose groups' means are averaged unweighted, for batch-wise fits."""

    def __init__(self, batch: str | None = None):
        self._batch, self.mean, self.delta = batch, 0.0, 0.0

    @property
    def by(self):
        return self._batch

    def aggregates(self, x):
        return {"mean": F.avg(x), "low": ieee.nan_min(x), "high": ieee.nan_max(x)}

    def over_groups(self):
        return {"mean": F.avg, "low": ieee.nan_min, "high": ieee.nan_max}

    def finish(self, stats):
        if stats["mean"] is not None:
            self.mean, self.delta = stats["mean"], stats["high"] - stats["low"]

    def lower(self, ctx, x):
        return ieee.ieee_div(x.cast("double") - F.lit(self.mean), F.lit(self.delta))


class MinMaxScale(Scaler):
    """(x - min) / (max - min); values outside the fitted range aren't cut."""

    def __init__(self):
        self.low = self.delta = ieee.INF

    def aggregates(self, x):
        return {"low": ieee.nan_min(x), "high": ieee.nan_max(x)}

    def finish(self, stats):
        if stats["low"] is not None:
            self.low, self.delta = stats["low"], stats["high"] - stats["low"]

    def lower(self, ctx, x):
        return ieee.ieee_div(x.cast("double") - F.lit(self.low), F.lit(self.delta))


class StandardScore(Scaler):
    """(x - mean) / std, with any ddof. Without data it leaves x as it is."""

    def __init__(self, ddof: int = 1):
        self.ddof, self.mean, self.std = ddof, 0.0, 1.0

    def aggregates(self, x):
        return {"n": F.count(x), "mean": F.avg(x), "var": F.var_pop(x)}

    def finish(self, stats):
        n = stats["n"]
        if n:
            self.mean = stats["mean"]
            self.std = (stats["var"] * n / (n - self.ddof)) ** 0.5 if n > self.ddof else ieee.NAN

    def lower(self, ctx, x):
        return ieee.ieee_div(x.cast("double") - F.lit(self.mean), F.lit(self.std))


def exact_quantiles(df: DataFrame, x: Column, shares: list[float], most: int = 20_000, accuracy: int = 10_000) -> list[float] | None:
    """Quantiles of x, interpolated between neighbouring values. A sketch gives narrow brackets around each, their rows
    are counted, and the values inside, at most `most` different ones, are read; larger brackets are narrowed again."""
    values = df.select(x.cast("double").alias("x")).where("x is not null")
    near = sorted({min(1.0, max(0.0, p + d)) for p in shares for d in (-2 / accuracy, 2 / accuracy)})
    n, cuts = values.agg(F.count("*"), F.percentile_approx("x", near, accuracy)).first()
    if not n:
        return None
    wanted = {int(p * (n - 1)) + k for p in shares for k in (0, 1)}
    found = values_at(values, n, {r for r in wanted if r < n}, cuts, most, accuracy)
    out = []
    for p in shares:
        at = p * (n - 1)
        low = int(at)
        out.append(found[low] if at == low else found[low] * (low + 1 - at) + found[low + 1] * (at - low))
    return out


def values_at(values: DataFrame, n: int, ranks: set[int], cuts: list[float], most: int, accuracy: int) -> dict[int, float]:
    """The values of n rows x that stand at the given ranks, from 0. cuts divide the rows into open ranges and single values."""
    v = sorted(set(cuts))
    ranges = [F.col("x") < F.lit(v[0])]
    for i, c in enumerate(v):
        ranges += [F.col("x") == F.lit(c), (F.col("x") > F.lit(c)) & (F.col("x") < F.lit(v[i + 1])) if i + 1 < len(v) else F.col("x") > F.lit(c)]
    sizes = values.agg(*[F.count(F.when(r, 1)) for r in ranges]).first()
    found, upto, few = {}, 0, []
    for k, m in enumerate(sizes):
        own = {r for r in ranks if upto <= r < upto + m}
        if own and k % 2:
            found.update(dict.fromkeys(own, v[k // 2]))
        elif own and m <= most:
            few.append((ranges[k], upto, own))
        elif own:
            inside = values.where(ranges[k])
            near = sorted({min(1.0, max(0.0, (r - upto) / m + d)) for r in own for d in (-2 / accuracy, 2 / accuracy)})
            more = inside.agg(F.percentile_approx("x", near, accuracy)).first()[0]
            found.update({r + upto: y for r, y in values_at(inside, m, {r - upto for r in own}, more, most, accuracy).items()})
        upto += m
    if few:
        which = F.coalesce(*[F.when(r, i) for i, (r, _, _) in enumerate(few)])
        rows = values.select(which.alias("i"), "x").where("i is not null").groupBy("i", "x").count().collect()
        for i, (_, before, own) in enumerate(few):
            at = before
            for x, m in sorted((r["x"], r["count"]) for r in rows if r["i"] == i):
                found.update({r: x for r in own if at <= r < at + m})
                at += m
    return found


class RobustScale(Scaler):
    """(x - median) / (third - first quartile). `how`: exact quantiles, in passes of their own, or `approx` with a mergeable sketch."""

    def __init__(self, how: str = "exact", accuracy: int = 10_000):
        if how not in ("exact", "approx"):
            raise ValueError(how)
        self._how, self._accuracy, self.median, self.iqr = how, accuracy, 0.0, 1.0

    @property
    def alone(self):
        return self._how == "exact"

    def aggregates(self, x):
        return {"q": F.percentile_approx(x, [0.25, 0.5, 0.75], self._accuracy)}

    def fit(self, df, x):
        if not self.alone:
            return super().fit(df, x)
        self.finish({"q": exact_quantiles(df, F.col(x) if isinstance(x, str) else x, [0.25, 0.5, 0.75])})
        return self

    def finish(self, stats):
        if stats["q"]:
            a, self.median, b = stats["q"]
            self.iqr = b - a

    def lower(self, ctx, x):
        return ieee.ieee_div(x.cast("double") - F.lit(self.median), F.lit(self.iqr))


class Stacked(Scaler):
    """Scalers of one kind, one for each column of an array: fitted in one pass, applied element by element."""

    takes, gives = (T.ArrayType(DOUBLE),), T.ArrayType(DOUBLE)

    def __init__(self, scalers: list[Scaler]):
        if len({type(s) for s in scalers}) != 1:
            raise ValueError("stacked scalers are of one kind")
        self._scalers = list(scalers)

    @property
    def alone(self):
        return self._scalers[0].alone or self._scalers[0].by is not None

    def aggregates(self, x):
        return {f"{i}_{n}": c for i, s in enumerate(self._scalers) for n, c in s.aggregates(F.get(x, F.lit(i))).items()}

    def fit(self, df, x):
        x = F.col(x) if isinstance(x, str) else x
        if self.alone:
            for i, s in enumerate(self._scalers):
                s.fit(df, F.get(x, F.lit(i)))
        else:
            self.finish(df.agg(*[c.alias(n) for n, c in self.aggregates(x).items()]).first().asDict())
        return self

    def finish(self, stats):
        for i, s in enumerate(self._scalers):
            s.finish({n.partition("_")[2]: v for n, v in stats.items() if n.partition("_")[0] == str(i)})

    def lower(self, ctx, x):
        return F.array(*[s.lower(ctx, F.get(x, F.lit(i))) for i, s in enumerate(self._scalers)])

    def state(self):
        return {"parts": [s.state() for s in self._scalers]}

    def load(self, state):
        for s, part in zip(self._scalers, state["parts"]):
            s.load(part)
        return self


def empirical_cdf(df: DataFrame, x: str, out: str = "cdf", cells: int = 64) -> DataFrame:
    """df with the share of values that are at most x: exact ranks, without one task ordering all rows.

    Values fall into cells between quantiles; ranks count inside a cell, cells before it are added from a small table.
    Rows are not moved as a whole: values are counted first, a row for each different value.
    """
    cuts = sorted(set(df.agg(F.percentile_approx(x, [i / cells for i in range(1, cells)], 10_000)).first()[0] or []))
    cell = F.lit(0)
    for c in cuts:
        cell = cell + (F.col(x) > F.lit(c)).cast("int")
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count("*").alias("_n")).withColumn("_cell", cell)
    sums = counts.groupBy("_cell").agg(F.sum("_n").alias("_s"))
    table = sums.select("_cell", (F.sum("_s").over(Window.orderBy("_cell")) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    inside = F.sum("_n").over(Window.partitionBy("_cell").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_to", inside).join(F.broadcast(table), "_cell")  # `cells` rows at most
    share = ranked.select(F.col(x).alias("_x"), ((F.col("_before") + F.col("_to")) / F.col("_all")).alias(out), F.col("_n"), (F.col("_before") + F.col("_to") - F.col("_n")).alias("_below"), "_all")
    return df.join(share, df[x] == share["_x"], "left").drop("_x")
