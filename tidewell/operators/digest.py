"""t-digest: a mergeable sketch of a distribution, as sorted centroids with weights.

Partitions are sketched where they are (`mapInPandas`), partial sketches are merged in a tree, and quantiles or shares
are read from the result by interpolation. `compat=True` reads a sketch the way the older estimator did: between two
centroids the interpolation runs from one cumulative weight to the other, backwards; tails have no share of their own.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import ieee
from tidewell.operators.base import DOUBLE
from tidewell.operators.scalers import Estimator, empirical_cdf

KIND = "means array<double>, weights array<double>, low double, high double"


@dataclasses.dataclass
class Digest:
    means: np.ndarray
    weights: np.ndarray
    low: float
    high: float

    @staticmethod
    def empty() -> "Digest":
        return Digest(np.zeros(0), np.zeros(0), np.inf, -np.inf)


def compress(means: np.ndarray, weights: np.ndarray, compression: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroids joined while they stay inside one unit of the arcsine scale."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    total = weights.sum()
    if len(means) <= compression or not total:
        return means, weights
    # a centroid's middle on the scale decides its cell; cells are one unit wide, so at most `compression` remain
    middle = (np.cumsum(weights) - weights / 2) / total
    cell = np.floor((np.arcsin(2 * middle - 1) / np.pi + 0.5) * compression).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    w = np.add.reduceat(weights, head)
    return np.add.reduceat(means * weights, head) / w, w


def add(d: Digest, values: np.ndarray, compression: float, weights: np.ndarray | None = None) -> Digest:
    if not len(values):
        return d
    w = np.ones(len(values)) if weights is None else weights
    m, w = compress(np.concatenate([d.means, values]), np.concatenate([d.weights, w]), compression)
    return Digest(m, w, min(d.low, values.min()), max(d.high, values.max()))


def merge(parts: list[Digest], compression: float) -> Digest:
    parts = [p for p in parts if len(p.means)]
    if not parts:
        return Digest.empty()
    m, w = compress(np.concatenate([p.means for p in parts]), np.concatenate([p.weights for p in parts]), compression)
    return Digest(m, w, min(p.low for p in parts), max(p.high for p in parts))


def quantile(d: Digest, q, compat: bool = False) -> np.ndarray:
    q = np.atleast_1d(np.asarray(q, float))
    n = len(d.means)
    if not n:
        return np.full(len(q), np.nan)
    if n == 1:
        return np.full(len(q), d.means[0])
    if compat:
        upto = np.cumsum(d.weights)
        at, first = q * upto[-1], d.weights[0]
        i = np.searchsorted(upto, at, side="right")
        j = i.clip(1, n - 1)
        f = (at - upto[j - 1]) / d.weights[j]
        inner = d.means[j] * (1 - f) + d.means[j - 1] * f
        inner = np.where(i == 0, d.means[-1], np.where(i >= n - 1, d.high, inner))  # inside the first centroid it wraps to the last
        return np.where(at <= first / 2, d.low + 2 * at / first * (d.means[0] - d.low), inner)
    total = d.weights.sum()
    middle = np.cumsum(d.weights) - d.weights / 2
    return np.interp(q * total, np.concatenate([[0], middle, [total]]), np.concatenate([[d.low], d.means, [d.high]]))


def cdf(d: Digest, x, compat: bool = False) -> np.ndarray:
    x = np.asarray(x, float)
    n = len(d.means)
    if not n:
        return np.zeros(len(x))
    total = d.weights.sum()
    if compat and n > 1:
        i = np.searchsorted(d.means, x, side="left").clip(1, n - 1)
        a, b = d.means[i - 1], d.means[i]
        width = np.where(b > a, b - a, 1.0)
        inner = (np.cumsum(d.weights)[i - 1] + d.weights[i] * (b - x) / width) / total
        out = np.where(x >= d.means[-1], 1.0, np.where(x <= d.means[0], 0.0, inner))
    elif compat or d.low == d.high:
        out = np.where(x < d.low, 0.0, np.where(x > d.high, 1.0, 0.5))
        if compat and d.low < d.high:
            out = np.where(x == d.low, 0.0, np.where(x == d.high, 1.0, out))
    else:
        middle = (np.cumsum(d.weights) - d.weights / 2) / total
        out = np.interp(x, np.concatenate([[d.low], d.means, [d.high]]), np.concatenate([[0], middle, [1]]))
        out = np.where(x < d.low, 0.0, np.where(x >= d.high, 1.0, out))
    return np.where(np.isnan(x), np.nan, out)


def sketch(df: DataFrame, x: Column | str, compression: float = 1000.0, fan_in: int = 32) -> Digest:
    """The digest of a column's values; NULL and NaN are passed over. The tasks' sketches, one each, meet in `fan_in` groups."""
    c = compression

    def parts(batches):
        d = Digest.empty()
        for b in batches:
            d = add(d, b["x"].to_numpy(np.float64), c)
        yield pd.DataFrame({"means": [d.means], "weights": [d.weights], "low": [d.low], "high": [d.high]})

    def joined(key, b):
        d = merge([Digest(np.asarray(m), np.asarray(w), lo, hi) for m, w, lo, hi in zip(b["means"], b["weights"], b["low"], b["high"])], c)
        return pd.DataFrame({"means": [d.means], "weights": [d.weights], "low": [d.low], "high": [d.high]})

    x = F.col(x) if isinstance(x, str) else x
    values = df.select(x.cast("double").alias("x")).where(~F.isnan("x") & F.col("x").isNotNull())
    which = F.pmod(F.xxhash64("low", "high", "means"), F.lit(fan_in))
    rows = values.mapInPandas(parts, KIND).withColumn("k", which).groupBy("k").applyInPandas(joined, KIND)
    out = rows.collect()  # `fan_in` sketches of `compression` centroids, or so
    return merge([Digest(np.array(r["means"]), np.array(r["weights"]), r["low"], r["high"]) for r in out], c)


def compat_ranks(df: DataFrame, x: str, out: str) -> DataFrame:
    """df with what `TDigestDistribution(compression, compat=True)`, fitted on column x, says of x itself, where `compression`
    is large enough to keep every value single: the share of smaller values, from exact ranks. No task holds all values."""
    rows = df.withColumn("_v", F.when(~F.isnan(x), F.col(x).cast("double")))
    of_nan = F.lit(0.0 if rows.where("_v IS NOT NULL").isEmpty() else None).cast("double")  # an Arrow worker's NaN is NULL
    ranked = empirical_cdf(rows, "_v", "_at_most")
    share = F.when(F.col("_all") == 1, 0.5).when(F.col("_below") + F.col("_n") == F.col("_all"), 1.0).otherwise(F.col("_below") / F.col("_all"))
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.isnan(x), of_nan).otherwise(share).alias(out))


class TDigestDistribution(Estimator):
    """The share of fitted values below x, from a digest. Unfitted: 0."""

    takes, gives = (DOUBLE,), DOUBLE

    def __init__(self, compression: float = 1000.0, compat: bool = False):
        self.compression, self.compat, self.digest = compression, compat, Digest.empty()

    def fit(self, df: DataFrame, x: Column | str) -> "TDigestDistribution":
        self.digest = sketch(df, x, self.compression)
        return self

    def lower(self, ctx, x):
        d, compat = self.digest, self.compat

        @F.pandas_udf("double")
        def share(v: pd.Series) -> pd.Series:
            return pd.Series(cdf(d, v.to_numpy(np.float64), compat))

        x = x.cast("double")
        return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(share(x))

    def state(self):
        d = self.digest
        return {"means": d.means.tolist(), "weights": d.weights.tolist(), "low": d.low, "high": d.high}

    def load(self, state):
        self.digest = Digest(np.array(state["means"]), np.array(state["weights"]), state["low"], state["high"])
        return self


class DigestRobustScale(Estimator):
    """(x - median) / (third - first quartile), both from a digest. Unfitted: x as it is."""

    takes, gives = (DOUBLE,), DOUBLE

    def __init__(self, compression: float = 1000.0, compat: bool = False):
        self.compression, self.compat, self.median, self.iqr = compression, compat, 0.0, 1.0

    def fit(self, df, x):
        a, self.median, b = map(float, quantile(sketch(df, x, self.compression), [0.25, 0.5, 0.75], self.compat))
        self.iqr = b - a
        return self

    def lower(self, ctx, x):
        return ieee.ieee_div(x.cast("double") - F.lit(self.median), F.lit(self.iqr))

    def state(self):
        return {"median": self.median, "iqr": self.iqr}

    def load(self, state):
        vars(self).update(state)
        return self
