"""Column helpers with IEEE results where Spark's defaults differ: division, extremes and clamping around NaN and NULL."""

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: Largest finite double.
HIGHEST = 1.7976931348623157e308


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with 0 / 0 = NaN and x / 0 = ±Inf instead of an error; NULL if either is NULL."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def nan_min(x: Column) -> Column:
    """Aggregate: the minimum, NaN if there is one (Spark sorts NaN last)."""
    return F.when(F.max(F.isnan(x.cast("double"))), F.lit(NAN)).otherwise(F.min(x.cast("double")))


def nan_max(x: Column) -> Column:
    return F.max(x.cast("double"))


def clamp(x: Column, low, high) -> Column:
    """Between low and high; NaN and NULL stay as they are; low above high gives high."""
    return F.when(x.isNull() | F.isnan(x.cast("double")), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def nan_to_num(x: Column, nan: float | None = 0.0, posinf: float | None = None, neginf: float | None = None) -> Column:
    x = x.cast("double")
    high, low = HIGHEST if posinf is None else posinf, -HIGHEST if neginf is None else neginf
    return F.when(F.isnan(x), F.lit(float(nan or 0.0))).when(x == INF, F.lit(float(high))).when(x == -INF, F.lit(float(low))).otherwise(x)
