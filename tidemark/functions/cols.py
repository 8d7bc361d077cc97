"""Column builders over one canonical window for each partition and order.

Missing values are NULL, never NaN. Divisions use try_divide, as ANSI mode raises on zero.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ASSET = ("asset",)


def series(keys: Iterable[str] = ASSET):
    return W.partitionBy(*keys).orderBy("dt")


def last(n: int, keys: Iterable[str] = ASSET):
    """The current row and the n - 1 before it."""
    return series(keys).rowsBetween(-(n - 1), 0)


def so_far(keys: Iterable[str] = ASSET):
    return series(keys).rowsBetween(W.unboundedPreceding, 0)


def lag(c, k: int = 1, keys: Iterable[str] = ASSET) -> Column:
    return F.lag(c, k).over(series(keys))


def div(a, b) -> Column:
    a, b = (x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x) for x in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def change(c: str, k: int = 1, keys: Iterable[str] = ASSET) -> Column:
    """c / (c of k rows before) - 1."""
    return div(F.col(c), lag(c, k, keys)) - 1


def log_change(c: str, keys: Iterable[str] = ASSET) -> Column:
    return F.ln(div(F.col(c), lag(c, 1, keys)))


def rolling(agg, c, n: int, keys: Iterable[str] = ASSET, least: int | None = None) -> Column:
    """agg over the last n rows, NULL unless `least` of them (all, by default) have a value."""
    c = F.col(c) if isinstance(c, str) else c
    w = last(n, keys)
    return F.when(F.count(c).over(w) >= (n if least is None else least), agg(c).over(w))


def mean(c, n: int, **k) -> Column:
    return rolling(F.avg, c, n, **k)


def std(c, n: int, **k) -> Column:
    return rolling(F.stddev_samp, c, n, **k)


def total(c, n: int, **k) -> Column:
    return rolling(F.sum, c, n, **k)


def age(keys: Iterable[str] = ASSET) -> Column:
    return F.row_number().over(series(keys))


def all_known(columns: Iterable[str]) -> Column:
    """None of the columns is NULL."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def clip(c: Column, lo: float, hi: float) -> Column:
    """Bounded; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def signal(c: Column, history: int, neutral: float = 0.0, lo: float | None = None, hi: float | None = None, keys: Iterable[str] = ASSET) -> Column:
    """c within bounds; neutral where history is shorter or c isn't a finite number."""
    bounded = c if lo is None else clip(c, lo, hi)
    sound = bounded.isNotNull() & ~F.isnan(bounded) & (F.abs(bounded) < float("inf"))
    return F.when((age(keys) >= history) & sound, bounded).otherwise(F.lit(neutral))


def weighted_mean(c: str, n: int, keys: Iterable[str] = ASSET) -> Column:
    """Weights 1..n, the newest row n; NULL unless all n rows have a value."""
    parts = [F.col(c) * n] + [lag(c, k, keys) * (n - k) for k in range(1, n)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out / F.lit(n * (n + 1) / 2)


def average_rank(c, by: Iterable[str] = ("dt",), descending: bool = False) -> Column:
    """Rank in (0, 1] with ties averaged, over the non-null values of each cross-section."""
    c = F.col(c) if isinstance(c, str) else c
    x = W.partitionBy(*by)
    order = c.desc_nulls_last() if descending else c.asc_nulls_last()
    ties = F.count(c).over(W.partitionBy(*by, c))
    return F.when(c.isNotNull(), (F.rank().over(x.orderBy(order)) + (ties - 1) / 2) / F.count(c).over(x))


def ordinal_rank(c: str, by: Iterable[str] = ("dt",), tie: str = "asset") -> Column:
    """Row numbers scaled to [-1, 1]; a single row has 0."""
    x = W.partitionBy(*by)
    n = F.count(F.lit(1)).over(x)
    return F.when(n > 1, (F.row_number().over(x.orderBy(c, tie)) - 1) / (n - 1) * 2 - 1).otherwise(F.lit(0.0))


def skew(c, n_values: Column, w) -> Column:
    """Bias-corrected skewness over a window that holds n_values values."""
    return F.when(n_values > 2, F.skewness(c).over(w) * F.sqrt(n_values * (n_values - 1)) / (n_values - 2))


def kurt(c, n_values: Column, w) -> Column:
    """Bias-corrected excess kurtosis."""
    n = n_values
    return F.when(n > 3, ((n + 1) * F.kurtosis(c).over(w) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def true_range(keys: Iterable[str] = ASSET) -> Column:
    """NULL in the first row."""
    before = lag("close", 1, keys)
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def compound(r: Column, w) -> Column:
    """Product of (1 + r) over a window, less 1. A return of -1 or less leaves nothing from there on."""
    alive = F.min(F.when(r > -1, 1).otherwise(0)).over(w) == 1
    return F.when(alive, F.exp(F.sum(F.ln(F.when(r > -1, 1 + r).otherwise(F.lit(1.0)))).over(w)) - 1).otherwise(F.lit(-1.0))


def drawdown(value: str, keys: Iterable[str] = ()) -> Column:
    """value / (largest so far) - 1."""
    w = W.partitionBy(*keys).orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    return div(F.col(value), F.max(value).over(w)) - 1
