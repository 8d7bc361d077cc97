"""Normalisers of a cross-section (dt) of values; NULL stays NULL unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cols as C


def scalar_clip(c: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    """A single value: missing or infinite is 0, others are clipped."""
    sound = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(sound, C.clip(c, lo, hi)).otherwise(0.0)


def _day(by):
    return W.partitionBy(*by)


def zscore_clip(df: DataFrame, c: str = "value", by=("dt",), limit: float = 3.0, lo: float = -1.0, hi: float = 1.0, population: bool = False) -> DataFrame:
    """z within +-limit, scaled to [lo, hi]; 0 deviation gives z = 0. population: deviation over n instead of n - 1."""
    x = _day(by)
    sd = (F.stddev_pop if population else F.stddev_samp)(c).over(x)
    z = F.coalesce(C.div(F.col(c) - F.avg(c).over(x), F.nullif(sd, F.lit(0.0))), F.lit(0.0))
    scaled = (C.clip(z, -limit, limit) / limit + 1) / 2 * (hi - lo) + lo
    return df.withColumn("norm", F.when(F.col(c).isNotNull(), scaled))


def minmax(df: DataFrame, c: str = "value", by=("dt",), lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """A section of equal values gets the middle of [lo, hi]."""
    x = _day(by)
    least, most = F.min(c).over(x), F.max(c).over(x)
    share = C.div(F.col(c) - least, F.nullif(most - least, F.lit(0.0)))
    return df.withColumn("norm", F.when(F.col(c).isNotNull(), F.coalesce(share, F.lit(0.5)) * (hi - lo) + lo))


def rank(df: DataFrame, c: str = "value", by=("dt",)) -> DataFrame:
    """2 * average rank - 1, in (-1, 1]."""
    return df.withColumn("norm", 2 * C.average_rank(c, by) - 1)


def rank_array(df: DataFrame, c: str = "value", by=("dt",)) -> DataFrame:
    """Average rank spread over the whole of [-1, 1]; a single or missing value gets -1."""
    n = F.count(c).over(_day(by))
    at = C.div(C.average_rank(c, by) * n - 1, F.nullif(n - 1, F.lit(0)))
    return df.withColumn("norm", 2 * F.coalesce(at, F.lit(0.0)) - 1)


def winsorize(df: DataFrame, c: str = "value", lo: float = 0.01, hi: float = 0.99, by=("dt",)) -> DataFrame:
    """Clipped to the section's quantiles: one small row of bounds for each section, joined back."""
    bounds = df.groupBy(*by).agg(F.percentile(c, lo).alias("_lo"), F.percentile(c, hi).alias("_hi"))
    return df.join(bounds, list(by)).withColumn("norm", F.when(F.col(c).isNotNull(), F.greatest("_lo", F.least("_hi", c)))).drop("_lo", "_hi")


METHODS = {"zscore_clip": zscore_clip, "minmax": minmax, "rank": rank, "winsorize": winsorize, "none": lambda df, c="value", by=("dt",): df.withColumn("norm", F.col(c))}
