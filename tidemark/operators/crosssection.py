"""Cross-sectional factors: builders from bars to (asset, dt, value). Assets without a raw value are left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cols as C
from .joins import valid_on


def _day():
    return W.partitionBy("dt")


def _raw(bars: DataFrame, raw: Column) -> DataFrame:
    return bars.select("*", raw.alias("raw")).where(F.col("raw").isNotNull() & ~F.isnan("raw")).select("asset", "dt", "raw")


def _with_r(bars: DataFrame) -> DataFrame:
    return bars.withColumn("r", C.change("close"))


def _ranked(df: DataFrame, negative: bool = False) -> DataFrame:
    rank = C.average_rank("raw")
    return df.select("asset", "dt", (1 - rank if negative else rank).alias("value"))


def zscore(df: DataFrame, c: str = "raw") -> DataFrame:
    """0 where the cross-section has no deviation."""
    z = C.div(F.col(c) - F.avg(c).over(_day()), F.nullif(F.stddev_samp(c).over(_day()), F.lit(0.0)))
    return df.select("asset", "dt", F.coalesce(z, F.lit(0.0)).alias("value"))


def _present(n: int) -> int:
    """Returns that a window of n needs: four fifths, two at least."""
    return max(2, -(-8 * n // 10))


def momentum_rank(bars: DataFrame, window: int = 20, max_vol: float | None = None, vol_window: int = 20) -> DataFrame:
    df = _with_r(bars)
    raw = C.change("close", window - 1)
    if max_vol is not None:
        raw = F.when(C.std("r", vol_window) * (252**0.5) <= max_vol, raw)
    return _ranked(_raw(df, raw))


def term_structure(bars: DataFrame) -> DataFrame:
    return zscore(_raw(bars, C.div(F.col("close") - F.col("close_next"), "close_next")))


def cross_momentum(bars: DataFrame, window: int = 240) -> DataFrame:
    return _ranked(_raw(bars, C.change("close", window)))


def series_momentum(bars: DataFrame, window: int = 240) -> DataFrame:
    return _raw(bars, C.change("close", window)).withColumnRenamed("raw", "value")


def composite_momentum(bars: DataFrame, window: int = 240, g: float = 0.4) -> DataFrame:
    df = _raw(bars, C.change("close", window)).withColumn("sign", F.signum("raw"))
    df = df.withColumn("pr", C.average_rank("raw", by=("dt", "sign")))
    up = F.when(F.col("pr") >= 1 - g, 0.5 + 0.5 * (F.col("pr") - (1 - g)) / g).otherwise(0.25 * F.col("pr"))
    down = F.when(F.col("pr") <= g, -0.5 - 0.5 * (g - F.col("pr")) / g).otherwise(-0.25 * (1 - F.col("pr")))
    return df.select("asset", "dt", F.when(F.col("sign") > 0, up).when(F.col("sign") < 0, down).otherwise(0.0).alias("value"))


def mean_signals(values: DataFrame) -> DataFrame:
    """asset, dt, value: ordinal rank in [-1, 1] of the mean over a date's factors. values: factor, asset, dt, value."""
    mean = values.groupBy("asset", "dt").agg(F.avg("value").alias("mean")).where("mean is not null")
    return mean.select("asset", "dt", C.ordinal_rank("mean").alias("value"))


def long_short(values: DataFrame, share: float = 0.2) -> DataFrame:
    """asset, dt, side of the upper share of positive and lower share of negative values, one asset each at least."""
    df = values.where("value <> 0").withColumn("sign", F.signum("value"))
    own = W.partitionBy("dt", "sign")
    n = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(own) * share))
    place = F.row_number().over(own.orderBy(F.abs("value").desc(), "asset"))
    return df.withColumn("k", place).withColumn("n", n).where("k <= n").select("asset", "dt", F.col("sign").cast("int").alias("side"))


def bias(bars: DataFrame, window: int = 20) -> DataFrame:
    raw = C.div(F.col("close") - C.mean("close", window), C.std("r", window) * C.lag("close", window))
    return _ranked(_raw(_with_r(bars), raw))


def trend_strength(bars: DataFrame, window: int = 20) -> DataFrame:
    df = bars.withColumn("step", F.abs(F.col("close") - C.lag("close")))
    return _ranked(_raw(df, C.div(F.col("close") - C.lag("close", window), F.nullif(C.total("step", window), F.lit(0.0)))))


def volatility(bars: DataFrame, window: int = 10) -> DataFrame:
    return _ranked(_raw(_with_r(bars), _of_full(C.std("r", window, least=_present(window)), window)))


def _of_full(raw: Column, window: int) -> Column:
    """NULL before the asset has a row more than the window."""
    return F.when(C.age() > window, raw)


def coefficient_of_variation(bars: DataFrame, window: int = 5) -> DataFrame:
    least = _present(window)
    raw = C.div(C.rolling(F.var_samp, "r", window, least=least), F.nullif(F.abs(C.mean("r", window, least=least)), F.lit(0.0)))
    return _ranked(_raw(_with_r(bars), _of_full(raw, window)))


def skewness(bars: DataFrame, window: int = 10) -> DataFrame:
    w = C.last(window)
    n = F.count("r").over(w)
    raw = F.when(n >= _present(window), C.skew(F.col("r"), n, w))
    return _ranked(_raw(_with_r(bars), _of_full(raw, window)), negative=True)


def kurtosis(bars: DataFrame, window: int = 60) -> DataFrame:
    w = C.last(window)
    n = F.count("r").over(w)
    raw = F.when(n >= _present(window), C.kurt(F.col("r"), n, w))
    return _ranked(_raw(_with_r(bars), _of_full(raw, window)), negative=True)


def amplitude(bars: DataFrame, window: int = 5) -> DataFrame:
    df = bars.withColumn("a", C.div(F.col("high") - F.col("close"), "close"))
    return _ranked(_raw(df, C.mean("a", window)))


def liquidity(bars: DataFrame, window: int = 1) -> DataFrame:
    df = _with_r(bars).withColumn("l", C.div("volume", F.nullif(F.abs("r"), F.lit(0.0))))
    return _ranked(_raw(df, F.avg("l").over(C.last(window))), negative=True)


def vcrr(bars: DataFrame) -> DataFrame:
    vwap = F.coalesce(C.div("amount", F.nullif(F.col("volume"), F.lit(0.0))), F.when(F.col("amount").isNull(), F.col("close")))
    df = bars.where("volume > 0").select("asset", "dt", (vwap - F.col("close")).alias("d"), (vwap + F.col("close")).alias("s"))
    df = df.where("d is not null").select("asset", "dt", C.average_rank("d").alias("rd"), C.average_rank("s").alias("rs"))
    df = df.withColumn("v", F.col("rd") / (F.col("rs") + 1e-10))
    z = (F.col("v") - F.avg("v").over(_day())) / (F.stddev_samp("v").over(_day()) + 1e-10)
    return df.select("asset", "dt", F.coalesce(C.clip(z, -3, 3) / 3, F.lit(0.0)).alias("value"))


def member_holdings(bars: DataFrame, holdings: DataFrame | None = None, win_rates: DataFrame | None = None) -> DataFrame:
    """Net share of holders.

    holdings (asset, valid_from, valid_to, long_pos, short_pos) replaces the bars' own columns on dates on which any asset of
    the bars has some; win_rates (asset, valid_from, valid_to, win_rate) weighs them, and leaves out assets without one, on
    dates on which any has one. Ranges exclude their end; a NULL end is open. Assets without bars don't count.
    """
    net = lambda long, short: C.div(F.col(long) - F.col(short), F.nullif(F.col(long) + F.col(short), F.lit(0.0)))
    if holdings is None:
        return zscore(_raw(bars, net("long_pos", "short_pos")))
    injected = holdings.select("asset", "valid_from", "valid_to", F.col("long_pos").cast("double").alias("held_long"), F.col("short_pos").cast("double").alias("held_short"))
    df = valid_on(bars.select("asset", "dt", "long_pos", "short_pos"), injected, ["held_long", "held_short"])
    df = df.withColumn("own", net("held_long", "held_short"))
    if win_rates is None:
        df = df.withColumn("win_rate", F.lit(None).cast("double"))
    else:
        df = valid_on(df, win_rates, ["win_rate"])
    day = W.partitionBy("dt")
    some = F.count("own").over(day) > 0
    rated = F.count(F.when(F.col("own").isNotNull(), F.col("win_rate"))).over(day) > 0
    value = F.when(some, F.when(rated, F.col("own") * F.col("win_rate")).otherwise(F.col("own"))).otherwise(net("long_pos", "short_pos"))
    return zscore(_raw(df, value))


FACTORS: dict[str, Callable[..., DataFrame]] = {
    "MomentumRank": momentum_rank,
    "TermStructure": term_structure,
    "CrossSectionalMomentumFactor": cross_momentum,
    "TimeSeriesMomentumFactor": series_momentum,
    "CompositeMomentumFactor": composite_momentum,
    "BIASFactor": bias,
    "TrendStrengthFactor": trend_strength,
    "VolatilityFactor": volatility,
    "CVFactor": coefficient_of_variation,
    "SkewnessFactor": skewness,
    "KurtosisFactor": kurtosis,
    "AmplitudeFactor": amplitude,
    "LiquidityFactor": liquidity,
    "VCRRFactor": vcrr,
    "MemberHoldings": member_holdings,
}
