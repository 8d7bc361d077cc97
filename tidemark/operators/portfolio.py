"""Portfolios from values: positions are taken a day after their signal, through `tradeable` alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cols as C
from ..sources.bars import calendar
from .pairs import joint_moments
from .gram import quadratic_form
from .timeseries import per_asset


def tradeable(position: str, keys=("asset",)) -> Column:
    """The position of the row before: what a signal known at the close can earn."""
    return F.coalesce(C.lag(position, 1, keys), F.lit(0.0))


def signal_backtest(bars: DataFrame, values: DataFrame, threshold: float = 0.0, cost: float = 0.001, capital: float = 1e6) -> DataFrame:
    """asset, dt, position, ret, equity of going long above the threshold and short below its negative."""
    df = bars.select("asset", "dt", F.coalesce(C.change("close"), F.lit(0.0)).alias("r")).join(values, ["asset", "dt"], "left")
    side = F.when(F.col("value") > threshold, 1.0).when(F.col("value") < -threshold, -1.0).otherwise(0.0)
    df = df.withColumn("side", side).withColumn("position", tradeable("side"))
    turn = F.abs(F.col("position") - F.coalesce(C.lag("position"), F.lit(0.0)))
    df = df.withColumn("ret", F.col("position") * F.col("r") - turn * cost)
    return df.select("asset", "dt", "position", "ret", (capital * (1 + C.compound(F.col("ret"), C.so_far()))).alias("equity"))


def quintile_weights(values: DataFrame, top: float = 0.8, bottom: float = 0.2, least_assets: int = 1) -> DataFrame:
    """asset, dt, weight: equal weights long at ranks of `top` or above, short at `bottom` or below (short wins if both), on
    dates with `least_assets` values."""
    x = W.partitionBy("dt")
    df = values.where("value is not null").withColumn("rank", C.average_rank("value")).withColumn("n", F.count(F.lit(1)).over(x)).where(F.col("n") >= least_assets)
    df = df.withColumn("short", F.col("rank") <= bottom).withColumn("long", F.col("rank") >= top)
    share = lambda c: 1.0 / F.nullif(F.sum(F.col(c).cast("int")).over(x), F.lit(0))
    weight = F.when(F.col("short"), -share("short")).when(F.col("long"), share("long"))
    return df.select("asset", "dt", weight.alias("weight")).where("weight is not null")


def long_short_backtest(bars: DataFrame, values: DataFrame, top: float = 0.8, bottom: float = 0.2, capital: float = 1e6, same_day: bool = False, halved: bool = False, least_assets: int = 1) -> DataFrame:
    """dt, ret, equity. A weight earns the asset's return of the next calendar date (none if it has no bar there).

    same_day looks ahead: the weight earns the return of its own date. halved counts both sides as one capital.
    """
    days = calendar(bars)
    held = quintile_weights(values, top, bottom, least_assets).join(days, "dt").select("asset", (F.col("ci") + (0 if same_day else 1)).alias("ci"), "weight")
    r = bars.select("asset", "dt", C.change("close").alias("r")).join(days, "dt").select("asset", "ci", "r")
    earned = held.join(r, ["asset", "ci"]).groupBy("ci").agg(F.sum(F.col("weight") * F.coalesce("r", F.lit(0.0))).alias("ret"))
    daily = days.join(earned, "ci", "left").select("dt", (F.coalesce("ret", F.lit(0.0)) / (2 if halved else 1)).alias("ret"))
    return equity(daily, capital)


def equity(daily: DataFrame, capital: float = 1e6, keys=()) -> DataFrame:
    """`daily` (keys, dt, ret) with equity; one row for each date."""
    w = W.partitionBy(*keys).orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn("equity", capital * (1 + C.compound(F.col("ret"), w)))


def pair_backtest(legs: DataFrame, values: DataFrame, halved: bool = False, capital: float = 1e6) -> DataFrame:
    """a1, a2, dt, position, ret, equity of holding the spread in the direction of the day before's value."""
    keys = ("a1", "a2")
    df = legs.join(values.select("a1", "a2", "dt", "value"), ["a1", "a2", "dt"], "left").withColumn("side", F.coalesce(F.signum("value"), F.lit(0.0)))
    df = df.withColumn("position", tradeable("side", keys))
    spread = F.coalesce(F.col("r1") - F.col("r2"), F.lit(0.0)) / (2 if halved else 1)
    return equity(df.select("a1", "a2", "dt", "position", (F.col("position") * spread).alias("ret")), capital, keys)


def allocation(strength: DataFrame, method: str = "equal", c: str = "vol") -> DataFrame:
    """`strength` (dt, ...) with share of the date's capital: equal, weighted (by |c|) or volatility_parity (by 1 / c)."""
    x = W.partitionBy("dt")
    raw = {"equal": F.lit(1.0), "weighted": F.abs(c), "volatility_parity": C.div(F.lit(1.0), F.nullif(F.col(c), F.lit(0.0)))}[method]
    df = strength.withColumn("_raw", raw)
    return df.withColumn("share", C.div("_raw", F.nullif(F.sum("_raw").over(x), F.lit(0.0)))).drop("_raw")


def pair_volatility(legs: DataFrame, window: int = 20, annual: float = 252.0) -> DataFrame:
    """a1, a2, dt, vol of the ratio's returns."""
    keys = ("a1", "a2")
    df = legs.select("a1", "a2", "dt", C.div("c1", "c2").alias("x")).withColumn("dx", C.change("x", 1, keys))
    return df.select("a1", "a2", "dt", (C.std("dx", window, keys=keys, least=10) * annual**0.5).alias("vol"))


def pair_sizes(legs: DataFrame, capital: float = 1e6, margin: float = 0.1, window: int = 20, default: float = 0.15, annual: float = 252.0) -> DataFrame:
    """a1, a2, dt, weight1, n1, n2: whole contracts of each leg so that both bear the same risk, by inverse volatility.

    A volatility that is missing (under 10 returns) or 0 counts as `default`. A leg has one contract at least; both have
    one where a price is missing or not above 0.
    """
    keys = ("a1", "a2")
    vol = lambda r: F.coalesce(F.nullif(C.std(r, window, keys=keys, least=10) * annual**0.5, F.lit(0.0)), F.lit(default))
    df = legs.select("a1", "a2", "dt", "c1", "c2", vol("r1").alias("v1"), vol("r2").alias("v2"))
    df = df.withColumn("weight1", F.col("v2") / (F.col("v1") + F.col("v2")))
    priced = (F.col("c1") > 0) & (F.col("c2") > 0)
    n = lambda w, c: F.when(priced, F.greatest(F.lit(1).cast("long"), F.floor(C.div(w * capital, F.col(c) * margin)))).otherwise(F.lit(1).cast("long"))
    return df.select("a1", "a2", "dt", "weight1", n(F.col("weight1"), "c1").alias("n1"), n(1 - F.col("weight1"), "c2").alias("n2"))


def vol_target(legs: DataFrame, target: float = 0.15, lookback: int = 60, base: float = 1.0, most: float = 3.0) -> DataFrame:
    """a1, a2, dt, vol, leverage: target over the annual deviation of the log ratio (20 values at least), within [0.1, 10]."""
    keys = ("a1", "a2")
    df = legs.select("a1", "a2", "dt", F.ln(C.div("c1", "c2")).alias("x"))
    df = df.withColumn("dx", F.col("x") - C.lag("x", 1, keys))
    df = df.withColumn("vol", C.std("dx", lookback, keys=keys, least=20) * 252**0.5).where("vol is not null")
    df = df.withColumn("vol", F.when(F.col("vol") == 0, 0.01).otherwise(F.col("vol")))
    return df.select("a1", "a2", "dt", "vol", F.least(C.clip(C.div(F.lit(target), "vol"), 0.1, 10) * base, F.lit(most)).alias("leverage"))


def inverse_vol_weights(bars: DataFrame, window: int = 20, default: float = 0.15) -> DataFrame:
    """asset, dt, vol, weight over the assets of a date."""
    df = bars.select("asset", "dt", C.change("close").alias("r"))
    df = df.withColumn("vol", F.coalesce(F.nullif(C.std("r", window, least=10) * 252**0.5, F.lit(0.0)), F.lit(default)))
    return df.select("asset", "dt", "vol", (1 / F.col("vol") / F.sum(1 / F.col("vol")).over(W.partitionBy("dt"))).alias("weight"))


def portfolio_vol(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """dt, vol = sqrt(w' S w). weights: dt, asset, weight; cov: a1, a2, cov with both orders and the diagonal."""
    form = quadratic_form(weights, cov, "cov")
    return form.select("dt", F.sqrt(F.greatest("form", F.lit(0.0))).alias("vol"))


def covariances(bars: DataFrame, annual: float = 252.0) -> DataFrame:
    """a1, a2, cov of daily returns over common dates, both orders and the diagonal."""
    half = joint_moments(bars, diagonal=True).select("a1", "a2", (F.col("cov") * annual).alias("cov"))
    return half.unionByName(half.where("a1 < a2").select(F.col("a2").alias("a1"), F.col("a1").alias("a2"), "cov"))


def vol_forecast(bars: DataFrame, decay: float = 0.94, annual: float = 252.0) -> DataFrame:
    """asset, dt, vol: root of the decayed mean of all squared returns so far."""

    def f(part: pd.DataFrame) -> np.ndarray:
        squares = part["close"].pct_change(fill_method=None) ** 2
        return np.sqrt(squares.ewm(alpha=1 - decay).mean() * annual).astype(object).where(lambda v: v.notna(), None)

    return per_asset(bars, ["close"], f).withColumnRenamed("value", "vol")


def risk_report(positions: DataFrame) -> DataFrame:
    """dt, long, short, net, gross value and the largest share. positions: dt, asset, value (signed)."""
    long, short = F.sum(F.greatest("value", F.lit(0.0))), -F.sum(F.least("value", F.lit(0.0)))
    return positions.groupBy("dt").agg(
        long.alias("long"), short.alias("short"), (long - short).alias("net"), (long + short).alias("gross"),
        C.div(F.max(F.abs("value")), F.nullif(long + short, F.lit(0.0))).alias("concentration"),
    )
