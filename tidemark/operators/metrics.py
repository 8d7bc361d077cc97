"""Performance of daily returns (keys, dt, ret), risk figures, reports and information coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cols as C

YEAR = 252


def _gain(r: str) -> Column:
    """Compound return of a group; all is lost at a return of -1 or less."""
    return F.when(F.min(r) > -1, F.exp(F.sum(F.ln(F.when(F.col(r) > -1, 1 + F.col(r)).otherwise(F.lit(1.0))))) - 1).otherwise(F.lit(-1.0))


def _measures(r: str, risk_free: float) -> list[Column]:
    n, total = F.count(r), _gain(r)
    annual = F.when(total > -1, F.pow(1 + total, YEAR / n) - 1).otherwise(F.lit(-1.0))
    vol = F.stddev_samp(r) * YEAR**0.5
    below = F.stddev_samp(F.when(F.col(r) < 0, F.col(r))) * YEAR**0.5
    return [
        n.alias("n_days"),
        total.alias("total_return"),
        annual.alias("annual_return"),
        vol.alias("volatility"),
        C.div(annual - risk_free, F.nullif(vol, F.lit(0.0))).alias("sharpe"),
        C.div(annual - risk_free, F.nullif(below, F.lit(0.0))).alias("sortino"),
        F.sum((F.col(r) > 0).cast("int")).alias("win_days"),
        F.sum((F.col(r) < 0).cast("int")).alias("loss_days"),
    ]


def performance(daily: DataFrame, keys=(), risk_free: float = 0.0) -> DataFrame:
    """One row for each key: return, risk and the largest drawdown with its dates. The running maximum is per key and needs its order of days."""
    w = W.partitionBy(*keys).orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    df = daily.withColumn("_e", 1 + C.compound(F.col("ret"), w))
    df = df.withColumn("_d", C.div("_e", F.greatest(F.max("_e").over(w), F.lit(1.0))) - 1)
    df = df.withColumn("_p", F.max_by("dt", F.struct(F.round("_e", 12), -F.unix_date("dt"))).over(w))
    worst, first = -F.least(F.min("_d"), F.lit(0.0)), F.struct(F.round("_d", 12), "dt")  # of equal drawdowns the first
    out = df.groupBy(*keys).agg(*_measures("ret", risk_free), worst.alias("max_drawdown"), F.min_by("_p", first).alias("peak"), F.min_by("dt", first).alias("trough"))
    return out.withColumn("calmar", C.div("annual_return", F.nullif(F.col("max_drawdown"), F.lit(0.0))))


def drawdowns(daily: DataFrame, keys=()) -> DataFrame:
    """keys, dt, equity, peak, drawdown of each day."""
    w = W.partitionBy(*keys).orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    df = daily.withColumn("equity", 1 + C.compound(F.col("ret"), w)).withColumn("peak", F.max("equity").over(w))
    return df.select(*keys, "dt", "equity", "peak", (C.div("equity", "peak") - 1).alias("drawdown"))


def yearly(daily: DataFrame, keys=(), risk_free: float = 0.0) -> DataFrame:
    """performance of each year with two days or more, and "Total" over all, as rows of one pass; drawdowns are a period's own."""
    periods = F.array(F.year("dt").cast("string"), F.lit("Total"))
    df = performance(daily.withColumn("period", F.explode(periods)), (*keys, "period"), risk_free)
    return df.where("n_days >= 2").drop("peak", "trough")


def monthly(daily: DataFrame, keys=()) -> DataFrame:
    """keys, year, m1 .. m12: compound return of each month."""
    by = daily.groupBy(*keys, F.year("dt").alias("year"), F.month("dt").alias("month")).agg(_gain("ret").alias("g"))
    return by.groupBy(*keys, "year").agg(*(F.max(F.when(F.col("month") == m, F.col("g"))).alias(f"m{m}") for m in range(1, 13)))


def var_cvar(daily: DataFrame, keys=(), level: float = 0.95) -> DataFrame:
    """var (less the quantile of returns) and cvar (less the mean of returns at or below it); 10 days at least."""
    bounds = daily.groupBy(*keys).agg(F.percentile("ret", 1 - level).alias("_q"), F.count("ret").alias("_n")).where("_n >= 10")
    joined = daily.join(bounds, list(keys)) if keys else daily.join(F.broadcast(bounds))  # one row on the right
    return joined.groupBy(*keys).agg((-F.first("_q")).alias("var"), (-F.avg(F.when(F.col("ret") <= F.col("_q"), F.col("ret")))).alias("cvar"))


def moments(daily: DataFrame, keys=()) -> DataFrame:
    n = F.count("ret")
    skew = F.when(n > 2, F.skewness("ret") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.kurtosis("ret") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return daily.groupBy(*keys).agg(skew.alias("skew"), kurt.alias("kurtosis"))


def rolling_risk(daily: DataFrame, window: int = 60, keys=()) -> DataFrame:
    mean, sd = (f("ret", window, keys=keys) for f in (C.mean, C.std))
    return daily.select(*keys, "dt", (sd * YEAR**0.5).alias("volatility"), (C.div(mean, F.nullif(sd, F.lit(0.0))) * YEAR**0.5).alias("sharpe"))


def trade_stats(trades: DataFrame, keys=()) -> DataFrame:
    """trades: keys, pnl. profit_factor is the mean win over the mean loss."""
    win, loss = F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))), F.avg(F.when(F.col("pnl") < 0, -F.col("pnl")))
    count = F.count("pnl")
    return trades.groupBy(*keys).agg(count.alias("n_trades"), C.div(F.sum((F.col("pnl") > 0).cast("int")), count).alias("win_rate"), win.alias("avg_win"), loss.alias("avg_loss"), C.div(win, loss).alias("profit_factor"))


def position_trades(positions: DataFrame, keys=("asset",)) -> DataFrame:
    """Stretches of one non-zero position (keys, dt, position, ret): keys, entered, left, days, pnl."""
    df = positions.withColumn("_new", (F.col("position") != F.coalesce(C.lag("position", 1, keys), F.lit(0.0))).cast("int"))
    df = df.withColumn("_k", F.sum("_new").over(C.so_far(keys))).where("position <> 0")
    return df.groupBy(*keys, "_k").agg(F.min("dt").alias("entered"), F.max("dt").alias("left"), F.count(F.lit(1)).alias("days"), F.sum("ret").alias("pnl")).drop("_k")


def daily_ic(values: DataFrame, bars: DataFrame, periods=(1, 5, 10, 20), least_assets: int = 5) -> DataFrame:
    """dt, period, ic: rank correlation of values with the sum of the next `period` returns over the assets of a date."""
    r = bars.select("asset", "dt", C.change("close").alias("r"))
    ahead = lambda p: C.series().rowsBetween(1, p)
    fwd = r.select("asset", "dt", *(F.when(F.count("r").over(ahead(p)) == p, F.sum("r").over(ahead(p))).alias(f"f{p}") for p in periods))
    long = fwd.select("asset", "dt", F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.col(f"f{p}").alias("f")) for p in periods))).alias("x"))
    df = long.select("asset", "dt", "x.period", "x.f").where("f is not null").join(values.where("value is not null"), ["asset", "dt"])
    by = ("dt", "period")
    df = df.withColumn("rv", C.average_rank("value", by)).withColumn("rf", C.average_rank("f", by))
    return df.groupBy("dt", "period").agg(F.corr("rv", "rf").alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_assets).where("ic is not null and not isnan(ic)").drop("n")


def ic_summary(ics: DataFrame, least: int = 10) -> DataFrame:
    """period, n, ic_mean, ic_std, ir, t."""
    df = ics.groupBy("period").agg(F.count("ic").alias("n"), F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std")).where(F.col("n") >= least)
    ir = C.div("ic_mean", F.nullif(F.col("ic_std"), F.lit(0.0)))
    return df.withColumn("ir", ir).withColumn("t", F.col("ir") * F.sqrt("n"))
