"""Time-series factors: builders from bars to (asset, dt, value), one value for every bar.

Where the history is shorter than a factor's window the value is its neutral one. Window expressions wherever the
recurrence has a closed form; grouped pandas functions, one asset at a time, where it hasn't.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cols as C
from . import scan, slices

VALUE = "asset string, dt date, value double"


def _out(df: DataFrame, value) -> DataFrame:
    return df.select("asset", "dt", value.alias("value"))


def per_asset(bars: DataFrame, columns: list[str], f: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """f of each asset's rows in order of dt. An asset's history is the unit of a recursion, so it is one group."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("dt")
        return pd.DataFrame({"asset": part["asset"], "dt": part["dt"], "value": f(part)})

    return bars.select("asset", "dt", *columns).groupBy("asset").applyInPandas(run, VALUE)


def hurst(prices: np.ndarray) -> np.ndarray:
    """R/S exponent of each window of prices [n, window]; 0.5 where it isn't defined."""
    r = np.diff(np.log(prices), axis=1)
    n, length = r.shape
    out = np.full(n, 0.5)
    if length < 10:
        return out
    sizes = 2 ** np.arange(2, int(np.log2(length)) + 1)
    y = np.full((n, len(sizes)), np.nan)
    for k, size in enumerate(sizes):
        seg = r[:, : length // size * size].reshape(n, -1, size)
        dev = np.cumsum(seg - seg.mean(axis=2, keepdims=True), axis=2)
        s = seg.std(axis=2, ddof=1)
        ok = s > 1e-10
        ratio = np.divide(dev.max(axis=2) - dev.min(axis=2), s, out=np.zeros_like(s), where=ok).sum(axis=1)
        rs = np.divide(ratio, ok.sum(axis=1), out=np.zeros(n), where=ok.any(axis=1))
        y[rs > 0, k] = np.log(rs[rs > 0])
    has = ~np.isnan(y)
    x, y, m = np.where(has, np.log(sizes), 0), np.where(has, y, 0), has.sum(axis=1)
    den = m * (x * x).sum(axis=1) - x.sum(axis=1) ** 2
    sound = (m >= 2) & (np.abs(den) >= 1e-10)
    slope = (m * (x * y).sum(axis=1) - x.sum(axis=1) * y.sum(axis=1))[sound] / den[sound]
    out[sound] = np.clip(slope, 0, 1)
    return out


def hurst_exponent(bars: DataFrame, window: int = 100, scale: float = 2.0, return_raw: bool = False, block: int = 4096) -> DataFrame:
    """All windows of an asset together, `block` of them at a time."""

    def f(part: pd.DataFrame) -> np.ndarray:
        c = part["close"].to_numpy()
        out = np.full(len(c), 0.0)
        if len(c) >= window and (return_raw or window > 10):
            rows = np.lib.stride_tricks.sliding_window_view(c, window)
            h = np.concatenate([hurst(rows[lo : lo + block]) for lo in range(0, len(rows), block)])
            out[window - 1 :] = h if return_raw else np.clip((h - 0.5) * scale, -1, 1)
        return out

    return per_asset(bars, ["close"], f)


def emd_trend(bars: DataFrame, window: int = 60) -> DataFrame:
    """Variance of moving averages against variance around short ones, within the window."""
    n = window
    df = bars.select("asset", "dt", "close")
    noise, trend = F.lit(0.0), F.lit(0.0)
    for k in (3, 5):
        if k < n:
            df = df.withColumn(f"d{k}", F.col("close") - F.avg("close").over(C.last(k)))
            noise = noise + F.var_pop(f"d{k}").over(C.last(n - k + 1))
    for k in sorted({10, 20, n // 2}):
        if 1 < k < n:
            df = df.withColumn(f"m{k}", F.avg("close").over(C.last(k)))
            trend = trend + F.var_pop(f"m{k}").over(C.last(n - k + 1))
    df = df.withColumn("noise", noise).withColumn("trend", trend)
    both = F.col("noise") + F.col("trend")
    return _out(df, C.signal(F.when(both < 1e-10, 0.5).otherwise(C.div("trend", both)), n, neutral=0.5))


def amihud(bars: DataFrame, short: int = 2, long: int = 8, mode: str = "series", before: bool = False, block: int = scan.BLOCK) -> DataFrame:
    """Ratio of two exponentially weighted means of r / amount; over all rows so far, or with mode="slice" over window + 1."""
    history = max(5 * long, 50)
    if mode == "slice":
        return slices.amihud(bars, short, long, history + (not before), before)
    df = bars.select("asset", "dt", (C.change("close") / (F.col("amount") + 1e-10)).alias("a"))
    df = scan.ewm(df, "a", {"s": short, "l": long + 1}, block=block)
    return _out(df, C.signal(F.col("s") / (F.col("l") + 1e-10), history, lo=-5, hi=5))


def amivest(bars: DataFrame, short: int = 12, long: int = 32) -> DataFrame:
    df = bars.select("asset", "dt", "amount", F.abs(C.change("close")).alias("r"))
    side = lambda n: C.total("amount", n) / (C.total("r", n) + 1e-10)
    return _out(df, C.signal(side(short) / (side(long) + 1e-10), max(2 * long, 80), lo=-5, hi=5))


def kalman_weights(window: int, q: float, r: float) -> np.ndarray:
    """[step, price]: the innovations of a local-level filter are constant combinations of the window's prices."""
    state, p, out = np.zeros(window), 1.0, []
    state[0] = 1
    for t in range(window):
        p += q
        z = np.zeros(window)
        z[t] = 1
        out.append(z - state)
        k = p / (p + r)
        state = state + k * (z - state)
        p *= 1 - k
    return np.array(out)


def kalman_deviation(bars: DataFrame, window: int = 60, q: float = 1e-5, r: float = 1e-3, zscore_window: int = 20) -> DataFrame:
    weights = kalman_weights(window, q, r)[-zscore_window:]

    def f(part: pd.DataFrame) -> np.ndarray:
        c = part["close"].to_numpy()
        out = np.zeros(len(c))
        if len(c) >= window:
            spread = np.lib.stride_tricks.sliding_window_view(c, window) @ weights.T
            s = spread.std(axis=1)
            z = np.divide(spread[:, -1] - spread.mean(axis=1), s, out=np.zeros(len(s)), where=s >= 1e-10)
            out[window - 1 :] = np.clip(z, -5, 5)
        return out

    return per_asset(bars, ["close"], f)


def trend_weights(window: int, q: float, r: float) -> np.ndarray:
    """The velocity of a constant-velocity filter at the window's end, as weights of its prices."""
    F_, H, Q = np.array([[1.0, 1], [0, 1]]), np.array([[1.0, 0]]), np.diag([q, 0.1 * q])
    x, p = np.zeros((2, window)), np.eye(2)
    x[0, 0] = 1
    for t in range(window):
        x, p = F_ @ x, F_ @ p @ F_.T + Q
        z = np.zeros(window)
        z[t] = 1
        k = p @ H.T / (H @ p @ H.T + r)
        x, p = x + k @ (z[None] - H @ x), (np.eye(2) - k @ H) @ p
    return x[1]


def kalman_trend(bars: DataFrame, window: int = 60, q: float = 1e-4, r: float = 1e-2) -> DataFrame:
    weights = trend_weights(window, q, r)

    def f(part: pd.DataFrame) -> np.ndarray:
        c = part["close"].to_numpy()
        out = np.zeros(len(c))
        if len(c) >= window:
            rows = np.lib.stride_tricks.sliding_window_view(c, window)
            m = rows.mean(axis=1)
            out[window - 1 :] = np.clip(np.divide(rows @ weights * 100, m, out=np.zeros(len(m)), where=np.abs(m) >= 1e-10), -1, 1)
        return out

    return per_asset(bars, ["close"], f)


def duvol(bars: DataFrame, period: int = 150, demean: bool = False) -> DataFrame:
    """Log of down-day over up-day variance."""
    df = bars.select("asset", "dt", C.change("close").alias("r"))
    if demean:
        df = df.withColumn("r", F.col("r") - C.mean("r", period))
    w = C.last(period)
    side = lambda up: F.sum(F.when(up, F.col("r") ** 2).otherwise(0.0)).over(w) / (F.sum(F.when(up, 1).otherwise(0)).over(w) - 1 + 1e-10)
    df = df.withColumn("down", side(F.col("r") < 0)).withColumn("up", side(F.col("r") > 0))
    ratio = F.col("down") / (F.col("up") + 1e-10) + 1e-10
    return _out(df, C.signal(F.when(ratio > 0, F.ln(ratio)), max(period + 20, 200), lo=-5, hi=5))


def runs_test(bars: DataFrame, runs_window: int = 10, ma_window: int = 60, z_threshold: float = 1.959963984540054, digits: int | None = None) -> DataFrame:
    """Too few or too many runs of ups and downs: go with the average's direction. digits: of the average, all if None."""
    n = runs_window
    average = C.mean("close", ma_window) if digits is None else F.round(C.mean("close", ma_window), digits)
    df = bars.select("asset", "dt", F.coalesce((C.change("close") >= 0).cast("int"), F.lit(0)).alias("b"), average.alias("ma"))
    df = df.withColumn("turn", (F.col("b") != C.lag("b")).cast("int")).withColumn("rising", F.col("ma") > C.lag("ma"))
    df = df.withColumn("n1", F.sum("b").over(C.last(n))).withColumn("runs", 1 + F.coalesce(F.sum("turn").over(C.last(n - 1)), F.lit(0)))
    both = 2.0 * F.col("n1") * (n - F.col("n1"))
    z = C.div(F.col("runs") - (both / n + 1), F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1.0)), F.lit(0.0))))
    far = F.coalesce(F.abs(z) > z_threshold, F.lit(False))
    return _out(df, C.signal(F.when(far, F.when(F.coalesce("rising", F.lit(False)), 1.0).otherwise(-1.0)).otherwise(0.0), max(ma_window + 30, 100)))


def investor_behaviour(
    bars: DataFrame, mom_w: int = 1, revs_w: int = 3, revs_mean_w: int = 10, revs_thr: float = 0.8, mean_w: int = 10, std_w: int = 5,
    weight: float = 0.7, quantile_window: int = 60, use_forget: bool = False, enhance: bool = True,
) -> DataFrame:
    """Momentum, turned to reversal while volatility is low, scaled by its own mean and deviation."""
    df = bars.select("asset", "dt", C.change("close").alias("r"))
    df = df.withColumn("mom", C.mean("r", mom_w)).withColumn("vol", C.std("r", revs_w))
    df = df.withColumn("vm", C.weighted_mean("vol", revs_mean_w) if use_forget else C.mean("vol", revs_mean_w))
    df = df.withColumn("q", C.rolling(lambda c: F.percentile(c, revs_thr), "vm", quantile_window))
    df = df.withColumn("base", F.when(F.coalesce(F.col("vm") <= F.col("q"), F.lit(False)), -F.col("mom")).otherwise(F.col("mom")))
    history = max(mom_w + revs_w + revs_mean_w + quantile_window + mean_w + std_w, 150)
    if not enhance:
        return _out(df, C.signal(F.col("base"), history))
    df = df.withColumn("m", C.mean("base", mean_w)).withColumn("s", C.std("base", std_w)).withColumn("am", F.abs("m"))
    scaled = weight * C.div("m", F.nullif(C.mean("am", 20), F.lit(0.0))) + (1 - weight) * C.div("s", F.nullif(C.mean("s", 20), F.lit(0.0)))
    return _out(df, C.signal(scaled, history, lo=-3, hi=3))


def crossing_averages(bars: DataFrame, fast: int, slow: int, kind: str, block: int = scan.BLOCK) -> DataFrame:
    """asset, dt, close and both moving averages, f and s."""
    df = bars.select("asset", "dt", "close")
    if kind in ("SMA", "WMA"):
        average = (lambda n: C.mean("close", n)) if kind == "SMA" else (lambda n: C.weighted_mean("close", n))
        return df.select("asset", "dt", "close", average(fast).alias("f"), average(slow).alias("s"))
    if kind == "EMA":
        return scan.ewm(df, "close", {"f": fast, "s": slow}, adjust=False, block=block)
    if kind == "LLT":
        return scan.low_lag(df, "close", {"f": fast, "s": slow}, block=block)
    raise ValueError(f"no moving average {kind!r}")


def moving_average(c: np.ndarray, n: int, kind: str) -> np.ndarray:
    """An average along one array of prices."""
    return slices.averages(np.asarray(c, dtype=float)[None], n, kind)[0]


def _crosses(bars: DataFrame, fast: int, slow: int, kind: str, block: int) -> DataFrame:
    """cross (1, -1 or NULL), the side and price of the last one, the bar of it and whether a stop came since."""
    df = crossing_averages(bars, fast, slow, kind, block)
    df = df.withColumn("pf", C.lag("f")).withColumn("ps", C.lag("s")).withColumn("i", C.age())
    up = (F.col("f") > F.col("s")) & (F.col("pf") <= F.col("ps")) & (F.col("i") > slow)
    down = (F.col("f") < F.col("s")) & (F.col("pf") >= F.col("ps")) & (F.col("i") > slow)
    df = df.withColumn("cross", F.when(up, 1).when(down, -1))
    df = df.withColumn("stretch", F.count("cross").over(C.so_far()))
    inside = W.partitionBy("asset", "stretch").orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("side", F.first("cross").over(inside)).withColumn("ref", F.first("close").over(inside)).withColumn("since", F.first("i").over(inside))
    stop = ((F.col("side") == 1) & (F.col("close") < F.col("ref"))) | ((F.col("side") == -1) & (F.col("close") > F.col("ref")))
    return df.withColumn("stopped", F.max(stop.cast("int")).over(inside))


def ma_crossover(bars: DataFrame, fast: int = 10, slow: int = 20, kind: str = "WMA", mode: str = "series", before: bool = False, block: int = scan.BLOCK) -> DataFrame:
    """Position of the last cross of two averages, flat once the price has crossed back its reference price.

    No recursion: a cross starts a stretch, and the position is gone as soon as the stretch has seen a stop. mode="slice"
    starts afresh on the last window + 1 rows: averages of a fixed window then only forget crosses of long ago.
    """
    history = max(2 * slow, 60)
    rows = history + (not before)
    if mode == "slice" and kind not in ("SMA", "WMA"):
        return slices.crossover(bars, fast, slow, kind, rows, before)
    df = _crosses(bars, fast, slow, kind, block)
    held = (F.col("stretch") > 0) & (F.col("stopped") == 0)
    if mode == "slice":
        held = held & (F.col("i") - F.col("since") <= rows - 1 - slow)
    value = C.signal(F.when(held, F.col("side").cast("double")).otherwise(0.0), rows if mode == "slice" else history)
    return slices.shifted(_out(df, value), before and mode == "slice")


def ma_crossover_details(bars: DataFrame, fast: int = 10, slow: int = 20, kind: str = "WMA", block: int = scan.BLOCK) -> DataFrame:
    """asset, dt, close, fast_ma, slow_ma, signal, ref_price (NULL when flat) and trade_type of each bar from the first one.

    trade_type: open_long, update_long_ref (a cross while long), stop_long, the same for short, else NULL. A stop on the
    bar of a cross can't be, as the reference price is that bar's.
    """
    df = _crosses(bars, fast, slow, kind, block)
    held = F.when((F.col("stretch") > 0) & (F.col("stopped") == 0), F.col("side")).otherwise(0)
    df = df.withColumn("held", held).withColumn("was", F.coalesce(C.lag("held"), F.lit(0)))
    name = F.when(F.col("side") == 1, "long").otherwise("short")
    crossed = F.when(F.col("was") == F.col("cross"), F.concat(F.lit("update_"), name, F.lit("_ref"))).otherwise(F.concat(F.lit("open_"), name))
    stopped = F.when((F.col("held") == 0) & (F.col("was") != 0), F.concat(F.lit("stop_"), F.when(F.col("was") == 1, "long").otherwise("short")))
    return df.select(
        "asset", "dt", "close", F.col("f").alias("fast_ma"), F.col("s").alias("slow_ma"), F.col("held").cast("double").alias("signal"),
        F.when(F.col("held") != 0, F.col("ref")).alias("ref_price"), F.when(F.col("cross").isNotNull(), crossed).otherwise(stopped).alias("trade_type"),
    )


def slm_timing(bars: DataFrame, n: int = 6, min_corpus: int = 200, mode: str = "series", before: bool = False) -> DataFrame:
    """Sign of how often a rise followed the last n - 1 moves more than a fall did, over all earlier n-grams, or with
    mode="slice" over those of the last window + 1 rows."""
    if mode == "slice":
        return slices.slm(bars, n, min_corpus, max(min_corpus + n, 300) + (not before), before)
    df = bars.select("asset", "dt", F.when(F.col("close") < C.lag("close"), "1").when(C.lag("close").isNotNull(), "2").alias("sym"))
    df = df.withColumn("i", C.age()).withColumn("h", F.concat(*(C.lag("sym", k) for k in range(n - 1, 0, -1))))
    before = W.partitionBy("asset", "h").orderBy("dt").rowsBetween(W.unboundedPreceding, -1)
    lead = F.coalesce(F.sum(F.when(F.col("sym") == "2", 1).when(F.col("sym") == "1", -1)).over(before), F.lit(0))
    return _out(df, F.when((F.col("i") > min_corpus + n) & F.col("h").isNotNull(), F.signum(lead.cast("double"))).otherwise(0.0))


def batch_distances(now: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Warping distances [b, n] of patterns [b, L, F] to n others each [b, n, L, F], anchored at the ends, free at the beginnings."""
    var = now.var(axis=1) + 1e-8
    length = now.shape[1]
    then = np.ascontiguousarray(past.transpose(3, 2, 0, 1))  # patterns side by side in memory
    acc = np.sqrt(sum((now[:, :, f].T[:, None, :, None] - then[f]) ** 2 / (var[:, f, None] + 1e-8) for f in range(now.shape[2])))
    for j in range(length - 2, -1, -1):
        acc[-1, j] += acc[-1, j + 1]
    for i in range(length - 2, -1, -1):
        below = np.minimum(acc[i + 1, :-1], acc[i + 1, 1:])
        acc[i, -1] += acc[i + 1, -1]
        for j in range(length - 2, -1, -1):
            acc[i, j] += np.minimum(below[j], acc[i, j + 1])
    return np.minimum(acc[0].min(axis=0), acc[:, 0].min(axis=0))


def pattern_distances(now: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Warping distance of one pattern [L, F] to many [n, L, F]."""
    return batch_distances(now[None], past[None])[0]


def _next_shell(now: np.ndarray, then: np.ndarray, scale: np.ndarray, row: np.ndarray | None, col: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """One more row and column of the warping sums of m pairs of patterns [F, L, m], from those next to the anchored end.

    Every path from the end to a free beginning crosses each shell, so the least sum on a shell bounds the distance from below.
    """
    r = 0 if row is None else len(row)
    at = now.shape[1] - 1 - r
    cost = lambda i, j: np.sqrt(sum((now[f, i] - then[f, j]) ** 2 / scale[f] for f in range(len(now))))
    along, down = cost(slice(at, at + 1), slice(at, None)), cost(slice(at, None), slice(at, at + 1))
    if row is None:
        return along, down
    for acc, before in ((along, row), (down, col)):
        below = np.minimum(before[:-1], before[1:])
        acc[r] += before[r - 1]
        for t in range(r - 1, 0, -1):
            acc[t] += np.minimum(below[t - 1], acc[t + 1])
    along[0] += np.minimum(row[0], np.minimum(along[1], down[1]))
    down[0] = along[0]
    return along, down


class _Pairs:
    """Pairs of a bar's pattern and an earlier one, with the warping sums of the last shell and the bound that it gives."""

    def __init__(self, now: np.ndarray, then: np.ndarray, scale: np.ndarray, bar: np.ndarray, past: np.ndarray, row=None, col=None, least=None):
        self.now, self.then, self.scale, self.bar, self.past, self.row, self.col, self.least = now, then, scale, bar, past, row, col, least

    def kept(self, which: np.ndarray) -> _Pairs:
        return _Pairs(self.now, self.then, self.scale, self.bar[which], self.past[which], self.row[:, which], self.col[:, which], self.least[which])

    def grown(self, shells: int, bound: np.ndarray | None = None) -> _Pairs:
        """With this many shells; pairs whose least sum is beyond their bar's bound are dropped on the way."""
        found, tail = self, slice(self.now.shape[1] - shells, None)
        now, then, scale = (x.take(which, axis=-1) for x, which in ((self.now[:, tail], self.bar), (self.then[:, tail], self.past), (self.scale, self.bar)))
        for _ in range(0 if found.row is None else len(found.row), shells):
            row, col = _next_shell(now, then, scale, found.row, found.col)
            found = _Pairs(self.now, self.then, self.scale, found.bar, found.past, row, col, np.minimum(row.min(axis=0), col.min(axis=0)))
            far = found.least > (np.inf if bound is None else bound[found.bar])
            if np.count_nonzero(far) > len(far) // 4:
                found = found.kept(~far)
                now, then, scale = now[:, :, ~far], then[:, :, ~far], scale[:, ~far]
        return found


def nearest_patterns(now: np.ndarray, then: np.ndarray, first: np.ndarray, end: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For b bars' patterns [F, L, b] the k nearest of the earlier ones [F, L, n] from `first` to `end`: bar, which one, its
    distance (by bar, the nearest and then the earliest first), and for each bar how many were computed to their end.

    Pairs whose shells show that they are farther than the bar's k-th so far, or than its `bound`, are dropped.
    """
    b, n, length = now.shape[2], then.shape[2], now.shape[1]
    scale = now.var(axis=1) + 1e-8 + 1e-8
    early = min(EARLY, length)
    row = col = None
    for _ in range(early):  # all pairs of the batch as a matrix
        row, col = _next_shell(now[:, -early:, :, None], then[:, -early:, None, :], scale[:, :, None], row, col)
    least = np.minimum(row.min(axis=0), col.min(axis=0))
    order = np.arange(n)
    outside = (order < first[:, None]) | (order >= end[:, None])
    least[outside] = np.inf

    def grown(which: np.ndarray) -> _Pairs:
        bar, past = np.nonzero(which)
        return _Pairs(now, then, scale, bar, past, row[:, bar, past], col[:, bar, past], least[bar, past]).grown(length, bound)

    found, rest = [], ~outside
    if length > early and n > 8 * k:
        seeds = np.zeros((b, n), bool)
        np.put_along_axis(seeds, np.argpartition(least, 2 * k, axis=1)[:, : 2 * k], True, axis=1)
        found.append(grown(seeds & rest))
        best = np.full((b, n), np.inf)
        best[found[0].bar, found[0].past] = np.nan_to_num(found[0].least, nan=np.inf)
        bound = np.minimum(bound, np.partition(best, k - 1, axis=1)[:, k - 1])
        rest &= ~seeds
    found.append(grown(rest & ~(least > bound[:, None])))
    bar, past, d = (np.concatenate([getattr(f, c) for f in found]) for c in ("bar", "past", "least"))
    done = np.bincount(bar, minlength=b)
    sorted_ = np.lexsort((past, d, bar))
    sorted_ = sorted_[~np.isnan(d[sorted_])]
    starts = np.searchsorted(bar[sorted_], np.arange(b))
    sorted_ = sorted_[np.arange(len(sorted_)) - starts[bar[sorted_]] < k]
    return bar[sorted_], past[sorted_], d[sorted_], done


EARLY = 8  # shells of all pairs before any is dropped
PAIRS = 1 << 14  # of patterns that step together
NEIGHBOURS = "asset string, i int, l int, h array<int>, d array<double>, next array<double>, compared long, finished long"


def pattern_neighbours(bars: DataFrame, length: int, k: int, min_history: int, volume_ma: int, library: int | None, block: int, use_volume: bool) -> DataFrame:
    """For each bar and block l of earlier bars the k nearest patterns in it: their bars h, distances d and next returns; how
    many patterns were compared and how many of these to the end.

    A task compares `block` bars with the patterns of one block of bars. Each bar meets its own block first; the k-th distance
    found there goes with it to the earlier blocks, which only look for nearer ones.
    """
    df = bars.select("asset", "dt", "close", "volume").withColumn("i", C.age() - 1)
    df = df.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("asset"))).withColumn("v", F.coalesce(C.div("volume", C.mean("volume", volume_ma, least=1)), F.lit(1.0)))
    df = df.withColumn("next", C.div(C.lag("close", -1), "close") - 1)
    back = range(length - 1, -1, -1)
    df = df.select("asset", "dt", "i", "n", "next", F.array(*(C.div(C.lag("close", b), "close") for b in back)).alias("p"), F.array(*(C.lag("v", b) for b in back)).alias("v"))
    own = F.floor(F.col("i") / block).cast("int")
    final = F.floor((F.col("n") - 1) / block).cast("int")
    scored = (F.col("n") >= max(length + min_history, 100)) & (F.col("i") >= length + max(min_history, k))
    now = df.where(scored).withColumn("c", own).select("asset", "c", "i", "p", "v")
    past = df.where(F.col("i") >= length - 1).withColumn("l", own).select("asset", "l", "i", "n", "next", "p", "v")
    features = ("p", "v") if use_volume else ("p",)

    def rows(part: pd.DataFrame) -> np.ndarray:
        return np.stack([np.array(part[c].to_list(), dtype=float).reshape(len(part), length) for c in features], axis=2)

    def nearest(now: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(now) and len(past):
            past = past.sort_values("i")
            then, at, nxt = np.ascontiguousarray(rows(past).transpose(2, 1, 0)), past["i"].to_numpy(), past["next"].to_numpy(dtype=float)
            patterns, t, bounds = np.ascontiguousarray(rows(now).transpose(2, 1, 0)), now["i"].to_numpy(), now["bound"].to_numpy(dtype=float)
            first = np.zeros(len(t), int) if library is None else np.searchsorted(at, t - 1 - library)
            end = np.searchsorted(at, t - 1)  # patterns that end at t - 2 at the latest
            for lo in range(0, len(t), step := max(1, PAIRS // len(at))):
                part = slice(lo, lo + step)
                bound = np.where(np.isnan(bounds[part]), np.inf, bounds[part])
                bar, near, d, done = nearest_patterns(patterns[:, :, part], then, first[part], end[part], k, bound)
                cuts = np.searchsorted(bar, np.arange(len(bound) + 1))
                for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if first[lo + j] < end[lo + j]:
                        found.append((now["asset"].iloc[0], t[lo + j], past["l"].iloc[0], at[near[a:b]], d[a:b], nxt[near[a:b]], end[lo + j] - first[lo + j], done[j]))
        return pd.DataFrame(found, columns=["asset", "i", "l", "h", "d", "next", "compared", "finished"])

    keys = ("asset", "c", "l")

    def met(now: DataFrame, past: DataFrame) -> DataFrame:
        past = past.toDF(*past.columns)  # columns of its own, as both sides come from one table
        return now.groupBy(*keys).cogroup(past.groupBy(*keys)).applyInPandas(nearest, NEIGHBOURS)

    here = met(now.withColumn("l", F.col("c")).withColumn("bound", F.lit(None).cast("double")), past.withColumn("c", F.col("l")).drop("n"))
    kth = here.select("asset", "i", F.try_element_at("d", F.lit(k)).alias("bound"))
    bounded = now.where("c > 0").join(kth, ["asset", "i"], "left").withColumn("l", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    later = past.where(F.col("l") < final).withColumn("c", F.explode(F.sequence(F.col("l") + 1, final))).drop("n")
    return here.unionByName(met(bounded, later))


def price_volume_pattern(
    bars: DataFrame, length: int = 11, k: int = 5, min_history: int = 50, volume_ma: int = 50, library: int | None = None, block: int = 2048,
    use_volume: bool = True, mode: str = "series", before: bool = False,
) -> DataFrame:
    """Sign of the weighted mean return after the k nearest of all earlier patterns of an asset, or of its last `library` ones.

    Patterns are of prices and volumes, or of prices alone. mode="slice" knows only the last window + 1 rows.
    """
    if mode == "slice":
        return slices.pattern(bars, length, k, volume_ma, use_volume, max(length + min_history, 100) + (not before), before)
    found = pattern_neighbours(bars, length, k, min_history, volume_ma, library, block, use_volume)
    near = found.select("asset", "i", F.inline(F.arrays_zip("h", "d", "next")))
    near = near.withColumn("place", F.row_number().over(W.partitionBy("asset", "i").orderBy("d", "h"))).where((F.col("place") <= k) & (F.col("d") > 0))
    lead = near.groupBy("asset", "i").agg(F.signum(F.sum(F.col("next") / F.col("d"))).alias("value"))
    df = bars.select("asset", "dt", (C.age() - 1).alias("i"))
    return df.join(lead, ["asset", "i"], "left").select("asset", "dt", F.coalesce("value", F.lit(0.0)).alias("value"))


def pattern_pruning(bars: DataFrame, length: int = 11, k: int = 5, min_history: int = 50, volume_ma: int = 50, block: int = 2048, use_volume: bool = True) -> DataFrame:
    """asset, compared, finished, share: how many distances of the search were computed to their end."""
    found = pattern_neighbours(bars, length, k, min_history, volume_ma, None, block, use_volume).groupBy("asset")
    sums = found.agg(F.sum("compared").alias("compared"), F.sum("finished").alias("finished"))
    return sums.withColumn("share", C.div("finished", "compared"))


def vcrr_series(bars: DataFrame, lookback: int = 20, use_amount: bool = True) -> DataFrame:
    vwap = F.col("amount") / (F.col("volume") + 1e-10) if use_amount else (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    df = bars.select("asset", "dt", (vwap - F.col("close")).alias("d"))
    z = (F.col("d") - C.mean("d", lookback)) / (C.std("d", lookback) + 1e-10)
    return _out(df, C.signal(C.clip(z, -3, 3) / 3, max(lookback + 10, 40)))


FACTORS: dict[str, Callable[..., DataFrame]] = {
    "HurstExponent": hurst_exponent,
    "EMDTrend": emd_trend,
    "AMIHUDFactor": amihud,
    "AmivestFactor": amivest,
    "KalmanFilterDeviation": kalman_deviation,
    "KalmanTrendFollower": kalman_trend,
    "DUVOLFactor": duvol,
    "RunsTestFactor": runs_test,
    "InvestorBehaviorTrendFactor": investor_behaviour,
    "InvestorBehaviorMomentum": investor_behaviour,
    "InvestorBehaviorReversal": partial(investor_behaviour, mom_w=60, revs_w=10, mean_w=5, std_w=5, weight=0.2, use_forget=True),
    "MACrossoverInnovationFactor": ma_crossover,
    "SLMTimingFactor": slm_timing,
    "PriceVolumePatternFactor": price_volume_pattern,
    "VCRRTimeSeriesFactor": vcrr_series,
}
