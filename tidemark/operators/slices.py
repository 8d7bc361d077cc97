"""Factors of unbounded memory evaluated on slices: every bar sees only the last rows, on which the recursion starts afresh.

The value of bar i comes from the `rows` bars up to it (or, with `before`, up to the bar before it), and is 0 where there
are fewer. Where the restart only cuts memory off, it is a window frame. Where state runs through the slice, all slices of
a block of bars step together in numpy; a block also gets the rows - 1 bars before it, so no group holds a whole history.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cols as C

BLOCK = 4096
BATCH = 256


def shifted(df: DataFrame, before: bool) -> DataFrame:
    """Values of the bar before."""
    return df.withColumn("value", F.coalesce(C.lag("value"), F.lit(0.0))) if before else df


def per_slice(bars: DataFrame, columns: list[str], rows: int, f: Callable[[np.ndarray], np.ndarray], before: bool = False, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """asset, dt, value: f of slices [n, rows, columns] gives their n values; NaN becomes 0."""
    numbered = bars.select("asset", "dt", *columns).withColumn("i", (C.age() - 1).cast("long"))
    blocks = F.sequence(F.floor(F.col("i") / block), F.floor((F.col("i") + rows - 1) / block))
    dealt = numbered.withColumn("block", F.explode(blocks))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        x = part[columns].to_numpy(dtype=float)
        own = (part["i"] // block == part["block"]).to_numpy()
        out = np.zeros(len(x))
        if len(x) >= rows:
            slices = np.lib.stride_tricks.sliding_window_view(x, rows, axis=0).transpose(0, 2, 1)
            last = np.arange(rows - 1, len(x))
            for lo in range(0, len(slices), batch):
                out[last[lo : lo + batch]] = np.nan_to_num(f(slices[lo : lo + batch]), nan=0.0)
        return pd.DataFrame({"asset": part["asset"][own], "dt": part["dt"][own], "value": out[own]})

    return shifted(dealt.groupBy("asset", "block").applyInPandas(run, "asset string, dt date, value double"), before)


def amihud(bars: DataFrame, short: int, long: int, rows: int, before: bool = False) -> DataFrame:
    """The restarted means weigh the slice's rows - 1 returns, so they are products with two constant vectors."""
    ages = np.arange(rows - 2, -1, -1.0)
    weights = [(1 - 2 / (n + 1)) ** ages for n in (short, long + 1)]

    def f(x: np.ndarray) -> np.ndarray:
        close, amount = x[:, :, 0], x[:, :, 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            a = (close[:, 1:] / close[:, :-1] - 1) / (amount[:, 1:] + 1e-10)
            has = ~np.isnan(a)
            fast, slow = ((np.where(has, a, 0) @ w) / (has @ w) for w in weights)
            ratio = fast / (slow + 1e-10)
        return np.where(np.isfinite(ratio), np.clip(ratio, -5, 5), 0.0)

    return per_slice(bars, ["close", "amount"], rows, f, before)


def averages(c: np.ndarray, n: int, kind: str) -> np.ndarray:
    """Moving averages along slices [slices, rows], each started at its slice's first row."""
    out = np.full(c.shape, np.nan)
    a = 2 / (n + 1)
    if kind in ("SMA", "WMA"):
        weights = np.ones(n) if kind == "SMA" else np.arange(1.0, n + 1)
        out[:, n - 1 :] = np.lib.stride_tricks.sliding_window_view(c, n, axis=1) @ (weights / weights.sum())
        return out
    out[:, 0] = c[:, 0]
    for t in range(1, c.shape[1]):
        if kind == "EMA":
            out[:, t] = (1 - a) * out[:, t - 1] + a * c[:, t]
        elif t == 1:
            out[:, t] = c[:, t]
        else:
            out[:, t] = (a - a * a / 4) * c[:, t] + a * a / 2 * c[:, t - 1] - (a - 3 * a * a / 4) * c[:, t - 2] + 2 * (1 - a) * out[:, t - 1] - (1 - a) ** 2 * out[:, t - 2]
    return out


def crossover(bars: DataFrame, fast: int, slow: int, kind: str, rows: int, before: bool = False) -> DataFrame:
    """All slices of a batch hold their position and reference price and step together."""

    def f(x: np.ndarray) -> np.ndarray:
        c = x[:, :, 0]
        quick, calm = averages(c, fast, kind), averages(c, slow, kind)
        above, below = quick > calm, quick < calm
        position, reference = np.zeros(len(c)), np.zeros(len(c))
        for t in range(slow, rows):
            cross = (above[:, t] & (quick[:, t - 1] <= calm[:, t - 1])).astype(float) - (below[:, t] & (quick[:, t - 1] >= calm[:, t - 1]))
            position = np.where(cross != 0, cross, position)
            reference = np.where(cross != 0, c[:, t], reference)
            position = np.where((c[:, t] - reference) * position < 0, 0.0, position)
        return position

    return per_slice(bars, ["close"], rows, f, before)


def slm(bars: DataFrame, n: int, min_corpus: int, rows: int, before: bool = False) -> DataFrame:
    """n-grams wholly inside the slice and before its last bar: a frame over the bars that end one, so nothing restarts."""
    df = bars.select("asset", "dt", F.when(F.col("close") < C.lag("close"), "1").when(C.lag("close").isNotNull(), "2").alias("sym"))
    df = df.withColumn("i", C.age()).withColumn("h", F.concat(*(C.lag("sym", k) for k in range(n - 1, 0, -1))))
    inside = C.W.partitionBy("asset", "h").orderBy("i").rangeBetween(-(rows - 1 - n), -1)
    lead = F.coalesce(F.sum(F.when(F.col("sym") == "2", 1).when(F.col("sym") == "1", -1)).over(inside), F.lit(0))
    enough = (F.col("i") >= rows) & F.col("h").isNotNull() & F.lit(rows - 2 >= min_corpus and rows >= min_corpus + n)
    return shifted(df.select("asset", "dt", F.when(enough, F.signum(lead.cast("double"))).otherwise(0.0).alias("value")), before)


def pattern(bars: DataFrame, length: int, k: int, volume_ma: int, use_volume: bool, rows: int, before: bool = False) -> DataFrame:
    """The last pattern of a slice against all of its earlier ones; the volume's mean starts at the slice's first row."""
    from .timeseries import batch_distances

    n = np.minimum(np.arange(1, rows + 1), volume_ma)

    def f(x: np.ndarray) -> np.ndarray:
        c, v = x[:, :, 0], x[:, :, 1]
        total = np.cumsum(v, axis=1)
        held = total - np.concatenate((np.zeros((len(v), min(volume_ma, rows))), total[:, :-volume_ma]), axis=1)[:, :rows]
        with np.errstate(divide="ignore", invalid="ignore"):
            volume = np.where(held > 0, v * n / held, 1.0)
            at = np.lib.stride_tricks.sliding_window_view(c, length, axis=1)
            shape = [at / at[:, :, -1:]]
            if use_volume:
                shape.append(np.lib.stride_tricks.sliding_window_view(volume, length, axis=1))
            shape = np.stack(shape, axis=3)  # [slices, patterns, length, features]
            after = c[:, length:] / c[:, length - 1 : -1] - 1
        d = batch_distances(shape[:, -1], shape[:, :-2])  # the last ends two bars before the slice's end
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        d, after = (np.take_along_axis(a, near, axis=1) for a in (d, after[:, : d.shape[1]]))
        weight = np.divide(1.0, d, out=np.zeros(d.shape), where=d > 0)
        return np.sign((weight * np.where(weight > 0, after, 0)).sum(axis=1))

    return per_slice(bars, ["close", "volume"], rows, f, before, batch=32)
