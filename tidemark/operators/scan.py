"""Recursions as scans of affine maps: s[t] = M[t] s[t-1] + v[t].

Composing such maps is associative, so a history is cut into blocks of rows. Every block is composed to one map (a group of
at most `block` rows), a prefix scan over an asset's few block maps gives the state at which each block starts, and the
blocks are replayed from there. Inside a block numpy does the same once more: sub-blocks side by side, composed step by step.

Diagonal maps hold their diagonal: M is [n, d] instead of [n, d, d].
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cols as C

BLOCK = 16384

Maps = tuple[np.ndarray, np.ndarray]


def _times(m: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Maps times states, or times maps, row by row."""
    if m.ndim == 2:
        return m * s if s.ndim == 2 else m[..., None] * s
    return np.einsum("nij,nj->ni" if s.ndim == 2 else "nij,njk->nik", m, s)


def _sides(m: np.ndarray, v: np.ndarray) -> Maps:
    """The maps in sub-blocks [blocks, steps, ...], filled up with identities."""
    n, d = v.shape
    steps = max(2, int(n**0.5))
    blocks = -(-n // steps)
    identity = np.ones(d) if m.ndim == 2 else np.eye(d)
    m = np.concatenate((m, np.broadcast_to(identity, (blocks * steps - n, *m.shape[1:]))))
    v = np.concatenate((v, np.zeros((blocks * steps - n, d))))
    return m.reshape(blocks, steps, *m.shape[1:]), v.reshape(blocks, steps, d)


def _composed(m: np.ndarray, v: np.ndarray) -> Maps:
    """One map for each sub-block."""
    p, q = m[:, 0], v[:, 0]
    for t in range(1, m.shape[1]):
        p, q = _times(m[:, t], p), _times(m[:, t], q) + v[:, t]
    return p, q


def composed(m: np.ndarray, v: np.ndarray) -> Maps:
    """All maps, the first one first, as one."""
    while len(v) > 1:
        m, v = _composed(*_sides(m, v))
    return m[0], v[0]


def states(m: np.ndarray, v: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The state after each map."""
    n = len(v)
    if n < 16:
        out = np.empty_like(v)
        for t in range(n):
            start = out[t] = _times(m[t : t + 1], start[None])[0] + v[t]
        return out
    m, v = _sides(m, v)
    p, q = _composed(m, v)
    s = np.concatenate((start[None], states(p[:-1], q[:-1], start)))
    out = np.empty_like(v)
    for t in range(v.shape[1]):
        s = out[:, t] = _times(m[:, t], s) + v[:, t]
    return out.reshape(-1, v.shape[2])[:n]


def scanned(df: DataFrame, maps: Callable[[pd.DataFrame], Maps], results: Callable[[np.ndarray, pd.DataFrame], dict[str, np.ndarray]], names: list[str], block: int = BLOCK) -> DataFrame:
    """`df` (asset, dt, any others) with a double column for each of `names`.

    `maps` gives the maps of some rows in order of dt, from their columns and i, the row's number in its asset from 0;
    `results` gives the new columns from the states after the rows, and the rows. A NaN becomes NULL.
    """
    dealt = df.withColumn("i", C.age() - 1).withColumn("block", F.floor(F.col("i") / block))

    def compose(part: pd.DataFrame) -> pd.DataFrame:
        m, v = composed(*maps(part.sort_values("i")))
        return pd.DataFrame({"asset": part["asset"].iloc[:1], "block": part["block"].iloc[:1], "m": [m.ravel()], "v": [v]})

    def prefix(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        v = np.stack(part["v"].to_list())
        m, d = np.stack(part["m"].to_list()), v.shape[1]
        after = states(m if m.shape[1] == d and d > 1 or d == 1 else m.reshape(-1, d, d), v, np.zeros(d))
        return part[["asset", "block"]].assign(start=list(np.concatenate((np.zeros((1, d)), after[:-1]))))

    kept, schema = df.columns, df.schema
    for n in names:
        schema = schema.add(n, "double")

    def replay(part: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        found = results(states(*maps(part), np.asarray(starts["start"].iloc[0], dtype=float)), part)
        found = {n: pd.Series(x, dtype=object).where(~np.isnan(x), None).to_numpy() for n, x in found.items()}
        return part[kept].assign(**found)

    blocks = dealt.groupBy("asset", "block").applyInPandas(compose, "asset string, block long, m array<double>, v array<double>")
    starts = blocks.groupBy("asset").applyInPandas(prefix, "asset string, block long, start array<double>")
    return dealt.groupBy("asset", "block").cogroup(starts.groupBy("asset", "block")).applyInPandas(replay, schema)


def ewm(df: DataFrame, column: str, spans: dict[str, float], adjust: bool = True, block: int = BLOCK) -> DataFrame:
    """`df` (asset, dt, `column`) with an exponentially weighted mean for each name and span; it stays where a value is missing.

    adjust=True divides a decaying sum of values by one of weights. adjust=False moves the mean towards a value by
    alpha / (alpha + decay^gap), where gap counts the rows since the value before; the first value is the first mean.
    """
    keeps = np.array([1 - 2 / (n + 1) for n in spans.values()])
    at = F.when(F.col(column).isNotNull(), C.age())
    if not adjust:
        df = df.withColumn("_at", at).withColumn("_gap", F.col("_at") - F.last("_at", ignorenulls=True).over(C.so_far().rowsBetween(C.W.unboundedPreceding, -1)))

    def maps(part: pd.DataFrame) -> Maps:
        x = part[column].to_numpy(dtype=float)[:, None]
        has = ~np.isnan(x)
        if adjust:
            v = np.stack((np.where(has, x, 0), has.astype(float)), axis=2).repeat(len(keeps), axis=1).reshape(len(x), -1)
            return np.broadcast_to(keeps.repeat(2), v.shape), v
        gap = part["_gap"].to_numpy(dtype=float)[:, None]
        old = np.where(np.isnan(gap), 0.0, keeps ** np.nan_to_num(gap))
        share = np.where(np.isnan(gap), 1.0, (1 - keeps) / (1 - keeps + old))
        return np.where(has, 1 - share, 1.0), np.where(has, share * np.nan_to_num(x), 0.0)

    def results(s: np.ndarray, part: pd.DataFrame) -> dict[str, np.ndarray]:
        if adjust:
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(s[:, 1::2] > 0, s[:, ::2] / s[:, 1::2], np.nan)
        else:
            s = np.where(part["_any"].to_numpy(dtype=bool)[:, None], s, np.nan)
        return dict(zip(spans, s.T, strict=True))

    df = df.withColumn("_any", F.count(column).over(C.so_far()) > 0)
    return scanned(df, maps, results, list(spans), block).drop("_any", "_at", "_gap")


def low_lag(df: DataFrame, column: str, spans: dict[str, int], block: int = BLOCK) -> DataFrame:
    """`df` with a low-lag trend line for each name and span; a missing value counts as the one before it."""
    filled = df.withColumn("_x", F.last(column, ignorenulls=True).over(C.so_far()))
    filled = filled.withColumn("_x1", C.lag("_x", 1)).withColumn("_x2", C.lag("_x", 2))
    alphas = [2 / (n + 1) for n in spans.values()]

    def maps(part: pd.DataFrame) -> Maps:
        x, x1, x2 = (part[c].to_numpy(dtype=float) for c in ("_x", "_x1", "_x2"))
        n, d = len(x), 2 * len(alphas)
        m, v = np.zeros((n, d, d)), np.zeros((n, d))
        early = np.isnan(x2)
        for k, a in enumerate(alphas):
            m[:, 2 * k, 2 * k], m[:, 2 * k, 2 * k + 1] = np.where(early, 0, 2 * (1 - a)), np.where(early, 0, -((1 - a) ** 2))
            m[:, 2 * k + 1, 2 * k] = 1.0
            v[:, 2 * k] = np.where(early, np.nan_to_num(x), (a - a * a / 4) * x + a * a / 2 * x1 - (a - 3 * a * a / 4) * x2)
        return m, v

    def results(s: np.ndarray, part: pd.DataFrame) -> dict[str, np.ndarray]:
        return dict(zip(spans, s[:, ::2].T, strict=True))

    return scanned(filled, maps, results, list(spans), block).drop("_x", "_x1", "_x2")


def level_gains(n: int, q: float, r: float) -> np.ndarray:
    """Gains of a local-level filter at rows 0 to n - 1; they no longer change after some hundreds of rows."""
    out, p = [1.0], (1 - (1 + q) / (1 + q + r)) * (1 + q)
    while len(out) < n:
        k = (p + q) / (p + q + r)
        out.append(k)
        if k == out[-2]:
            break
        p = (1 - k) * (p + q)
    return np.array(out)


def filtered_level(df: DataFrame, column: str = "close", q: float = 1e-5, r: float = 1e-3, block: int = BLOCK) -> DataFrame:
    """`df` with `filtered`, the level a Kalman filter holds after each row of an asset, and `deviation`, the value less the level before.

    The first value is the first level. A missing value leaves the level as it is and has no deviation; the filter starts
    at the first known one. The gain depends on the count of values alone, so the level is a scan of affine maps.
    """
    seen = df.withColumn("_seen", F.count(column).over(C.so_far()))

    def maps(part: pd.DataFrame) -> Maps:
        x, at = part[column].to_numpy(dtype=float), part["_seen"].to_numpy(dtype=np.int64) - 1
        gains = level_gains(int(at.max()) + 1, q, r)
        k = np.where(np.isnan(x), 0.0, gains[np.clip(at, 0, len(gains) - 1)])
        return (1 - k)[:, None], (k * np.nan_to_num(x))[:, None]

    def results(s: np.ndarray, part: pd.DataFrame) -> dict[str, np.ndarray]:
        return {"filtered": np.where(part["_seen"].to_numpy() > 0, s[:, 0], np.nan)}

    found = scanned(seen, maps, results, ["filtered"], block)
    before = F.when(F.col("_seen") > 1, C.lag("filtered", 1)).when(F.col("_seen") == 1, F.col(column))
    return found.withColumn("deviation", F.col(column) - before).drop("_seen")
