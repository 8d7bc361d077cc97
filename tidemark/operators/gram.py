"""Work on all pairs of a universe in blocks of assets: a task has two blocks as matrices of dates and assets.

Rows that are shuffled grow with assets x dates x blocks. What a task gives out is reduced inside it, to a row for each pair
(statistics), for each asset and date (best partners) or for each date (quadratic forms), never to a row for a pair and date.
Assets are counted when a function here is called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def block_of(asset: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(asset), F.lit(blocks)).cast("int")


def blocks_of(rows: DataFrame, block: int) -> int:
    return -(-rows.select("asset").distinct().count() // block) or 1


def dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """Each row for all pairs of blocks i <= j that its asset's block b is part of."""
    rows = rows.withColumn("b", block_of("asset", blocks))
    both = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return both.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("o")


def _pairs(part: pd.DataFrame) -> Iterator[tuple[str, str]]:
    """Pairs a < b of an asset of block i and one of block j, ordered by both names."""
    i, j = part["i"].iloc[0], part["j"].iloc[0]
    of = part.drop_duplicates("asset").set_index("asset")["b"].sort_index()
    for a in of.index:
        for b in of.index:
            if a < b and (i == j or of[a] != of[b]):
                yield a, b


def _columns(part: pd.DataFrame, value: str) -> tuple[pd.Index, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The dates, and for each asset its values on them and whether it has a row there."""
    table = part.assign(_row=1.0).pivot(index="dt", columns="asset", values=[value, "_row"])
    values = {a: table[value][a].to_numpy(dtype=float) for a in table[value].columns}
    return table.index, values, {a: ~np.isnan(table["_row"][a].to_numpy(dtype=float)) for a in values}


def rolling_corr(x: np.ndarray, y: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Correlation and number of the pairs without NaN among the last `window` rows; NaN where one side doesn't vary."""
    has = ~(np.isnan(x) | np.isnan(y))
    if not has.any():
        return np.full(len(x), np.nan), np.zeros(len(x))
    x, y = (np.where(has, v - v[has].mean(), 0.0) for v in (x, y))

    def over(v: np.ndarray) -> np.ndarray:
        s = np.concatenate(([0.0], np.cumsum(v)))
        return s[1:] - s[np.maximum(np.arange(len(v)) + 1 - window, 0)]

    n = over(has.astype(float))
    known = np.flatnonzero(has)
    varies = []
    for v in (x, y):  # a change from the last known value, at a row whose last known value lies in the window too
        last = np.full(len(v), -1)
        last[known[1:]] = known[:-1]
        moved = np.zeros(len(v))
        moved[known[1:]] = v[known[1:]] != v[known[:-1]]
        latest = np.maximum.accumulate(np.where(moved > 0, last, -1))
        varies.append(latest > np.arange(len(v)) - window)
    with np.errstate(divide="ignore", invalid="ignore"):
        mx, my = over(x) / n, over(y) / n
        cov, vx, vy = over(x * y) / n - mx * my, over(x * x) / n - mx * mx, over(y * y) / n - my * my
        corr = cov / np.sqrt(np.maximum(vx, 0) * np.maximum(vy, 0))
    return np.where(varies[0] & varies[1] & np.isfinite(corr), corr, np.nan), n


def best_partners(rows: DataFrame, window: int, least: int, least_corr: float, block: int = BLOCK) -> DataFrame:
    """asset, dt, partner, corr: the partner of the highest correlation above `least_corr` over the last `window` dates that
    both have, `least` of them with both values; the first by name among equals. rows: asset, dt, r."""
    blocks = blocks_of(rows, block)

    def best(part: pd.DataFrame) -> pd.DataFrame:
        dates, values, has = _columns(part, "r")
        top = {a: np.full(len(dates), -np.inf) for a in values}
        partner = {a: np.empty(len(dates), dtype=object) for a in values}
        for a, b in _pairs(part):
            both = np.flatnonzero(has[a] & has[b])
            corr, n = rolling_corr(values[a][both], values[b][both], window)
            good = (n >= least) & (np.nan_to_num(corr, nan=-2.0) > least_corr)
            for one, other in ((a, b), (b, a)):
                better = both[good & (np.nan_to_num(corr, nan=-2.0) > top[one][both])]
                top[one][better] = corr[np.searchsorted(both, better)]
                partner[one][better] = other
        found = [pd.DataFrame({"asset": a, "dt": dates[k], "partner": partner[a][k], "corr": top[a][k]}) for a in values for k in [np.flatnonzero(top[a] > -np.inf)] if len(k)]
        return pd.concat(found) if found else pd.DataFrame(columns=["asset", "dt", "partner", "corr"])

    found = dealt(rows.select("asset", "dt", "r"), blocks).groupBy("i", "j").applyInPandas(best, "asset string, dt date, partner string, corr double")
    near = found.groupBy("asset", "dt").agg(F.min(F.struct((-F.col("corr")).alias("far"), "partner")).alias("best"))
    return near.select("asset", "dt", "best.partner", (-F.col("best.far")).alias("corr"))


def last_common(chosen: DataFrame, rows: DataFrame, value: str, n: int, block: int = BLOCK) -> DataFrame:
    """`chosen` (asset, dt, partner) with x and y, the values of both on the last n dates up to dt that both have."""
    blocks = blocks_of(rows, block)
    own, other = block_of("asset", blocks), block_of("partner", blocks)
    asked = chosen.select("asset", "dt", "partner").withColumns({"i": F.least(own, other), "j": F.greatest(own, other)})

    def fetch(asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(part):
            dates, values, has = _columns(part, value)
            for (a, b), mine in asked.groupby(["asset", "partner"]):
                both = np.flatnonzero(has[a] & has[b])
                x, y = values[a][both], values[b][both]
                ends = np.searchsorted(both, dates.get_indexer(mine["dt"]), side="right")
                out += [(a, dt, b, x[max(0, e - n) : e], y[max(0, e - n) : e]) for dt, e in zip(mine["dt"], ends.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["asset", "dt", "partner", "x", "y"])

    spread = dealt(rows.select("asset", "dt", value), blocks)
    return asked.groupBy("i", "j").cogroup(spread.groupBy("i", "j")).applyInPandas(fetch, "asset string, dt date, partner string, x array<double>, y array<double>")


def pair_statistic(rows: DataFrame, value: str, f: Callable[[np.ndarray, np.ndarray], float], name: str, within: str, block: int = BLOCK) -> DataFrame:
    """`within`, a1 < a2 and f of both values on the dates that both have, for pairs of the same `within`; NaN becomes NULL."""
    blocks = blocks_of(rows, block)

    def each(part: pd.DataFrame) -> pd.DataFrame:
        _, values, has = _columns(part, value)
        out = []
        for a, b in _pairs(part):
            both = has[a] & has[b]
            if both.any():
                s = f(values[a][both], values[b][both])
                out.append((part["g"].iloc[0], a, b, None if np.isnan(s) else s))
        return pd.DataFrame(out, columns=["g", "a1", "a2", name]).astype({name: object})

    spread = dealt(rows.select(F.col(within).alias("g"), "asset", "dt", value), blocks)
    return spread.groupBy("g", "i", "j").applyInPandas(each, f"g string, a1 string, a2 string, {name} double").withColumnRenamed("g", within)


def quadratic_form(weights: DataFrame, matrix: DataFrame, value: str, block: int = BLOCK) -> DataFrame:
    """dt and the sum over a1, a2 of weight(a1) * value(a1, a2) * weight(a2), on dates that have weights of some known pair.

    weights: asset, dt, weight; matrix: a1, a2, `value`, both orders and the diagonal as far as known.
    """
    blocks = blocks_of(weights, block)
    first, second = block_of("a1", blocks), block_of("a2", blocks)
    entries = matrix.where(F.col(value).isNotNull()).select("a1", "a2", F.col(value).alias("v")).withColumns({"i": F.least(first, second), "j": F.greatest(first, second)})

    def product(part: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(entries):
            return pd.DataFrame(columns=["dt", "part"], dtype=object)
        w = part.pivot(index="dt", columns="asset", values="weight")
        known = entries.pivot(index="a1", columns="a2", values="v").reindex(index=w.columns, columns=w.columns)
        m, has, held = known.fillna(0).to_numpy(dtype=float), w.notna().to_numpy(), w.fillna(0).to_numpy(dtype=float)
        some = ((has.astype(float) @ known.notna().to_numpy(dtype=float)) * has).sum(axis=1) > 0
        return pd.DataFrame({"dt": w.index[some], "part": ((held @ m) * held).sum(axis=1)[some]})

    spread = dealt(weights.select("asset", "dt", "weight"), blocks)
    parts = spread.groupBy("i", "j").cogroup(entries.groupBy("i", "j")).applyInPandas(product, "dt date, part double")
    return parts.groupBy("dt").agg(F.sum("part").alias("form"))
