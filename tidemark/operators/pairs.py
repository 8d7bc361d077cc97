"""Pair factors on pair_bars (a1, a2, dt, c1, c2, r1, r2): correlation, selection, and signals of one leg against the other."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cols as C
from . import gram
from .joins import tails

PAIR = ("a1", "a2")


def _out(df: DataFrame, value: Column) -> DataFrame:
    return df.select("a1", "a2", "dt", value.alias("value"))


def joint_moments(bars: DataFrame, within: str | None = None, diagonal: bool = False, block: int = 64) -> DataFrame:
    """within (if any), a1, a2, n, corr and cov (sample) of daily returns over common dates, for a1 < a2 of the same `within`.

    Assets are dealt into blocks. A task has the returns of two blocks as matrices of dates and assets, whose products over
    the dates that both know are all sums the moments need, so rows shuffled grow with assets x dates x blocks, not pairs.
    """
    group = F.col(within) if within else F.lit("")
    r = bars.select(group.alias("g"), "asset", "dt", C.change("close").alias("r"))
    found = moments_by(r, "dt", block).where(F.col("a1") <= F.col("a2") if diagonal else F.col("a1") < F.col("a2"))
    return found.withColumnRenamed("g", within) if within else found.drop("g")


def moments_by(r: DataFrame, place: str, block: int = 64) -> DataFrame:
    """g, a1, a2, n, corr and cov (sample) over the places that both assets of a group g have, for a1 <= a2.

    r: g, asset, `place`, r. The assets are counted when this is called.
    """
    r = r.where("r is not null").withColumnRenamed(place, "dt")
    blocks = -(-r.select("asset").distinct().count() // block) or 1
    dealt = r.withColumn("b", F.pmod(F.xxhash64("asset"), F.lit(blocks)).cast("int"))
    both = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")})

    def products(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        x = part.pivot(index="dt", columns="asset", values="r")
        of = part.drop_duplicates("asset").set_index("asset")["b"]
        first, second = (x[[a for a in x.columns if of[a] == k]] for k in (i, j))
        has = [(~m.isna()).to_numpy(float) for m in (first, second)]
        own = [(m - m.mean()).fillna(0).to_numpy() for m in (first, second)]
        n, sx, sy = has[0].T @ has[1], own[0].T @ has[1], has[0].T @ own[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = own[0].T @ own[1] - sx * sy / n
            vx, vy = (own[0] ** 2).T @ has[1] - sx * sx / n, has[0].T @ own[1] ** 2 - sy * sy / n
            corr, cov = cov / np.sqrt(np.maximum(vx * vy, 0)), cov / (n - 1)
        a, b = (np.array(m.columns, dtype=object) for m in (first, second))
        rows, cols = np.nonzero(n > 0)
        swap = a[rows] > b[cols]
        out = pd.DataFrame({"g": part["g"].iloc[0], "a1": np.where(swap, b[cols], a[rows]), "a2": np.where(swap, a[rows], b[cols]), "n": n[rows, cols].astype(int), "corr": corr[rows, cols], "cov": cov[rows, cols]})
        if i == j:
            out = out[~swap]
        out[["corr", "cov"]] = out[["corr", "cov"]].replace([np.inf, -np.inf], np.nan)
        return out.astype(object).where(out.notna(), None)

    return both.groupBy("g", "i", "j").applyInPandas(products, "g string, a1 string, a2 string, n long, corr double, cov double")


def tail_correlations(bars: DataFrame, as_of_dates: DataFrame, window: int = 60, least: int = 20) -> DataFrame:
    """sector, as_of, a1 < a2, n, corr of both assets' last returns up to a date, the last with the last whatever their dates."""
    r = bars.select("asset", "dt", C.change("close").alias("r"))
    sectors = bars.select("asset", "sector").distinct()
    dealt = tails(r, as_of_dates, window).join(sectors, "asset")
    key = F.to_json(F.struct("sector", F.col("as_of").cast("string").alias("as_of")))
    found = moments_by(dealt.select(key.alias("g"), "asset", "place", "r"), "place").where((F.col("a1") < F.col("a2")) & (F.col("n") >= least))
    of = F.from_json("g", "sector string, as_of date")
    return found.select(of["sector"].alias("sector"), of["as_of"].alias("as_of"), "a1", "a2", "n", "corr")


def correlations(bars: DataFrame, least: int = 20, within: str | None = None) -> DataFrame:
    """a1 < a2, corr of daily returns and n, for pairs (of the same `within`, which is then a column) with `least` common dates."""
    return joint_moments(bars, within).drop("cov").where(F.col("n") >= least)


def mirrored(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("a2").alias("a1"), F.col("a1").alias("a2"), *(c for c in pairs.columns if c not in PAIR)))


def best_partner(corr: DataFrame, least: float = 0.3) -> DataFrame:
    """Per asset the partner of the highest correlation above `least`, the first by name among equals."""
    place = F.row_number().over(W.partitionBy("a1").orderBy(F.col("corr").desc(), "a2"))
    return mirrored(corr).where(F.col("corr") > least).withColumn("k", place).where("k = 1").drop("k")


def autocorrelation(x: np.ndarray, y: np.ndarray) -> float:
    """Of the log ratio of two prices with itself one row before; NaN where it doesn't vary."""
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.log(x / y)
        now, before = z[1:], z[:-1]
        sound = ~(np.isnan(now) | np.isnan(before))
        now, before = now[sound], before[sound]
        return float(np.corrcoef(now, before)[0, 1]) if len(now) > 1 and np.ptp(now) > 0 and np.ptp(before) > 0 else np.nan


def select_pairs(bars: DataFrame, method: str = "composite", least: float = 0.0, top: int = 1) -> DataFrame:
    """sector, a1, a2, score: the `top` pairs of each sector by correlation, or by it and the spread's mean reversion.

    composite: correlation less the lag-one autocorrelation of the log price ratio; cointegration: its negative alone.
    """
    inside = correlations(bars, within="sector")
    if method != "correlation_only":
        inside = inside.join(gram.pair_statistic(bars, "close", autocorrelation, "rho", "sector").drop("sector"), ["a1", "a2"])
        score = F.col("corr") - F.col("rho") if method == "composite" else -F.col("rho")
    else:
        score = F.col("corr")
    ranked = inside.withColumn("score", score).where(F.col("corr") >= least)
    place = F.row_number().over(W.partitionBy("sector").orderBy(F.col("score").desc(), "a1", "a2"))
    return ranked.withColumn("k", place).where(F.col("k") <= top).select("sector", "a1", "a2", "score")


def trend_following(legs: DataFrame, window: int = 60, fast: int = 10, slow: int = 30) -> DataFrame:
    df = legs.withColumn("x", F.col("c1") / F.greatest("c2", F.lit(1e-10)))
    df = df.withColumn("f", C.mean("x", fast, keys=PAIR)).withColumn("s", C.mean("x", slow, keys=PAIR))
    before = C.lag("f", 4, PAIR)
    score = 10 * C.div(F.col("f") - F.col("s"), "s") + 5 * C.div(F.col("f") - before, before)
    return _out(df, C.signal(score, slow + 5, lo=-1, hi=1, keys=PAIR))


def style_momentum(legs: DataFrame, lookback: int = 1, weighted: bool = False, strength: float = 1.0) -> DataFrame:
    d = C.change("c1", lookback, PAIR) - C.change("c2", lookback, PAIR)
    scale = F.least(100 * F.abs(d), F.lit(1.0)) if weighted else F.lit(1.0)
    return _out(legs, C.signal(F.signum(d) * scale * strength, lookback + 1, lo=-1, hi=1, keys=PAIR))


def enhanced_style_momentum(legs: DataFrame, lookback: int = 1, least: float = 0.001, confirm: bool = False, target: float = 0.15) -> DataFrame:
    """style_momentum where the legs differ enough, the winner (if asked) above its average, scaled to the ratio's volatility."""
    df = legs.withColumn("d", C.change("c1", lookback, PAIR) - C.change("c2", lookback, PAIR)).withColumn("x", C.div("c1", "c2"))
    df = df.withColumn("dx", C.change("x", 1, PAIR))
    scale = F.coalesce(C.clip(C.div(F.lit(target / 252**0.5), F.nullif(C.std("dx", 20, keys=PAIR), F.lit(0.0))), 0.5, 2), F.lit(1.0))
    value = F.when(F.abs("d") >= least, F.signum("d")).otherwise(0.0)
    if confirm:
        above = F.when(F.col("d") > 0, F.col("c1") > C.mean("c1", 5, keys=PAIR)).otherwise(F.col("c2") > C.mean("c2", 5, keys=PAIR))
        value = F.when(F.coalesce(above, F.lit(False)), value).otherwise(0.0)
    return _out(df, C.signal(value * scale, max(lookback + 1, 2), lo=-1, hi=1, keys=PAIR))


def kalman_innovations(x: np.ndarray, y: np.ndarray, delta: float, ve: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Innovations, hedge ratios and spreads of windows [n, w]: y = alpha + beta x with both coefficients drifting."""
    n, w = x.shape
    beta, alpha, pb, pa = np.zeros(n), np.zeros(n), np.ones(n), np.ones(n)
    e, betas, spreads = np.empty((n, w)), np.empty((n, w)), np.empty((n, w))
    for t in range(w):
        pb, pa = pb + delta, pa + delta
        xt = x[:, t]
        e[:, t] = y[:, t] - (alpha + beta * xt)
        s = xt * xt * pb + pa + ve
        kb, ka = pb * xt / s, pa / s
        beta, alpha = beta + kb * e[:, t], alpha + ka * e[:, t]
        pb, pa = pb * (1 - kb * xt), pa * (1 - ka)
        betas[:, t], spreads[:, t] = beta, y[:, t] - (alpha + beta * xt)
    return e, betas, spreads


def kalman_pair(
    legs: DataFrame, window: int = 60, zscore_window: int = 20, entry: float = 1.0, delta: float = 1e-4, ve: float = 1e-3, rule: int = 1,
    take: float = 0.05, stop: float = 0.05, hold: int = 45,
) -> DataFrame:
    """a1, a2, dt, value, z, hedge, spread. Rule 1 signals z beyond the entry; rule 2 also needs both prices in the outer
    quarter and holds a position until its spread has moved by the take or stop share or `hold` days; rule 3 holds rule 1's."""
    window = max(window, zscore_window)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("dt")
        c1, c2 = part["c1"].to_numpy(), part["c2"].to_numpy()
        n = len(part)
        value, z, hedge, spread = np.zeros(n), np.zeros(n), np.full(n, np.nan), np.full(n, np.nan)
        if n >= window:
            x, y = (np.lib.stride_tricks.sliding_window_view(c, window) for c in (c2, c1))
            e, b, s = kalman_innovations(x, y, delta, ve)
            own = e[:, -zscore_window:]
            dev = own.std(axis=1)
            z[window - 1 :] = np.divide(own[:, -1] - own.mean(axis=1), dev, out=np.zeros(len(dev)), where=dev >= 1e-10)
            hedge[window - 1 :], spread[window - 1 :] = b[:, -1], s[:, -1]
            raw = np.where(z < -entry, 1, np.where(z > entry, -1, 0))
            if rule == 2:
                low = [np.append(np.full(window - 1, np.nan), np.percentile(v, 25, axis=1)) for v in (y, x)]
                high = [np.append(np.full(window - 1, np.nan), np.percentile(v, 75, axis=1)) for v in (y, x)]
                raw = np.where((raw == 1) & (c1 < high[0]) & (c2 < high[1]), 1, np.where((raw == -1) & (c1 > low[0]) & (c2 > low[1]), -1, 0))
            if rule == 1:
                value = raw.astype(float)
            else:
                side, ref, days = 0, 0.0, 0
                for t in range(window - 1, n):
                    if side:
                        days += 1
                        gain = side * (spread[t] - ref) / max(abs(ref), 1e-10)
                        if gain >= take or gain <= -stop or days >= hold:
                            side = 0
                    elif raw[t]:
                        side, ref, days = int(raw[t]), spread[t], 0
                    value[t] = side
        out = part[["a1", "a2", "dt"]].assign(value=value, z=z, hedge=hedge, spread=spread)
        return out.astype(object).where(out.notna(), None)

    return legs.groupBy("a1", "a2").applyInPandas(run, "a1 string, a2 string, dt date, value double, z double, hedge double, spread double")


def copula_cdf(u: Column, v: Column, family: str, theta: float) -> Column:
    """C(u, v) of one family, at least 1e-10."""
    if family == "clayton":
        c = F.pow(F.greatest(F.pow(u, F.lit(-theta)) + F.pow(v, F.lit(-theta)) - 1, F.lit(1e-10)), F.lit(-1 / theta))
    elif family == "gumbel":
        c = F.exp(-F.pow(F.pow(-F.ln(u), F.lit(theta)) + F.pow(-F.ln(v), F.lit(theta)), F.lit(1 / theta)))
    else:
        top = (F.exp(-theta * u) - 1) * (F.exp(-theta * v) - 1)
        c = -F.ln(1 + top / (np.exp(-theta) - 1)) / theta
    return F.greatest(c, F.lit(1e-10))


def copula_conditional(u: Column, v: Column, family: str, theta: float) -> Column:
    """dC / du."""
    if family == "clayton":
        return F.pow(u, F.lit(-theta - 1)) * F.pow(F.greatest(F.pow(u, F.lit(-theta)) + F.pow(v, F.lit(-theta)) - 1, F.lit(1e-10)), F.lit(-1 / theta - 1))
    if family == "gumbel":
        a, b = -F.ln(u), -F.ln(v)
        s = F.pow(a, F.lit(theta)) + F.pow(b, F.lit(theta))
        return copula_cdf(u, v, family, theta) * F.pow(s, F.lit(1 / theta - 1)) * F.pow(a, F.lit(theta - 1)) / u
    eu, ev = F.exp(-theta * u), F.exp(-theta * v)
    return eu * (ev - 1) / ((np.exp(-theta) - 1) + (eu - 1) * (ev - 1))


FAMILIES = (("clayton", 10.0), ("gumbel", 10.0), ("frank", 10.0))  # the sum of log C grows with theta: the bound is the fit


def _copula_score(df: DataFrame, entry: float) -> tuple[DataFrame, Column]:
    """df with what the score needs, and (0.5 - dC/du) * 2 of the last of the returns x and y, 0 within the entry."""
    n = F.size("x")
    share = lambda a, at: F.size(F.filter(a, lambda e: e <= at)) / F.size(a)
    bound = lambda c: F.greatest(F.lit(0.01), F.least(F.lit(0.99), c))
    df = df.where(n > 1).withColumn("hx", F.slice("x", 1, n - 1)).withColumn("hy", F.slice("y", 1, n - 1))
    df = df.withColumn("u", bound(share("hx", F.element_at("x", -1)))).withColumn("v", bound(share("hy", F.element_at("y", -1))))
    df = df.withColumn("us", F.transform("hx", lambda e: bound(F.size(F.filter("hx", lambda o: o <= e)) / F.size("hx"))))
    df = df.withColumn("vs", F.transform("hy", lambda e: bound(F.size(F.filter("hy", lambda o: o <= e)) / F.size("hy"))))

    def fit(family: str, theta: float) -> Column:
        logs = F.zip_with("us", "vs", lambda a, b: F.ln(copula_cdf(a, b, family, theta)))
        return F.aggregate(logs, F.lit(0.0), lambda s, e: s + e)

    df = df.select("*", *(fit(f, t).alias(f"fit_{f}") for f, t in FAMILIES))
    best = F.greatest(*(F.col(f"fit_{f}") for f, _ in FAMILIES))
    cond = F.coalesce(*(F.when(F.col(f"fit_{f}") == best, copula_conditional(F.col("u"), F.col("v"), f, t)) for f, t in FAMILIES))
    score = (0.5 - cond) * 2
    return df, F.when(F.abs(score) >= entry, C.clip(score, -1, 1)).otherwise(0.0)


def _corr_over(w) -> Column:
    """Correlation of r1 and r2 where both are known; NULL where one doesn't vary (corr raises in ANSI mode)."""
    x, y = F.when(F.col("r2").isNotNull(), F.col("r1")), F.when(F.col("r1").isNotNull(), F.col("r2"))
    return C.div(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))


def _copula_windows(legs: DataFrame, window: int) -> DataFrame:
    w = C.last(window, PAIR)
    df = legs.where(F.col("r1").isNotNull() & F.col("r2").isNotNull())
    return df.select("a1", "a2", "dt", F.collect_list("r1").over(w).alias("x"), F.collect_list("r2").over(w).alias("y"), _corr_over(w).alias("corr"))


def copula_pair(legs: DataFrame, window: int = 60, least_corr: float = 0.5, entry: float = 0.2) -> DataFrame:
    """Score of a1 against a2: (0.5 - dC/du) * 2 at the last returns' empirical ranks, under the family that fits best.

    Each row looks at its last `window` returns as arrays of a bounded frame; nothing leaves the JVM.
    """
    df, score = _copula_score(_copula_windows(legs, window), entry)
    return _out(df, F.when((F.size("x") >= max(20, window - 10)) & (F.col("corr") > least_corr), score).otherwise(0.0))


def copula_fits(legs: DataFrame, window: int = 60) -> DataFrame:
    """a1, a2, dt, and for each family theta and the log-likelihood of the last `window` returns, with the best family."""
    df, _ = _copula_score(_copula_windows(legs, window), 0.0)
    best = F.greatest(*(F.col(f"fit_{f}") for f, _ in FAMILIES))
    name = F.coalesce(*(F.when(F.col(f"fit_{f}") == best, F.lit(f)) for f, _ in FAMILIES))
    return df.select("a1", "a2", "dt", *(x for f, t in FAMILIES for x in (F.lit(t).alias(f"theta_{f}"), F.col(f"fit_{f}"))), name.alias("family"))


def all_legs(bars: DataFrame, change: Callable[[str], Column] = C.change) -> DataFrame:
    """pair_bars of every pair a1 < a2 of the universe."""
    leg = lambda k: bars.select(F.col("asset").alias(f"a{k}"), "dt", F.col("close").alias(f"c{k}"), change("close").alias(f"r{k}"))
    return leg(1).join(leg(2), "dt").where("a1 < a2").select("a1", "a2", "dt", "c1", "r1", "c2", "r2")


def _universe(bars: DataFrame, scored: DataFrame) -> DataFrame:
    """asset, dt, partner, value for every bar: 0 and no partner where none is correlated enough."""
    own = scored.select(F.col("a1").alias("asset"), "dt", F.col("a2").alias("partner"), "value")
    return bars.select("asset", "dt").join(own, ["asset", "dt"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def copula_universe(bars: DataFrame, window: int = 60, least_corr: float = 0.5, entry: float = 0.2, block: int = gram.BLOCK) -> DataFrame:
    """copula_pair of every asset and date against its best partner by the last `window` common returns, whose returns alone
    are fetched once it is known."""
    r = bars.select("asset", "dt", C.change("close").alias("r")).where("r is not null")
    near = gram.best_partners(r, window, max(20, window - 10), least_corr, block)
    df, score = _copula_score(gram.last_common(near, r, "r", window, block).select(F.col("asset").alias("a1"), F.col("partner").alias("a2"), "dt", "x", "y"), entry)
    return _universe(bars, df.withColumn("value", score))


def trend_universe(bars: DataFrame, window: int = 60, least_corr: float = 0.3, fast: int = 10, slow: int = 30, block: int = gram.BLOCK) -> DataFrame:
    """trend_following of every asset and date against its best partner by the last `window` - 1 common log returns."""
    r = bars.select("asset", "dt", "close", C.log_change("close").alias("r"))
    near = gram.best_partners(r, window - 1, 20, least_corr, block)
    history = max(slow + 5, fast + 4)
    df = gram.last_common(near, r, "close", history, block)
    ratio = F.zip_with("x", "y", lambda a, b: a / F.greatest(b, F.lit(1e-10)))
    mean = lambda n, before=0: F.aggregate(F.slice("z", history - before - n + 1, n), F.lit(0.0), lambda s, e: s + e) / n
    df = df.withColumn("z", ratio).withColumn("full", F.size("z") >= history)
    df = df.withColumns({"f": F.when(F.col("full"), mean(fast)), "s": F.when(F.col("full"), mean(slow)), "before": F.when(F.col("full"), mean(fast, 4))})
    score = C.clip(10 * C.div(F.col("f") - F.col("s"), "s") + 5 * C.div(F.col("f") - F.col("before"), "before"), -1, 1)
    return _universe(bars, df.select(F.col("asset").alias("a1"), F.col("partner").alias("a2"), "dt", F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0)).alias("value")))


FACTORS: dict[str, Callable[..., DataFrame]] = {
    "CopulaPairFactor": copula_pair,
    "TrendFollowingPairFactor": trend_following,
    "KalmanFilterPairFactor": kalman_pair,
    "StyleMomentumPairFactor": style_momentum,
    "EnhancedStyleMomentumPairFactor": enhanced_style_momentum,
}
