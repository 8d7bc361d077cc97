"""Recursions split within an asset, and factors on slices, against loops over bars and over slices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import scan, timeseries

N = 330


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(7)
    out = []
    for asset, n in (("A", N), ("B", 40), ("C", 140), ("D", 1)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        close[n // 2 : n // 2 + 3] = close[n // 2]
        volume = rng.integers(0, 9, n).astype(float)
        out.append(pd.DataFrame({"asset": asset, "dt": pd.bdate_range("2020-01-01", periods=n).date, "close": close, "volume": volume, "amount": close * volume}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def walk_bars(spark, walk):
    return spark.createDataFrame(walk).withColumn("dt", F.to_date("dt")).cache()


def by_asset(df, column="value"):
    found = df.toPandas().sort_values(["asset", "dt"])
    return {a: p[column].to_numpy(dtype=float) for a, p in found.groupby("asset")}


def low_lag(c, n):
    a, out = 2 / (n + 1), list(c[:2])
    for t in range(2, len(c)):
        out.append((a - a * a / 4) * c[t] + a * a / 2 * c[t - 1] - (a - 3 * a * a / 4) * c[t - 2] + 2 * (1 - a) * out[-1] - (1 - a) ** 2 * out[-2])
    return np.array(out)


AVERAGES = {
    "SMA": lambda c, n: pd.Series(c).rolling(n).mean().to_numpy(),
    "WMA": lambda c, n: pd.Series(c).rolling(n).apply(lambda x: (x * np.arange(1, n + 1)).sum() / (n * (n + 1) / 2), raw=True).to_numpy(),
    "EMA": lambda c, n: pd.Series(c).ewm(span=n, adjust=False).mean().to_numpy(),
    "LLT": low_lag,
}


def positions(c, kind, details=False):
    f, s = (AVERAGES[kind](c, n) for n in (10, 20))
    pos, ref, out = 0, None, [(0, None, None)] * min(20, len(c))
    for i in range(20, len(c)):
        kind_ = None
        cross = 1 if f[i] > s[i] and f[i - 1] <= s[i - 1] else -1 if f[i] < s[i] and f[i - 1] >= s[i - 1] else 0
        if cross:
            name = "long" if cross == 1 else "short"
            kind_ = f"update_{name}_ref" if pos == cross else f"open_{name}"
            pos, ref = cross, c[i]
        if pos and (c[i] - ref) * pos < 0:
            kind_ = "stop_long" if pos == 1 else "stop_short"
            pos, ref = 0, None
        out.append((pos, ref, kind_))
    return out if details else np.array([p for p, *_ in out], float)


def amihud_last(p):
    a = p["close"].pct_change() / (p["amount"] + 1e-10)
    return float(np.clip(np.nan_to_num((a.ewm(span=2).mean() / (a.ewm(span=9).mean() + 1e-10)).iloc[-1]), -5, 5))


def slm_last(p):
    c = p["close"].to_numpy()
    if len(c) < 206:
        return 0.0
    sym = "".join("1" if b < a else "2" for a, b in zip(c, c[1:], strict=False))[:-1]
    grams = [sym[i : i + 6] for i in range(len(sym) - 5)]
    return float(np.sign(grams.count(sym[-5:] + "2") - grams.count(sym[-5:] + "1")))


def pattern_last(p, use_volume=True):
    c, v = p["close"].to_numpy(), p["volume"].to_numpy()
    ma = pd.Series(v).rolling(50, min_periods=1).mean().to_numpy()
    v = np.divide(v, ma, out=np.ones(len(v)), where=ma > 0)
    shape = lambda i: np.stack([c[i - 10 : i + 1] / c[i], v[i - 10 : i + 1]][: 1 + use_volume], axis=1)
    t = len(c) - 1
    hist = range(10, t - 1)
    d = timeseries.pattern_distances(shape(t), np.stack([shape(i) for i in hist]))
    near = np.argsort(d, kind="stable")[:5]
    return float(np.sign(sum((c[hist[j] + 1] / c[hist[j]] - 1) / d[j] for j in near if d[j] > 0)))


def sliced(walk, window, f, before):
    """The drivers' loops: window + 1 rows up to a bar, or window rows before it."""
    out = {}
    for a, p in walk.groupby("asset"):
        out[a] = np.array([0.0 if i < window else f(p.iloc[i - window : i + (not before)]) for i in range(len(p))])
    return out


@pytest.mark.parametrize("before", [False, True])
def test_slices_match_the_loop(walk, walk_bars, before):
    cases = [(timeseries.amihud(walk_bars, mode="slice", before=before), 50, amihud_last), (timeseries.slm_timing(walk_bars, mode="slice", before=before), 300, slm_last)]
    cases += [(timeseries.ma_crossover(walk_bars, kind=k, mode="slice", before=before), 60, lambda p, k=k: positions(p["close"].to_numpy(), k)[-1]) for k in AVERAGES]
    cases += [(timeseries.price_volume_pattern(walk_bars, mode="slice", before=before, use_volume=v), 100, lambda p, v=v: pattern_last(p, v)) for v in (True, False)]
    for df, window, f in cases:
        found, want = by_asset(df), sliced(walk, window, f, before)
        assert found.keys() == want.keys()
        for a in want:
            np.testing.assert_allclose(found[a], want[a], atol=1e-9)


def test_slices_cross_blocks(walk, walk_bars):
    from tidemark.operators import slices

    want = by_asset(timeseries.amihud(walk_bars, mode="slice"))
    for block, batch in ((7, 3), (50, 1), (64, 1000)):
        found = by_asset(slices.per_slice(walk_bars, ["close"], 5, lambda x: x[:, :, 0].sum(axis=1), block=block, batch=batch))
        for a, p in walk.groupby("asset"):
            np.testing.assert_allclose(found[a], p["close"].rolling(5).sum().fillna(0), atol=1e-9)
    assert (want["A"][50:] != by_asset(timeseries.amihud(walk_bars))["A"][50:]).any()


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 14])
def test_scans_match_loops_at_any_block(walk, walk_bars, block):
    crossing = {k: timeseries.crossing_averages(walk_bars, 10, 20, k, block) for k in ("EMA", "LLT")}
    for k, df in crossing.items():
        fast, slow = by_asset(df, "f"), by_asset(df, "s")
        for a, p in walk.groupby("asset"):
            for found, n in ((fast[a], 10), (slow[a], 20)):
                np.testing.assert_allclose(found, AVERAGES[k](p["close"].to_numpy(), n), rtol=1e-9)
    found = by_asset(timeseries.amihud(walk_bars, block=block))
    for a, p in walk.groupby("asset"):
        np.testing.assert_allclose(found[a], [amihud_last(p.iloc[: i + 1]) if i >= 49 else 0 for i in range(len(p))], atol=1e-9)


def test_scans_of_gaps(spark):
    x = [None, 3.0, None, 5.0, 4.0, None, None, 9.0, 2.0]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(x)] + [("B", 0, None)], "asset string, dt int, x double")
    for adjust in (True, False):
        want = pd.Series(x, dtype=float).ewm(span=4, adjust=adjust).mean().to_numpy()
        found = by_asset(scan.ewm(df, "x", {"m": 4}, adjust, block=2), "m")
        np.testing.assert_allclose(found["A"], want)
        assert np.isnan(found["B"]).all()
    filled = [3.0, 3.0, 5.0, 4.0, 4.0, 4.0, 9.0, 2.0]
    np.testing.assert_allclose(by_asset(scan.low_lag(df, "x", {"m": 4}, block=3), "m")["A"][1:], low_lag(np.array(filled), 4))
    assert scan.ewm(df.where("false"), "x", {"m": 4}).count() == 0


@pytest.mark.parametrize("kind", sorted(AVERAGES))
def test_crossover_details(walk, walk_bars, kind):
    found = timeseries.ma_crossover_details(walk_bars, kind=kind).toPandas().sort_values(["asset", "dt"])
    for a, p in walk.groupby("asset"):
        mine, want = found[found.asset == a], positions(p["close"].to_numpy(), kind, details=True)
        assert [(int(r.signal), None if pd.isna(r.ref_price) else r.ref_price, r.trade_type) for r in mine.itertuples()] == want
    assert {"open_long", "open_short", "stop_long", "stop_short"} <= set(found.trade_type.dropna())


@pytest.mark.parametrize(("block", "use_volume"), [(50, True), (4096, True), (70, False)])
def test_pruned_search_finds_all(walk, walk_bars, block, use_volume):
    found = timeseries.pattern_neighbours(walk_bars, 11, 5, 50, 50, None, block, use_volume).toPandas()
    p = walk[walk.asset == "A"]
    c, v = p["close"].to_numpy(), p["volume"].to_numpy()
    v = np.divide(v, ma := pd.Series(v).rolling(50, min_periods=1).mean().to_numpy(), out=np.ones(N), where=ma > 0)
    shapes = {i: np.stack([c[i - 10 : i + 1] / c[i], v[i - 10 : i + 1]][: 1 + use_volume], axis=1) for i in range(10, N)}
    for t in range(61, N, 13):
        d = timeseries.pattern_distances(shapes[t], np.stack([shapes[i] for i in range(10, t - 1)]))
        mine = sorted((x, h) for r in found[(found.asset == "A") & (found.i == t)].itertuples() for x, h in zip(r.d, r.h, strict=True))[:5]
        best = np.argsort(d, kind="stable")[:5]
        assert [h for _, h in mine] == [j + 10 for j in best] and np.allclose([x for x, _ in mine], d[best], rtol=1e-12)
    share = {r.asset: r.share for r in timeseries.pattern_pruning(walk_bars, block=block, use_volume=use_volume).collect()}
    assert 0 < share["A"] < 0.6 and found[found.asset == "A"].compared.sum() == sum(t - 11 for t in range(61, N))
