"""Joins of dated rows against loops, and the run log with half-written and repeated runs."""

import datetime as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import crosssection, joins, pairs
from tidemark.sources import runlog

day = lambda n: D.date(2020, 1, 1) + D.timedelta(days=int(n))


@pytest.mark.parametrize("unit", ["day", "month", "year"])
def test_as_of_matches_a_loop(spark, unit):
    rng = np.random.default_rng(3)
    facts = [(k, day(n), float(v), None if v % 3 == 0 else int(v)) for k in ("a", "b", None) for n, v in zip(rng.integers(0, 700, 40), rng.integers(0, 99, 40), strict=True)]
    facts += [("a", None, 1.0, 1), ("a", day(5), 2.0, 1), ("a", day(5), 2.0, 3)]
    asked = [(i, k, t, "x") for i, (k, t) in enumerate((k, None if n == 0 else D.datetime(2020, 1, 1, 7) + D.timedelta(days=int(n))) for k in ("a", "b", "c", None) for n in rng.integers(0, 800, 60))]
    left = spark.createDataFrame([*asked, asked[0]], "id int, k string, at timestamp, v string")
    right = spark.createDataFrame(facts, "k string, known date, x double, y int")
    out = joins.as_of(left, right, ["k"], "at", "known", ["x", "y"], unit)
    assert out.columns == ["id", "k", "at", "v", "x", "y"]
    found = out.collect()
    assert len(found) == len(asked) + 1
    for r in found:
        known = [(d, x, -1 if y is None else y) for k, d, x, y in facts if k is not None and k == r.k and d is not None and r["at"] is not None and d <= r["at"].date()]
        d, x, y = max(known, default=(None, None, -1))
        assert (r.x, -1 if r.y is None else r.y) == (x, y)
    assert joins.as_of(left, right.where("false"), ["k"], "at", "known", ["x"], unit).where("x is not null").count() == 0
    assert joins.as_of(left.where("false"), right, ["k"], "at", "known", ["x"], unit).count() == 0


def test_ranges_of_validity(spark):
    facts = [("a", day(0), day(40), 1.0), ("a", day(30), day(50), 2.0), ("a", day(30), day(35), 9.0), ("a", day(90), None, 3.0), ("b", day(10), day(10), 4.0), ("b", day(12), day(11), 5.0), ("z", day(0), None, 6.0), (None, day(0), None, 7.0)]
    rows = [(k, day(n)) for k in ("a", "b", None) for n in range(0, 130, 5)]
    out = joins.valid_on(spark.createDataFrame([*rows, rows[0]], "asset string, dt date"), spark.createDataFrame(facts, "asset string, valid_from date, valid_to date, x double"), ["x"])
    found = out.collect()
    assert len(found) == len(rows) + 1 and out.columns == ["asset", "dt", "x"]
    for r in found:
        holding = [(a, x) for k, a, b, x in facts if k is not None and k == r.asset and a <= r.dt and (b is None or r.dt < b)]
        assert r.x == max(holding, default=(None, None))[1]


def test_holdings_fall_back_and_weigh(spark):
    bars = spark.createDataFrame([(a, day(n), float(k + 2), 1.0) for k, a in enumerate("abc") for n in range(4)], "asset string, dt date, long_pos double, short_pos double")
    held = spark.createDataFrame([("a", day(1), None, 3.0, 1.0), ("b", day(1), None, 1.0, 1.0), ("c", day(3), None, 0.0, 0.0), ("q", day(0), None, 9.0, 1.0)], "asset string, valid_from date, valid_to date, long_pos double, short_pos double")
    rates = spark.createDataFrame([("a", day(2), day(3), 0.5), ("q", day(0), None, 0.5)], "asset string, valid_from date, valid_to date, win_rate double")
    found = {(r.asset, (r.dt - day(0)).days): r.value for r in crosssection.member_holdings(bars, held, rates).collect()}
    assert {n: sorted(a for a, m in found if m == n) for n in range(4)} == {0: ["a", "b", "c"], 1: ["a", "b"], 2: ["a"], 3: ["a", "b"]}
    own = np.array([1 / 3, 2 / 4, 3 / 5])
    np.testing.assert_allclose([found[a, 0] for a in "abc"], (own - own.mean()) / own.std(ddof=1))
    np.testing.assert_allclose([found["a", 1], found["b", 1], found["a", 2]], [0.5**0.5, -(0.5**0.5), 0])


def test_tails_ignore_dates(spark):
    rng = np.random.default_rng(5)
    out = []
    for k, a in enumerate("abcd"):
        days_ = np.sort(rng.choice(200, 90 + 10 * k, replace=False))
        out += [(a, "s" if a != "d" else "t", day(n), float(c)) for n, c in zip(days_, 100 + np.cumsum(rng.normal(size=len(days_))), strict=True)]
    bars = spark.createDataFrame(out, "asset string, sector string, dt date, close double")
    asked = spark.createDataFrame([(day(n),) for n in (20, 90, 199, 500)], "as_of date")
    found = {((r.as_of - day(0)).days, r.a1, r.a2): (r.n, r.corr) for r in pairs.tail_correlations(bars, asked, window=30, least=12).collect()}
    want = {}
    for n in (20, 90, 199, 500):
        r = {}
        for a in "abc":
            c = np.array([c for x, _, d, c in out if x == a and d <= day(n)])
            r[a] = (c[1:] / c[:-1] - 1)[-30:]
        for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
            m = min(len(r[a]), len(r[b]))
            if m >= 12:
                want[n, a, b] = (m, np.corrcoef(r[a][-m:], r[b][-m:])[0, 1])
    assert found.keys() == want.keys() and len(want) >= 9
    for k, (m, corr) in want.items():
        assert found[k][0] == m and abs(found[k][1] - corr) < 1e-9


@pytest.mark.parametrize("largest", [0, 100])
def test_multipliers(spark, largest):
    symbols = ["rb2401.SHF", "RB", "AU.SHF", "x9y12", "", None, "12", "if2403.a.b"]
    df = spark.createDataFrame([(s,) for s in symbols], "asset string")
    known = spark.createDataFrame([("RB", 10), ("AU", 1000), ("X9Y", 7), ("RB", 9), (None, 3), ("IF", None)], "product string, multiplier int")
    out = joins.looked_up(df, known, "product", "multiplier", F.lit(10), joins.product_code(F.col("asset")), largest)
    assert {r.asset: r.multiplier for r in out.collect()} == {"rb2401.SHF": 10, "RB": 10, "AU.SHF": 1000, "x9y12": 7, "": 10, None: 10, "12": 10, "if2403.a.b": 10}
    assert joins.multipliers(df, known).count() == len(symbols)


def test_run_log_shows_whole_runs_only(spark, tmp_path):
    log = runlog.RunLog(spark, f"file://{tmp_path}/log")
    assert log.runs().count() == 0 and log.read().count() == 0 and log.vacuum() == 0
    factors = spark.createDataFrame([(day(0), "m", "a", 1.0), (day(0), "m", "b", None), (day(1), "m", "a", 2.0), (day(1), "v", "a", 3.0), (day(1), None, "a", 4.0)], "dt date, factor string, ticker string, value double")
    signals = spark.createDataFrame([(day(0), "a", 0.5, 0.25), (day(0), None, 9.0, 9.0)], "dt date, ticker string, signal double, ts_contribution double")
    trades = spark.createDataFrame([(day(1), "a", "buy", 2.0, 9.5), (day(1), "a", "buy", 2.0, 9.5)], "dt date, ticker string, action string, quantity double, price double")
    notes = spark.createDataFrame([(day(2), "why", "test")], "dt date, key string, value string")
    pnl = spark.createDataFrame([(day(0), 0.01)], "dt date, daily_return double")
    records = runlog.days(factors, signals, None, trades, pnl, None, notes)
    log.append("one", records)
    half = log.write(records)  # a writer that dies before its manifest
    assert [r.run_id for r in log.runs().collect()] == ["one"] and log.read().count() == 3
    with pytest.raises(KeyError):
        log.read("two")
    with pytest.raises(FileExistsError):
        log.append("one", records)
    log.commit("two", log.write(runlog.days(factors, trades=trades, levels=("trades",))))
    assert {(r.run_id, r.days) for r in log.runs().collect()} == {("one", 3), ("two", 1)} and half
    t = log.tables("one")
    assert sorted((r.dt, r.factor, r.ticker, r.value) for r in t["factors"].where("value is not null").collect()) == [(day(0), "m", "a", 1.0), (day(1), "m", "a", 2.0), (day(1), "v", "a", 3.0)]
    assert t["factors"].count() == 4 and t["factors"].first().type == "UNKNOWN"
    assert [(r.ticker, r.signal, r.ts_contribution, r.pair_contribution) for r in t["signals"].collect()] == [("a", 0.5, 0.25, None)]
    assert t["trades"].count() == 2 and t["positions"].count() == 0 and t["volatility"].count() == 0
    assert t["pnl"].first().daily_return == 0.01 and t["metadata"].first().key == "why"
    assert log.tables("two")["factors"].count() == 0 and log.tables()["trades"].count() == 4
    assert log.vacuum() == 2 and log.read().count() == 4
    with pytest.raises(ValueError):
        runlog.days(levels=("pnl",))
    for name in ("", "a/b", ".x"):
        with pytest.raises(ValueError):
            log.commit(name, half)


def walk(spark, n=130, seed=8):
    rng = np.random.default_rng(seed)
    common = rng.normal(0, 0.02, n)
    out = []
    for k, a in enumerate("ABCDEFG"):
        c = 50 * np.exp(np.cumsum((k != 6) * (0.8 * common + rng.normal(0, 0.005 * (k + 1), n))))
        keep = np.sort(rng.choice(n, n - 5 * k, replace=False))
        out += [(a, "st"[k % 2], day(i), float(c[i])) for i in keep]
    return spark.createDataFrame(out, "asset string, sector string, dt date, close double"), out


@pytest.mark.parametrize("block", [2, 64])
def test_best_partners_by_blocks(spark, block):
    from tidemark.functions import cols as C
    from tidemark.operators import gram

    bars, rows = walk(spark)
    r = bars.select("asset", "dt", C.log_change("close").alias("r"))
    near = gram.best_partners(r, 20, 8, 0.3, block)
    found = {(x.asset, (x.dt - day(0)).days): (x.partner, x["corr"]) for x in near.collect()}
    series = {a: {(d - day(0)).days: c for x, _, d, c in rows if x == a} for a in "ABCDEFG"}
    ret = {a: dict(zip(list(s)[1:], np.diff(np.log(list(s.values()))), strict=True)) for a, s in series.items()}
    want = {}
    for a in "ABCDEFG":
        for t in series[a]:
            best = (0.3, None)
            for b in "ABCDEFG":
                at = [d for d in series[a] if d in series.get(b, {}) and d <= t][-20:]
                known = [d for d in at if d in ret[a] and d in ret[b]]
                if b == a or not at or at[-1] != t or len(known) < 8:
                    continue
                x, y = np.array([ret[a][d] for d in known]), np.array([ret[b][d] for d in known])
                if np.ptp(x) > 0 and np.ptp(y) > 0 and (c := np.corrcoef(x, y)[0, 1]) > best[0]:
                    best = (c, b)
            if best[1]:
                want[a, t] = best
    assert found.keys() == want.keys() and len(want) > 300
    assert all(found[k][0] == b and abs(found[k][1] - c) < 1e-9 for k, (c, b) in want.items())
    for x in gram.last_common(near, r, "r", 7, block).where("asset = 'B'").collect():
        t = (x.dt - day(0)).days
        at = [d for d in series["B"] if d in series[x.partner] and d <= t][-7:]
        np.testing.assert_allclose(x.x, [ret["B"].get(d, np.nan) for d in at])
        np.testing.assert_allclose(x.y, [ret[x.partner].get(d, np.nan) for d in at])


@pytest.mark.parametrize("block", [2, 64])
def test_quadratic_forms_and_scores_by_blocks(spark, block):
    from tidemark.operators import gram

    bars, rows = walk(spark)
    weights = bars.select("asset", "dt", (F.col("close") / 50).alias("weight"))
    matrix = [(a, b, (1.0 + ord(a) - 65) * (1.0 + ord(b) - 65) / 9) for a in "ABCDEF" for b in "ABCDEF" if (a, b) not in (("A", "B"), ("B", "A"))]
    found = {(r.dt - day(0)).days: r.form for r in gram.quadratic_form(weights, spark.createDataFrame(matrix, "a1 string, a2 string, v double"), "v", block).collect()}
    want = {}
    for t in range(130):
        w = {a: c / 50 for a, _, d, c in rows if d == day(t)}
        if any(a in w and b in w for a, b, _ in matrix):
            want[t] = sum(w[a] * w[b] * v for a, b, v in matrix if a in w and b in w)
    assert found.keys() == want.keys() and all(abs(found[t] - want[t]) < 1e-9 for t in want)
    rho = {(r.a1, r.a2): r.rho for r in gram.pair_statistic(bars, "close", pairs.autocorrelation, "rho", "sector", block).collect()}
    assert set(rho) == {(a, b) for a in "ABCDEFG" for b in "ABCDEFG" if a < b and (ord(b) - ord(a)) % 2 == 0}
    series = {a: {d: c for x, _, d, c in rows if x == a} for a in "ACE"}
    z = np.array([np.log(series["A"][d] / series["C"][d]) for d in sorted(set(series["A"]) & set(series["C"]))])
    assert abs(rho["A", "C"] - np.corrcoef(z[1:], z[:-1])[0, 1]) < 1e-9
