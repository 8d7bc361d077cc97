"""Configuration over defaults, industry tables, the filtered level and contract sizes."""

import math
import sys

import numpy as np
import pytest

from tidemark.operators import portfolio, scan
from tidemark.plans import config as G
from tidemark.plans.engine_api import KINDS, Engine, Mode
from tidemark.sources import bars as B

YAML = """
factor_type_weights: {pair_trading: 0.3}
common:
  time_series:
    - {name: EMDTrend, category: trend, default_params: {window: 60}}
    - {name: OwnSlope, category: trend, class: own_factors.slope, default_params: {scale: 2.0}}
idiosyncratic:
  by_sector: {metals: {time_series: [{name: EMDTrend, category: trend, default_params: {window: 40}}]}}
  by_asset: {CU: {time_series: [{name: EMDTrend, category: fast, default_params: {window: 20}}]}}
fixed_pairs: {metals: [[CU, AL]], oils: [[Y, P]]}
backtest: {transaction_cost: 0.002}
"""


@pytest.fixture
def path(tmp_path):
    pytest.importorskip("yaml")
    p = tmp_path / "factors.yaml"
    p.write_text(YAML, encoding="utf-8")
    return p


def test_defaults_without_a_file(tmp_path):
    for where in (None, str(tmp_path / "none.yaml")):
        c = G.Config(where)
        assert c.get("backtest.initial_capital") == 1e7 and c.get("backtest.nothing", 3) == 3 and c.get("backtest.initial_capital.x") is None
        assert c.categories() == ["copula", "liquidity", "trend"] and c.categories("cross_sectional") == []
        assert c.params("HurstExponent") == {"window": 100, "scale": 2.0} and c.params("nothing") == {}
    c.factor("HurstExponent")["default_params"]["window"] = 1
    assert c.params("HurstExponent")["window"] == 100, "answers are copies"


def test_file_over_defaults(path):
    c = G.Config(str(path))
    assert c.get("factor_type_weights") == {"time_series": 0.5, "cross_sectional": 0.35, "pair_trading": 0.3}
    assert c.get("backtest") == {"initial_capital": 1e7, "transaction_cost": 0.002}
    assert [f["name"] for f in c.factors("time_series")] == ["EMDTrend", "OwnSlope"], "a list replaces the default one"
    assert [f["name"] for f in c.factors(category="copula")] == ["CopulaPairFactor"]
    assert [c.params("EMDTrend", sector=s, asset=a)["window"] for s, a in ((None, None), ("metals", None), ("metals", "CU"), (None, "CU"), ("oils", "Y"))] == [60, 40, 20, 20, 60]
    assert c.params("EMDTrend", {"window": 7}, "metals", "CU") == {"window": 7}
    assert [f["name"] for f in c.factors("time_series", asset="CU", category="fast")] == ["EMDTrend"]
    assert c.pairs() == {"metals": [("CU", "AL")], "oils": [("Y", "P")]}
    path.write_text("backtest: {initial_capital: 5}", encoding="utf-8")
    assert c.get("backtest.initial_capital") == 1e7 and c.reload()["backtest"]["initial_capital"] == 5
    path.write_text("- a list", encoding="utf-8")
    with pytest.raises(ValueError):
        c.reload()
    path.write_text("", encoding="utf-8")
    assert c.reload() == G.DEFAULTS


def test_task_with_a_factor_by_path(spark, path, tmp_path, monkeypatch):
    (tmp_path / "own_factors.py").write_text("from pyspark.sql import functions as F\n\ndef slope(bars, scale=1.0):\n    return bars.select('asset', 'dt', (F.col('close') * scale).alias('value'))\n", encoding="utf-8")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setitem(KINDS, "time_series", dict(KINDS["time_series"]))
    task = G.Config(str(path)).task(Mode.MULTI_TS, sector="metals", params={"OwnSlope": {"scale": 3.0}}, start="2020-01-02")
    assert task.factors == ["EMDTrend", "OwnSlope"] and task.params == {"EMDTrend": {"window": 40}, "OwnSlope": {"scale": 3.0}}
    assert (task.capital, task.cost, task.start) == (1e7, 0.002, "2020-01-02") and "own_factors" not in sys.modules
    bars = spark.createDataFrame([("CU", "2020-01-02", 2.0)], "asset string, dt string, close double")
    task.factors = ["OwnSlope"]
    assert [r.value for r in Engine(bars).values(task, bars).collect()] == [6.0] and "own_factors" in sys.modules
    assert G.Config(str(path)).task("pair_factor", sector="oils").pairs == [("Y", "P")]
    G.register_path("Broken", "time_series", "own_factors.nothing")
    with pytest.raises(ImportError):
        KINDS["time_series"]["Broken"](bars)
    with pytest.raises(ImportError):
        G.loaded("nodots")


def test_with_industry(spark):
    bars = spark.createDataFrame([("CU", 1, None), ("AL", 2, "own"), ("X", 3, None), (None, 4, None), ("E", 5, None)], "asset string, i int, sector string")
    table = spark.createDataFrame([(" CU ", "metals"), ("CU", "alloys"), ("AL", "metals"), ("E", "  "), ("Z", "none"), (None, "q")], "PRODUCT_CODE string, INDUSTRY string")
    assert {r.i: r.sector for r in B.with_industry(bars, table).collect()} == {1: "alloys", 2: "metals", 3: "unknown", 4: "unknown", 5: "unknown"}
    assert {r.i: r.sector for r in B.with_industry(bars, table.where("false"), "?").collect()} == {1: "?", 2: "own", 3: "?", 4: "?", 5: "?"}
    assert B.with_industry(bars.drop("sector"), table).count() == 5


@pytest.mark.parametrize("block", [2, 7, 5000])
def test_filtered_level(spark, block):
    rng = np.random.default_rng(3)
    x = [None, None, *(None if rng.random() < 0.1 else float(v) for v in 100 + rng.normal(size=60).cumsum())]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)] + [("b", 0, 5.0), ("c", 0, None)], "asset string, dt long, close double")
    got = {(r.asset, r.dt): r for r in scan.filtered_level(df, block=block, q=1e-2, r=0.5).collect()}
    level, p = None, 1.0
    for i, z in enumerate(x):
        deviation = None
        if z is not None:
            level = z if level is None else level
            deviation, gain = z - level, (p + 1e-2) / (p + 1e-2 + 0.5)
            level, p = level + gain * deviation, (1 - gain) * (p + 1e-2)
        r = got["a", i]
        assert (r.filtered is None) == (level is None) and (level is None or math.isclose(r.filtered, level, rel_tol=1e-9)), i
        assert (r.deviation is None) == (deviation is None) and (deviation is None or math.isclose(r.deviation, deviation, abs_tol=1e-8)), i
    assert got["b", 0].filtered == 5.0 and got["b", 0].deviation == 0.0 and got["c", 0].filtered is None


def test_pair_sizes(spark):
    rows = [("a", "b", i, 100.0 + i % 3, 40.0, 0.01 * (-1) ** i, 0.02 * (-1) ** i) for i in range(25)] + [("c", "d", 0, 0.0, 5.0, None, None), ("e", "f", 0, 1e9, 5.0, None, None)]
    df = spark.createDataFrame(rows, "a1 string, a2 string, dt long, c1 double, c2 double, r1 double, r2 double")
    got = {(r.a1, r.dt): r for r in portfolio.pair_sizes(df).collect()}
    assert math.isclose(got["a", 24].weight1, 2 / 3) and (got["a", 24].n1, got["a", 24].n2) == (int(2e6 / 3 / 10), int(1e6 / 3 / 4))
    assert got["a", 3].weight1 == 0.5, "too few returns"
    assert (got["c", 0].n1, got["c", 0].n2) == (1, 1) and (got["e", 0].n1, got["e", 0].n2) == (1, 1_000_000)
