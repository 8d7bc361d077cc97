"""Whole backtests by mode."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans.engine_api import Engine, Mode, Task, kind_of, list_factors, register, saved
from tidemark.sources import bars as B

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    pytest.importorskip("duckdb")
    return Engine(B.daily_bars(spark, DATA).cache())


def test_registry():
    assert len(list_factors()) >= 35 and kind_of("HurstExponent") == "time_series"
    with pytest.raises(KeyError):
        kind_of("nothing")

    @register("CloseLevel", "time_series")
    def close_level(bars, scale=1.0):
        return bars.select("asset", "dt", (F.col("close") * scale).alias("value"))

    assert "CloseLevel" in list_factors("time_series")


def test_task_options():
    task = Task.of({"mode": "pair_factor", "factors": ["StyleMomentumPairFactor"], "pairs": [["Brand#1", "Brand#2"]]})
    assert task.mode is Mode.PAIR and task.pairs == [("Brand#1", "Brand#2")]
    with pytest.raises(ValueError):
        Task.of({"mode": "pair_factor", "factors": [], "typo": 1})


def test_cross_section_is_saved(spark, engine, tmp_path):
    result = engine.run(Task(Mode.MULTI_XS, ["VolatilityFactor", "AmplitudeFactor"], start="1996-01-01", end="1999-12-31"))
    result.save(str(tmp_path), "r1", ("parquet", "csv"))
    assert saved(spark, str(tmp_path), "daily").agg(F.min("dt")).first()[0].year == 1996
    assert saved(spark, str(tmp_path), "yearly", "r1", "csv").count() == 5
    assert len(json.loads(result.metrics_json())) == 1


def test_single_assets_and_pairs(engine):
    one = engine.run(Task(Mode.MULTI_TS, ["AmivestFactor", "VCRRTimeSeriesFactor"], assets=["Brand#1", "Brand#2"]))
    assert one.performance.count() == 2 and one.trades.count() > 0
    pair = engine.run(Task(Mode.PAIR, ["StyleMomentumPairFactor"], pairs=[("Brand#1", "Brand#2")]))
    assert pair.performance.count() == 1
    rows = engine.report(Task(Mode.PAIR, ["StyleMomentumPairFactor"], pairs=[("Brand#1", "Brand#2")]), pair).collect()
    assert rows[0]["Asset_Pool"] == "Brand#1-Brand#2" and {r["Year"] for r in rows} >= {"1997", "Total"}


def test_pairs_of_several_factors(spark, engine):
    pair = ("Brand#1", "Brand#2")
    legs = B.pair_bars(engine.bars, B.pair_list(spark, [pair]))
    names = ["StyleMomentumPairFactor", "EnhancedStyleMomentumPairFactor", "TrendFollowingPairFactor"]
    each = [{r.dt: r.value for r in engine.pair_values(Task(Mode.PAIR, [n]), engine.bars, legs).collect()} for n in names]
    both = {r.dt: r.value for r in engine.pair_values(Task(Mode.PAIR, names), engine.bars, legs).collect()}
    assert both.keys() == each[0].keys() and all(abs(both[d] - sum(e[d] for e in each) / 3) < 1e-12 for d in both) and len(both) > 10
    task = Task(Mode.PAIR, [names[0], "TimeSeriesMomentumFactor"], {"TimeSeriesMomentumFactor": {"window": 20}}, pairs=[pair])
    mixed = {r.dt: r.value for r in engine.pair_values(task, engine.bars, legs).collect()}
    momentum = {(r.asset, r.dt): r.value for r in engine.values(Task(Mode.SINGLE_XS, ["TimeSeriesMomentumFactor"], task.params), engine.bars).collect()}
    clip = lambda v: max(-1.0, min(1.0, v))
    signal = {k: clip(0.35 * v) for k, v in momentum.items()}
    want = {d: clip(0.7 * each[0][d] + 0.3 * (signal[pair[0], d] - signal[pair[1], d]) / 2) for d in each[0] if (pair[0], d) in signal and (pair[1], d) in signal}
    assert mixed.keys() == want.keys() and all(abs(mixed[d] - want[d]) < 1e-9 for d in want) and len(want) > 5
    assert engine.run(task).performance.count() == 1
    with pytest.raises(ValueError):
        engine.run(Task(Mode.PAIR, ["TimeSeriesMomentumFactor"], pairs=[pair])).performance.count()
