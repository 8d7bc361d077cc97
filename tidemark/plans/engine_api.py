"""Engine: whole backtests by mode, from a dict or YAML file to tables on disk."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import combine, crosssection, metrics, pairs, portfolio, report, timeseries
from ..sources import bars as B


class Mode(Enum):
    """What a task runs: one or several factors on assets one by one, across assets or on pairs."""

    SINGLE_TS = "single_factor_single_asset_ts"
    MULTI_TS = "multi_factor_single_asset_ts"
    MULTI_ASSET_TS = "multi_factor_multi_asset_ts"
    SINGLE_XS = "single_factor_xs"
    MULTI_XS = "multi_factor_xs"
    PAIR = "pair_factor"


@dataclass
class Task:
    mode: Mode
    factors: list[str]
    params: dict = field(default_factory=dict)  # factor -> parameters
    assets: list[str] = field(default_factory=list)
    sectors: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    start: str | None = None
    end: str | None = None
    capital: float = 1e6
    cost: float = 0.001
    liquidity: str | None = None

    @staticmethod
    def of(config: dict) -> Task:
        known = {k: v for k, v in config.items() if k in Task.__dataclass_fields__}
        if unknown := set(config) - set(known):
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return Task(**known | {"mode": Mode(config["mode"]), "pairs": [tuple(p) for p in config.get("pairs", [])]})

    @staticmethod
    def read(path: str) -> Task:
        import yaml

        with open(path, encoding="utf-8") as f:
            return Task.of(yaml.safe_load(f))


KINDS = {"time_series": timeseries.FACTORS, "cross_sectional": crosssection.FACTORS, "pair_trading": pairs.FACTORS}


def register(name: str, kind: str):
    """Decorator: a builder (bars or pair bars, **params) -> values becomes a factor."""

    def add(f):
        KINDS[kind][name] = f
        return f

    return add


def kind_of(name: str) -> str:
    found = next((k for k, fs in KINDS.items() if name in fs), None)
    if found is None:
        raise KeyError(f"no factor {name!r}")
    return found


def list_factors(kind: str | None = None) -> list[str]:
    return sorted(n for k, fs in KINDS.items() if kind in (None, k) for n in fs)


@dataclass
class Result:
    """Lazy tables of a run."""

    values: DataFrame
    daily: DataFrame
    performance: DataFrame
    yearly: DataFrame
    trades: DataFrame | None = None

    def save(self, path: str, run_id: str, formats=("parquet",)) -> None:
        """Each table under path/format/table/run_id=...; earlier runs stay."""
        for name, df in vars(self).items():
            for fmt in formats if df is not None else ():
                df.write.mode("overwrite").format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(f"{path}/{fmt}/{name}/run_id={run_id}")

    def metrics_json(self) -> str:
        """One object for each row of performance: a handful of keys, so they may come to the driver."""
        rows = self.performance.select(F.to_json(F.struct("*"))).collect()
        return json.dumps([json.loads(r[0]) for r in rows])


def saved(spark, path: str, table: str, run_id: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A saved table of one run, the last by name if none is given."""
    df = spark.read.format(fmt).options(**({"header": "true", "inferSchema": "true"} if fmt == "csv" else {})).load(f"{path}/{fmt}/{table}")
    runs = df.withColumn("run_id", F.col("run_id").cast("string"))
    if run_id is None:
        run_id = runs.agg(F.max("run_id")).first()[0]
    return runs.where(F.col("run_id") == run_id)


class Engine:
    def __init__(self, bars: DataFrame):
        self.bars = bars

    def _bars(self, task: Task) -> DataFrame:
        bars = B.selected(self.bars, task.assets, task.sectors)
        if task.liquidity:
            bars = bars.join(B.liquid(bars, task.liquidity).select("asset"), "asset", "left_semi")
        return bars

    def _range(self, df: DataFrame, task: Task) -> DataFrame:
        """The asked dates, cut after the windows have seen what lies before."""
        if task.start:
            df = df.where(F.col("dt") >= F.lit(task.start).cast("date"))
        return df.where(F.col("dt") <= F.lit(task.end).cast("date")) if task.end else df

    def values(self, task: Task, bars: DataFrame) -> DataFrame:
        """factor, factor_type, category, scope, asset, dt, value of the task's single-asset and cross-sectional factors."""
        out = None
        for name in task.factors:
            kind = kind_of(name)
            df = KINDS[kind][name](bars, **task.params.get(name, {}))
            df = df.select(F.lit(name).alias("factor"), F.lit(kind).alias("factor_type"), F.lit(kind).alias("category"), F.lit("common").alias("scope"), "asset", "dt", "value")
            out = df if out is None else out.unionByName(df)
        return out

    def run(self, task: Task) -> Result:
        bars = self._bars(task)
        if task.mode == Mode.PAIR:
            return self._pairs(task, bars)
        values = self.values(task, bars)
        if len(task.factors) == 1:
            signal = values.select("asset", "dt", "value")
        else:
            signal = combine.combined(values).select("asset", "dt", F.col("signal").alias("value"))
        if task.mode in (Mode.SINGLE_XS, Mode.MULTI_XS):
            daily = self._range(portfolio.long_short_backtest(bars, signal, capital=task.capital).select("dt", "ret"), task)
            return self._result(values, portfolio.equity(daily, task.capital), ())
        positions = self._range(portfolio.signal_backtest(bars, signal, cost=task.cost, capital=task.capital), task)
        trades = metrics.position_trades(positions)
        return self._result(values, positions, ("asset",), trades)

    def _pairs(self, task: Task, bars: DataFrame) -> Result:
        listed = B.pair_list(bars.sparkSession, task.pairs) if task.pairs else pairs.select_pairs(bars).select("a1", "a2")
        legs = B.pair_bars(bars, listed)
        values = self.pair_values(task, bars, legs)
        return self._result(values, self._range(portfolio.pair_backtest(legs, values, capital=task.capital), task), ("a1", "a2"))

    def pair_values(self, task: Task, bars: DataFrame, legs: DataFrame) -> DataFrame:
        """a1, a2, dt, value: the mean of the task's pair factors, and if it has others half the difference of their legs' signals."""
        of_pairs = [n for n in task.factors if kind_of(n) == "pair_trading"]
        if not of_pairs:
            raise ValueError("a task on pairs needs a pair factor")
        found = None
        for name in of_pairs:
            df = KINDS["pair_trading"][name](legs, **task.params.get(name, {})).select("a1", "a2", "dt", "value")
            found = df if found is None else found.unionByName(df)
        if len(of_pairs) > 1:
            found = found.groupBy("a1", "a2", "dt").agg(F.avg("value").alias("value"))
        others = [n for n in task.factors if n not in of_pairs]
        if not others:
            return found
        single = combine.combined(self.values(replace(task, factors=others), bars))
        return combine.with_pairs(found, single).withColumnRenamed("signal", "value")

    def report(self, task: Task, result: Result, config: str = "") -> DataFrame:
        """Summary rows of a run that has one equity curve."""
        names = [f"{a}-{b}" for a, b in task.pairs] or task.assets
        return report.summary(result.daily.select("dt", "equity"), task.mode.value, task.factors, names, task.start or "", task.end or "", config)

    def _result(self, values: DataFrame, daily: DataFrame, keys: tuple, trades: DataFrame | None = None) -> Result:
        rets = daily.select(*keys, "dt", "ret")
        return Result(values, daily, metrics.performance(rets, keys), metrics.yearly(rets, keys), trades)
