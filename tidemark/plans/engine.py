"""Queries of the analytics engine over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cols as C
from ..operators import combine, crosssection, joins, metrics, normalize, pairs, portfolio, quantiles, report, scan, timeseries
from ..sources import bars as B
from ..sources import runlog
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, so that sums in another order compare equal; minus zero becomes zero."""
    return df.select(*((F.round(c, DIGITS) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = unsigned_zero(sql)


def unsigned_zero(sql: str) -> str:
    """Rounded values plus 0, which turns minus zero into zero."""
    return re.sub(r", ([26])\) (AS|ELSE)\b", r", \1) + 0 \2", sql)


def on_bars(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(B.daily_bars(spark, sf_dir))


def on_pairs(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(B.pair_bars(B.daily_bars(spark, sf_dir), B.pair_list(spark)))


def on_all_pairs(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return on_bars(lambda b: f(pairs.all_legs(b)))


def value(expr: str, frm: str = "rets", where: str = "") -> str:
    return f"SELECT asset, dt, {expr} AS value FROM {frm} {where}"


# --- bars and columns -------------------------------------------------------------------------------------------------
add("bars_daily", on_bars(lambda b: b), S.query("SELECT asset, dt, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, volume, round(amount,6) AS amount, long_pos, short_pos, oi, sector, round(close_next,6) AS close_next FROM bars"))
add(
    "bars_hourly_events",
    B.hourly_events,
    "SELECT event_type AS asset, date_trunc('hour', ts) AS dt, round(arg_min(value, row(ts, event_id)),6) AS open, round(max(value),6) AS high, round(min(value),6) AS low, round(arg_max(value, row(ts, event_id)),6) AS close, count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2",
)
_col = lambda c: on_bars(lambda b: b.withColumn("r", C.change("close")).select("asset", "dt", c().alias("value")))
add("ret_simple", _col(lambda: F.col("r")), S.query(value("round(r, 6)")))
add("ret_log", _col(lambda: C.log_change("close")), S.query(value(f"round(ln(close / {S.lag('close')}), 6)", "bars")))
add("roll_vol", _col(lambda: C.std("r", 20)), S.query(value(f"round({S.full('stddev_samp({})', 'r', 20)}, 6)")))
_rolled = lambda n, q, least: on_bars(lambda b: quantiles.rolling_quantile(b.select("asset", "dt", C.change("close").alias("r")), "r", n, q, least=least).select("asset", "dt", "value"))
add("roll_quantile", _rolled(20, 0.8, 20), S.query(value(f"round(CASE WHEN count(r) {S.w(20)} = 20 THEN quantile_cont(r, 0.8) {S.w(20)} END, 6)")))
add("roll_quantile_long", _rolled(1000, 0.35, 60), S.query(value(f"round(CASE WHEN count(r) {S.w(1000)} >= 60 THEN quantile_cont(r, 0.35) {S.w(1000)} END, 6)")))
add("skew_corrected", _col(lambda: F.when(C.age() > 60, C.skew(F.col("r"), F.count("r").over(C.last(60)), C.last(60)))), S.query(value(f"CASE WHEN i > 60 THEN round(skewness(r) {S.w(60)}, 6) END")))
add("kurt_corrected", _col(lambda: F.when(C.age() > 60, C.kurt(F.col("r"), F.count("r").over(C.last(60)), C.last(60)))), S.query(value(f"CASE WHEN i > 60 THEN round(kurtosis(r) {S.w(60)}, 6) END")))
add("roll_mean_any", _col(lambda: C.mean("r", 20, least=1)), S.query(value(f"round(avg(r) {S.w(20)}, 6)")))
add(
    "atr",
    on_bars(lambda b: b.withColumn("tr", C.true_range()).select("asset", "dt", C.mean("tr", 14).alias("value"))),
    S.query(value(f"round({S.full('avg({})', 'tr', 14)}, 6)", "t"), f"t AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM (SELECT *, {S.lag('close')} AS pc FROM bars))"),
)
add("weighted_mean", _col(lambda: C.weighted_mean("close", 10)), S.query(value(f"round(({' + '.join(f'{S.lag("close", k)} * {10 - k}' if k else 'close * 10' for k in range(10))}) / 55, 6)")))
add("asset_drawdown", on_bars(lambda b: b.select("asset", "dt", C.drawdown("close", ["asset"]).alias("value"))), S.query(value("round(close / max(close) OVER (PARTITION BY asset ORDER BY dt) - 1, 6)")))
add("avgrank", on_bars(lambda b: b.select("asset", "dt", C.average_rank("volume").alias("value"))), S.query(value(f"round({S.pct_rank('volume')}, 6)")))
add("ord_rank", on_bars(lambda b: b.select("asset", "dt", C.ordinal_rank("volume").alias("value"))), S.query(value("CASE WHEN n > 1 THEN round((k - 1) / (n - 1.0) * 2 - 1, 6) ELSE 0 END", "(SELECT asset, dt, row_number() OVER (PARTITION BY dt ORDER BY volume, asset) AS k, count(*) OVER (PARTITION BY dt) AS n FROM bars)")))
add("asset_list", on_bars(lambda b: b.select("asset").distinct()), "SELECT DISTINCT p_brand AS asset FROM lineitem JOIN part ON l_partkey = p_partkey")
add("selected_range", on_bars(lambda b: B.padded_range(B.selected(b, ["Brand#1"], ["sector2"]), "1998-01-01", "1998-12-31", 0).select("asset", "dt", "close")), S.query("SELECT asset, dt, round(close,6) AS close FROM bars WHERE (asset = 'Brand#1' OR sector = 'sector2') AND dt BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"))
add(
    "as_of_prices",
    on_bars(lambda b: B.as_of_prices(b)),
    S.query("SELECT asset, dt, round(close, 6) AS close FROM grid ASOF JOIN bars USING (asset, dt)", "grid AS (SELECT * FROM (SELECT DISTINCT asset FROM bars) CROSS JOIN (SELECT DISTINCT dt FROM bars))").replace("SELECT asset, dt, round(close, 6)", "SELECT grid.asset, grid.dt, round(close, 6)"),
)
add(
    "bars_industry",
    lambda spark, sf_dir: B.with_industry(B.daily_bars(spark, sf_dir).drop("sector"), B.industries(spark, sf_dir)).select("asset", "dt", "close", "sector"),
    S.query(
        "SELECT asset, dt, round(close, 6) AS close, coalesce(s, 'unknown') AS sector FROM bars LEFT JOIN tops USING (asset)",
        "sizes AS (SELECT p_brand AS asset, p_size // 10 AS size, count(*) AS n FROM part GROUP BY 1, 2)",
        "tops AS (SELECT asset, 'size' || size AS s FROM (SELECT *, sum(n) OVER (PARTITION BY asset) AS parts FROM sizes) WHERE n >= 0.25 * parts QUALIFY row_number() OVER (PARTITION BY asset ORDER BY n DESC, size DESC) = 1)",
    ),
)
add("liquidity_strict", on_bars(lambda b: B.liquid(b, min_volume=38, min_oi=700)), S.query("SELECT * FROM (SELECT asset, round(avg(volume),6) AS avg_volume, round(avg(oi),6) AS avg_oi FROM bars GROUP BY asset) WHERE avg_volume >= 38 AND avg_oi >= 700"))
add("liquidity_percentile", on_bars(lambda b: B.liquid(b, "percentile")), S.query("SELECT asset, round(v,6) AS avg_volume, round(o,6) AS avg_oi FROM (SELECT *, percent_rank() OVER (ORDER BY v) AS s FROM (SELECT asset, avg(volume) AS v, avg(oi) AS o FROM bars GROUP BY asset)) WHERE s >= 0.5"))
add("liquidity_composite", on_bars(lambda b: B.liquid(b, "composite")), S.query("SELECT asset, round(v,6) AS avg_volume, round(o,6) AS avg_oi FROM (SELECT *, (percent_rank() OVER (ORDER BY v) + percent_rank() OVER (ORDER BY o)) / 2 AS s FROM (SELECT asset, avg(volume) AS v, avg(oi) AS o FROM bars GROUP BY asset)) WHERE s >= 0.5"))

add(
    "kalman_level",
    on_bars(lambda b: scan.filtered_level(b.select("asset", "dt", "close"))),
    S.query(
        "SELECT asset, dt, round(close, 6) AS close, round(x, 6) AS filtered, round(close - before, 6) AS deviation FROM level",
        "gains(i, k, p) AS (SELECT 1, 1.0::DOUBLE, (1 - (1 + 1e-5) / (1 + 1e-5 + 1e-3)) * (1 + 1e-5) UNION ALL"
        " SELECT i + 1, (p + 1e-5) / (p + 1e-5 + 1e-3), (1 - (p + 1e-5) / (p + 1e-5 + 1e-3)) * (p + 1e-5) FROM gains WHERE i < (SELECT max(i) FROM rets))",
        "steps AS MATERIALIZED (SELECT asset, dt, close, i, k FROM rets JOIN gains USING (i))",
        "level(asset, dt, close, i, x, before) AS (SELECT asset, dt, close, i, close, close FROM steps WHERE i = 1 UNION ALL"
        " SELECT s.asset, s.dt, s.close, s.i, l.x + s.k * (s.close - l.x), l.x FROM level l JOIN steps s ON s.asset = l.asset AND s.i = l.i + 1)",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)

# --- time-series factors ----------------------------------------------------------------------------------------------
TS = timeseries.FACTORS
_emd = ", ".join([*(f"close - avg(close) {S.w(k)} AS d{k}" for k in (3, 5)), *(f"avg(close) {S.w(k)} AS m{k}" for k in (10, 20, 30))])
_noise = " + ".join(f"var_pop(d{k}) {S.w(61 - k)}" for k in (3, 5))
_trend = " + ".join(f"var_pop(m{k}) {S.w(61 - k)}" for k in (10, 20, 30))
_ib = [
    "ib1 AS (SELECT *, {mom} AS mom, {vol} AS vol FROM rets)",
    "ib2 AS (SELECT *, {vm} AS vm FROM ib1)",
    "ib3 AS (SELECT *, CASE WHEN count(vm) {w60} = 60 THEN quantile_cont(vm, 0.8) {w60} END AS q FROM ib2)",
    "ib4 AS (SELECT *, CASE WHEN coalesce(vm <= q, false) THEN -mom ELSE mom END AS base FROM ib3)",
    "ib5 AS (SELECT *, {m} AS m, {s} AS s FROM ib4)",
    "ib6 AS (SELECT *, {am} AS am, {as_} AS as_ FROM (SELECT *, abs(m) AS absm FROM ib5))",
]


def _behaviour(mom_w=1, revs_w=3, mean_w=10, std_w=5, weight=0.7, forget=False) -> str:
    history = max(mom_w + revs_w + 10 + 60 + mean_w + std_w, 150)
    weighted = "(" + " + ".join(f"{S.lag('vol', k)} * {10 - k}" if k else "vol * 10" for k in range(10)) + ") / 55"
    parts = dict(
        mom=S.full("avg({})", "r", mom_w), vol=S.full("stddev_samp({})", "r", revs_w), vm=weighted if forget else S.full("avg({})", "vol", 10), w60=S.w(60),
        m=S.full("avg({})", "base", mean_w), s=S.full("stddev_samp({})", "base", std_w), am=S.full("avg({})", "absm", 20), as_=S.full("avg({})", "s", 20),
    )
    return S.query(value(S.guarded(f"{weight} * m / nullif(am, 0) + {1 - weight} * s / nullif(as_, 0)", history, -3, 3), "ib6"), *(c.format(**parts) for c in _ib))


_wma = lambda n: "(" + " + ".join(f"{S.lag('close', k)} * {n - k}" if k else f"close * {n}" for k in range(n)) + f") / {n * (n + 1) // 2}"
TS_SQL = {
    "EMDTrend": S.query(value(S.guarded(f"CASE WHEN noise + trend < 1e-10 THEN 0.5 ELSE trend / (noise + trend) END", 60, neutral=0.5), "e2"), f"e1 AS (SELECT asset, dt, i, {_emd} FROM rets)", f"e2 AS (SELECT asset, dt, i, {_noise} AS noise, {_trend} AS trend FROM e1)"),
    "AmivestFactor": S.query(value(S.guarded("(s1 / (a1 + 1e-10)) / (s2 / (a2 + 1e-10) + 1e-10)", 80, -5, 5), f"(SELECT asset, dt, i, sum(amount) {S.w(12)} AS s1, sum(abs(r)) {S.w(12)} AS a1, sum(amount) {S.w(32)} AS s2, sum(abs(r)) {S.w(32)} AS a2 FROM rets)")),
    "DUVOLFactor": S.query(
        value(S.guarded("ln(dn / (up + 1e-10) + 1e-10)", 200, -5, 5), "d2"),
        f"d2 AS (SELECT asset, dt, i, sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) {S.w(150)} / (sum(CASE WHEN r < 0 THEN 1 ELSE 0 END) {S.w(150)} - 1 + 1e-10) AS dn, sum(CASE WHEN r > 0 THEN r * r ELSE 0 END) {S.w(150)} / (sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) {S.w(150)} - 1 + 1e-10) AS up FROM rets)",
    ),
    "RunsTestFactor": S.query(
        value("CASE WHEN i < 100 THEN 0 WHEN far THEN CASE WHEN coalesce(ma > pma, false) THEN 1 ELSE -1 END ELSE 0 END::DOUBLE", "r4"),
        f"r1 AS (SELECT asset, dt, i, coalesce(r >= 0, false)::INT AS b, round({S.full('avg({})', 'close', 60)}, 9) AS ma FROM rets)",
        f"r2 AS (SELECT *, {S.lag('ma')} AS pma, (b <> {S.lag('b')})::INT AS turn FROM r1)",
        f"r3 AS (SELECT *, sum(b) {S.w(10)}::DOUBLE AS n1, 1 + coalesce(sum(turn) {S.w(9)}, 0) AS runs FROM r2)",
        "r4 AS (SELECT *, coalesce(abs(runs - (2 * n1 * (10 - n1) / 10 + 1)) / sqrt(nullif(2 * n1 * (10 - n1) * (2 * n1 * (10 - n1) - 10), 0) / 900) > 1.959963984540054, false) AS far FROM (SELECT * FROM r3 WHERE 2 * n1 * (10 - n1) > 10 UNION ALL SELECT * REPLACE (0 AS n1) FROM r3 WHERE 2 * n1 * (10 - n1) <= 10))",
    ),
    "InvestorBehaviorTrendFactor": _behaviour(),
    "InvestorBehaviorMomentum": _behaviour(),
    "InvestorBehaviorReversal": _behaviour(60, 10, 5, 5, 0.2, True),
    "MACrossoverInnovationFactor": S.query(
        value("CASE WHEN i >= 60 AND g > 0 AND st = 0 THEN side ELSE 0 END::DOUBLE", "m5"),
        f"m1 AS (SELECT asset, dt, i, close, {_wma(10)} AS f, {_wma(20)} AS s FROM rets)",
        f"m2 AS (SELECT *, CASE WHEN i > 20 AND f > s AND {S.lag('f')} <= {S.lag('s')} THEN 1 WHEN i > 20 AND f < s AND {S.lag('f')} >= {S.lag('s')} THEN -1 END AS x FROM m1)",
        "m3 AS (SELECT *, count(x) OVER (PARTITION BY asset ORDER BY dt) AS g FROM m2)",
        "m4 AS (SELECT *, first(x) OVER (PARTITION BY asset, g ORDER BY dt) AS side, first(close) OVER (PARTITION BY asset, g ORDER BY dt) AS ref FROM m3)",
        "m5 AS (SELECT *, max(CASE WHEN (side = 1 AND close < ref) OR (side = -1 AND close > ref) THEN 1 ELSE 0 END) OVER (PARTITION BY asset, g ORDER BY dt) AS st FROM m4)",
    ),
    "SLMTimingFactor": S.query(
        value("CASE WHEN i > 206 AND h IS NOT NULL THEN sign(coalesce(sum(CASE sym WHEN '2' THEN 1 WHEN '1' THEN -1 END) OVER (PARTITION BY asset, h ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) ELSE 0 END::DOUBLE", "s2"),
        f"s1 AS (SELECT asset, dt, i, CASE WHEN close < {S.lag('close')} THEN '1' WHEN {S.lag('close')} IS NOT NULL THEN '2' END AS sym FROM rets)",
        f"s2 AS (SELECT *, {' || '.join(S.lag('sym', k) for k in range(5, 0, -1))} AS h FROM s1)",
    ),
    "VCRRTimeSeriesFactor": S.query(value(S.guarded(f"greatest(-3, least(3, (d - {S.full('avg({})', 'd', 20)}) / ({S.full('stddev_samp({})', 'd', 20)} + 1e-10))) / 3", 40), "(SELECT asset, dt, i, amount / (volume + 1e-10) - close AS d FROM rets)")),
}
_prices = f"(SELECT *, list(close) {S.w(60)} AS l FROM rets)"
_times = lambda weights: "list_dot_product(l, " + repr([float(x) for x in weights]) + "::DOUBLE[])"
_spread = "[" + ", ".join(_times(w) for w in timeseries.kalman_weights(60, 1e-5, 1e-3)[-20:]) + "]"
TS_SQL["KalmanFilterDeviation"] = S.query(
    value("CASE WHEN i >= 60 AND list_stddev_pop(e) >= 1e-10 THEN round(greatest(-5, least(5, (e[20] - list_avg(e)) / list_stddev_pop(e))), 6) ELSE 0 END", "kd"),
    f"kd AS (SELECT asset, dt, i, CASE WHEN i >= 60 THEN {_spread} END AS e FROM {_prices})",
)
TS_SQL["KalmanTrendFollower"] = S.query(value(f"CASE WHEN i >= 60 AND abs(list_avg(l)) >= 1e-10 THEN round(greatest(-1, least(1, {_times(timeseries.trend_weights(60, 1e-4, 1e-2))} * 100 / list_avg(l))), 6) ELSE 0 END", _prices))


def _decayed(c: str, keep: float, frm: str) -> str:
    """Weighted mean of all values of c so far, whose weights shrink with each row, of every row of an asset."""
    return f"SELECT x.asset, x.i, sum(y.{c} * pow({keep!r}, x.i - y.i)) / sum(pow({keep!r}, x.i - y.i)) FILTER (y.{c} IS NOT NULL) AS m FROM {frm} x JOIN {frm} y ON x.asset = y.asset AND y.i <= x.i GROUP BY 1, 2"


TS_SQL["AMIHUDFactor"] = S.query(
    "SELECT asset, dt, CASE WHEN i >= 50 THEN round(coalesce(greatest(-5, least(5, s.m / (g.m + 1e-10))), 0), 6) ELSE 0 END AS value FROM il JOIN s USING (asset, i) JOIN g USING (asset, i)",
    "il AS (SELECT asset, dt, i, r / (amount + 1e-10) AS a FROM rets)", f"s AS ({_decayed('a', 1 - 2 / 3, 'il')})", f"g AS ({_decayed('a', 1 - 2 / 10, 'il')})",
)
TS = {**TS, "RunsTestFactor": lambda b: timeseries.runs_test(b, digits=9)}  # nine digits of the average in both engines
for _k, (_name, _f) in enumerate(TS.items(), 1):
    add(f"ts_T{_k}", on_bars(_f), TS_SQL.get(_name))
_cross = TS_SQL["MACrossoverInnovationFactor"]
_ema = lambda n: f"SELECT x.asset, x.i, sum(y.close * pow({1 - 2 / (n + 1)!r}, x.i - y.i) * CASE WHEN y.i = 1 THEN 1 ELSE {2 / (n + 1)!r} END) AS m FROM rets x JOIN rets y ON x.asset = y.asset AND y.i <= x.i GROUP BY 1, 2"
add("ts_T12_sma", on_bars(lambda b: timeseries.ma_crossover(b, kind="SMA")), _cross.replace(_wma(10), S.full("avg({})", "close", 10)).replace(_wma(20), S.full("avg({})", "close", 20)))
add(
    "ts_T12_ema",
    on_bars(lambda b: timeseries.ma_crossover(b, kind="EMA")),
    _cross.replace(f"SELECT asset, dt, i, close, {_wma(10)} AS f, {_wma(20)} AS s FROM rets", f"SELECT asset, dt, i, close, f.m AS f, s.m AS s FROM rets JOIN ({_ema(10)}) f USING (asset, i) JOIN ({_ema(20)}) s USING (asset, i)"),
)


def _llt(c: str, n: int) -> str:
    """A low-lag line from its last two values, c and p{c}, and three closes."""
    a = 2 / (n + 1)
    return f"CASE WHEN b.i = 2 THEN close ELSE {a - a * a / 4!r} * close + {a * a / 2!r} * c1 - {a - 3 * a * a / 4!r} * c2 + {2 * (1 - a)!r} * {c} - {(1 - a) ** 2!r} * p{c} END"


_llt_cross = _cross.replace("WITH ", "WITH RECURSIVE ", 1).replace(
    f"m1 AS (SELECT asset, dt, i, close, {_wma(10)} AS f, {_wma(20)} AS s FROM rets)",
    f"b AS MATERIALIZED (SELECT asset, dt, i, close, {S.lag('close')} AS c1, {S.lag('close', 2)} AS c2 FROM rets),\n"
    "l AS (SELECT asset, i, close AS f, NULL::DOUBLE AS pf, close AS s, NULL::DOUBLE AS ps FROM b WHERE i = 1 "
    f"UNION ALL SELECT b.asset, b.i, {_llt('f', 10)}, f, {_llt('s', 20)}, s FROM l JOIN b ON b.asset = l.asset AND b.i = l.i + 1),\n"
    "m1 AS (SELECT asset, dt, i, close, f, s FROM l JOIN b USING (asset, i))",
)
add("ts_T12_llt", on_bars(lambda b: timeseries.ma_crossover(b, kind="LLT")), _llt_cross)
add(
    "ts_T12_details",
    on_bars(lambda b: timeseries.ma_crossover_details(b)),
    _cross[: _cross.rindex("SELECT")].rstrip()
    + """, m6 AS (SELECT *, CASE WHEN g > 0 AND st = 0 THEN side ELSE 0 END AS held FROM m5),
m7 AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY asset ORDER BY dt), 0) AS was, CASE WHEN side = 1 THEN 'long' ELSE 'short' END AS name FROM m6)
SELECT asset, dt, round(close, 6) AS close, round(f, 6) AS fast_ma, round(s, 6) AS slow_ma, held::DOUBLE AS signal, CASE WHEN held <> 0 THEN round(ref, 6) END AS ref_price,
  CASE WHEN x IS NOT NULL AND was = x THEN 'update_' || name || '_ref' WHEN x IS NOT NULL THEN 'open_' || name
    WHEN held = 0 AND was = 1 THEN 'stop_long' WHEN held = 0 AND was = -1 THEN 'stop_short' END AS trade_type FROM m7""",
)

# --- the same on slices, where recursions start afresh ------------------------------------------------------------------
_sliced_mean = lambda span: f"list_dot_product(l, {[(1 - 2 / (span + 1)) ** k for k in range(49, -1, -1)]!r}::DOUBLE[]) / {sum((1 - 2 / (span + 1)) ** k for k in range(50))!r}"
add(
    "ts_T3_slice",
    on_bars(lambda b: timeseries.amihud(b, mode="slice")),
    S.query(value(f"CASE WHEN i >= 51 THEN round(greatest(-5, least(5, ({_sliced_mean(2)}) / ({_sliced_mean(9)} + 1e-10))), 6) ELSE 0 END", "s"), f"s AS (SELECT asset, dt, i, list(coalesce(r, 0) / (amount + 1e-10)) {S.w(50)} AS l FROM rets)"),
)
add(
    "ts_T12_slice",
    on_bars(lambda b: timeseries.ma_crossover(b, mode="slice")),
    _cross.replace("AS ref FROM m3", "AS ref, first(i) OVER (PARTITION BY asset, g ORDER BY dt) AS since FROM m3").replace("i >= 60 AND g > 0 AND st = 0", "i >= 61 AND g > 0 AND st = 0 AND i - since <= 40"),
)
add("ts_T12_slice_llt", on_bars(lambda b: timeseries.ma_crossover(b, kind="LLT", mode="slice")))
add(
    "ts_T13_slice",
    on_bars(lambda b: timeseries.slm_timing(b, mode="slice")),
    TS_SQL["SLMTimingFactor"].replace("ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ORDER BY i RANGE BETWEEN 294 PRECEDING AND 1 PRECEDING").replace("i > 206", "i >= 301"),
)
add("ts_T14_slice", on_bars(lambda b: timeseries.price_volume_pattern(b, mode="slice")))
add("ts_T14_price", on_bars(lambda b: timeseries.price_volume_pattern(b, use_volume=False)))

# --- cross-sectional factors ------------------------------------------------------------------------------------------
XS = crosssection.FACTORS


def _xs(raw: str, negative: bool = False, frm: str = "rets") -> str:
    rank = S.pct_rank("raw")
    return S.query(value(f"round({'1 - ' if negative else ''}{rank}, 6)", "x"), f"x AS (SELECT * FROM (SELECT asset, dt, {raw} AS raw FROM {frm}) WHERE raw IS NOT NULL)")


def _xz(raw: str) -> str:
    return S.query(value("round(coalesce((raw - avg(raw) OVER (PARTITION BY dt)) / nullif(stddev_samp(raw) OVER (PARTITION BY dt), 0), 0), 6)", "x"), f"x AS (SELECT * FROM (SELECT asset, dt, {raw} AS raw FROM bars) WHERE raw IS NOT NULL)")


_aged = lambda c, n, least: f"CASE WHEN i > {n} AND count(r) {S.w(n)} >= {least} THEN {c} END"
XS_SQL = {
    "MomentumRank": _xs(f"close / {S.lag('close', 19)} - 1"),
    "TermStructure": _xz("(close - close_next) / close_next"),
    "CrossSectionalMomentumFactor": _xs(f"close / {S.lag('close', 240)} - 1"),
    "TimeSeriesMomentumFactor": S.query(value("round(raw, 6)", "x"), f"x AS (SELECT * FROM (SELECT asset, dt, close / {S.lag('close', 240)} - 1 AS raw FROM bars) WHERE raw IS NOT NULL)"),
    "CompositeMomentumFactor": S.query(
        value("round(CASE WHEN sg > 0 THEN CASE WHEN pr >= 0.6 THEN 0.5 + 0.5 * (pr - 0.6) / 0.4 ELSE 0.25 * pr END WHEN sg < 0 THEN CASE WHEN pr <= 0.4 THEN -0.5 - 0.5 * (0.4 - pr) / 0.4 ELSE -0.25 * (1 - pr) END ELSE 0 END, 6)", "y"),
        f"x AS (SELECT *, sign(raw) AS sg FROM (SELECT asset, dt, close / {S.lag('close', 240)} - 1 AS raw FROM bars) WHERE raw IS NOT NULL)",
        f"y AS (SELECT *, {S.pct_rank('raw', 'dt, sg')} AS pr FROM x)",
    ),
    "BIASFactor": _xs(f"(close - {S.full('avg({})', 'close', 20)}) / ({S.full('stddev_samp({})', 'r', 20)} * {S.lag('close', 20)})"),
    "TrendStrengthFactor": _xs(f"(close - {S.lag('close', 20)}) / nullif({S.full('sum({})', 'step', 20)}, 0)", frm=f"(SELECT *, abs(close - {S.lag('close')}) AS step FROM bars)"),
    "VolatilityFactor": _xs(_aged(f"stddev_samp(r) {S.w(10)}", 10, 8)),
    "CVFactor": _xs(_aged(f"var_samp(r) {S.w(5)} / nullif(abs(avg(r) {S.w(5)}), 0)", 5, 4)),
    "SkewnessFactor": _xs(_aged(f"skewness(r) {S.w(10)}", 10, 8), True),
    "KurtosisFactor": _xs(_aged(f"kurtosis(r) {S.w(60)}", 60, 48), True),
    "AmplitudeFactor": _xs(S.full("avg({})", "a", 5), frm="(SELECT *, (high - close) / close AS a FROM bars)"),
    "LiquidityFactor": _xs("volume / nullif(abs(r), 0)", True),
    "VCRRFactor": S.query(
        value("CASE WHEN sd IS NULL THEN 0 ELSE round(greatest(-3, least(3, (v - m) / (sd + 1e-10))) / 3, 6) END", "(SELECT *, avg(v) OVER (PARTITION BY dt) AS m, stddev_samp(v) OVER (PARTITION BY dt) AS sd FROM z)"),
        "x AS (SELECT asset, dt, amount / volume - close AS d, amount / volume + close AS s FROM bars WHERE volume > 0)",
        f"z AS (SELECT asset, dt, {S.pct_rank('d')} / ({S.pct_rank('s')} + 1e-10) AS v FROM x)",
    ),
    "MemberHoldings": _xz("(long_pos - short_pos) / nullif(long_pos + short_pos, 0)"),
}
for _k, (_name, _f) in enumerate(XS.items(), 1):
    add(f"xs_X{_k}", on_bars(_f), XS_SQL.get(_name))
add(
    "xs_long_short",
    on_bars(lambda b: crosssection.long_short(crosssection.composite_momentum(b, window=60))),
    S.query(
        "SELECT asset, dt, sv::INT AS side FROM (SELECT *, row_number() OVER (PARTITION BY dt, sv ORDER BY abs(value) DESC, asset) AS k, greatest(1, floor(count(*) OVER (PARTITION BY dt, sv) * 0.2)) AS n FROM (SELECT *, sign(value) AS sv FROM v WHERE value <> 0)) WHERE k <= n",
        f"x AS (SELECT *, sign(raw) AS sg FROM (SELECT asset, dt, close / {S.lag('close', 60)} - 1 AS raw FROM bars) WHERE raw IS NOT NULL)",
        f"y AS (SELECT *, {S.pct_rank('raw', 'dt, sg')} AS pr FROM x)",
        "v AS (SELECT asset, dt, CASE WHEN sg > 0 THEN CASE WHEN pr >= 0.6 THEN 0.5 + 0.5 * (pr - 0.6) / 0.4 ELSE 0.25 * pr END WHEN sg < 0 THEN CASE WHEN pr <= 0.4 THEN -0.5 - 0.5 * (0.4 - pr) / 0.4 ELSE -0.25 * (1 - pr) END ELSE 0 END AS value FROM y)",
    ),
)

# --- pairs ------------------------------------------------------------------------------------------------------------
_pk = "a1, a2"
_lagp = lambda c, k=1: S.lag(c, k, _pk)
_corr = "cr AS (SELECT x.asset AS a1, y.asset AS a2, corr(x.r, y.r) AS corr, count(*) AS n FROM rets x JOIN rets y ON x.dt = y.dt AND x.asset < y.asset WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20)"
_corr_bars = on_bars(lambda b: pairs.correlations(b))
add("pair_bars", on_pairs(lambda p: p), S.query("SELECT a1, a2, dt, round(c1,6) AS c1, round(r1,6) AS r1, round(c2,6) AS c2, round(r2,6) AS r2 FROM legs", pairs=True))
add("pair_corr", _corr_bars, S.query("SELECT a1, a2, round(corr, 6) AS corr, n FROM cr", _corr))
add("pair_matrix", on_bars(lambda b: pairs.mirrored(pairs.correlations(b))), S.query("SELECT a1, a2, round(corr, 6) AS corr, n FROM cr UNION ALL SELECT a2, a1, round(corr, 6), n FROM cr", _corr))
add("best_partner", on_bars(lambda b: pairs.best_partner(pairs.correlations(b), -1.0)), S.query("SELECT a1, a2, round(corr, 6) AS corr, n FROM (SELECT *, row_number() OVER (PARTITION BY a1 ORDER BY corr DESC, a2) AS k FROM (SELECT * FROM cr UNION ALL SELECT a2, a1, corr, n FROM cr)) WHERE k = 1", _corr))
add(
    "select_pairs",
    on_bars(lambda b: pairs.select_pairs(b, "correlation_only", least=-1.0, top=2)),
    S.query("SELECT sector, a1, a2, round(corr, 6) AS score FROM (SELECT cr.*, s1.sector, row_number() OVER (PARTITION BY s1.sector ORDER BY corr DESC, a1, a2) AS k FROM cr JOIN sec s1 ON s1.asset = a1 JOIN sec s2 ON s2.asset = a2 WHERE s1.sector = s2.sector) WHERE k <= 2", _corr, "sec AS (SELECT DISTINCT asset, sector FROM bars)"),
)
add(
    "select_pairs_composite",
    on_bars(lambda b: pairs.select_pairs(b, "composite", least=-1.0)),
    S.query(
        "SELECT sector, a1, a2, round(score, 6) AS score FROM (SELECT s1.sector, cr.a1, cr.a2, corr - rho AS score, row_number() OVER (PARTITION BY s1.sector ORDER BY corr - rho DESC, cr.a1, cr.a2) AS k FROM cr JOIN ac ON ac.a1 = cr.a1 AND ac.a2 = cr.a2 JOIN sec s1 ON s1.asset = cr.a1 JOIN sec s2 ON s2.asset = cr.a2 WHERE s1.sector = s2.sector) WHERE k = 1",
        _corr, "sec AS (SELECT DISTINCT asset, sector FROM bars)",
        "lg AS (SELECT x.asset AS a1, y.asset AS a2, x.dt, ln(x.close / y.close) AS x FROM bars x JOIN bars y ON x.dt = y.dt AND x.asset < y.asset)",
        f"ac AS (SELECT a1, a2, corr(x, px) AS rho FROM (SELECT *, {_lagp('x')} AS px FROM lg) GROUP BY 1, 2)",
    ),
)
add("close_table", on_bars(lambda b: B.close_table(b, [a for p in B.PAIRS for a in p])), S.query("SELECT * FROM (SELECT dt, " + ", ".join(f"round(avg(close) FILTER (asset = '{a}'), 6) AS \"{a}\"" for p in B.PAIRS for a in p) + " FROM bars GROUP BY dt) WHERE " + " AND ".join(f'"{a}" IS NOT NULL' for p in B.PAIRS for a in p)))
PAIR_SQL = {
    "TrendFollowingPairFactor": S.query(
        "SELECT a1, a2, dt, " + S.guarded(f"10 * (f - s) / s + 5 * (f - {_lagp('f', 4)}) / {_lagp('f', 4)}", 35, -1, 1) + " AS value FROM t",
        f"t AS (SELECT a1, a2, dt, i, {S.full('avg({})', 'x', 10, _pk)} AS f, {S.full('avg({})', 'x', 30, _pk)} AS s FROM (SELECT *, c1 / greatest(c2, 1e-10) AS x FROM legs))",
        pairs=True,
    ),
    "StyleMomentumPairFactor": S.query(f"SELECT a1, a2, dt, coalesce(sign((c1 / {_lagp('c1')} - 1) - (c2 / {_lagp('c2')} - 1)), 0)::DOUBLE AS value FROM legs", pairs=True),
    "EnhancedStyleMomentumPairFactor": S.query(
        f"SELECT a1, a2, dt, CASE WHEN d IS NULL THEN 0 ELSE round(greatest(-1, least(1, CASE WHEN abs(d) >= 0.001 THEN sign(d) ELSE 0 END * coalesce(greatest(0.5, least(2, {0.15 / 252**0.5!r} / nullif({S.full('stddev_samp({})', 'dx', 20, _pk)}, 0))), 1))), 6) END AS value FROM t",
        f"t AS (SELECT *, x / {_lagp('x')} - 1 AS dx FROM (SELECT *, (c1 / {_lagp('c1')} - 1) - (c2 / {_lagp('c2')} - 1) AS d, c1 / c2 AS x FROM legs))",
        pairs=True,
    ),
}
for _k, (_name, _f) in enumerate(pairs.FACTORS.items(), 1):
    if _name in PAIR_SQL:  # the SQL is of the listed pairs
        add(f"pair_R{_k}", on_pairs(_f), PAIR_SQL[_name])
        add(f"pair_R{_k}_all", on_all_pairs(_f), S.of_all_pairs(PAIR_SQL[_name]))
add("pair_R1", on_bars(pairs.copula_universe))
add("pair_R2_universe", on_bars(pairs.trend_universe))
add("pair_R10", on_all_pairs(pairs.copula_fits))
add("pair_R3", on_all_pairs(pairs.kalman_pair))
add("pair_R3_rule2", on_all_pairs(lambda p: pairs.kalman_pair(p, rule=2)))
add("pair_R3_rule3", on_all_pairs(lambda p: pairs.kalman_pair(p, rule=3)))

# --- normalisers and combination --------------------------------------------------------------------------------------
_section = on_bars(lambda b: b.select("asset", "dt", F.col("volume").alias("value")))


def _norm(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(_section(spark, sf_dir))


def _norm_sql(e: str) -> str:
    return S.query(f"SELECT asset, dt, value, round({e}, 6) AS norm FROM (SELECT asset, dt, volume AS value FROM bars)")


_day = "OVER (PARTITION BY dt)"
for _n, _sd in (("n_zscore", "stddev_samp"), ("n_zscore_array", "stddev_pop")):
    add(_n, _norm(lambda d, p=_n.endswith("array"): normalize.zscore_clip(d, population=p)), _norm_sql(f"greatest(-3, least(3, coalesce((value - avg(value) {_day}) / nullif({_sd}(value) {_day}, 0), 0))) / 3"))
add("n_minmax", _norm(normalize.minmax), _norm_sql(f"2 * coalesce((value - min(value) {_day}) / nullif(max(value) {_day} - min(value) {_day}, 0), 0.5) - 1"))
add("n_rank", _norm(normalize.rank), _norm_sql(f"2 * {S.pct_rank('value')} - 1"))
add("n_rank_array", _norm(normalize.rank_array), _norm_sql(f"2 * coalesce(({S.pct_rank('value')} * count(*) {_day} - 1) / nullif(count(*) {_day} - 1, 0), 0) - 1"))
add("n_winsorize", _norm(lambda d: normalize.winsorize(d, lo=0.1, hi=0.9)), _norm_sql(f"greatest(quantile_cont(value, 0.1) {_day}, least(quantile_cont(value, 0.9) {_day}, value))"))
for _n, _by in (("n_winsorize_sector", ["sector"]), ("n_winsorize_all", [])):
    _whole = f"OVER ({'PARTITION BY sector' if _by else ''})"
    add(_n, on_bars(lambda b, by=_by: quantiles.clipped_to_quantiles(b.select("asset", "sector", "dt", C.change("close").alias("value")), "value", 0.02, 0.97, by).select("asset", "dt", "value", "norm")),
        S.query(f"SELECT asset, dt, round(value, 6) AS value, round(CASE WHEN value IS NOT NULL THEN greatest(quantile_cont(value, 0.02) {_whole}, least(quantile_cont(value, 0.97) {_whole}, value)) END, 6) AS norm FROM (SELECT *, r AS value FROM rets)"))
add("n_clip", on_bars(lambda b: b.select("asset", "dt", normalize.scalar_clip(C.change("close") * 20).alias("norm"))), S.query("SELECT asset, dt, CASE WHEN r IS NULL THEN 0 ELSE round(greatest(-1, least(1, r * 20)), 6) END AS norm FROM rets"))


def _factor_values(b: DataFrame) -> DataFrame:
    def one(df: DataFrame, name: str, kind: str, category: str) -> DataFrame:
        return df.select(F.lit(name).alias("factor"), F.lit(kind).alias("factor_type"), F.lit(category).alias("category"), F.lit("common").alias("scope"), "asset", "dt", "value")

    return one(timeseries.amivest(b), "amivest", "time_series", "liquidity").unionByName(one(timeseries.vcrr_series(b), "vcrr", "time_series", "volume")).unionByName(one(crosssection.momentum_rank(b), "rank", "cross_sectional", "momentum"))


_strip = lambda sql: sql[sql.index("WITH ") + 5 :]
_t4 = value(S.guarded("(s1 / (a1 + 1e-10)) / (s2 / (a2 + 1e-10) + 1e-10)", 80, -5, 5).replace("round(", "(").replace(", 6)", ")"), f"(SELECT asset, dt, i, sum(amount) {S.w(12)} AS s1, sum(abs(r)) {S.w(12)} AS a1, sum(amount) {S.w(32)} AS s2, sum(abs(r)) {S.w(32)} AS a2 FROM rets)")
_t15 = value(f"CASE WHEN i >= 40 THEN greatest(-3, least(3, (d - {S.full('avg({})', 'd', 20)}) / ({S.full('stddev_samp({})', 'd', 20)} + 1e-10))) / 3 ELSE 0 END", "(SELECT asset, dt, i, amount / (volume + 1e-10) - close AS d FROM rets)")
_x1 = value(S.pct_rank("raw"), f"(SELECT * FROM (SELECT asset, dt, close / {S.lag('close', 19)} - 1 AS raw FROM rets) WHERE raw IS NOT NULL)")
add(
    "combine_type",
    on_bars(lambda b: combine.combined(_factor_values(b)).drop("breakdown")),
    S.query(
        "SELECT asset, dt, round(greatest(-1, least(1, ts + xs)), 6) AS signal, round(ts, 6) AS time_series_contribution, round(xs, 6) AS cross_sectional_contribution, 0.0::DOUBLE AS pair_trading_contribution FROM (SELECT asset, dt, 0.5 * (a.value + b.value) / 2 AS ts, coalesce(0.35 * c.value, 0) AS xs FROM a JOIN b USING (asset, dt) LEFT JOIN c USING (asset, dt))",
        f"a AS ({_t4})", f"b AS ({_t15})", f"c AS ({_x1})",
    ),
)
_abc = (f"a AS ({_t4})", f"b AS ({_t15})", f"c AS ({_x1})")
_mean = "CASE WHEN c.value IS NULL THEN (a.value + b.value) / 2 ELSE (a.value + b.value + c.value) / 3 END"
add("combine_scopes", on_bars(lambda b: combine.scope_means(_factor_values(b))), S.query(f"SELECT asset, dt, round({_mean}, 6) AS common, NULL::DOUBLE AS idiosyncratic FROM a JOIN b USING (asset, dt) LEFT JOIN c USING (asset, dt)", *_abc))
add(
    "combine_categories",
    on_bars(lambda b: combine.combined(_factor_values(b)).select("asset", "dt", F.explode("breakdown").alias("category", "mean"))),
    S.query("SELECT asset, dt, 'time_series/liquidity' AS category, round(value, 6) AS mean FROM a UNION ALL SELECT asset, dt, 'time_series/volume', round(value, 6) FROM b UNION ALL SELECT asset, dt, 'cross_sectional/momentum', round(value, 6) FROM c", *_abc),
)
add(
    "xs_signals",
    on_bars(lambda b: crosssection.mean_signals(_factor_values(b).withColumn("value", F.round("value", 9)))),
    S.query(
        "SELECT asset, dt, CASE WHEN n > 1 THEN round((k - 1)::DOUBLE / (n - 1) * 2 - 1, 6) ELSE 0 END AS value FROM (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY m, asset) AS k, count(*) OVER (PARTITION BY dt) AS n FROM mm)",
        *_abc, f"mm AS (SELECT asset, dt, {_mean.replace('a.value', 'round(a.value, 9)').replace('b.value', 'round(b.value, 9)').replace('+ c.value', '+ round(c.value, 9)')} AS m FROM a JOIN b USING (asset, dt) LEFT JOIN c USING (asset, dt))",
    ),
)

# --- portfolios and metrics -------------------------------------------------------------------------------------------
_mom = lambda b: crosssection.series_momentum(b, window=20)
_bt_ts = on_bars(lambda b: portfolio.signal_backtest(b, _mom(b)))
_bt_sql = [
    f"v AS (SELECT asset, dt, close / {S.lag('close', 20)} - 1 AS value FROM bars)",
    "p AS (SELECT rets.asset, rets.dt, coalesce(r, 0) AS r, CASE WHEN value > 0 THEN 1.0 WHEN value < 0 THEN -1.0 ELSE 0.0 END::DOUBLE AS side FROM rets LEFT JOIN v USING (asset, dt))",
    f"q AS (SELECT *, coalesce({S.lag('side')}, 0) AS position FROM p)",
    f"bt AS (SELECT asset, dt, position, position * r - abs(position - coalesce({S.lag('position')}, 0)) * 0.001 AS ret FROM q)",
]
add("bt_ts", _bt_ts, S.query("SELECT asset, dt, position, round(ret, 6) AS ret, round(1e6 * exp(sum(ln(1 + ret)) OVER (PARTITION BY asset ORDER BY dt)), 6) AS equity FROM bt", *_bt_sql))
QUERIES["bt_ts"] = lambda s, d: _bt_ts(s, d).select("asset", "dt", "position", (F.round("ret", 6) + 0.0).alias("ret"), F.round("equity", 2).alias("equity"))
ORACLE_SQL["bt_ts"] = ORACLE_SQL["bt_ts"].replace("ORDER BY dt)), 6) + 0 AS equity", "ORDER BY dt)), 2) AS equity")

_xs_daily = [
    f"v AS (SELECT asset, dt, {_aged(f'stddev_samp(r) {S.w(10)}', 10, 8)} AS raw FROM rets)",
    f"k AS (SELECT asset, dt, {S.pct_rank('pr')} AS rank FROM (SELECT asset, dt, {S.pct_rank('raw')} AS pr FROM (SELECT * FROM v WHERE raw IS NOT NULL)))",
    "wt AS (SELECT asset, dt, CASE WHEN rank <= 0.2 THEN -1.0 / sum((rank <= 0.2)::INT) OVER (PARTITION BY dt) WHEN rank >= 0.8 THEN 1.0 / sum((rank >= 0.8)::INT) OVER (PARTITION BY dt) END AS weight FROM k)",
    "cal AS (SELECT dt, row_number() OVER (ORDER BY dt) AS ci FROM (SELECT DISTINCT dt FROM bars))",
    "ea AS (SELECT c2.dt, sum(weight * coalesce(r, 0)) AS ret FROM wt JOIN cal c1 ON c1.dt = wt.dt JOIN cal c2 ON c2.ci = c1.ci + 1 JOIN rets ON rets.asset = wt.asset AND rets.dt = c2.dt WHERE weight IS NOT NULL GROUP BY c2.dt)",
    "dl AS (SELECT cal.dt, coalesce(ret, 0) AS ret FROM cal LEFT JOIN ea USING (dt))",
]
_xs_build = on_bars(lambda b: portfolio.long_short_backtest(b, crosssection.volatility(b)))
QUERIES["bt_xs"] = lambda s, d: _xs_build(s, d).select("dt", (F.round("ret", 6) + 0.0).alias("ret"), F.round("equity", 2).alias("equity"))
ORACLE_SQL["bt_xs"] = unsigned_zero(S.query("SELECT dt, round(ret, 6) AS ret, round(1e6 * exp(sum(ln(1 + ret)) OVER (ORDER BY dt)), 2) AS equity FROM dl", *_xs_daily))
add(
    "bt_xs_same_day",
    on_bars(lambda b: portfolio.long_short_backtest(b, crosssection.volatility(b), same_day=True, halved=True, least_assets=3).select("dt", "ret")),
    S.query("SELECT cal.dt, round(coalesce(sum(weight * coalesce(r, 0)) FILTER (n >= 3) / 2, 0), 6) AS ret FROM cal LEFT JOIN (SELECT wt.*, count(*) OVER (PARTITION BY dt) AS n FROM wt) w ON w.dt = cal.dt AND weight IS NOT NULL LEFT JOIN rets ON rets.asset = w.asset AND rets.dt = w.dt GROUP BY cal.dt", *_xs_daily),
)
add("xs_weights", on_bars(lambda b: portfolio.quintile_weights(crosssection.volatility(b))), S.query("SELECT asset, dt, round(weight, 6) AS weight FROM wt WHERE weight IS NOT NULL", *_xs_daily))
_pair_bt = on_pairs(lambda p: portfolio.pair_backtest(p, pairs.style_momentum(p)))
QUERIES["bt_pair"] = lambda s, d: _pair_bt(s, d).select("a1", "a2", "dt", "position", (F.round("ret", 6) + 0.0).alias("ret"), F.round("equity", 2).alias("equity"))
ORACLE_SQL["bt_pair"] = unsigned_zero(S.query(
    "SELECT a1, a2, dt, position, round(ret, 6) AS ret, round(1e6 * exp(sum(ln(1 + ret)) OVER (PARTITION BY a1, a2 ORDER BY dt)), 2) AS equity FROM (SELECT *, position * coalesce(r1 - r2, 0) AS ret FROM pp)",
    f"ps AS (SELECT *, coalesce(sign((c1 / {_lagp('c1')} - 1) - (c2 / {_lagp('c2')} - 1)), 0)::DOUBLE AS side FROM legs)",
    f"pp AS (SELECT *, coalesce({_lagp('side')}, 0) AS position FROM ps)",
    pairs=True,
))

_perf = (
    "SELECT {k} count(ret) AS n_days, round(exp(sum(ln(1 + ret))) - 1, 6) AS total_return, round(pow(exp(sum(ln(1 + ret))), 252.0 / count(ret)) - 1, 6) AS annual_return, "
    "round(stddev_samp(ret) * sqrt(252), 6) AS volatility, round((pow(exp(sum(ln(1 + ret))), 252.0 / count(ret)) - 1) / nullif(stddev_samp(ret) * sqrt(252), 0), 6) AS sharpe, "
    "round((pow(exp(sum(ln(1 + ret))), 252.0 / count(ret)) - 1) / nullif(stddev_samp(ret) FILTER (ret < 0) * sqrt(252), 0), 6) AS sortino, "
    "sum((ret > 0)::INT)::BIGINT AS win_days, sum((ret < 0)::INT)::BIGINT AS loss_days"
)
_dd = ["ev AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY dt)) AS e FROM dl)", "dv AS (SELECT *, e / greatest(max(e) OVER (ORDER BY dt), 1) - 1 AS d, arg_max(dt, row(round(e, 12), -epoch(dt))) OVER (ORDER BY dt) AS pk FROM ev)"]
_total = S.query(_perf.format(k="") + ", round(-least(min(d), 0), 6) AS max_drawdown, arg_min(pk, row(round(d, 12), dt)) AS peak, arg_min(dt, row(round(d, 12), dt)) AS trough, round((pow(exp(sum(ln(1 + ret))), 252.0 / count(ret)) - 1) / nullif(-least(min(d), 0), 0), 6) AS calmar FROM dv", *_xs_daily, *_dd)
add("perf_total", lambda s, d: metrics.performance(_xs_build(s, d).select("dt", "ret")), _total)
add("bt_xs_volatility", lambda s, d: metrics.performance(_xs_build(s, d).select("dt", "ret")), _total)
_period = [
    "pd AS (SELECT dt, ret, unnest([year(dt)::VARCHAR, 'Total']) AS period FROM dl)",
    "pe AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY period ORDER BY dt)) AS e FROM pd)",
    "pq AS (SELECT *, e / greatest(max(e) OVER (PARTITION BY period ORDER BY dt), 1) - 1 AS d FROM pe)",
]
_worst = ", round(-least(min(d), 0), 6) AS max_drawdown, round((pow(exp(sum(ln(1 + ret))), 252.0 / count(ret)) - 1) / nullif(-least(min(d), 0), 0), 6) AS calmar"
add("perf_yearly", lambda s, d: metrics.yearly(_xs_build(s, d).select("dt", "ret")), S.query(f"SELECT * FROM ({_perf.format(k='period,')}{_worst} FROM pq GROUP BY period) WHERE n_days >= 2", *_xs_daily, *_period))
_report = lambda s, d: report.summary(_xs_build(s, d).select("dt", "equity"), "single_factor_xs", ["VolatilityFactor"], start="1992-01-01", end="1998-12-31", at="2000-01-01 00:00:00")
_curve = [
    "cu AS (SELECT dt, exp(sum(ln(1 + ret)) OVER (ORDER BY dt)) AS e, unnest([year(dt)::VARCHAR, 'Total']) AS \"Year\" FROM dl)",
    'cr AS (SELECT *, e / lag(e) OVER (PARTITION BY "Year" ORDER BY dt) - 1 AS r, 1 - e / max(e) OVER (PARTITION BY "Year" ORDER BY dt) AS dd FROM cu)',
    'cm AS (SELECT "Year", count(r) AS n, arg_max(e, dt) / arg_min(e, dt) - 1 AS t, stddev_samp(r) * sqrt(252) AS v, stddev_samp(r) FILTER (r < -1e-12) * sqrt(252) AS b, max(dd) AS m, sum((r > 1e-12)::INT) / count(r)::DOUBLE AS wr FROM cr GROUP BY "Year" HAVING count(r) >= 1)',
    "ca AS (SELECT *, pow(1 + t, 252.0 / n) - 1 AS a FROM cm)",
]
add(
    "summary_report",
    _report,
    S.query(
        "SELECT '2000-01-01 00:00:00' AS \"Backtest_Time\", '截面' AS \"Dimension\", 'Common' AS \"Factor_Layer_1\", 'volatility' AS \"Factor_Layer_2\", '' AS \"Asset_Pool\", '单因子-截面' AS \"Backtest_Type\", 'VolatilityFactor' AS \"Factor_Name\", \"Year\", round(a, 6) AS \"Annualized_Return\", round(v, 6) AS \"Volatility\", round(coalesce(a / nullif(v, 0), 0), 6) AS \"Sharpe_Ratio\", round(coalesce(a / nullif(m, 0), 0), 6) AS \"Calmar_Ratio\", round(m, 6) AS \"Max_Drawdown\", round(wr, 6) AS \"Win_Rate\", round(coalesce(a / nullif(b, 0), 0), 6) AS \"Sortino_Ratio\", round(t, 6) AS \"Total_Return\", n AS \"Trading_Days\", '1992-01-01' AS \"Start_Date\", '1998-12-31' AS \"End_Date\", '' AS \"Config_Path\", '2000-01-01 00:00:00' AS \"Generated_At\" FROM ca",
        *_xs_daily, *_curve,
    ),
)
add(
    "summary_totals",
    lambda s, d: report.totals(_report(s, d)),
    S.query(
        "SELECT kd AS \"Dimension\", kb AS \"Backtest_Type\", 1::BIGINT AS runs, round(coalesce(a / nullif(v, 0), 0), 6) AS avg_sharpe, round(a, 6) AS avg_return, round(m, 6) AS avg_max_dd FROM ca, (VALUES ('截面', '单因子-截面'), ('截面', NULL), (NULL, '单因子-截面'), (NULL, NULL)) k(kd, kb) WHERE \"Year\" = 'Total'",
        *_xs_daily, *_curve,
    ),
)
add("drawdown", lambda s, d: metrics.drawdowns(_xs_build(s, d).select("dt", "ret")), S.query("SELECT dt, round(e, 6) AS equity, round(max(e) OVER (ORDER BY dt), 6) AS peak, round(e / max(e) OVER (ORDER BY dt) - 1, 6) AS drawdown FROM ev", *_xs_daily, _dd[0]))
add("monthly_table", lambda s, d: metrics.monthly(_xs_build(s, d).select("dt", "ret")), S.query("SELECT year(dt) AS year, " + ", ".join(f"round(exp(sum(ln(1 + ret)) FILTER (month(dt) = {m})) - 1, 6) AS m{m}" for m in range(1, 13)) + " FROM dl GROUP BY 1", *_xs_daily))
add("var_cvar", lambda s, d: metrics.var_cvar(_xs_build(s, d).select("dt", "ret")), S.query("SELECT round(-any_value(q), 6) AS var, round(-avg(ret) FILTER (ret <= q), 6) AS cvar FROM (SELECT ret, quantile_cont(ret, 0.05) OVER () AS q FROM dl)", *_xs_daily))
add("moments", lambda s, d: metrics.moments(_xs_build(s, d)), S.query("SELECT round(skewness(ret), 6) AS skew, round(kurtosis(ret), 6) AS kurtosis FROM dl", *_xs_daily))
add("rolling_risk", lambda s, d: metrics.rolling_risk(_xs_build(s, d)), S.query("SELECT dt, CASE WHEN n = 60 THEN round(sd * sqrt(252), 6) END AS volatility, CASE WHEN n = 60 THEN round(m / nullif(sd, 0) * sqrt(252), 6) END AS sharpe FROM (SELECT dt, count(ret) OVER w AS n, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS sd FROM dl WINDOW w AS (ORDER BY dt ROWS 59 PRECEDING))", *_xs_daily))
_tr = [*_bt_sql, f"tk AS (SELECT *, sum((position <> pp)::INT) OVER (PARTITION BY asset ORDER BY dt) AS k FROM (SELECT *, coalesce({S.lag('position')}, 0) AS pp FROM bt))", "tr AS (SELECT asset, k, min(dt) AS entered, max(dt) AS \"left\", count(*) AS days, sum(ret) AS pnl FROM tk WHERE position <> 0 GROUP BY asset, k)"]
add("position_trades", lambda s, d: metrics.position_trades(_bt_ts(s, d)), S.query('SELECT asset, entered, "left", days, round(pnl, 6) AS pnl FROM tr', *_tr))
add("trade_stats", lambda s, d: metrics.trade_stats(metrics.position_trades(_bt_ts(s, d)), ["asset"]), S.query("SELECT asset, count(pnl) AS n_trades, round(sum((pnl > 0)::INT) / count(pnl)::DOUBLE, 6) AS win_rate, round(avg(pnl) FILTER (pnl > 0), 6) AS avg_win, round(-avg(pnl) FILTER (pnl < 0), 6) AS avg_loss, round(avg(pnl) FILTER (pnl > 0) / -avg(pnl) FILTER (pnl < 0), 6) AS profit_factor FROM tr GROUP BY asset", *_tr))
_ic = [
    f"fv AS (SELECT asset, dt, raw AS value FROM (SELECT asset, dt, close / {S.lag('close', 20)} - 1 AS raw FROM bars) WHERE raw IS NOT NULL)",
    "fw AS (" + " UNION ALL ".join(f"SELECT asset, dt, {p} AS period, CASE WHEN count(r) OVER f = {p} THEN sum(r) OVER f END AS f FROM rets WINDOW f AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND {p} FOLLOWING)" for p in (1, 5, 10, 20)) + ")",
    f"rk AS (SELECT dt, period, {S.pct_rank('value', 'dt, period')} AS a, {S.pct_rank('f', 'dt, period')} AS b FROM fw JOIN fv USING (asset, dt) WHERE f IS NOT NULL)",
    "ic AS (SELECT dt, period, corr(a, b) AS ic FROM rk GROUP BY dt, period HAVING count(*) >= 5 AND corr(a, b) IS NOT NULL AND NOT isnan(corr(a, b)))",
]
_ic_build = on_bars(lambda b: metrics.daily_ic(_mom(b), b))
add("ic_daily", _ic_build, S.query("SELECT dt, period, round(ic, 6) AS ic FROM ic", *_ic))
add("ic_metrics", lambda s, d: metrics.ic_summary(_ic_build(s, d)), S.query("SELECT period, count(ic) AS n, round(avg(ic), 6) AS ic_mean, round(stddev_pop(ic), 6) AS ic_std, round(avg(ic) / nullif(stddev_pop(ic), 0), 6) AS ir, round(avg(ic) / nullif(stddev_pop(ic), 0) * sqrt(count(ic)), 6) AS t FROM ic GROUP BY period HAVING count(ic) >= 10", *_ic))

# --- allocation and risk ------------------------------------------------------------------------------------------------
_pv = f"pv AS (SELECT a1, a2, dt, {S.full('stddev_samp({})', 'dx', 20, _pk, 10)} * sqrt(252) AS vol FROM (SELECT *, x / {_lagp('x')} - 1 AS dx FROM (SELECT *, c1 / c2 AS x FROM legs)))"
add("alloc_volparity", on_pairs(lambda p: portfolio.allocation(portfolio.pair_volatility(p), "volatility_parity")), S.query("SELECT a1, a2, dt, round(vol, 6) AS vol, round(1 / vol / sum(1 / vol) OVER (PARTITION BY dt), 6) AS share FROM pv", _pv, pairs=True))
add("alloc_equal", on_pairs(lambda p: portfolio.allocation(portfolio.pair_volatility(p), "equal")), S.query("SELECT a1, a2, dt, round(vol, 6) AS vol, round(1.0 / count(*) OVER (PARTITION BY dt), 6) AS share FROM pv", _pv, pairs=True))
add("vol_target", on_pairs(portfolio.vol_target), S.query(f"SELECT a1, a2, dt, round(vol, 6) AS vol, round(least(3.0, greatest(0.1, least(10.0, 0.15 / vol))), 6) AS leverage FROM (SELECT a1, a2, dt, {S.full('stddev_samp({})', 'dx', 60, _pk, 20)} * sqrt(252) AS vol FROM (SELECT *, x - {_lagp('x')} AS dx FROM (SELECT *, ln(c1 / c2) AS x FROM legs))) WHERE vol IS NOT NULL", pairs=True))
_shares = lambda how: on_all_pairs(lambda p: portfolio.allocation(portfolio.pair_volatility(p), how))
_all_bt = on_all_pairs(lambda p: portfolio.pair_backtest(p, pairs.style_momentum(p)))
QUERIES["bt_pair_all"] = lambda s, d: _all_bt(s, d).select("a1", "a2", "dt", "position", (F.round("ret", 6) + 0.0).alias("ret"), F.round("equity", 2).alias("equity"))
ORACLE_SQL["bt_pair_all"] = S.of_all_pairs(ORACLE_SQL["bt_pair"])
for _name, _build in (("alloc_volparity", _shares("volatility_parity")), ("alloc_equal", _shares("equal")), ("vol_target", on_all_pairs(portfolio.vol_target))):
    add(f"{_name}_all", _build)
    ORACLE_SQL[f"{_name}_all"] = S.of_all_pairs(ORACLE_SQL[_name])
_legs_vol = ", ".join(f"coalesce(nullif({S.full('stddev_samp({})', f'r{k}', 20, 'a1, a2', 10)} * sqrt(252), 0), 0.15) AS v{k}" for k in (1, 2))
add(
    "pair_sizes",
    on_all_pairs(portfolio.pair_sizes),
    S.of_all_pairs(S.query(
        "SELECT a1, a2, dt, round(w, 6) AS weight1, greatest(1, floor(w * 1e6 / (c1 * 0.1)))::BIGINT AS n1, greatest(1, floor((1 - w) * 1e6 / (c2 * 0.1)))::BIGINT AS n2 FROM (SELECT *, v2 / (v1 + v2) AS w FROM lv)",
        f"lv AS (SELECT *, {_legs_vol} FROM legs)", pairs=True,
    )),
)
add("inverse_vol_weights", on_bars(portfolio.inverse_vol_weights), S.query("SELECT asset, dt, round(vol, 6) AS vol, round(1 / vol / sum(1 / vol) OVER (PARTITION BY dt), 6) AS weight FROM iv", f"iv AS (SELECT asset, dt, coalesce(nullif({S.full('stddev_samp({})', 'r', 20, 'asset', 10)} * sqrt(252), 0), 0.15) AS vol FROM rets)"))


add("covariances", on_bars(portfolio.covariances), S.query("SELECT a1, a2, round(cov, 6) AS cov FROM (SELECT x.asset AS a1, y.asset AS a2, covar_samp(x.r, y.r) * 252 AS cov FROM rets x JOIN rets y USING (dt) WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2)"))
add(
    "portfolio_vol",
    on_bars(lambda b: portfolio.portfolio_vol(portfolio.inverse_vol_weights(b).select("dt", "asset", "weight"), portfolio.covariances(b))),
    S.query(
        "SELECT dt, round(sqrt(greatest(sum(x.weight * y.weight * cov), 0)), 6) AS vol FROM wv x JOIN wv y USING (dt) JOIN cv ON cv.a1 = x.asset AND cv.a2 = y.asset GROUP BY dt",
        f"iv AS (SELECT asset, dt, coalesce(nullif({S.full('stddev_samp({})', 'r', 20, 'asset', 10)} * sqrt(252), 0), 0.15) AS vol FROM rets)",
        "wv AS (SELECT asset, dt, 1 / vol / sum(1 / vol) OVER (PARTITION BY dt) AS weight FROM iv)",
        "cv AS (SELECT x.asset AS a1, y.asset AS a2, covar_samp(x.r, y.r) * 252 AS cov FROM rets x JOIN rets y USING (dt) WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2)",
    ),
)
add("vol_forecast", on_bars(portfolio.vol_forecast), S.query("SELECT asset, dt, round(sqrt(m * 252), 6) AS vol FROM rets JOIN f USING (asset, i)", "sq AS (SELECT asset, i, r * r AS s FROM rets)", f"f AS ({_decayed('s', 0.94, 'sq')})"))
add(
    "risk_report",
    on_bars(lambda b: portfolio.risk_report(portfolio.quintile_weights(crosssection.volatility(b)).withColumnRenamed("weight", "value"))),
    S.query('SELECT dt, round(l, 6) + 0 AS "long", round(s, 6) + 0 AS short, round(l - s, 6) + 0 AS net, round(l + s, 6) AS gross, round(m / nullif(l + s, 0), 6) AS concentration FROM (SELECT dt, sum(greatest(weight, 0)) AS l, -sum(least(weight, 0)) AS s, max(abs(weight)) AS m FROM wt WHERE weight IS NOT NULL GROUP BY dt)', *_xs_daily),
)

# --- dated facts, tails, irregular times, lookups, the run log -----------------------------------------------------------
add(
    "as_of_events",
    lambda s, d: joins.as_of(B.event_times(s, d), B.daily_bars(s, d), ["asset"], "at", "dt", ["dt", "close"]).select("event_id", "asset", "dt", "close"),
    S.query(
        "SELECT e.event_id, e.asset, bars.dt, round(close, 6) AS close FROM e ASOF LEFT JOIN bars ON e.asset = bars.asset AND e.at >= bars.dt",
        "e AS (SELECT event_id, 'Brand#' || (user_id % 25 + 1) AS asset, TIMESTAMP '1995-01-01' + to_seconds((epoch_us(ts) // 1000000 - 1704067200) * 80) AS at FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)",
    ),
)
add(
    "tail_corr",
    on_bars(lambda b: pairs.tail_correlations(b, b.groupBy(F.trunc("dt", "month")).agg(F.max("dt").alias("as_of")))),
    S.query(
        "SELECT x.sector, x.as_of, x.asset AS a1, y.asset AS a2, count(*) AS n, round(CASE WHEN stddev_pop(x.r) > 0 AND stddev_pop(y.r) > 0 THEN corr(x.r, y.r) END, 6) AS corr "
        "FROM tail x JOIN tail y ON x.as_of = y.as_of AND x.sector = y.sector AND x.place = y.place AND x.asset < y.asset GROUP BY ALL HAVING count(*) >= 20",
        "as_ofs AS (SELECT max(dt) AS as_of FROM bars GROUP BY date_trunc('month', dt))",
        "tail AS (SELECT * FROM (SELECT as_of, asset, sector, r, row_number() OVER (PARTITION BY asset, as_of ORDER BY dt DESC) AS place FROM rets JOIN as_ofs ON dt <= as_of WHERE r IS NOT NULL) WHERE place <= 60)",
    ),
)
_facts = [
    "facts AS (SELECT 'Brand#' || (c_nationkey + 1) AS asset, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS valid_from, "
    "coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')), 0)::DOUBLE AS l, "
    "coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')), 0)::DOUBLE AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)",
    "rates AS (SELECT 'Brand#' || (c_nationkey + 1) AS asset, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH AS DATE) AS valid_from, avg((o_orderstatus = 'F')::INT) AS win_rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2 HAVING count(*) >= 4)",
    "held AS (SELECT bars.asset, bars.dt, (facts.l - facts.s) / nullif(facts.l + facts.s, 0) AS own, (long_pos - short_pos) / nullif(long_pos + short_pos, 0) AS plain FROM bars ASOF LEFT JOIN facts ON bars.asset = facts.asset AND bars.dt >= facts.valid_from)",
    "rated AS (SELECT held.*, win_rate FROM held LEFT JOIN rates ON held.asset = rates.asset AND held.dt >= rates.valid_from AND held.dt < rates.valid_from + INTERVAL 3 MONTH)",
    "x AS (SELECT * FROM (SELECT asset, dt, CASE WHEN count(own) OVER (PARTITION BY dt) = 0 THEN plain WHEN count(win_rate) FILTER (own IS NOT NULL) OVER (PARTITION BY dt) > 0 THEN own * win_rate ELSE own END AS raw FROM rated) WHERE raw IS NOT NULL)",
]
_scored = value("round(coalesce((raw - avg(raw) OVER (PARTITION BY dt)) / nullif(stddev_samp(raw) OVER (PARTITION BY dt), 0), 0), 6)", "x")
add("xs_X15_holdings", lambda s, d: crosssection.member_holdings(B.daily_bars(s, d), B.holdings(s, d), B.win_rates(s, d)), S.query(_scored, *_facts))


def _contracts(spark: SparkSession) -> DataFrame:
    """The multipliers of some products; others have the default."""
    return spark.createDataFrame([("PROMO", 5), ("STANDARD", 20), ("SMALL", 100), ("ECONOMY", 1000)], "product string, multiplier int")


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols like small0042.xch, from the first word of a part's type and its number."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select("p_partkey", F.concat(F.lower(F.substring_index("p_type", " ", 1)), F.lpad(F.col("p_partkey").cast("string"), 4, "0"), F.lit(".xch")).alias("asset"))


add(
    "multipliers",
    lambda s, d: joins.multipliers(_symbols(s, d), _contracts(s)),
    """WITH m(product, multiplier) AS (VALUES ('PROMO', 5), ('STANDARD', 20), ('SMALL', 100), ('ECONOMY', 1000)),
sym AS (SELECT p_partkey, lower(split_part(p_type, ' ', 1)) || lpad(p_partkey::VARCHAR, 4, '0') || '.xch' AS asset FROM part)
SELECT p_partkey, asset, coalesce(multiplier, 10)::INT AS multiplier FROM sym LEFT JOIN m ON product = regexp_replace(upper(split_part(asset, '.', 1)), '[0-9]+$', '')""",
)


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a run written and read back: positions, returns and trades of bt_ts and the daily ICs, as long rows."""
    positions, ics = _bt_ts(spark, sf_dir), _ic_build(spark, sf_dir)
    turn = positions.withColumn("quantity", F.col("position") - F.coalesce(C.lag("position"), F.lit(0.0))).where("quantity <> 0")
    records = runlog.days(
        factors=ics.select("dt", F.lit("ic").alias("factor"), F.col("period").cast("string").alias("ticker"), F.col("ic").alias("value"), F.lit("IC").alias("type")),
        positions=positions.select("dt", F.col("asset").alias("ticker"), F.col("position").alias("value")),
        trades=turn.select("dt", F.col("asset").alias("ticker"), F.when(F.col("quantity") > 0, "buy").otherwise("sell").alias("action"), F.abs("quantity").alias("quantity")),
        pnl=positions.groupBy("dt").agg(F.avg("ret").alias("daily_return")),
    )
    log = runlog.RunLog(spark, f"{runlog.shared_folder(spark)}/tidemark-runs-{uuid.uuid4().hex}")
    log.append("bt_ts", records)
    tables = log.tables("bt_ts")
    row = lambda kind, name, ticker, v: (F.lit(kind).alias("kind"), "dt", name.alias("name"), ticker.alias("ticker"), v.alias("value"))
    nothing = F.lit(None).cast("string")
    out = tables["factors"].select(*row("factor", F.col("factor"), F.col("ticker"), F.col("value")))
    out = out.unionByName(tables["positions"].select(*row("position", nothing, F.col("ticker"), F.col("value"))))
    out = out.unionByName(tables["trades"].select(*row("trade", F.col("action"), F.col("ticker"), F.col("quantity"))))
    return out.unionByName(tables["pnl"].select(*row("pnl", F.lit("daily_return"), nothing, F.col("daily_return"))))


add(
    "run_log",
    _logged,
    S.query(
        "SELECT 'factor' AS kind, dt, 'ic' AS name, period::VARCHAR AS ticker, round(ic, 6) AS value FROM ic "
        "UNION ALL SELECT 'position', dt, NULL, asset, position FROM bt "
        "UNION ALL SELECT 'trade', dt, CASE WHEN q > 0 THEN 'buy' ELSE 'sell' END, asset, abs(q) FROM (SELECT *, position - coalesce(lag(position) OVER (PARTITION BY asset ORDER BY dt), 0) AS q FROM bt) WHERE q <> 0 "
        "UNION ALL SELECT 'pnl', dt, 'daily_return', NULL, round(avg(ret), 6) FROM bt GROUP BY dt",
        *_bt_sql, *_ic,
    ),
)

add(
    "combine_pairs",
    on_bars(lambda b: combine.with_pairs(pairs.style_momentum(pairs.all_legs(b)), _mom(b).withColumnRenamed("value", "signal"))),
    S.of_all_pairs(
        S.query(
            "SELECT a1, a2, dt, round(greatest(-1, least(1, 0.7 * value + 0.3 * (x.s - y.s) / 2)), 6) AS signal FROM sm JOIN mo x USING (dt) JOIN mo y USING (dt) WHERE x.asset = a1 AND y.asset = a2",
            f"mo AS (SELECT * FROM (SELECT asset, dt, close / {S.lag('close', 20)} - 1 AS s FROM bars) WHERE s IS NOT NULL)",
            f"sm AS (SELECT a1, a2, dt, CASE WHEN i >= 2 THEN sign(c1 / {_lagp('c1')} - c2 / {_lagp('c2')}) ELSE 0 END AS value FROM legs)",
            pairs=True,
        )
    ),
)
