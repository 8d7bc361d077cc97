"""SQL fragments of the oracle queries, in DuckDB's dialect, written apart from the Spark plans."""

from __future__ import annotations

BARS = r"""
tick AS (
  SELECT p_brand AS asset, CAST(l_shipdate AS DATE) AS dt, p_retailprice * (1 - l_discount) AS px,
    CAST(l_quantity AS DECIMAL(18,2)) AS q, l_discount,
    row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey),
day AS (
  SELECT asset, dt, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
    sum(q)::DOUBLE AS volume, sum((CAST(round(px, 4) AS DECIMAL(18,4)) * q)::DECIMAL(28,6))::DOUBLE AS amount,
    coalesce(sum(q) FILTER (l_discount >= 0.05), 0)::DOUBLE AS long_pos, coalesce(sum(q) FILTER (l_discount < 0.05), 0)::DOUBLE AS short_pos
  FROM tick GROUP BY asset, dt),
bars AS (
  SELECT *, sum(volume) OVER (PARTITION BY asset ORDER BY dt ROWS 19 PRECEDING) AS oi,
    'sector' || (CAST(regexp_extract(asset, '(\d+)$', 1) AS INT) % 5) AS sector, (open + high + low + close) / 4 AS close_next
  FROM day),
rets AS (
  SELECT *, close / lag(close) OVER (PARTITION BY asset ORDER BY dt) - 1 AS r, row_number() OVER (PARTITION BY asset ORDER BY dt) AS i FROM bars)
"""

PAIR_BARS = """
pl(a1, a2) AS (VALUES ('Brand#11', 'Brand#12'), ('Brand#21', 'Brand#22'), ('Brand#3', 'Brand#4'), ('Brand#5', 'Brand#6')),
legs AS (
  SELECT a1, a2, x.dt, x.close AS c1, x.r AS r1, y.close AS c2, y.r AS r2, row_number() OVER (PARTITION BY a1, a2 ORDER BY x.dt) AS i
  FROM pl JOIN rets x ON x.asset = a1 JOIN rets y ON y.asset = a2 AND y.dt = x.dt)
"""


def w(n: int, keys: str = "asset") -> str:
    """The last n rows."""
    return f"OVER (PARTITION BY {keys} ORDER BY dt ROWS {n - 1} PRECEDING)"


def full(agg: str, c: str, n: int, keys: str = "asset", least: int | None = None) -> str:
    return f"CASE WHEN count({c}) {w(n, keys)} >= {least or n} THEN {agg.format(c)} {w(n, keys)} END"


def lag(c: str, k: int = 1, keys: str = "asset") -> str:
    return f"lag({c}, {k}) OVER (PARTITION BY {keys} ORDER BY dt)"


def pct_rank(c: str, by: str = "dt") -> str:
    """Average rank over the rows of a section, all of which have a value."""
    return f"((rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY {by}))"


def query(select: str, *ctes: str, pairs: bool = False) -> str:
    return "WITH " + ",\n".join([BARS, *([PAIR_BARS] if pairs else []), *ctes]) + "\n" + select


def guarded(value: str, history: int, lo: float | None = None, hi: float | None = None, neutral: float = 0) -> str:
    bounded = value if lo is None else f"greatest({lo}, least({hi}, {value}))"
    return f"CASE WHEN i >= {history} AND ({value}) IS NOT NULL THEN round({bounded}, 6) ELSE {neutral} END"


def of_all_pairs(sql: str) -> str:
    """SQL of the listed pairs, over every pair a1 < a2 instead."""
    start = sql.index("pl(a1, a2) AS")
    end = sql.index("legs AS", start)
    names = "(SELECT DISTINCT asset FROM bars)"
    return f"{sql[:start]}pl AS (SELECT x.asset AS a1, y.asset AS a2 FROM {names} x JOIN {names} y ON x.asset < y.asset),\n{sql[end:]}"
