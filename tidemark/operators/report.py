"""Summary reports: an equity curve by year and in total, with what was run, as rows that many runs append to."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cols as C
from .metrics import YEAR

FLAT = 1e-12
# The report's columns, the labels of dimensions and of kinds of backtests, the words that tell a factor's category.
COLUMNS = (
    "Backtest_Time", "Dimension", "Factor_Layer_1", "Factor_Layer_2", "Asset_Pool", "Backtest_Type", "Factor_Name", "Year", "Annualized_Return",
    "Volatility", "Sharpe_Ratio", "Calmar_Ratio", "Max_Drawdown", "Win_Rate", "Sortino_Ratio", "Total_Return", "Trading_Days", "Start_Date",
    "End_Date", "Config_Path", "Generated_At",
)
DIMENSIONS = {"ts": "时序", "xs": "截面", "pair": "配对"}
SINGLE, MULTI = "单因子", "多因子"
CATEGORIES = {
    "trend": ("hurst", "trend", "emd", "ma"),
    "volatility": ("vol", "duvol", "cv", "amplitude"),
    "liquidity": ("amihud", "amivest", "liquidity"),
    "momentum": ("momentum", "bias", "strength"),
    "copula": ("copula",),
    "kalman": ("kalman",),
    "investor_behavior": ("investor", "behavior"),
    "statistical": ("runs", "slm", "skew", "kurt"),
}


def labels(mode: str) -> tuple[str, str]:
    """Dimension, and kind of backtest, of a mode's name."""
    name = mode.lower()
    dimension = DIMENSIONS["pair" if "pair" in name else "xs" if name.endswith("_xs") or "comprehensive" in name else "ts"]
    return dimension, f"{SINGLE if 'single_factor' in name else MULTI}-{dimension}"


def categories(factors: list[str]) -> str:
    """Each factor's first category whose words its name holds, "mixed" if no name has any."""
    of = lambda f: next((c for c, words in CATEGORIES.items() if any(w in f.lower() for w in words)), None)
    return ", ".join(sorted({c for f in factors if (c := of(f))})) or "mixed"


def pool(names: list[str]) -> str:
    return ", ".join(names) if len(names) <= 5 else f"{', '.join(names[:3])} ... ({len(names)} assets)"


def breakdown(curve: DataFrame, keys=()) -> DataFrame:
    """keys, Year ("Total" for all) and measures of an equity curve (keys, dt, equity). A period's returns lie within it;
    those within FLAT of zero are neither wins nor losses, as the curve's own rounding is of that size."""
    by = (*keys, "Year")
    w = W.partitionBy(*by).orderBy("dt")
    df = curve.withColumn("Year", F.explode(F.array(F.year("dt").cast("string"), F.lit("Total"))))
    df = df.withColumn("r", C.div("equity", F.lag("equity").over(w)) - 1).withColumn("d", 1 - C.div("equity", F.max("equity").over(w)))
    n, total = F.count("r"), C.div(F.max_by("equity", "dt"), F.min_by("equity", "dt")) - 1
    df = df.groupBy(*by).agg(
        n.alias("Trading_Days"), total.alias("Total_Return"), (F.stddev_samp("r") * YEAR**0.5).alias("Volatility"),
        (F.stddev_samp(F.when(F.col("r") < -FLAT, F.col("r"))) * YEAR**0.5).alias("below"), F.max("d").alias("Max_Drawdown"),
        C.div(F.sum((F.col("r") > FLAT).cast("int")), n).alias("Win_Rate"),
    )
    left = F.when(F.col("Total_Return") > -1, F.pow(1 + F.col("Total_Return"), YEAR / F.col("Trading_Days")) - 1).otherwise(F.lit(-1.0))
    df = df.where("Trading_Days >= 1").withColumn("Annualized_Return", left)
    over = lambda c: F.coalesce(C.div("Annualized_Return", F.nullif(F.col(c), F.lit(0.0))), F.lit(0.0))
    return df.withColumns({"Sharpe_Ratio": over("Volatility"), "Sortino_Ratio": over("below"), "Calmar_Ratio": over("Max_Drawdown")}).drop("below")


def summary(curve: DataFrame, mode: str, factors: list[str], assets=(), start: str = "", end: str = "", config: str = "", layer: str = "Common", at: str | None = None) -> DataFrame:
    """The 21 columns of a run, a row for each year and "Total". at: time of the run (now if None)."""
    dimension, kind = labels(mode)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss") if at is None else F.lit(at)
    fixed = {
        "Backtest_Time": now, "Generated_At": now, "Dimension": F.lit(dimension), "Backtest_Type": F.lit(kind), "Factor_Layer_1": F.lit(layer),
        "Factor_Layer_2": F.lit(categories(factors)), "Asset_Pool": F.lit(pool(list(assets))), "Factor_Name": F.lit(", ".join(factors)),
        "Start_Date": F.lit(start), "End_Date": F.lit(end), "Config_Path": F.lit(config),
    }
    return breakdown(curve).withColumns(fixed).select(*COLUMNS)


def append(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """Add a run's rows to those at `path`; what is there isn't read."""
    report.write.mode("append").format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


def totals(report: DataFrame) -> DataFrame:
    """Dimension, Backtest_Type, runs and means over "Total" rows: by both, by each alone and over all (nulls)."""
    d, t = F.col("Dimension"), F.col("Backtest_Type")
    means = [F.avg(c).alias(f"avg_{n}") for n, c in (("sharpe", "Sharpe_Ratio"), ("return", "Annualized_Return"), ("max_dd", "Max_Drawdown"))]
    return report.where("Year = 'Total'").groupingSets([[d, t], [d], [t], []], d, t).agg(F.count(F.lit(1)).alias("runs"), *means)


def text(row: dict) -> str:
    """One performance row as lines of text."""
    lines = [f"{re.sub('_', ' ', k):<24}{v:>16.6f}" if isinstance(v, float) else f"{re.sub('_', ' ', k):<24}{v!s:>16}" for k, v in row.items()]
    width = max(map(len, lines), default=0)
    return "\n".join(["=" * width, *lines, "=" * width])
