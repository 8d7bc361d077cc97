"""Combining factors in levels: factor, scope, category, type. Input: factor, factor_type, category, scope, asset, dt, value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cols as C

# Default weights of the factor types.
WEIGHTS = {"time_series": 0.50, "cross_sectional": 0.35, "pair_trading": 0.15}


def combined(values: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """asset, dt, signal within [-1, 1], a contribution for each type, breakdown of means by type and category.

    One aggregation by (asset, dt, type, category), and one over its few rows.
    """
    by_category = values.groupBy("asset", "dt", "factor_type", "category").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    name = F.concat_ws("/", "factor_type", "category")
    parts = [
        F.coalesce(C.div(F.sum(F.when(F.col("factor_type") == t, F.col("s"))), F.sum(F.when(F.col("factor_type") == t, F.col("n")))), F.lit(0.0)) * w
        for t, w in weights.items()
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return by_category.groupBy("asset", "dt").agg(
        C.clip(total, -1, 1).alias("signal"),
        *(p.alias(f"{t}_contribution") for t, p in zip(weights, parts, strict=True)),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(name.alias("name"), C.div("s", "n").alias("mean"))))).alias("breakdown"),
    )


def scope_means(values: DataFrame) -> DataFrame:
    """asset, dt, common and idiosyncratic: reported, not part of the signal."""
    return values.groupBy("asset", "dt").agg(*(F.avg(F.when(F.col("scope") == s, F.col("value"))).alias(s) for s in ("common", "idiosyncratic")))


def with_pairs(pair_signals: DataFrame, single: DataFrame, weight: float = 0.7) -> DataFrame:
    """a1, a2, dt, signal: weight of the pair's own value, the rest of half the difference of its legs' signals."""
    one = single.select(F.col("asset").alias("a1"), "dt", F.col("signal").alias("s1"))
    two = single.select(F.col("asset").alias("a2"), "dt", F.col("signal").alias("s2"))
    value = weight * F.col("value") + (1 - weight) * (F.col("s1") - F.col("s2")) / 2
    return pair_signals.join(one, ["a1", "dt"]).join(two, ["a2", "dt"]).select("a1", "a2", "dt", C.clip(value, -1, 1).alias("signal"))


def resolve(config: dict, factor: str, asset: str | None = None, sector: str | None = None, overrides: dict | None = None) -> dict:
    """Parameters of a factor: defaults, then its sector's, its asset's and the call's own.

    config: {"factors": {name: {"params", "sectors": {sector: params}, "assets": {asset: params}, "scope", "only": [assets]}}}
    """
    own = config.get("factors", {}).get(factor, {})
    return {**own.get("params", {}), **own.get("sectors", {}).get(sector, {}), **own.get("assets", {}).get(asset, {}), **(overrides or {})}


def applicable(config: dict, asset: str) -> list[str]:
    """Names of common factors, and of those for this asset alone; the first of a name counts."""
    return [n for n, f in config.get("factors", {}).items() if f.get("scope", "common") == "common" or asset in f.get("only", [])]
