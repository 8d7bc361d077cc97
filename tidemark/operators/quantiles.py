"""Exact quantiles that don't sort a whole frame or hold a whole section.

`rolling_quantile`: an order-statistic window. A history is cut into blocks of rows, each with the rows before it that its windows
reach; inside a block all windows are answered together on the binary digits of the values' ranks, so the work is
rows x log(rows of a block), whatever the window's length.

`section_quantiles`: selection by histogram refinement. A double becomes a 64-bit integer of the same order; four rounds of counts
over 16 bits each narrow the bin that holds the asked rank. What is shuffled is counts, at most 65,536 a section, round and task.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..functions import cols as C

BLOCK = 16384
BITS, ROUNDS = 16, 4


def kth(ranks: np.ndarray, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of ranks[start:end], for many windows at once; 0 <= k < end - start.

    From the highest binary digit down: of a window, count those with digit 0; the k-th is among them or among the rest. Values are
    then parted by the digit, keeping their order, so a window stays one range.
    """
    start, end, k = start.copy(), end.copy(), k.copy()
    found = np.zeros(len(k), np.int64)
    for bit in reversed(range(max(1, int(ranks.max(initial=0)).bit_length()))):
        one = (ranks >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~one)))
        here = zeros[end] - zeros[start]
        up = k >= here
        k = np.where(up, k - here, k)
        found |= up.astype(np.int64) << bit
        start, end = (np.where(up, zeros[-1] + at - zeros[at], zeros[at]) for at in (start, end))
        ranks = np.concatenate((ranks[~one], ranks[one]))
    return found


def window_quantiles(x: np.ndarray, n: int, q: float, least: int) -> np.ndarray:
    """Interpolated quantile of the known values in the last n entries, NaN where fewer than `least` are known."""
    known = ~np.isnan(x)
    before = np.concatenate(([0], np.cumsum(known)))
    at = np.arange(len(x))
    start, end = before[np.maximum(at + 1 - n, 0)], before[at + 1]
    out = np.full(len(x), np.nan)
    asked = end - start >= max(least, 1)
    if not asked.any():
        return out
    start, end = start[asked], end[asked]
    values, ranks = np.unique(x[known], return_inverse=True)
    place = q * (end - start - 1)
    low = np.floor(place).astype(np.int64)
    a = values[kth(ranks, start, end, low)]
    b = values[kth(ranks, start, end, np.minimum(low + 1, end - start - 1))]
    with np.errstate(invalid="ignore"):
        out[asked] = np.where(a == b, a, a + (b - a) * (place - low))
    return out


def rolling_quantile(df: DataFrame, column: str, n: int, q: float, name: str = "value", least: int | None = None, keys: Iterable[str] = ("asset",), order: str = "dt", block: int = BLOCK) -> DataFrame:
    """`df` with a double column `name`: the quantile q of `column` over the last n rows of a key, NULL unless `least` of them
    (all, by default) are known. NULL and NaN are unknown. Rows with equal keys and order stand in no defined order, as in a window.

    A block holds at least n rows, so a row goes to its own block and at most the next one.
    """
    keys, least, block = list(keys), n if least is None else least, max(block, n)
    i = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    own = F.floor(F.col("_i") / block)
    reach = F.when(F.col("_i") % block >= block - n + 1, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = df.withColumn("_i", i).withColumn("_block", F.explode(reach))
    kept = df.columns

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_i")
        found = window_quantiles(part[column].to_numpy(dtype=float, na_value=np.nan), n, q, least)
        mine = (part["_i"] // block == part["_block"]).to_numpy()
        values = pd.Series(found[mine], dtype=object)
        return part[mine][kept].assign(**{name: values.where(values.notna(), None).to_numpy()})

    return dealt.groupBy(*keys, "_block").applyInPandas(answer, df.schema.add(name, "double"))


@F.pandas_udf(LongType())
def _ordered(x: pd.Series) -> pd.Series:
    """Integers in the order of the doubles; minus zero is zero."""
    bits = (x.to_numpy(dtype=float) + 0.0).view(np.int64)
    return pd.Series(bits ^ (bits >> 63 & np.int64(2**63 - 1)))


@F.pandas_udf(DoubleType())
def _restored(k: pd.Series) -> pd.Series:
    bits = k.to_numpy(dtype=np.int64)
    return pd.Series((bits ^ (bits >> 63 & np.int64(2**63 - 1))).view(float))


def _narrowed(counts: DataFrame, section: list[str]) -> DataFrame:
    """Of bins with `_n` rows and the targets asked of them, the bin that holds each target, its rank counted from the bin's start."""
    upto = F.sum("_n").over(W.partitionBy(*section).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
    held = counts.withColumn("_before", upto - F.col("_n"))
    inside = F.filter("_targets", lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_before") + F.col("_n")))
    moved = F.transform(inside, lambda t: F.struct(t["id"].alias("id"), (t["rank"] - F.col("_before")).alias("rank"), t["part"].alias("part")))
    return held.withColumn("_targets", moved).where(F.size("_targets") > 0)


def section_quantiles(df: DataFrame, column: str, quantiles: dict[str, float], by: Iterable[str] = ("dt",)) -> DataFrame:
    """by, and for each name the interpolated quantile of the section's known values; sections without any have no row.

    NULL and NaN are unknown, NULL keys form no section, an empty `by` makes everything one section. Reads `df` once a round. The
    bounds joined to it are at most twice the quantiles for each section; Spark broadcasts them by measured size.
    """
    by = list(by)
    x = F.col(column).cast("double")
    section = by or ["_all"]
    known = df.where(x.isNotNull() & ~F.isnan(x) & C.all_known(by)).withColumns({} if by else {"_all": F.lit(0)})
    rows = known.select(*section, _ordered(x).alias("_k"))
    digits = lambda r: F.shiftright("_k", 64 - BITS * (r + 1))

    total = F.sum("_n").over(W.partitionBy(*section)) - 1
    targets = []
    for j, q in enumerate(quantiles.values()):
        place = total * F.lit(float(q))
        low = F.floor(place)
        for side, rank in enumerate((low, F.ceil(place))):
            targets.append(F.struct(F.lit(2 * j + side).alias("id"), rank.cast("long").alias("rank"), (place - low).alias("part")))
    counts = rows.groupBy(*section, digits(0).alias("_bin")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_targets", F.array(*targets))
    found = _narrowed(counts, section)
    for r in range(1, ROUNDS):
        bounds = found.select(*section, F.col("_bin").alias("_in"), "_targets")
        inside = rows.withColumn("_in", digits(r - 1)).join(bounds, [*section, "_in"])
        counts = inside.groupBy(*section, "_in", "_targets", digits(r).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
        found = _narrowed(counts, [*section, "_in"])
    ends = found.select(*section, _restored("_bin").alias("_v"), F.explode("_targets").alias("_t"))
    side = lambda i: F.max(F.when(F.col("_t.id") == i, F.col("_v")))
    out = []
    for j, name in enumerate(quantiles):
        a, b, part = side(2 * j), side(2 * j + 1), F.max(F.when(F.col("_t.id") == 2 * j, F.col("_t.part")))
        out.append(F.when(a == b, a).otherwise(a + (b - a) * part).alias(name))
    return ends.groupBy(*section).agg(*out).select(*by, *quantiles)


def clipped_to_quantiles(df: DataFrame, column: str, lo: float, hi: float, by: Iterable[str] = ()) -> DataFrame:
    """`df` with `norm`: the value within its section's quantiles; every row stays, one without a section has a NULL norm."""
    by = list(by)
    bounds = section_quantiles(df, column, {"_lo": lo, "_hi": hi}, by)
    if by:
        both = df.join(bounds, by, "left")
    else:
        both = df.withColumn("_all", F.lit(0)).join(bounds.withColumn("_all", F.lit(0)), "_all", "left").drop("_all")
    known = F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")) & F.col("_lo").isNotNull()
    return both.withColumn("norm", F.when(known, F.greatest("_lo", F.least("_hi", F.col(column).cast("double"))))).drop("_lo", "_hi")
