"""Joins of dated rows: the last row up to a time, facts with ranges of validity, places counted from the end, defaults.

Each works on keys of any size: time is cut into pieces that join or sort by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cols as C


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, known: str, columns: list[str], unit: str = "month") -> DataFrame:
    """`left` with `columns` of the last row of `right` that has the same keys and `known` <= `at`; NULL if there is none.

    One sort of the union of both sides by keys, piece of time and time; the last row before each piece comes from a prefix
    over the pieces. Rows of `right` with equal keys and time: the largest `columns` count. NULL keys meet nothing.
    """
    fields = F.struct(*(F.col(c) for c in columns))
    kept = F.struct(*left.columns)
    time = lambda c: F.col(c).cast("timestamp")
    queries = left.select(*keys, time(at).alias("_t"), F.lit(None).cast(right.select(fields.alias("f")).schema["f"].dataType).alias("_f"), kept.alias("_left"))
    facts = right.where(F.col(known).isNotNull()).select(*keys, time(known).alias("_t"), fields.alias("_f"), F.lit(None).cast(queries.schema["_left"].dataType).alias("_left"))
    both = queries.unionByName(facts).withColumn("_piece", F.date_trunc(unit, "_t"))
    order = W.partitionBy(*keys, "_piece").orderBy("_t", F.col("_f").asc_nulls_last())
    here = F.last("_f", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    piece = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    ends = both.groupBy(*keys, "_piece").agg(F.max_by("_f", F.when(F.col("_f").isNotNull(), F.struct("_t", "_f"))).alias("_end"))
    carried = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(piece)).drop("_end")
    met = both.withColumn("_here", here).where("_left is not null").join(carried, [*keys, "_piece"], "left")
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_here", "_before"))
    nothing = F.lit(None).cast(both.schema["_f"].dataType)
    found = F.when(C.all_known(keys), found).otherwise(nothing)
    return met.withColumn("_found", found).select("_left.*", *(F.col("_found")[c].alias(c) for c in columns))


def valid_on(rows: DataFrame, facts: DataFrame, columns: list[str], key: str = "asset", at: str = "dt", unit: str = "month") -> DataFrame:
    """`rows` with `columns` of the fact on the same key whose range [valid_from, valid_to) holds `at`; NULL if none does.

    An interval join by pieces of time: a fact is repeated for each piece that its range touches, an open range (NULL) up to
    the last row's. Of several facts that hold, the one that began last counts, then the largest `columns`.
    """
    last = rows.agg(F.max(at).alias("_last"))
    until = F.coalesce(F.date_sub("valid_to", 1), F.col("_last"))
    ranges = facts.crossJoin(F.broadcast(last)).where(F.col("valid_from") <= until)  # one row on the right
    pieces = F.sequence(F.date_trunc(unit, "valid_from"), F.date_trunc(unit, until), F.expr(f"interval 1 {unit}"))
    dealt = ranges.select(F.col(key).alias("_key"), "valid_from", until.alias("_until"), F.struct(*columns).alias("_fact"), F.explode(pieces).alias("_piece"))
    met = rows.select(key, at).distinct().withColumn("_piece", F.date_trunc(unit, at)).join(dealt.withColumnRenamed("_key", key), [key, "_piece"])
    holds = met.where((F.col("valid_from") <= F.col(at)) & (F.col(at) <= F.col("_until")))
    best = holds.groupBy(key, at).agg(F.max(F.struct("valid_from", "_fact")).alias("_best"))
    return rows.join(best, [key, at], "left").select(*rows.columns, *(F.col("_best._fact")[c].alias(c) for c in columns))


def tails(values: DataFrame, as_of_dates: DataFrame, window: int, column: str = "r") -> DataFrame:
    """as_of, asset, place (0 is the last), `column`: each asset's last `window` values up to every date of `as_of_dates` (as_of).

    Dates are only used to find where a tail ends; NULLs of `column` are no values.
    """
    numbered = values.where(F.col(column).isNotNull()).select("asset", "dt", column).withColumn("i", C.age())
    wanted = numbered.select("asset").distinct().crossJoin(as_of_dates.select("as_of"))  # a row for each tail of the result
    ends = as_of(wanted, numbered, ["asset"], "as_of", "dt", ["i"]).where("i is not null").withColumnRenamed("i", "end")
    pieces = F.array_distinct(F.array(F.floor(F.col("end") / window), F.floor((F.col("end") - window + 1) / window)))
    dealt = ends.withColumn("piece", F.explode(pieces))
    met = dealt.join(numbered.withColumn("piece", F.floor(F.col("i") / window)).drop("dt"), ["asset", "piece"])
    place = F.col("end") - F.col("i")
    return met.where((place >= 0) & (place < window)).select("as_of", "asset", place.alias("place"), column)


def looked_up(rows: DataFrame, table: DataFrame, key: str, value: str, default: Column, by: Column, largest: int = 100_000) -> DataFrame:
    """`rows` with `value` of `table`'s row whose `key` equals `by`, else `default`. Broadcast up to `largest` rows, which are counted when called."""
    one = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(value).alias("_value"))
    small = one.count() <= largest
    met = rows.drop(value).withColumn("_by", by).join(F.broadcast(one) if small else one, F.col("_by") == F.col("_key"), "left")
    return met.withColumn(value, F.coalesce("_value", default)).drop("_by", "_key", "_value")


def product_code(symbol: Column) -> Column:
    """RB of rb2401.SHF: upper case, without what follows the first dot and without digits at the end."""
    return F.regexp_replace(F.upper(F.substring_index(symbol, ".", 1)), r"\d+$", "")


def multipliers(rows: DataFrame, table: DataFrame, symbol: str = "asset", default: int = 10) -> DataFrame:
    """`rows` with the contract multiplier of their symbol's product. table: product, multiplier."""
    return looked_up(rows, table, "product", "multiplier", F.lit(default), product_code(F.col(symbol)))
