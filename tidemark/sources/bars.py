"""Canonical daily bars: asset, dt, open, high, low, close, volume, amount, oi, sector, close_next, long_pos, short_pos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cols as C

# Names that market tables use for the canonical columns, in order of preference.
ALIASES = {
    "dt": ("TRADE_DT", "date"),
    "asset": ("PRODUCT_CODE", "ticker"),
    "open": ("S_DQ_OPEN", "OPEN"),
    "high": ("S_DQ_HIGH", "HIGH"),
    "low": ("S_DQ_LOW", "LOW"),
    "close": ("S_DQ_CLOSE_ADJ", "S_DQ_CLOSE", "CLOSE"),
    "volume": ("S_DQ_VOLUME", "VOLUME"),
    "amount": ("S_DQ_AMOUNT", "AMOUNT"),
    "oi": ("S_DQ_OI", "OI"),
    "sector": ("INDUSTRY",),
    "contract_type": ("FS_INFO_TYPE",),
    "close_next": ("settle_next", "next_close"),
    "long_pos": ("long_position", "top20_long", "long_oi", "member_long"),
    "short_pos": ("short_position", "top20_short", "short_oi", "member_short"),
}
MAIN_CONTRACT = "主力合约_Wind调整"
PAIRS = (("Brand#11", "Brand#12"), ("Brand#21", "Brand#22"), ("Brand#3", "Brand#4"), ("Brand#5", "Brand#6"))


def canonical(df: DataFrame, main_contract: str | None = MAIN_CONTRACT) -> DataFrame:
    """Canonical names and types: NaN becomes NULL, dt a date, amount falls back to volume * close."""
    names = set(df.columns)
    for to, known in ALIASES.items():
        if to not in names and (found := next((k for k in known if k in names), None)):
            df = df.withColumnRenamed(found, to)
            names.add(to)
    for c in ("open", "high", "low", "close", "volume", "amount", "oi", "close_next", "long_pos", "short_pos"):
        if c in names:
            df = df.withColumn(c, F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))
    if "contract_type" in names and main_contract is not None:
        df = df.where(F.col("contract_type") == main_contract)
    if {"volume", "close"} <= names:
        fallback = F.col("volume") * F.col("close")
        df = df.withColumn("amount", F.coalesce("amount", fallback) if "amount" in names else fallback)
    return df.withColumn("dt", F.to_date("dt"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars from trades: brands are assets, p_retailprice * (1 - l_discount) is a tick's price.

    Only min, max and exact decimal sums, so map-side partial aggregation leaves one row for each asset and day to shuffle.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_retailprice")
    tick = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    q, px = F.col("l_quantity").cast("decimal(18,2)"), F.round("px", 4).cast("decimal(18,4)")
    money = lambda c: F.sum(c).cast("double")
    bars = (
        items.join(parts, items.l_partkey == parts.p_partkey)
        .withColumn("px", F.col("p_retailprice") * (1 - F.col("l_discount")))
        .withColumn("tick", tick)
        .groupBy(F.col("p_brand").alias("asset"), F.to_date("l_shipdate").alias("dt"))
        .agg(
            F.min_by("px", "tick").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "tick").alias("close"),
            money(q).alias("volume"),
            money((px * q).cast("decimal(28,6)")).alias("amount"),
            money(F.when(F.col("l_discount") >= 0.05, q).otherwise(0)).alias("long_pos"),
            money(F.when(F.col("l_discount") < 0.05, q).otherwise(0)).alias("short_pos"),
        )
    )
    return (
        bars.withColumn("oi", F.sum("volume").over(C.last(20)))
        .withColumn("sector", F.concat(F.lit("sector"), (F.regexp_extract("asset", r"(\d+)$", 1).cast("int") % 5).cast("string")))
        .withColumn("close_next", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)
    )


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second grain: hourly bars of events by type."""
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .where("value is not null")
        .groupBy(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").alias("dt"))
        .agg(
            F.min_by("value", F.struct("ts", "event_id")).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", F.struct("ts", "event_id")).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def industries(spark: SparkSession, sf_dir: str, least: float = 0.25) -> DataFrame:
    """asset, sector: a brand's most frequent class of sizes, if it has at least that share of its parts."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("asset"), F.floor(F.col("p_size") / 10).alias("size"))
    counts = parts.groupBy("asset", "size").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("asset").agg(F.max(F.struct("n", "size")).alias("top"), F.sum("n").alias("parts"))
    return top.where(F.col("top.n") >= least * F.col("parts")).select("asset", F.concat(F.lit("size"), F.col("top.size").cast("string")).alias("sector"))


def with_industry(bars: DataFrame, table: DataFrame, unknown: str = "unknown") -> DataFrame:
    """`bars` with the sector of an industry table (asset, sector, or any of their aliases), else the one they have, else `unknown`.

    A left join: every bar stays and none is repeated. Of an asset's sectors the first by name counts, an empty one isn't
    any; spaces around names don't matter. The table has a row for each asset; Spark broadcasts it by its measured size.
    """
    for to in ("asset", "sector"):
        if to not in table.columns:
            table = table.withColumnRenamed(next(k for k in ALIASES[to] if k in table.columns), to)
    known = table.select(F.trim("asset").alias("asset"), F.nullif(F.trim("sector"), F.lit("")).alias("_sector"))
    known = known.groupBy("asset").agg(F.min("_sector").alias("_sector"))
    own = [F.col("sector")] if "sector" in bars.columns else []
    return bars.join(known, "asset", "left").withColumn("sector", F.coalesce("_sector", *own, F.lit(unknown))).drop("_sector")


def selected(bars: DataFrame, assets: list[str] | None = None, sectors: list[str] | None = None) -> DataFrame:
    """Assets listed or in the sectors listed; all if neither is given."""
    if not assets and not sectors:
        return bars
    return bars.where(F.col("asset").isin(assets or []) | F.col("sector").isin(sectors or []))


def padded_range(bars: DataFrame, start: str, end: str, lookback_days: int) -> DataFrame:
    """Rows that factors of a finite memory can need for [start, end]; reaches the scan as a plain filter on dt."""
    return bars.where((F.col("dt") >= F.date_sub(F.lit(start).cast("date"), lookback_days)) & (F.col("dt") <= F.lit(end).cast("date")))


def liquid(bars: DataFrame, method: str = "strict", min_volume: float = 10000, min_oi: float = 5000, share: float = 0.5) -> DataFrame:
    """asset, avg_volume, avg_oi of liquid assets: strict (both floors), percentile (upper share by volume) or composite (mean of both ranks)."""
    by_asset = bars.groupBy("asset").agg(F.avg("volume").alias("avg_volume"), F.avg("oi").alias("avg_oi"))
    if method == "strict":
        return by_asset.where((F.col("avg_volume") >= min_volume) & (F.col("avg_oi") >= min_oi))
    rank = lambda c: F.percent_rank().over(W.orderBy(c))
    score = rank("avg_volume") if method == "percentile" else (rank("avg_volume") + rank("avg_oi")) / 2
    return by_asset.withColumn("score", score).where(F.col("score") >= 1 - share).drop("score")


def pair_bars(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """a1, a2, dt and both legs' close and r, on dates that both have. pairs: a1, a2.

    The bars meet the pair list first, so that each leg is filtered before the legs meet on their date.
    """
    slim = bars.select("asset", "dt", "close", C.change("close").alias("r"))
    one = slim.join(pairs, slim.asset == pairs.a1).select("a1", "a2", "dt", F.col("close").alias("c1"), F.col("r").alias("r1"))
    two = slim.join(pairs, slim.asset == pairs.a2).select("a1", "a2", "dt", F.col("close").alias("c2"), F.col("r").alias("r2"))
    return one.join(two, ["a1", "a2", "dt"])


def pair_list(spark: SparkSession, pairs=PAIRS) -> DataFrame:
    return spark.createDataFrame(list(pairs), "a1 string, a2 string")


def close_table(bars: DataFrame, assets: list[str]) -> DataFrame:
    """dt and the close (mean of several) of each listed asset, on dates that all have."""
    return selected(bars, assets).groupBy("dt").pivot("asset", sorted(assets)).agg(F.avg("close")).dropna()


def calendar(bars: DataFrame) -> DataFrame:
    """dt and its number among all dates."""
    return bars.select("dt").distinct().withColumn("ci", F.row_number().over(W.orderBy("dt")))


def as_of_prices(bars: DataFrame) -> DataFrame:
    """For every asset and calendar date the last close up to it; no row before an asset's first.

    Each bar is repeated for the dates up to the asset's next one, so nothing is joined back. For query times of one's own
    see `operators.joins.as_of`.
    """
    days = calendar(bars)
    end = days.agg(F.max("ci").alias("end"))
    until = F.coalesce(F.lead("ci").over(W.partitionBy("asset").orderBy("ci")), F.col("end") + 1)
    spans = bars.select("asset", "dt", "close").join(days, "dt").join(F.broadcast(end)).withColumn("until", until)  # one row on the right
    return spans.select("asset", "close", F.explode(F.sequence("ci", F.col("until") - 1)).alias("ci")).join(days, "ci").where("close is not null").select("asset", "dt", "close")


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, asset, at: irregular query times. Each user asks for one of the brands; a second of 2024 is 80 of 1995 on."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null and user_id is not null")
    at = F.timestamp_seconds(F.lit(788918400) + (F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) * 80)
    return events.select("event_id", F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("asset"), at.alias("at"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, valid_from, valid_to, long_pos, short_pos: month by month the urgent and the other orders of a nation's customers,
    known from the next month on until a newer fact comes."""
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    q = F.col("o_totalprice").cast("decimal(18,2)")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    asset = F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string"))
    month = F.add_months(F.trunc("o_orderdate", "month"), 1)
    money = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    facts = (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy(asset.alias("asset"), month.alias("valid_from"))
        .agg(money(F.when(urgent, q)).alias("long_pos"), money(F.when(~urgent, q)).alias("short_pos"))
    )
    return facts.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy("asset").orderBy("valid_from")))


def win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, valid_from, valid_to, win_rate: the share of filled orders in a nation's quarter, valid in the quarter after it,
    where there were four orders."""
    orders, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    asset = F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string"))
    quarter = F.add_months(F.trunc("o_orderdate", "quarter"), 3)
    filled = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    facts = orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy(asset.alias("asset"), quarter.alias("valid_from")).agg(C.div(F.sum(filled), F.count(F.lit(1))).alias("win_rate"), F.count(F.lit(1)).alias("n"))
    return facts.where("n >= 4").select("asset", "valid_from", F.add_months("valid_from", 3).alias("valid_to"), "win_rate")
