"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

A document's size is its number of words. Targets per source come from weights, capped at `max_epochs` times the
source's size, the excess shared again by weight. Whole epochs of a source come first; what is left of its target is
filled in the order of exponential keys -ln(u) / quality, to the document nearest the budget.

The order never needs one task per source: keys fall into `buckets` ranges, sizes are summed per source and range, and
only the range in which the budget ends is sorted.

Repeated rows (equal id, text and source) share a key and lie side by side in that order. Where a target ends among them,
as many of them are taken as bring the source nearest to it: each Spark partition gives its share by its count of them.

Defined cases: null text or one without words has size 0; texts of any length are counted whole; null sources form one
source, last in order; an empty table gives an empty result; further columns are kept by `mix` and don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, packed, table, unpacked, word_count

BUCKETS = 4096


def quality_weight(text: Column) -> Column:
    """1 less the share of ASCII digits and signs among the characters, at least 0.25; null or empty text has 0.25."""
    share = F.regexp_count(text, F.lit(r"[!-@\[-`{-~]")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.25), F.lit(1.0) - share), F.lit(0.25))


def _drawn(docs: DataFrame, quality: Column | None, seed: str) -> DataFrame:
    """_size, _key and _bucket beside each row; the same for the same id, text and seed in every run."""
    named = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit("")))
    u = (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 1) / F.lit(4503599627370497.0)
    return (
        docs.withColumn("_size", word_count(F.col("text")))
        .withColumn("_key", -F.log(u) / (quality_weight(F.col("text")) if quality is None else quality))
        .withColumn("_bucket", F.floor((1 - F.exp(-F.col("_key") / 2)) * BUCKETS))
    )


def plan(drawn: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Per source: source_size, target, _epochs, and _last, the largest key that the fractional epoch takes.

    `drawn` has source, _size, _key and _bucket. Windows without partitions run over one row per source.
    """
    ranges = drawn.groupBy("source", "_bucket").agg(F.sum("_size").alias("held"))
    every = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = (
        ranges.groupBy("source")
        .agg(F.sum("held").alias("source_size"))
        .withColumn("rank", F.row_number().over(every) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    )
    filling = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = W.partitionBy()
    level = (
        (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing))
    )
    sources = (
        sources.withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long"))
        .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
        .select("source", "source_size", "target", "_epochs", "_rest")
    )
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    reached = (
        ranges.alias("a")
        .join(sources.alias("b"), same)
        .select("a.*", "b._rest")
        .withColumn("upto", F.sum("held").over(W.partitionBy("source").orderBy("_bucket")))
        .where(F.col("upto") > F.col("_rest"))
        .groupBy("source")
        .agg(F.min(F.struct("_bucket", F.col("upto").alias("upto"), "held", "_rest")).alias("end"))
        .select("source", F.col("end._bucket").alias("_end"), (F.col("end.upto") - F.col("end.held")).alias("_before"), "end._rest")
    )
    by_key = W.partitionBy("source").orderBy("_key")
    some = F.least(F.col("n"), F.greatest(F.lit(0), F.floor((F.col("_rest") - F.col("upto")) / F.col("_size") + F.col("n") + 0.5)))
    last = (
        drawn.alias("a")
        .join(reached.alias("b"), same & (F.col("a._bucket") == F.col("b._end")))
        .groupBy("a.source", "a._key")
        .agg(F.max("a._size").alias("_size"), F.count(F.lit(1)).alias("n"), F.first("b._before").alias("_before"), F.first("b._rest").alias("_rest"))
        .withColumn("upto", F.col("_before") + F.sum(F.col("_size") * F.col("n")).over(by_key))
        .withColumn("some", F.when(F.col("_size") > 0, some).when(F.col("upto") <= F.col("_rest"), F.col("n")).otherwise(0).cast("long"))
        .groupBy("source")
        .agg(
            F.max(F.when(F.col("some") == F.col("n"), F.col("_key"))).alias("_in"),
            F.max(F.when((F.col("some") > 0) & (F.col("some") < F.col("n")), F.struct(F.col("_key"), "some", "n"))).alias("_cut"),
        )
    )
    ended = (
        reached.alias("a")
        .join(last.alias("b"), same)
        .select("a.source", F.coalesce("b._in", F.lit(-1.0)).alias("_in"), "b._cut", "a._end")
    )
    return (
        sources.alias("a")
        .join(ended.alias("b"), same, "left")
        .select("a.source", "a.source_size", "a.target", "a._epochs", "b._in", "b._end", "b._cut")
    )


def _copies() -> Column:
    """Epochs, and one more for keys in ranges before the last or up to the last key taken."""
    return F.col("_epochs") + F.coalesce((F.col("_bucket") < F.col("_end")) | (F.col("_key") <= F.col("_in")), F.lit(False)).cast("long")


def _of_repeated(rows: DataFrame) -> DataFrame:
    """One more copy for `_cut.some` of a source's `_cut.n` repeated rows, dealt over partitions by how many each has of them."""
    rows = rows.withColumn("_part", F.spark_partition_id()).withColumn("_row_id", F.monotonically_increasing_id())
    held = rows.groupBy("_source", "_part").agg(F.count(F.lit(1)).alias("held"), F.first("_cut").alias("cut"))
    upto = F.sum("held").over(W.partitionBy("_source").orderBy("_part"))  # a row for each partition
    share = lambda c: F.floor(F.col("cut.some") * c / F.col("cut.n"))
    quotas = held.withColumn("upto", upto).select(F.col("_source").alias("_of"), F.col("_part").alias("_at"), (share(F.col("upto")) - share(F.col("upto") - F.col("held"))).alias("_quota"))
    mine = F.row_number().over(W.partitionBy("_source", "_part").orderBy("_row_id")) <= F.col("_quota")
    met = rows.join(quotas, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_at")))
    return met.withColumn("copies", F.col("_epochs") + mine.cast("long")).drop("_part", "_row_id", "_of", "_at", "_quota")


def apply_plan(drawn: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows of `drawn` with source_size, target and copies. Looks at the plan, a row for each source, when called."""
    wanted = planned.withColumnRenamed("source", "_source")
    met = drawn.join(wanted, F.col("source").eqNullSafe(F.col("_source")))
    if planned.where("_cut is not null").isEmpty():
        found = met.withColumn("copies", _copies())
    else:
        cut = F.coalesce(F.col("_key") == F.col("_cut._key"), F.lit(False))
        found = met.where(~cut).withColumn("copies", _copies()).unionByName(_of_repeated(met.where(cut)))
    return found.drop("_source", "_epochs", "_in", "_end", "_cut")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, quality: Column | None = None, seed: str = "mix:") -> DataFrame:
    """The rows of `docs` (doc_id, text, source, any others), each as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession)
    drawn = _drawn(packed(docs, "doc_id", "text", "source"), quality, seed)
    slim = scratch.write(drawn.select("source", "_size", "_key", "_bucket"), "drawn")
    planned = scratch.write(plan(slim, weights, max_epochs), "plan")
    taken = apply_plan(drawn, planned).where("copies > 0")
    return unpacked(taken.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    scratch = Scratch(spark)
    drawn = scratch.write(_drawn(docs, None, "mix:").drop("text"), "drawn")
    planned = scratch.write(plan(drawn), "plan")
    return apply_plan(drawn, planned).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken")
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370497.0)
      / coalesce(greatest(0.25, 1.0 - length(regexp_extract_all(text, '[!-@\[-`{-~]')) / greatest(length(text), 1)), 0.25) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r
  FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(r % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
f AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
l AS (SELECT level FROM f WHERE level <= cap / weight ORDER BY cap / weight, r LIMIT 1),
t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM l)) AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs FROM t),
c AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
