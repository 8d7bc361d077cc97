"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed on full digests.

Runs on DataFrame functions alone. Defined cases: a null url, or one without "://", has an empty host and path and
gets the default verdict; urls of any length are read whole, the first "://" alone ends the scheme; repeated rows and urls
are each judged; a rule with a null host or path fits nothing, one with a null verdict gives the default; an empty table
gives an empty result; other columns are kept, but for those that the result adds. Among rules that fit, the longest (host + path, in characters) wins, then the longer host, then block
before allow.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, packed, split_join

PREFIX_HEX = 8  # 32 bits of the SHA-256 digest take part in the join
BROADCAST_RULES = 50_000
ADDED = ("host", "path", "rule", "verdict")

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _rest(url: Column) -> Column:
    """What follows the first "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)", 1), F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*(/[^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX_HEX), 16, 10).cast("long")


def _expressions(shapes: list[tuple[int, int]]) -> Column:
    """Digests of a site's last k labels with the first n characters of its path, for the shapes (k, n) that it has room for."""
    labels, path = F.split("site.host", r"\."), F.col("site.path")
    known = F.from_json(F.lit(json.dumps([{"k": k, "n": n} for k, n in shapes])), "array<struct<k: int, n: int>>")
    fitting = F.filter(known, lambda s: (F.size(labels) >= s["k"]) & (F.length(path) >= s["n"]))
    return F.transform(fitting, lambda s: _digest(F.array_join(F.slice(labels, -s["k"], s["k"]), "."), F.substring(path, F.lit(1), s["n"])))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """`pages` with host, path, rule and verdict. `rules`: host, path, verdict.

    Each distinct site, a pair of host and path, is expanded only to the shapes that rules have: a pair of the number of host
    labels and the length of the path. The shapes are data of one expression; they are read on the driver, and their number
    is bounded by the longest rule's labels times its length. Up to `broadcast_rules` rules are broadcast; more are joined
    by a shuffle that splits expressions which many sites share, as the join of pages to their sites always does. Rules and
    pages are counted when this is called.
    """
    rules = rules.where("host is not null and path is not null").select("host", "path", "verdict").distinct()
    digest = _digest(F.col("host"), F.col("path"))
    ruled = rules.select(
        _short(digest).alias("short"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("chars"),
        F.struct(
            F.length(F.concat("host", "path")).alias("n"),
            F.length("host").alias("host_chars"),
            (F.coalesce("verdict", F.lit("")) == "block").alias("blocks"),
            F.concat("host", "path").alias("rule"),
            F.col("verdict").alias("verdict"),
            digest.alias("digest"),
        ).alias("rule"),
    )
    shapes = sorted((r.labels, r.chars) for r in ruled.select("labels", "chars").distinct().collect())

    judged = packed(pages.drop(*ADDED), "url").withColumn("site", F.struct(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")))
    like = pages.drop(*ADDED)
    if not shapes:
        plain = judged.withColumn("best", F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")))
        return _verdicts(plain, like, default)
    by_short = ruled.groupBy("short").agg(F.collect_list("rule").alias("_rules"))  # rules of equal digest differ in verdict alone
    sites = judged.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    expanded = sites.select("site", "pages", F.explode(_expressions(shapes)).alias("digest")).withColumn("short", _short(F.col("digest")))
    if ruled.count() <= broadcast_rules:
        met = expanded.join(F.broadcast(by_short), "short")
    else:
        counted = Scratch(pages.sparkSession).write(by_short.join(expanded.groupBy("short").agg(F.count(F.lit(1)).alias("n")), "short"), "rules")
        met = split_join(expanded, counted, "short", "site", counted.agg(F.sum("n")).first()[0] or 0)
    best = (
        met.select("site", "pages", F.explode(F.filter("_rules", lambda r: r["digest"] == F.col("digest"))).alias("found"))
        .groupBy("site")
        .agg(F.max("found").alias("best"), F.first("pages").alias("n"))
    )
    return _verdicts(split_join(judged.withColumn("_id", F.monotonically_increasing_id()), best, "site", "_id", pages.count(), "left"), like, default)


def _verdicts(judged: DataFrame, like: DataFrame, default: str) -> DataFrame:
    columns = [F.col("url") if c == "url" else F.col("_row")[c].alias(c) for c in like.columns]
    return judged.select(*columns, "site.host", "site.path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT page_id, rest, CASE WHEN cut = 0 THEN rest ELSE substr(rest, 1, cut - 1) END AS raw_host
  FROM (SELECT page_id, rest, length(regexp_extract(rest, '^[^/?#]*')) + 1 AS cut
        FROM (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
              FROM pages))),
hp AS (
  SELECT row_number() OVER () AS rn, page_id,
    translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM parts),
fit AS (
  SELECT rn, rh || rp AS rule, rv,
    row_number() OVER (PARTITION BY rn ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS k
  FROM hp JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict
FROM hp LEFT JOIN (SELECT rn, rule, rv FROM fit WHERE k = 1) USING (rn)
"""
