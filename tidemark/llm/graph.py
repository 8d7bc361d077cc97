"""Connected components of a table of edges: union-find inside batches, then large-star and small-star steps across them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, split_join


def forest(a: list[int], b: list[int]) -> dict[int, int]:
    """Each node of the edges and the smallest node of its component, by union-find with path halving."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def _contracted(edges: DataFrame) -> DataFrame:
    """u, v (u > v) with the same components as edges (a, b): of each batch the trees of its union-find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = forest(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            pairs = [(x, r) for x, r in roots.items() if x != r]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    return edges.select("a", "b").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component (its smallest reachable node) for every node of `edges` (a, b long) that isn't itself smallest.

    An edge leads from its larger node u to its smaller v. The large step needs the smallest neighbour of v: edges whose v
    has none smaller stay as they are, the rest meet a pre-aggregated minimum, and a v or u that very many edges have is
    split (`split_join`). Each step is written to the shared folder, which cuts the lineage. The steps end when every u has
    one edge and no v is a u of another, which is counted exactly.
    """
    now = scratch.write(_contracted(edges.where("a <> b").select("a", "b")).distinct(), f"{name}-0")
    step = 0
    while True:
        smaller = now.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("several"))
        larger = now.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        ends = scratch.write(larger.join(smaller, F.col("u") == F.col("v"), "full"), f"{name}-ends-{step}")
        total, crossed, unsettled = ends.agg(F.sum("n"), F.count_if(F.expr("n > 0 and several > 0")), F.count_if(F.expr("several > 1"))).first()
        if not unsettled and not crossed:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        if crossed:
            moved = split_join(now, ends.where("v is not null").select("v", "m", "n"), "v", "u", total)
            now = scratch.write(moved.select("u", F.coalesce("m", "v").alias("v")).distinct(), f"{name}-large-{step}")
        least = scratch.write(now.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-least-{step}")
        small = (
            split_join(now, least, "u", "v", total)
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = scratch.write(small, f"{name}-{step + 1}")
        scratch.drop(*(f"{name}-{k}{step}" for k in ("", "ends-", "large-", "least-")))
        step += 1
