"""Embedding near-dedup: a hierarchical navigable small-world graph per shard, every shard queried, cosine verified.

Vectors with the same label and components form a class, and one of each class goes on. The vectors of a label are
dealt into shards of bounded size; a task builds a shard's graph, inserting growing chunks of vectors that search
together.

The audit takes the classes that hold an id divisible by 50 as queries, against every graph of their label, and compares
with brute force at each width of a ladder of beams. Found and true links are summed over all tasks: a label takes the
first width at which both its own recall and that of all labels reach RECALL. Then every shard's vectors query every
graph of their label with that beam, from which links are followed on; a query whose beam holds nothing but links is
widened to the whole shard. Links are confirmed by cosine in double precision. A task has both directions of two shards,
keeps their links as bits, and gives only the number of links of each vector and a spanning tree of the components, so
that what leaves it grows with the vectors, however many links there are.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link
with nothing; vectors of different lengths don't link; rows that repeat a vec_id share its result; a null vec_id links
with nothing, has a null component and isn't kept; an empty table gives an empty result; further columns don't matter.
`recall` is the share of the label's audited links that were found, null where the audit has none.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, split_join, table
from .graph import components

LINKS, BUILD_BEAM = 12, 32  # neighbours on the upper levels (twice as many on level 0); beam of insertions
SHARD, SHARD_BYTES, QUERIES, CHUNK = 16384, 32 << 20, 1024, 512
WHOLE = 1 << 30  # a beam as wide as any shard: every vector is compared
BEAMS, UNMEASURED = (16, 32, 64, 128, 256, 512, 1024, WHOLE), 128  # the beam where no audited query has a link
AUDITED, RECALL = 50, 0.98
SLACK = 0.05  # how far below the threshold a node may be that leads on to links


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length 1 (largest component first, so that squares can't overflow)."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Graph:
    """neighbours[level][node] holds node numbers, -1 where there is none; node 0 upwards, in order of insertion."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, neighbours: list[np.ndarray], entry: int):
        self.vectors, self.levels, self.neighbours, self.entry = vectors, levels, neighbours, entry

    def _near(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Cosine of each query with its row of ids; -2 for -1."""
        s = np.matmul(self.vectors[np.maximum(ids, 0)], queries[:, :, None])[:, :, 0]
        return np.where(ids >= 0, s, np.float32(-2))

    def descend(self, queries: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        """Greedy steps on a level from the nodes `at`."""
        now = self._near(queries, at[:, None])[:, 0]
        live = np.arange(len(queries))
        at = at.copy()
        while len(live):
            ids = self.neighbours[level][at[live]]
            s = self._near(queries[live], ids)
            best = s.argmax(axis=1)
            gain = s[np.arange(len(live)), best] > now[live]
            live, ids, best = live[gain], ids[gain], best[gain]
            at[live], now[live] = ids[np.arange(len(live)), best], s[gain][np.arange(len(live)), best]
        return at

    def beam(self, queries: np.ndarray, at: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nodes found nearest to each query, with their cosines, best first."""
        n, rows = len(queries), np.arange(len(queries))
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -2, np.float32)
        done = np.zeros((n, width), bool)
        ids[:, 0], sims[:, 0] = at, self._near(queries, at[:, None])[:, 0]
        visited = np.zeros((n, len(self.vectors)), bool)
        visited[rows, at] = True
        live = rows
        while len(live):
            open_ = np.where(done[live], np.float32(-3), sims[live])
            pick = open_.argmax(axis=1)
            going = open_[np.arange(len(live)), pick] > -2
            live, pick = live[going], pick[going]
            if not len(live):
                break
            done[live, pick] = True
            new = self.neighbours[level][ids[live, pick]]
            seen = visited[live[:, None], np.maximum(new, 0)]
            new = np.where((new < 0) | seen, -1, new)
            r, c = np.nonzero(new >= 0)
            visited[live[r], new[r, c]] = True
            s = self._near(queries[live], new)
            all_s = np.concatenate((sims[live], s), axis=1)
            keep = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            take = lambda a: np.take_along_axis(a, keep, axis=1)
            ids[live] = take(np.concatenate((ids[live], new), axis=1))
            done[live] = take(np.concatenate((done[live], np.zeros(new.shape, bool)), axis=1))
            sims[live] = take(all_s)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(queries), self.entry)
        for level in range(len(self.neighbours) - 1, 0, -1):
            at = self.descend(queries, at, level)
        return self.beam(queries, at, 0, min(width, len(self.vectors)))

    def within(self, queries: np.ndarray, width: int, low: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Query rows and nodes with a cosine of `low` or more: those of a beam, and all that neighbours of such lead to.

        Nodes up to SLACK below `low` are passed through. Queries whose beam is full of links meet the whole shard.
        """
        n = len(self.vectors)
        if width >= n:
            for lo in range(0, len(queries), 256):
                r, node = np.nonzero(queries[lo : lo + 256] @ self.vectors.T >= low)
                yield lo + r, node
            return
        ids, sims = self.search(queries, width)
        full = np.flatnonzero(sims[:, -1] >= low)
        for lo in range(0, len(full), 256):
            r, node = np.nonzero(queries[full[lo : lo + 256]] @ self.vectors.T >= low)
            yield full[lo + r], node
        seen = np.zeros(len(queries) * n, bool)
        r, c = np.nonzero(ids >= 0)
        seen[r * n + ids[r, c]] = True
        r, c = np.nonzero((sims >= low - SLACK) & (sims[:, -1:] < low))
        node, s = ids[r, c], sims[r, c]
        yield r[s >= low], node[s >= low]
        while len(r):
            near = self.neighbours[0][node]
            key = (r[:, None] * n + near)[near >= 0]
            key = np.unique(key[~seen[key]])
            seen[key] = True
            r, node = key // n, key % n
            s = np.concatenate([np.einsum("ij,ij->i", queries[r[i : i + 65536]], self.vectors[node[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0)])
            yield r[s >= low], node[s >= low]
            on = s >= low - SLACK
            r, node = r[on], node[on]

    def diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row of candidates (best first), those nearer to the row's node than to any chosen before; then the rest."""
        x = self.vectors[np.maximum(ids, 0)]
        among = np.matmul(x, x.transpose(0, 2, 1))
        valid = ids >= 0
        chosen = np.zeros(ids.shape, bool)
        for i in range(ids.shape[1]):
            rival = np.where(chosen, among[:, i], np.float32(-2)).max(axis=1)
            chosen[:, i] = valid[:, i] & (sims[:, i] > rival) & (chosen.sum(axis=1) < most)
        order = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, order, axis=1)
        return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)

    def link(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, level: int) -> None:
        """Join nodes to the diverse ones of their candidates, both ways."""
        table_ = self.neighbours[level]
        most = table_.shape[1]
        mine = self.diverse(ids, sims, most // 2 if level == 0 else most)
        table_[nodes, : mine.shape[1]] = mine
        r, c = np.nonzero(mine >= 0)
        target, source = mine[r, c], nodes[r]
        uniq, inverse, count = np.unique(target, return_inverse=True, return_counts=True)
        order = np.argsort(inverse, kind="stable")
        slot = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
        wide = np.full((len(uniq), most + int(count.max() if len(count) else 0)), -1, np.int64)
        wide[:, :most] = table_[uniq]
        wide[inverse[order], most + slot] = source[order]
        wide = -np.sort(-wide, axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        free = (wide >= 0).sum(axis=1) <= most
        if free.any():
            table_[uniq[free]] = -np.sort(-wide[free], axis=1)[:, :most]
        for lo in range(0, len(full := np.flatnonzero(~free)), 256):
            part = full[lo : lo + 256]
            s = self._near(self.vectors[uniq[part]], wide[part])
            by = np.argsort(-s, axis=1, kind="stable")[:, : most + 16]
            table_[uniq[part]] = self.diverse(np.take_along_axis(wide[part], by, axis=1), np.take_along_axis(s, by, axis=1), most)

def build(ids: np.ndarray, vectors: np.ndarray) -> Graph:
    """A graph over unit vectors; levels come from the ids, so that a rebuilt graph is the same."""
    n = len(ids)
    u = np.array([int.from_bytes(hashlib.blake2b(str(i).encode(), digest_size=7).digest(), "little") + 1 for i in ids.tolist()]) / 2.0**56
    levels = np.minimum((-np.log(u) / np.log(LINKS)).astype(np.int64), 8)
    top = int(levels.max())
    neighbours = [np.full((n, 2 * LINKS if level == 0 else LINKS), -1, np.int64) for level in range(top + 1)]
    g = Graph(vectors.astype(np.float32), levels, neighbours, 0)
    start, size = 1, 1
    while start < n:
        nodes = np.arange(start, min(n, start + size))
        q, reach = g.vectors[nodes], int(levels[g.entry])
        at = np.full(len(nodes), g.entry)
        inside = q @ q.T
        np.fill_diagonal(inside, -2)
        for level in range(min(top, max(reach, int(levels[nodes].max()))), -1, -1):
            here = levels[nodes] >= level
            if level > reach:
                found_ids, found = np.full((int(here.sum()), 1), -1, np.int64), np.full((int(here.sum()), 1), -2, np.float32)
            else:
                if (~here).any():
                    at[~here] = g.descend(q[~here], at[~here], level)
                if not here.any():
                    continue
                found_ids, found = g.beam(q[here], at[here], level, min(BUILD_BEAM, n))
                at[here] = found_ids[:, 0]
            own = inside[np.ix_(here, here)]
            k = min(own.shape[1], BUILD_BEAM)
            by = np.argpartition(-own, k - 1, axis=1)[:, :k]
            s = np.take_along_axis(own, by, axis=1)
            mates = np.where(s > -2, nodes[here][by], -1)
            all_ids, all_s = np.concatenate((found_ids, mates), axis=1), np.concatenate((found, s), axis=1)
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :BUILD_BEAM]
            g.link(nodes[here], np.take_along_axis(all_ids, order, axis=1), np.take_along_axis(all_s, order, axis=1), level)
        best = nodes[levels[nodes].argmax()]
        if levels[best] > levels[g.entry]:
            g.entry = int(best)
        start, size = start + len(nodes), min(CHUNK, 2 * size)
    return g


class Shard:
    """The classes of a shard: graph, class ids, sizes, and the vectors as they came (kept in 4 bytes where that is exact)."""

    def __init__(self, graph: Graph, ids: np.ndarray, copies: np.ndarray, raw: np.ndarray):
        self.graph, self.ids, self.copies, self.raw = graph, ids, copies, raw
        self.exact = unit(raw)

    @staticmethod
    def of(ids: np.ndarray, copies: np.ndarray, raw: np.ndarray) -> Shard:
        order = np.argsort(ids)
        order = order[np.random.default_rng(len(ids)).permutation(len(ids))]
        raw = raw[order]
        return Shard(build(ids[order], unit(raw)), ids[order], copies[order], raw)

    def dump(self) -> bytes:
        out, g = io.BytesIO(), self.graph
        with np.errstate(over="ignore"):
            short = self.raw.astype(np.float32)
        raw = short if (short == self.raw).all() else self.raw
        np.savez(out, ids=self.ids, copies=self.copies, raw=raw, levels=g.levels, entry=g.entry, **{f"n{i}": x.astype(np.int32) for i, x in enumerate(g.neighbours)})
        return out.getvalue()

    @staticmethod
    def load(blob: bytes) -> Shard:
        with np.load(io.BytesIO(blob)) as f:
            raw = f["raw"].astype(np.float64)
            levels = sum(k[0] == "n" for k in f.files)
            graph = Graph(unit(raw).astype(np.float32), f["levels"], [f[f"n{i}"].astype(np.int64) for i in range(levels)], int(f["entry"]))
            return Shard(graph, f["ids"], f["copies"], raw)

    def linked(self, queries: np.ndarray, width: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of queries (unit vectors in double precision) and nodes with a cosine of `least` or more."""
        for r, node in self.graph.within(queries.astype(np.float32), width, np.float32(least - 1e-4)):
            for lo in range(0, len(r), 65536):
                a, b = r[lo : lo + 65536], node[lo : lo + 65536]
                sure = np.einsum("ij,ij->i", queries[a], self.exact[b]) >= least
                yield a[sure], b[sure]


def audit(shard: Shard, ids: np.ndarray, queries: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """Width, links found and links there are, for each width of the ladder."""
    out = np.array([(width, 0, 0) for width in BEAMS])
    for lo in range(0, len(ids), QUERIES):
        own = queries[lo : lo + QUERIES]
        truth = (own @ shard.exact.T >= least) & (ids[lo : lo + QUERIES, None] != shard.ids[None, :])
        there, found = int(truth.sum()), -1
        for rung, width in enumerate(BEAMS):
            if found < there:  # all found with a narrower beam are found with a wider one
                hit = np.zeros_like(truth)
                for r, node in shard.linked(own, width, least):
                    hit[r, node] = True
                found = int((hit & truth).sum())
            out[rung, 1:] += found, there
    return [tuple(r) for r in out.tolist()]


def hits(asking: Shard, asked: Shard, width: int, least: float) -> np.ndarray:
    """Bits [asking, asked / 8] of the links that the vectors of one shard find in another."""
    n = len(asked.ids)
    out = np.zeros((len(asking.ids), -(-n // 8)), np.uint8)
    for lo in range(0, len(asking.ids), QUERIES):
        own = np.zeros((len(asking.ids[lo : lo + QUERIES]), n), bool)
        for r, node in asked.linked(asking.exact[lo : lo + QUERIES], width, least):
            own[r, node] = True
        if asking is asked:
            own[np.arange(len(own)), lo + np.arange(len(own))] = False
        out[lo : lo + QUERIES] = np.packbits(own, axis=1)
    return out


def _tiles(bits: np.ndarray, back: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row, column and links of the tiles that have any, found in either direction."""
    for i in range(0, len(bits), QUERIES):
        for j in range(0, n, QUERIES):
            one, other = bits[i : i + QUERIES, j // 8 : (j + QUERIES) // 8], back[j : j + QUERIES, i // 8 : (i + QUERIES) // 8]
            if one.any() or other.any():
                found = np.unpackbits(one, axis=1, count=min(QUERIES, n - j))
                yield i, j, (found | np.unpackbits(other, axis=1, count=min(QUERIES, len(bits) - i)).T).astype(bool)


def _roots(nodes: int, tiles: Callable[[], Iterator[tuple[int, int, np.ndarray]]]) -> np.ndarray:
    """The smallest node of each node's component; tiles give links between node i + row and node j + column."""
    root = np.arange(nodes)
    while True:
        before = root.copy()
        for i, j, tile in tiles():
            r, c = tile.shape
            up = np.where(tile, root[None, j : j + c], nodes).min(axis=1)
            root[i : i + r] = np.minimum(root[i : i + r], up)
            down = np.where(tile, root[i : i + r, None], nodes).min(axis=0)
            root[j : j + c] = np.minimum(root[j : j + c], down)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def search(a: Shard, b: Shard | None, width: int, least: float) -> list[tuple[int, int, int]]:
    """Class, class it is linked to (itself if to none) and links with rows of other classes, for those that have any.

    b is another shard of the label, or None for links within a. The pairs are a spanning forest of the components.
    """
    n_a = len(a.ids)
    if b is None:
        bits = hits(a, a, width, least)
        tiles = lambda: ((i, j, t) for i, j, t in _tiles(bits, bits, n_a))
        ids, copies = a.ids, a.copies
    else:
        bits, back = hits(a, b, width, least), hits(b, a, width, least)
        tiles = lambda: ((i, n_a + j, t) for i, j, t in _tiles(bits, back, len(b.ids)))
        ids, copies = np.append(a.ids, b.ids), np.append(a.copies, b.copies)
    far = np.zeros(len(ids), np.int64)
    for i, j, tile in tiles():
        far[i : i + len(tile)] += tile @ copies[j : j + tile.shape[1]]
        if b is not None:
            far[j : j + tile.shape[1]] += copies[i : i + len(tile)] @ tile
    root = _roots(len(ids), tiles)
    some = np.flatnonzero(far)
    return list(zip(ids[some].tolist(), ids[root[some]].tolist(), far[some].tolist(), strict=True))


def near_vectors(vectors: DataFrame, least: float = 0.93, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall for each row of `vectors` (vec_id, embedding, label)."""
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull()
        & F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("e", lambda x: x != 0), F.lit(False))
    )
    good = scratch.write(rows.where(sound).distinct().select("vec_id", F.struct("label", "e").alias("same")), "good")
    total = good.count()
    classes = good.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max(F.col("vec_id") % AUDITED == 0).alias("audited"))
    classes = scratch.write(classes, "classes")
    member = scratch.write(split_join(good, classes.select("same", "rep", "n"), "same", "vec_id", total).select("vec_id", "rep"), "member")
    own = classes.select("rep", F.col("n").alias("copies"), "audited", "same.label", "same.e", F.struct("same.label", F.size("same.e").alias("dim")).alias("group"))
    groups = own.groupBy("group").agg(F.count(F.lit(1)).alias("n")).withColumn("most", F.least(F.lit(shard), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("group.dim"))))))
    blocks_ = F.ceil(F.col("n") / (AUDITED * QUERIES)).alias("blocks")
    groups = scratch.write(groups.select("group", "n", F.ceil(F.col("n") / F.col("most")).cast("int").alias("shards"), blocks_), "groups")
    dealt = split_join(own, groups, "group", "rep", total).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))

    def built(part: pd.DataFrame) -> pd.DataFrame:
        one = Shard.of(part["rep"].to_numpy(), part["copies"].to_numpy(), np.stack(part["e"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"group": [part["group"].iloc[0]], "shard": [part["shard"].iloc[0]], "graph": [one.dump()]})

    dealt = scratch.write(dealt, "dealt")
    key = dealt.select("rep", "copies", "e", F.to_json("group").alias("group"), "shard")
    graphs = scratch.write(key.groupBy("group", "shard").applyInPandas(built, "group string, shard int, graph binary"), "graphs", "none")
    shards = groups.select(F.to_json("group").alias("group"), "shards", "n")

    asked = (
        dealt.where("audited")
        .select(F.to_json("group").alias("group"), "rep", "e", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        .groupBy("group", "shard", "block")
        .agg(F.collect_list(F.struct("rep", "e")).alias("queries"))
        .join(graphs, ["group", "shard"])
    )

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, block, blob in zip(*(batch.column(c) for c in ("group", "queries", "graph")), strict=True):
                ids = block.values.field("rep").to_numpy()
                x = block.values.field("e").flatten().to_numpy().reshape(len(ids), -1)
                out += [(g.as_py(), *r) for r in audit(Shard.load(blob.as_py()), ids, unit(x), least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["group", "width", "found", "there"])

    audited = small_batches(asked).mapInArrow(audits, "group string, width int, found long, there long")
    audited = scratch.write(audited.groupBy("group", "width").agg(F.sum("found").alias("found"), F.sum("there").alias("there")), "audited")
    enough = F.col("found") >= RECALL * F.col("there")
    everywhere = audited.groupBy("width").agg(F.sum("found").alias("found"), F.sum("there").alias("there")).where(enough & (F.col("there") > 0))
    least_width = everywhere.agg(F.min("width")).first()[0] or UNMEASURED
    measured = audited.where(enough & (F.col("width") >= least_width) | (F.col("width") == BEAMS[-1])).groupBy("group").agg(F.min(F.struct("width", "found", "there")).alias("w"))
    widths = scratch.write(
        shards.join(measured, "group", "left").select("group", "n", "shards", F.coalesce("w.width", F.lit(least_width)).alias("width"), (F.col("w.found") / F.nullif("w.there", F.lit(0))).alias("recall")),
        "widths",
    )

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, width in zip(*(batch.column(c).to_pylist() for c in ("graph", "other", "width")), strict=True):
                out = search(Shard.load(x), None if y is None else Shard.load(y), width, least)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["rep", "to", "far"])

    pairs = widths.select("group", "width", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "shards").withColumn("second", F.explode(F.sequence(F.col("shard"), F.col("shards") - 1)))
    second = graphs.select("group", F.col("shard").alias("second"), F.col("graph").alias("other"))
    both = (
        pairs.repartition(F.xxhash64("group", "shard", "second")).join(graphs, ["group", "shard"])
        .join(second, ["group", "second"])
        .select("graph", F.when(F.col("second") > F.col("shard"), F.col("other")).alias("other"), "width")
    )
    linked = scratch.write(small_batches(both).mapInArrow(found, "rep long, to long, far long"), "linked")
    comps = components(linked.select(F.col("rep").alias("a"), F.col("to").alias("b")), scratch, "comps")
    far = linked.groupBy("rep").agg(F.sum("far").alias("far"))
    per_class = (
        split_join(dealt.select("rep", "copies", F.to_json("group").alias("group")), widths.select("group", "n", "recall"), "group", "rep", total)
        .withColumnRenamed("copies", "n")
        .join(far, "rep", "left")
        .join(comps, F.col("rep") == F.col("node"), "left")
        .select("rep", "n", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"), "recall")
    )
    per_class = scratch.write(per_class, "per_class")
    by_id = split_join(member, per_class, "rep", "vec_id", total).groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"), F.max("recall").alias("recall"))
    by_id = scratch.write(by_id, "by_id")
    scratch.drop("graphs", "good", "classes", "dealt", "groups", "linked", "member", "per_class", "audited", "widths")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(by_id, "vec_id", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
        "recall",
    )


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
