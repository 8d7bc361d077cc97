"""MinHash near-dedup: SuperMinHash signatures, banding, verification on whole sets, components.

A document's set holds its distinct shingles of w words (64-bit hashes). For each element SuperMinHash draws a
permutation of the signature's slots and writes rank + random to them in order, so the ranks of one element are
correlated; an element is done as soon as its next rank exceeds the largest value of the signature. Documents with
equal sets form a class, and one of each class goes on. Classes that share a band meet in a bucket; each is compared,
on whole sets, with the bucket's hub, the member that meets most others. Buckets whose members still lie in different
components after that are searched exhaustively, in tiles of bounded size. Links are confirmed on the whole sets only.
Joins on a band, a class or a hub deal a hot key over many tasks (`split_join`).

Defined cases: null or empty text, or one of white space, has an empty set and links with nothing; fewer words than w
are one shingle; rows that repeat a doc_id share its component, and what any of their texts links with is linked with
all of them; a null doc_id has a null component and isn't kept; an empty table gives an empty result; texts of any length
are read whole; further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, Scratch, blocks, encoded, mix, small_batches, split_join, table
from .graph import components

SLOTS, ROWS = 128, 4  # bands of 4 slots: a pair at 0.8 shares none of the 32 with a chance of 5e-8
TILE = 256
SMALL_AREA = 4 * TILE
BLOCK_BYTES = 2 << 20

class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; words are lower-cased in A-Z and split at ASCII white space."""
    of_word = _WordHashes()
    out = []
    for text in texts:
        words = encoded(text).lower().split()
        h = np.fromiter(map(of_word.__getitem__, words), np.uint64, len(words))
        if not len(h):
            out.append(h)
            continue
        n = max(1, len(h) - width + 1)
        x = np.full(n, min(len(h), width), np.uint64)
        for j in range(min(width, len(h))):
            x = mix(x * GOLDEN + h[j : j + n])
        out.append(np.unique(x))
    return out


def super_minhash(elements: np.ndarray, doc: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures [n, slots] of sets given as elements and their documents; all elements take a step together.

    Step j of an element's Fisher-Yates shuffle swaps index j with a random index k from j on. What stands at an index
    follows from earlier swaps, so only those are kept, not whole permutations.
    """
    h = np.full(n * slots, np.uint64(slots << 32), np.uint64)
    swapped: list[np.ndarray] = []
    moved: list[np.ndarray] = []
    for j in range(slots):
        draw = mix(elements + np.uint64(int(GOLDEN) * (j + 1) % 2**64))
        k = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        at_k, at_j = k.copy(), np.full(len(k), j)
        for old_k, old_j in zip(swapped, moved, strict=True):
            hit = old_k == k
            at_k[hit] = old_j[hit]
            hit = old_k == j
            at_j[hit] = old_j[hit]
        np.minimum.at(h, doc * slots + at_k, np.uint64(j << 32) | (draw >> np.uint64(32)))
        swapped.append(k)
        moved.append(at_j)
        going = h.reshape(n, slots).max(axis=1)[doc] >= np.uint64((j + 1) << 32)
        if not going.any():
            break
        elements, doc = elements[going], doc[going]
        swapped, moved = [x[going] for x in swapped], [x[going] for x in moved]
    return h.reshape(n, slots)


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """[n, bands] int64 hashes of `rows` slots each, the band's number included."""
    n, slots = signatures.shape
    parts = signatures[:, : slots // rows * rows].reshape(n, slots // rows, rows)
    x = np.arange(slots // rows, dtype=np.uint64)[None, :] + GOLDEN
    for j in range(rows):
        x = mix(x * GOLDEN + parts[:, :, j])
    return x.view(np.int64)


def _arrays(values: np.ndarray, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, pa.int64()))


def signed_docs(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, fp (of the whole set, null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            sets = shingle_sets(block.column("text").to_pylist(), width)
            sizes = [len(s) for s in sets]
            keys = band_keys(super_minhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets)))
            full = np.array(sizes) > 0
            fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = _arrays(keys[full].ravel(), (full * keys.shape[1]).tolist())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), bands], ["doc_id", "n_shingles", "fp", "bands"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, fp binary, bands array<long>")


def doc_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles (sorted as unsigned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            sets = shingle_sets(block.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), _arrays(np.concatenate(sets).view(np.int64), [len(s) for s in sets])], ["doc_id", "shingles"])

    return small_batches(docs).mapInArrow(run, "doc_id long, shingles array<long>")


def linked(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def verified(pairs: DataFrame, hubs: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """Pairs (a, b) of hub and doc_id whose whole sets meet the threshold.

    pairs: hub, doc_id. hubs: hub and n, of how many of `total` pairs. A hub's set goes to every part of its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            xs, ys = (c.values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (x, y))
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            keep = []
            for i in range(batch.num_rows):
                s, t = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                small, large = (s, t) if len(s) < len(t) else (t, s)
                if 100 * len(small) < percent * len(large):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                if linked(int((large[at] == small).sum()), len(s), len(t), percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("hub", "doc_id")], ["a", "b"])

    own = hubs.join(sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("x")), "hub")
    with_doc = pairs.join(sets.select("doc_id", F.col("shingles").alias("y")), "doc_id")
    return split_join(with_doc, own, "hub", "doc_id", total).select("hub", "doc_id", "x", "y").mapInArrow(run, "a long, b long")


def tile_links(tile: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of the rows of a tile (doc_id, comp, shingles), one verified link for each two components that have any."""
    ids, comps = tile["doc_id"].to_numpy(), tile["comp"].to_numpy()
    sets = [np.asarray(s, np.int64) for s in tile["shingles"]]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    several = count[column] > 1  # shingles of one document alone are in no intersection
    row, column = row[several], np.unique(column[several], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    for lo in range(0, width, 4096):
        part = (column >= lo) & (column < lo + 4096)
        hot = np.zeros((len(sets), min(4096, width - lo)), np.float32)
        hot[row[part], column[part] - lo] = 1
        common += hot @ hot.T
    common = common.astype(np.int64)
    ok = linked(common, sizes[:, None], sizes[None, :], percent) & (comps[:, None] < comps[None, :])
    a, b = np.nonzero(ok)
    found = pd.DataFrame({"a": ids[a], "b": ids[b], "ca": comps[a], "cb": comps[b]}).drop_duplicates(["ca", "cb"])
    return found[["a", "b"]].astype("int64")


def _residual(members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, total: int, scratch: Scratch) -> DataFrame:
    """Links between components that only members other than the hubs show.

    Buckets with several components that meet in a document form an area, which is searched at once if it is small; a
    larger one goes bucket by bucket, so that a chain of buckets doesn't make its ends meet. The documents outside the
    largest component of such a group, in blocks of TILE, are compared with each other and with the blocks of that one.
    """
    comp = F.coalesce("component", "doc_id").alias("comp")
    placed = scratch.write(members.join(comps, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", comp), "placed")
    open_keys = scratch.write(
        placed.groupBy("key")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
        .where("lo <> hi and n > 2")
        .select("key", "first", "n"),
        "open_keys",
    )
    meet = scratch.write(split_join(placed, open_keys, "key", "doc_id", total).select("key", "first", "doc_id", "comp").distinct(), "meet")
    areas = components(meet.select(F.col("first").alias("a"), F.col("doc_id").alias("b")), scratch, "areas")
    docs = (
        meet.join(areas, F.col("doc_id") == F.col("node"), "left")
        .select("key", "doc_id", "comp", F.coalesce("component", "doc_id").alias("area"))
    )
    docs = scratch.write(docs, "open")
    small = docs.select("area", "doc_id").distinct().groupBy("area").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") <= SMALL_AREA).select("area")
    sizes = docs.groupBy("area").agg(F.count(F.lit(1)).alias("n")).join(small.withColumn("small", F.lit(True)), "area", "left")
    grouped = split_join(docs, scratch.write(sizes, "sizes"), "area", "doc_id", total)
    # areas and buckets are numbered apart: a group is (area, 0) or (0, key)
    docs = scratch.write(
        grouped.select(
            F.when(F.col("small"), F.struct("area", F.lit(0).cast("long").alias("key"))).otherwise(F.struct(F.lit(0).cast("long").alias("area"), "key")).alias("group"),
            "doc_id",
            "comp",
        ).distinct(),
        "grouped",
    )
    by_comp = docs.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = by_comp.groupBy("group").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"))
    main = main.where("n > most.n").select("group", "n", F.col("most.comp").alias("main"), F.col("most.n").alias("n_main"), (F.col("n") - F.col("most.n")).alias("n_rest"))
    placed = (
        split_join(docs, scratch.write(main, "main"), "group", "doc_id", total)
        .withColumn("rest", F.col("comp") != F.col("main"))
        .withColumn("rest_blocks", F.ceil(F.col("n_rest") / TILE))
        .withColumn("main_blocks", F.ceil(F.col("n_main") / TILE))
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.when(F.col("rest"), F.col("rest_blocks")).otherwise(F.col("main_blocks"))))
    )
    count = F.col("rest_blocks").cast("int")
    own = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.struct(F.least(F.col("block"), j.cast("long")).alias("i"), F.greatest(F.col("block"), j.cast("long")).alias("j")))
    to_main = F.transform(F.sequence(F.lit(0), F.col("main_blocks").cast("int") - 1), lambda j: F.struct(F.col("block").alias("i"), (-1 - j).cast("long").alias("j")))
    from_main = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.cast("long").alias("i"), (-1 - F.col("block")).alias("j")))
    tiles = placed.withColumn("tile", F.explode(F.when(F.col("rest"), F.concat(own, to_main)).otherwise(from_main)))
    return (
        tiles.select("group", "tile", "doc_id", "comp")
        .join(sets, "doc_id")
        .groupBy("group", "tile")
        .applyInPandas(lambda t: tile_links(t, percent), "a long, b long")
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and class_id (smallest doc_id with the same set) for each row of `docs`."""
    scratch = Scratch(docs.sparkSession)
    signed = scratch.write(signed_docs(docs, width), "signed")
    known = signed.where("fp is not null and doc_id is not null")
    total = signed.count()
    classes = known.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = scratch.write(classes, "classes")
    labelled = split_join(signed.select("doc_id", "n_shingles", "fp"), classes, "fp", "doc_id", total, "left")
    labelled = scratch.write(labelled.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")), "labelled")
    # rows that repeat a doc_id with other texts tie their classes together
    several = labelled.groupBy("doc_id").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most")).where("least <> most")
    ties = scratch.write(labelled.select("doc_id", "class_id").distinct().join(several, "doc_id").select(F.col("least").alias("a"), F.col("class_id").alias("b")), "ties")
    scratch.drop("classes")
    reps = known.groupBy("fp").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("r.doc_id", "r.bands")
    banded = scratch.write(reps.select("doc_id", F.explode("bands").alias("key")), "banded")
    rows = banded.count()
    shared = scratch.write(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", F.col("n")), "shared")
    members = scratch.write(split_join(banded, shared, "key", "doc_id", rows), "members")
    scratch.drop("banded", "signed")

    meets = members.groupBy("doc_id").agg(F.sum("size").alias("meets"))
    best = members.join(meets, "doc_id").groupBy("key").agg((-F.max(F.struct("meets", (-F.col("doc_id")).alias("d")))["d"]).alias("hub"), F.count(F.lit(1)).alias("n"))
    pairs = split_join(members.select("key", "doc_id"), scratch.write(best, "best"), "key", "doc_id", rows).where("doc_id <> hub").select("hub", "doc_id").distinct()
    pairs = scratch.write(pairs, "pairs")
    hubs = scratch.write(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")), "hubs")
    involved = members.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = scratch.write(doc_sets(texts, width).where(F.size("shingles") > 0), "sets")
    links = scratch.write(verified(pairs, hubs, sets, percent, pairs.count()), "links").unionAll(ties)
    comps = components(links, scratch, "comps")
    more = scratch.write(_residual(members, comps, sets, percent, rows, scratch), "more")
    if more.take(1):
        comps = components(links.unionAll(more), scratch, "all")
    scratch.drop("sets", "members", "links", "more", "meet", "open", "open_keys", "placed", "grouped", "sizes", "main", "best", "pairs", "hubs", "shared", "ties")
    grown = labelled.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("class_id is not null")
    found = scratch.write(grown.join(comps, F.col("class_id") == F.col("node"), "left").select("class_id", "component", "n"), "found")
    return (
        split_join(labelled, found, "class_id", "doc_id", total, "left")
        .withColumn("component_id", F.coalesce("component", "class_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "class_id")
    )


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
