"""Removal of byte strings that an earlier document has too: suffix arrays per shard, merged by binary search.

Every 50-byte string has one place of least 8-byte hash in it (its minimizer), the same wherever the string occurs. A
document is cut into pieces: runs of start positions with the same minimizer, with the bytes their strings need. Pieces
go to buckets by their minimizer, so equal strings meet whatever documents they are in. A piece that a chunk of
documents holds several times travels once, for the smallest document; for the others all of it is repeated.

A bucket keeps pieces whose minimizer several documents have, cuts them into shards of bounded size, builds each
shard's suffix array by Larsson-Sadakane refinement (ranks of 8 bytes doubled until they are whole, sorting only groups
that are still tied), and the common prefixes of neighbours by Kasai's walk, in lockstep over pieces. Runs of suffixes with 50 bytes in
common are one string; the smallest document of each is merged across shards by binary search.

Defined cases: null text is empty; texts under 50 bytes lose nothing; documents with the same doc_id don't count as
smaller than each other; repeated rows lose the same bytes; a null doc_id comes after all others; an empty table gives an empty result; texts of any length
are read whole; further columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, Scratch, blocks, encoded, mix, small_batches, table

LENGTH = 50
GRAM = 8
WINDOW = LENGTH - GRAM + 1
SIDE = (LENGTH - GRAM + 1) // 2  # bytes beside the minimizer that a string has on one side at least
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20  # of pieces, about four bytes for each byte of text
SHARD_BYTES = 2 << 20
KEYS = ("key_1", "key_2")
LAST = np.iinfo(np.int64).max

def _words(buf: np.ndarray, order: str = "<") -> np.ndarray:
    """The 8 bytes from every position on as a number; buf has 8 spare bytes at its end."""
    return np.ndarray((len(buf) - 8,), f"{order}u8", buf, strides=(1,))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for sizes[i] numbers, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def pieces(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, and of every piece its document, first start position (in the joined bytes), number of start
    positions and minimizer position."""
    sizes = np.array([len(r) for r in raws], np.int64)
    buf = np.frombuffer(b"".join([*raws, b"\0" * (LENGTH + 16)]), np.uint8).copy()
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    starts = _spread(ends - sizes, np.maximum(sizes - LENGTH + 1, 0))
    none = np.zeros(0, np.int64)
    if not len(starts):
        return buf, none, none, none, none
    w = _words(buf)[: total + 16]
    least = (mix(w[: total + 8].astype(np.uint64) * GOLDEN) & np.uint64(0xFFFFFFFF00000000)) | np.arange(total + 8, dtype=np.uint64)
    size = 1
    while 2 * size <= WINDOW:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = WINDOW - size
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(raws)), np.maximum(sizes - LENGTH + 1, 0))
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
    return buf, doc[new], starts[new], np.diff(np.append(new, len(starts))), at[new]


def _distinct(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each slice the first slice, in the given order, with equal bytes (hashed first, then compared)."""
    n = len(start)
    acc = np.zeros(n, np.uint64)
    w = _words(buf)
    for lo in range(0, int(size.max()), 8):
        live = np.flatnonzero(size > lo)
        x = w[start[live] + lo].astype(np.uint64)
        spare = np.maximum(8 - (size[live] - lo), 0).astype(np.uint64)
        x = (x << (spare * np.uint64(8))) & np.uint64(2**64 - 1)
        acc[live] = mix(acc[live] * GOLDEN + x + np.uint64(lo + 1))
    acc = mix(acc + size.astype(np.uint64))
    order = np.argsort(acc, kind="stable")
    fresh = np.concatenate(([True], acc[order][1:] != acc[order][:-1]))
    lead = np.empty(n, np.int64)
    lead[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(n), 0))]
    other = np.flatnonzero(lead != np.arange(n))
    same = size[other] == size[lead[other]]
    for lo in range(0, int(size.max()), 8):
        live = np.flatnonzero(same & (size[other] > lo))
        x, y = w[start[other[live]] + lo].astype(np.uint64), w[start[lead[other[live]]] + lo].astype(np.uint64)
        spare = (np.maximum(8 - (size[other[live]] - lo), 0) * 8).astype(np.uint64)
        same[live] = (x << spare) == (y << spare)
    lead[other[~same]] = other[~same]
    return lead


def _packed(**arrays: np.ndarray) -> bytes:
    """Arrays by name, integers as differences, in one compressed block."""
    out = []
    for name, a in arrays.items():
        raw = (np.diff(a, prepend=a.dtype.type(0)) if a.dtype == np.int64 else a).tobytes()
        out.append(name.ljust(8).encode() + a.dtype.str[1:].encode() + len(raw).to_bytes(6, "little") + raw)
    return zstandard.ZstdCompressor(level=5).compress(b"".join(out))


def _unpacked(block: bytes) -> dict[str, np.ndarray]:
    raw, at, found = zstandard.ZstdDecompressor().decompress(block), 0, {}
    while at < len(raw):
        name, kind, n = raw[at : at + 8].decode().strip(), raw[at + 8 : at + 10].decode(), int.from_bytes(raw[at + 10 : at + 16], "little")
        a = np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 16)
        found[name] = np.cumsum(a) if a.dtype == np.int64 else a
        at += 16 + n
    return found


def _full(n: np.ndarray) -> np.ndarray:
    """Masks with the lowest n bits set."""
    return (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)


def routed(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed pieces: bucket, chunk, block. docs: key_1, key_2, doc_id (no nulls), text.

    Pieces name a row by its number in the chunk; one more block of each chunk has the keys of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", CHUNK_BYTES):
            raws = [encoded(t) for t in part.column("text").to_pylist()]
            ids, keys = part.column("doc_id").to_numpy(), np.stack([part.column(k).to_numpy() for k in KEYS])
            order = np.lexsort((*keys, ids))
            raws, ids, keys = [raws[i] for i in order.tolist()], ids[order], keys[:, order]
            sizes = np.array([len(r) for r in raws], np.int64)
            buf, doc, start, n, at = pieces(raws)
            if not len(doc):
                continue
            base = np.cumsum(sizes) - sizes
            lead = _distinct(buf, start, n + LENGTH - 1)
            w = _words(buf)
            bucket = (mix(w[at].astype(np.uint64) * GOLDEN) % np.uint64(buckets)).astype(np.int64)
            local = ids[doc] > ids[doc[lead]]
            chunk = hashlib.blake2b(keys.tobytes(), digest_size=16).digest()
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=buckets))
            rows = [(int.from_bytes(chunk[:7], "little") % buckets, chunk, _packed(keys=keys.ravel().view(np.uint64)))]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = by[lo:hi]
                done, own = own[local[own]], own[~local[own]]
                sent = own[lead[own] == own]
                number = np.searchsorted(sent, lead[own])
                rows.append((int(bucket[by[lo]]), chunk, _packed(
                    n=n[sent].astype(np.uint8), off=(at[sent] - start[sent]).astype(np.uint8), doc=ids[doc[sent]],
                    bytes=buf[_spread(start[sent], n[sent] + LENGTH - 1)],
                    o_piece=number.astype(np.int64), o_row=doc[own], o_at=start[own] - base[doc[own]],
                    l_row=doc[done], l_at=start[done] - base[doc[done]], l_n=n[done].astype(np.uint8),
                )))
            b, c, d = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.binary())], ["bucket", "chunk", "block"])

    return small_batches(docs).mapInArrow(run, "bucket long, chunk binary, block binary")


def suffix_array(buf: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions in the order of the bytes from each on to its piece's end (left: bytes to it), equal ones by position.

    Ranks number groups by their last place, as Larsson and Sadakane do; a group of one is done.
    """
    n = len(left)
    key = _words(buf, ">")[:n].astype(np.uint64)
    spare = (np.maximum(8 - left, 0) * 8).astype(np.uint64)
    key = (key >> spare) << spare
    order = np.lexsort((np.minimum(left, 8), key)) if (left < 8).any() else np.argsort(key, kind="stable")

    def grouped(differs: np.ndarray, size: int) -> np.ndarray:
        """Rank of each place: the last place of its group."""
        last = np.append(np.flatnonzero(differs[1:]), size - 1)
        return np.repeat(last, np.diff(np.append(-1, last)))

    short = np.minimum(left, 8)
    differs = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (short[order][1:] != short[order][:-1])))
    places = grouped(differs, n)
    rank = np.empty(n, np.int64)
    rank[order] = places
    depth = 8
    while depth < left.max():
        tied = np.zeros(n, bool)
        tied[1:] |= places[1:] == places[:-1]
        tied[:-1] |= places[:-1] == places[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = order[at]
        beyond = np.where(left[own] > depth, rank[np.minimum(own + depth, n - 1)] + 1, 0)
        pair = places[at] * (n + 1) + beyond
        by = np.argsort(pair, kind="stable")
        order[at] = own[by]
        pair = pair[by]
        cut = np.concatenate(([True], pair[1:] != pair[:-1]))
        last = np.append(np.flatnonzero(cut[1:]), len(at) - 1)
        places = places.copy()
        places[at] = np.repeat(at[last], np.diff(np.append(-1, last)))
        rank[order[at]] = places[at]
        depth *= 2
    return order


def common_prefixes(buf: np.ndarray, order: np.ndarray, left: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each place in `order` the bytes in common with the place before, up to LENGTH.

    Kasai's walk: the next position of a piece shares at least one byte less than the last did, so that each step only
    extends. All pieces (first position, size) take a step together.
    """
    n = len(order)
    w = _words(buf)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    out = np.zeros(n, np.int64)
    by = np.argsort(-sizes, kind="stable")
    first, sizes = first[by], sizes[by]
    h = np.zeros(len(first), np.int64)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -step, side="left"))
        pos = first[:live] + step
        place = where[pos]
        prev = order[np.maximum(place - 1, 0)]
        most = np.where(place > 0, np.minimum(np.minimum(left[pos], left[prev]), LENGTH), 0)
        now = np.minimum(np.maximum(h[:live] - 1, 0), most)
        going = np.flatnonzero(now < most)
        while len(going):
            x = w[pos[going] + now[going]].astype(np.uint64) ^ w[prev[going] + now[going]].astype(np.uint64)
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3)
            now[going] = np.minimum(now[going] + same, most[going])
            going = going[(same == 8) & (now[going] < most[going])]
        h[:live] = now
        out[place] = now
    return out


def _shard(ctx: np.ndarray, n: np.ndarray, doc: np.ndarray):
    """Of a shard's pieces: order of its start positions, string number of each in that order, start's piece, and per
    string a position and the smallest document."""
    sizes = n + LENGTH - 1
    first = np.cumsum(sizes) - sizes
    left = np.repeat(first + sizes, sizes) - np.arange(len(ctx))
    buf = np.append(ctx, np.zeros(16, np.uint8))
    order = suffix_array(buf, left)
    lcp = common_prefixes(buf, order, left, first, n)
    whole = left[order] >= LENGTH
    place, lcp = order[whole], lcp[whole]
    string = np.cumsum(lcp < LENGTH) - 1
    piece = np.repeat(np.arange(len(n)), sizes)[place]
    heads = np.flatnonzero(lcp < LENGTH)
    return place, string, piece, place[heads], np.minimum.reduceat(doc[piece], heads), first


def _side_hash(gram: np.ndarray, w: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of the minimizer and the SIDE bytes from `first` on, whose last eight are at `last`."""
    h = gram
    for at in (first, first + 8, last):  # SIDE is 16 to 24
        h = mix(h * GOLDEN + w[at].astype(np.uint64))
    return h


def _shared(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether several documents have a row's key."""
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(heads, len(key)))
    several = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads) if len(heads) else np.zeros(0, bool)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(several, count)
    return out


def repeated_masks(ctx: np.ndarray, n: np.ndarray, off: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each piece a mask of its start positions whose string a smaller document has.

    Of pieces with equal bytes only the smallest document's takes part in the search; larger ones are repeated throughout.
    """
    size = n.astype(np.int64) + LENGTH - 1
    first = np.cumsum(size) - size
    order = np.argsort(doc, kind="stable")
    lead = np.empty(len(n), np.int64)
    lead[order] = order[_distinct(np.append(ctx, np.zeros(80, np.uint8)), first[order], size[order])]
    own = np.flatnonzero(lead == np.arange(len(n)))
    masks = np.zeros(len(n), np.uint64)
    masks[own] = _distinct_masks(ctx[_spread(first[own], size[own])], n[own], off[own], doc[own])
    return np.where(doc > doc[lead], _full(n), masks[lead])


def _distinct_masks(ctx: np.ndarray, n: np.ndarray, off: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """repeated_masks of pieces no two of which are equal."""
    masks = np.zeros(len(n), np.uint64)
    sizes = n.astype(np.int64) + LENGTH - 1
    first = np.cumsum(sizes) - sizes
    w = _words(np.append(ctx, np.zeros(32, np.uint8)))
    at, end = first + off, first + sizes
    gram = mix(w[at].astype(np.uint64) * GOLDEN)
    # A string has SIDE more bytes on one side of its minimizer: pieces that share those with no other document are out.
    left, right = np.flatnonzero(off >= SIDE), np.flatnonzero(end - at >= GRAM + SIDE)
    near = np.zeros(len(n), bool)
    near[left] |= _shared(_side_hash(gram[left], w, at[left] - SIDE, at[left] - 8), doc[left])
    near[right] |= _shared(_side_hash(gram[right] + np.uint64(1), w, at[right] + GRAM, at[right] + GRAM + SIDE - 8), doc[right])
    keep = np.flatnonzero(near)
    keep = keep[np.argsort(gram[keep], kind="stable")]  # pieces of one minimizer lie together
    if not len(keep):
        return masks
    held = np.cumsum(sizes[keep])
    shard = (held - 1) // SHARD_BYTES
    parts = []
    for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(keep)).tolist()), strict=True):
        own = keep[lo:hi]
        text = ctx[_spread(first[own], sizes[own])]
        place, string, piece, head, least, at = _shard(text, n[own].astype(np.int64), doc[own])
        parts.append([own, place - at[piece], string, piece, np.lib.stride_tricks.sliding_window_view(text, LENGTH)[head].copy().view(f"S{LENGTH}").ravel(), least])
    for i, a in enumerate(parts):  # the strings of a shard are in order, so another's are found by binary search
        for b in parts[:i]:
            at = np.minimum(np.searchsorted(b[4], a[4]), len(b[4]) - 1)
            hit = np.flatnonzero(b[4][at] == a[4])
            both = np.minimum(a[5][hit], b[5][at[hit]])
            a[5][hit], b[5][at[hit]] = both, both
    for i, (own, offset, string, piece, _, least) in enumerate(parts):
        for b in parts[:i]:  # a string of three shards: what a later pair has found
            at = np.minimum(np.searchsorted(b[4], parts[i][4]), len(b[4]) - 1)
            hit = np.flatnonzero(b[4][at] == parts[i][4])
            least[hit] = np.minimum(least[hit], b[5][at[hit]])
        gone = least[string] < doc[own][piece]
        np.bitwise_or.at(masks, own[piece[gone]], np.uint64(1) << offset[gone].astype(np.uint64))
    return masks


def judged(bucket: pd.DataFrame) -> pd.DataFrame:
    """Per chunk the masks of its pieces that have any, those that the chunk itself found included; blocks of keys as they are."""
    chunks, blocks_, out = [], [], []
    for chunk, raw in zip(bucket["chunk"], bucket["block"], strict=True):
        block = _unpacked(raw)
        if "keys" in block:
            out.append((chunk, raw))
        else:
            chunks.append(chunk)
            blocks_.append(block)
    counts = [len(b["n"]) for b in blocks_]
    join = lambda k: np.concatenate([b[k] for b in blocks_])
    masks = repeated_masks(join("bytes"), join("n"), join("off").astype(np.int64), join("doc")) if sum(counts) else np.zeros(0, np.uint64)
    at = 0
    for chunk, b, n in zip(chunks, blocks_, counts, strict=True):
        own = masks[at : at + n][b["o_piece"]]
        at += n
        some = own > 0
        row, pos, mask = np.concatenate((b["o_row"][some], b["l_row"])), np.concatenate((b["o_at"][some], b["l_at"])), np.concatenate((own[some], _full(b["l_n"])))
        if len(row):
            out.append((chunk, _packed(row=row, at=pos, mask=mask)))
    return pd.DataFrame(out, columns=["chunk", "block"])


def intervals(chunk: pd.DataFrame) -> pd.DataFrame:
    """Keys and removed byte ranges (start, end), in order, as 64-bit integers, of the rows of a chunk that lose bytes."""
    found = [_unpacked(b) for b in chunk["block"]]
    keys = next(b["keys"] for b in found if "keys" in b).view(np.int64).reshape(2, -1)
    found = [b for b in found if "keys" not in b]
    if not found:
        return pd.DataFrame({"key_1": pd.Series(dtype="int64"), "key_2": pd.Series(dtype="int64"), "spans": pd.Series(dtype=object)})
    row, at, mask = (np.concatenate([b[k] for b in found]) for k in ("row", "at", "mask"))
    bits = (mask[:, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1)
    r, c = np.nonzero(bits)
    row, start = row[r], at[r] + c
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + LENGTH)))
    heads = np.flatnonzero(new)
    lasts = np.append(heads[1:], len(start)) - 1
    spans = np.stack((start[heads], start[lasts] + LENGTH), axis=1)
    cuts = np.flatnonzero(np.concatenate(([True], row[heads][1:] != row[heads][:-1])))
    whose = row[heads][cuts]
    return pd.DataFrame({"key_1": keys[0, whose], "key_2": keys[1, whose], "spans": [s.tobytes() for s in np.split(spans, cuts[1:])]})


def removed_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """key_1, key_2, spans of the rows that lose bytes. docs: key_1, key_2, doc_id, text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-4 * size // BUCKET_BYTES))
    ordered = docs.select(*KEYS, F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text")
    dealt = routed(ordered, buckets).repartition(-(-buckets // 4), "bucket")  # partitions that don't grow with the corpus
    masks = scratch.write(dealt.groupBy("bucket").applyInPandas(judged, "chunk binary, block binary"), "masks", "none")
    found = masks.groupBy("chunk").applyInPandas(intervals, "key_1 long, key_2 long, spans binary").groupBy(*KEYS).agg(F.max("spans").alias("spans"))
    found = scratch.write(found, "spans")
    scratch.drop("masks")
    return found


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) for each row of `docs`."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = keyed.withColumns({"key_1": F.xxhash64("doc_id", "text"), "key_2": F.xxhash64(F.lit(2), "text", "doc_id")})  # 128 bits, so that no two rows share them
    spans = removed_spans(keyed, Scratch(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", CHUNK_BYTES):
            rows = []
            for text, raw in zip(block.column("text").to_pylist(), block.column("spans").to_pylist(), strict=True):
                data = encoded(text)
                cut = [] if raw is None else np.frombuffer(raw, np.int64).reshape(-1, 2).tolist()
                kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), len(data)], strict=True))
                rows.append((len(data), len(data) - len(kept), len(cut), kept))
            columns = [pa.array(c, pa.int64() if i < 3 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return keyed.join(spans, [*KEYS], "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
