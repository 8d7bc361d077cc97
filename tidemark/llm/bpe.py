"""Byte-level BPE over the whole corpus: each distinct word is encoded once, by replaying the merges of the rank table.

A word is a match of the pattern. Blocks of documents become rows of word numbers, and each has a list of its distinct
words. The blocks are dealt into slices of about 16 GB of text, and a slice's lists into buckets by the words' hashes, so that a
bucket has the rows of its words from all blocks of the slice and encodes every word once. However large the corpus, no bucket
has more than a slice's blocks, and a block has at most a slice's buckets: a word that is everywhere is replayed once a slice.
A bucket's words are laid out as a chain of tokens. An inverted index leads from the rank of a token pair to the positions
where the pair stands; ranks are taken in ascending order from a heap, all words that have the pair merge it together, and
only the neighbours of what was merged get new entries. Of touching places of one rank a word merges every second, from
the left, as a word-by-word encoder would; where the merged token could be part of a pair of lower rank that encoder's
order matters, and a word with several such places is finished by itself from a heap of its pairs. Words that are tokens
are taken whole. The ids then go back to the blocks that have the word, and from there into the documents.

The vocabulary is a file of base64 tokens and ranks; its path is a parameter and must be valid on every executor.

Defined cases: null text is empty and has no tokens; texts and words of any length are encoded whole, in time about in
proportion to their length; equal texts give equal ids; repeated rows are each encoded; an empty table gives an empty
result; `encode` keeps further columns but the text (join it by id where it is needed), and both replace columns that are
named like what they add.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbered, Scratch, blocks, small_batches, table, trim

BLOCK_BYTES = 4 << 20  # of text whose words are numbered together
MOST_PARTS = 50_000  # of the table of numbers, as Spark takes 100,000 buckets at most; each then has more blocks
BUCKET_TEXT = 16 << 20  # a bucket of words for each so many bytes of text
SLICE_TEXT = 16 << 30  # blocks of about so much text share buckets, so that a word that every block has meets a bounded number of them
NONE = np.int64(1 << 40)


@cache
def tokens_of(path: str) -> dict[int, bytes]:
    """Tokens by rank; read once in each Python worker."""
    with open(path, "rb") as f:
        return {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    def __init__(self, path: str):
        self.tokens = tokens_of(path)
        self.ranks = {token: rank for rank, token in self.tokens.items()}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, merged = array("q"), array("q")
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(np.frombuffer(pairs, np.int64))
        self.pairs, self.merged = np.frombuffer(pairs, np.int64)[order], np.frombuffer(merged, np.int64)[order]
        sides = np.stack((self.pairs >> 32, self.pairs & 0xFFFFFFFF))
        self.early = set(sides[sides > self.merged].tolist())  # tokens that are part of a pair of lower rank

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair becomes, NONE where it is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words in a row, and how many each has."""
        n = len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        flat = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(n), sizes)
        total = len(flat)
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        first = np.cumsum(sizes) - sizes
        after = np.arange(1, total + 1)
        before = np.arange(-1, total - 1)
        live = np.ones(total, bool)
        rank = np.full(total, NONE)  # of the pair that starts here
        if total > 1:
            inside = (word[1:] == word[:-1]) & (whole[word[1:]] < 0)
            at = np.flatnonzero(inside)
            rank[at] = self.pair_ranks(flat[at], flat[at + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(positions: np.ndarray) -> None:
            """Enter positions, by their rank, in the index."""
            order = np.argsort(rank[positions], kind="stable")
            positions = positions[order]
            found = rank[positions]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for lo, hi in pairwise([0, *cuts.tolist(), len(positions)]):
                r = int(found[lo])
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(positions[lo:hi])

        start = np.flatnonzero(rank < NONE)
        if len(start):
            add(start)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            positions = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            positions = positions[rank[positions] == r]
            if not len(positions):
                continue
            if len(positions) > 1:
                if r in self.early:
                    owners = word[positions]
                    again = np.append(False, owners[1:] == owners[:-1])
                    for w in np.unique(owners[again]).tolist():
                        self._finish(w, int(first[w]), int(sizes[w]), flat, live, rank, after)
                    positions = positions[~np.isin(owners, owners[again])] if again.any() else positions
                    if not len(positions):
                        continue
                touch = np.append(False, after[positions[:-1]] == positions[1:])
                heads = np.flatnonzero(~touch)
                place = np.arange(len(positions)) - np.repeat(heads, np.diff(np.append(heads, len(positions))))
                positions = positions[place % 2 == 0]
            right = after[positions]
            beyond = after[right]
            flat[positions] = r
            live[right] = False
            rank[right] = NONE
            after[positions] = beyond
            linked = beyond < total
            before[beyond[linked]] = positions[linked]
            owner = word[positions]
            has_next = linked & (word[np.minimum(beyond, total - 1)] == owner)
            new = np.full(len(positions), NONE)
            new[has_next] = self.pair_ranks(flat[positions[has_next]], flat[beyond[has_next]])
            rank[positions] = new
            previous = before[positions]
            has_previous = (previous >= 0) & (word[np.maximum(previous, 0)] == owner)
            left = previous[has_previous]
            rank[left] = self.pair_ranks(flat[left], flat[positions[has_previous]])
            touched = np.concatenate((positions, left))
            touched = touched[rank[touched] < NONE]
            if len(touched):
                add(touched)
        taken = whole >= 0
        live[taken[word]] = False
        flat[first[taken]], live[first[taken]] = whole[taken], True
        return flat[live], np.bincount(word[live], minlength=n)

    def _finish(self, w: int, start: int, size: int, flat: np.ndarray, live: np.ndarray, rank: np.ndarray, after: np.ndarray) -> None:
        """Merge all that is left of one word: the pair of least rank first, the leftmost of several."""
        at, chain = start, []
        while at < start + size:
            chain.append(at)
            at = int(after[at])
        tokens = flat[chain].tolist()
        right, left = list(range(1, len(chain) + 1)), list(range(-1, len(chain) - 1))
        pair = lambda i: self.ranks.get(self.tokens[tokens[i]] + self.tokens[tokens[right[i]]]) if right[i] < len(chain) else None
        heap = [(r, i) for i in range(len(chain)) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        gone = [False] * len(chain)
        while heap:
            r, i = heapq.heappop(heap)
            if gone[i] or pair(i) != r:
                continue
            j = right[i]
            tokens[i], gone[j], right[i] = r, True, right[j]
            if right[i] < len(chain):
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and (q := pair(k)) is not None:
                    heapq.heappush(heap, (q, k))
        flat[chain], rank[start : start + size] = tokens, NONE
        live[np.array(chain)[gone]] = False


@cache
def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return Vocabulary(path)


def varints(a: np.ndarray) -> np.ndarray:
    """Numbers below 2**35 as bytes of seven bits each, the lowest first; all but a number's last byte have the top bit set."""
    a = a.astype(np.int64)
    size = 1 + sum((a >= 1 << 7 * j).astype(np.int64) for j in range(1, 5))
    first = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for j in range(int(size.max()) if len(a) else 0):
        own = size > j
        out[first[own] + j] = (a[own] >> 7 * j & 127) | np.where(size[own] > j + 1, 128, 0)
    return out


def numbers(raw: np.ndarray) -> np.ndarray:
    """What `varints` wrote."""
    last = np.flatnonzero(raw < 128)
    first = np.append(0, last[:-1] + 1) if len(last) else last
    size, out = last - first + 1, np.zeros(len(last), np.int64)
    for j in range(int(size.max()) if len(last) else 0):
        own = size > j
        out[own] |= (raw[first[own] + j].astype(np.int64) & 127) << 7 * j
    return out


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of bytes or of numbers, compressed together."""
    out = []
    for a in arrays:
        raw = a if a.dtype == np.uint8 else varints(a)
        out += [b"\0" if raw is a else b"\1", len(raw).to_bytes(8, "little"), raw.tobytes()]
    return zstandard.ZstdCompressor(level=9).compress(b"".join(out))


def unpacked(block: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(block), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at + 1 : at + 9], "little")
        a = np.frombuffer(raw, np.uint8, n, at + 9)
        out.append(numbers(a) if raw[at] else a)
        at += 9 + n
    return out


def numbered_words(texts: list[str | None], pattern) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """How many words each text has, the numbers of all in a row, and the distinct words by number, frequent ones first."""
    index = Numbered()
    words = [np.fromiter(map(index.__getitem__, pattern.findall(t or "")), np.int32) for t in texts]
    flat = np.concatenate(words)
    order = np.argsort(-np.bincount(flat, minlength=len(index)), kind="stable")
    number = np.empty(len(index), np.int32)
    number[order] = np.arange(len(index))
    distinct = [w.encode("utf-8") for w in index]
    return np.array([len(w) for w in words], np.int64), number[flat], [distinct[i] for i in order.tolist()]


def spelled(words: np.ndarray, ids: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ids of a text from the numbers of its words; word w has counts[w] ids from first[w] on."""
    n = counts[words]
    ends = np.cumsum(n)
    return ids[np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(first[words] - ends + n, n)]


def numbered(docs: DataFrame, pattern: str, buckets: int, slices: int = 1) -> DataFrame:
    """A row for each block of documents (no _bucket): _rows (as in docs) and _data, the words in each document and the
    numbers of them all; and one for each block and bucket of its slice: the words' numbers (as differences), lengths and bytes."""
    row = docs.schema["_row"].dataType
    schema = T.StructType([T.StructField("_rows", T.ArrayType(row)), T.StructField("_block", T.LongType()), T.StructField("_bucket", T.LongType()), T.StructField("_data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        base = TaskContext.get().partitionId() << 32
        for number, block in enumerate(gathered(batches, "text")):
            sizes, words, distinct = numbered_words(block.column("text").to_pylist(), compiled)
            whole = block.column("_row").combine_chunks()
            whole = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
            yield pa.RecordBatch.from_arrays([whole, pa.array([base | number]), pa.nulls(1, pa.int64()), pa.array([packed(sizes, words)])], schema.names)
            shift = zlib.crc32((base | number).to_bytes(8, "little")) % slices * buckets
            bucket = np.array([shift + zlib.crc32(w) % buckets for w in distinct], np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets * slices))
            lists = []
            for lo, hi in pairwise(cuts.tolist()):
                own = [distinct[i] for i in order[lo:hi].tolist()]
                lists.append(packed(np.diff(order[lo:hi], prepend=0), np.array([len(w) for w in own]), np.frombuffer(b"".join(own), np.uint8)))
            out = [pa.nulls(len(lists), whole.type), pa.array([base | number] * len(lists), pa.int64()), pa.array(bucket[order][cuts[:-1]]), pa.array(lists, pa.binary())]
            yield from pa.table(out, schema.names).to_batches(max_chunksize=4096)
            del words, distinct, lists, out
            trim()

    return small_batches(docs).mapInArrow(run, schema)


def spellings(words: DataFrame, path: str, buckets: int) -> DataFrame:
    """_of (block), _ids: numbers (as differences), token counts and ids of the words of each row. A bucket's words are replayed together, each once."""

    def run(bucket: pa.Table) -> pa.Table:
        index, rows = Numbered(), []
        for data in bucket.column("_data").to_pylist():
            steps, sizes, raw = unpacked(data)
            raw, ends = raw.tobytes(), np.append(0, np.cumsum(sizes)).tolist()
            rows.append((steps, np.array([index[raw[a:b]] for a, b in pairwise(ends)], np.int64)))
        ids, counts = vocabulary(path).replay(list(index))
        first = np.cumsum(counts) - counts
        return pa.table({"_of": bucket.column("_block"), "_ids": pa.array([packed(steps, counts[own], spelled(own, ids, counts, first)) for steps, own in rows], pa.binary())})

    return words.repartition(-(-buckets // 4), "_bucket").groupBy("_bucket").applyInArrow(run, "_of long, _ids binary")


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """The columns of `docs` but the text, n_tokens and ids (little-endian unsigned 32-bit) for each of its rows."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    scratch = Scratch(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text, "n_tokens", "ids")]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    slices = max(1, -(-size // SLICE_TEXT))
    buckets = max(8, -(-size // (slices * BUCKET_TEXT)))
    row = F.struct(*others) if others else F.struct(F.lit(0).alias("_"))
    parts = min(MOST_PARTS, max(8, -(-size // (2 * BLOCK_BYTES))))  # partitions that don't grow with the corpus
    # the documents' numbers stay where they are written: only words and their ids are shuffled
    rows = scratch.write_dealt(numbered(docs.select(F.col(text).alias("text"), row.alias("_row")), pattern, buckets, slices), "numbered", "_block", parts)

    def filled(block: pa.Table, own: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in own.column("_ids").to_pylist()]
        n = sum(len(p) for p, _, _ in parts)
        counts, first, at = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for steps, count, ids in parts:
            places = np.cumsum(steps)
            counts[places], first[places] = count, at + np.cumsum(count) - count
            at += len(ids)
        ids = np.concatenate([np.zeros(0, np.int64), *(p[2] for p in parts)]).astype("<u4")
        sizes, words = unpacked(block.column("_data")[0].as_py())
        out = [spelled(w, ids, counts, first) for w in np.split(words, np.cumsum(sizes)[:-1])]
        added = [pa.array([len(x) for x in out], pa.int64()), pa.array([x.tobytes() for x in out], pa.binary())]
        del out, words, parts
        trim()
        return pa.table([block.column("_rows").combine_chunks().flatten(), *added], ["_row", "n_tokens", "ids"])

    schema = T.StructType([T.StructField("_row", rows.schema["_rows"].dataType.elementType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    own = spellings(rows.where("_bucket is not null").select("_bucket", "_block", "_data"), path, buckets * slices).repartition(parts, "_of")
    coded = rows.where("_bucket is null").drop("_bucket").groupBy("_block").cogroup(own.groupBy("_of")).applyInArrow(filled, schema)
    return coded.select(*(F.col("_row")[c].alias(c) for c in others), "n_tokens", "ids")


def gathered(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.Table]:
    """Tables of about BLOCK_BYTES of text."""
    held, size = [], 0
    for block in blocks(batches, text, BLOCK_BYTES):
        held.append(block)
        size += block.column(block.schema.get_field_index(text)).nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """`encoded` with decoded (replaced if it is there), the bytes of its ids; an id outside the vocabulary raises KeyError."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for block in blocks(batches, "ids", 1 << 20):
            texts = [b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in block.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(texts, pa.binary())], [*block.schema.names, "decoded"])

    return small_batches(encoded).mapInArrow(run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decode(encode(docs)).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
