"""Benchmark decontamination: a broadcast hash set of test n-grams, training windows scanned in numpy, hits verified word by word.

Words are runs of ASCII digits, letters (A-Z lower-cased) and all characters beyond ASCII. A window is `width` consecutive
words of an item; an item of fewer words, but not none, is one window. Word and window hashes of a block of documents are
made at once; what the set holds is compared with the item's own words before it counts, so hashes decide nothing.

What is broadcast is bounded: `index` takes at most `limit` bytes of benchmark text. A larger benchmark is dealt over as
many parts as that needs; each part scans the documents, writes its hits alone, and a last pass unites them. Documents are
not shuffled with one part, the usual case.

Defined cases: null and empty texts have no words; an item without words never occurs; items of equal text are each listed,
a repeated item_id once, a null one as "null"; repeated rows have equal results; a null doc_id is kept; a word longer than
LONG bytes is hashed by blake2b, so texts of any length go through whole; empty tables give no hits or an empty result; of
other columns only those that the result adds are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blocks, encoded, mix, packed, small_batches, table, unpacked

WIDTH = 10
LIMIT = 8 << 20
BLOCK_BYTES = 1 << 20
SLICE_BYTES = 1 << 20
LONG = 4096
BITS = 22

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True
_numbers = np.random.default_rng(13).integers(0, 1 << 63, 256 + LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE, PLACE = _numbers[:256], _numbers[256:]


@dataclass
class Words:
    """The words of some texts: where they begin and end in `data` (lower-cased), their hashes, and where each text's begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text(self, lo: int, hi: int) -> bytes:
        return b" ".join([self.data[a:b].tobytes() for a, b in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)])


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    length = end - start
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(length <= LONG)
    held = np.cumsum(length[short])
    lo = 0
    while lo < len(short):
        done = held[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(held, done + SLICE_BYTES, side="right")))
        mine, n = short[lo:hi], length[short[lo:hi]]
        before = held[lo:hi] - n - done
        place = np.arange(held[hi - 1] - done) - np.repeat(before, n)
        values = BYTE[data[np.repeat(start[mine], n) + place]] * PLACE[place]
        out[mine] = mix(np.add.reduceat(values, before))
        lo = hi
    return out


def words_of(texts: list[bytes]) -> Words:
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]  # a line end, which is in no word, closes each text
    inside = np.concatenate(([False], INSIDE[data], [False]))
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))) if texts else np.zeros(1, np.int64)
    return Words(data, start, end, _hashes(data, start, end), np.searchsorted(start, offsets))


def windows(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all windows of `length` words, and their hashes."""
    n = max(0, len(words.start) - length + 1)
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h += words.hash[k : k + n] * PLACE[k]
    text = np.searchsorted(words.first, np.arange(len(words.start)), side="right")
    inside = np.flatnonzero(text[:n] == text[length - 1 :]) if n else np.zeros(0, np.int64)
    return inside, mix(h[inside] + np.uint64(length))


@dataclass
class Index:
    """Windows of benchmark items by hash: sorted hashes, the item of each, and its place in the item's words joined by spaces."""

    names: list[str]
    joined: bytes
    lengths: list[int]
    hash: np.ndarray
    item: np.ndarray
    start: np.ndarray
    end: np.ndarray
    seen: np.ndarray
    known: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def items_of(self, h: np.uint64, text: bytes) -> tuple[int, ...]:
        """The items that hold exactly this window."""
        if (found := self.known.get(text)) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            found = self.known[text] = tuple(sorted({int(self.item[k]) for k in range(lo, hi) if self.joined[self.start[k] : self.end[k]] == text}))
        return found


def index(items: list[tuple[str, str | None]], width: int = WIDTH) -> Index:
    """The hash set of some items: (name, text)."""
    words = words_of([encoded(t) for _, t in items])
    counts = np.diff(words.first)
    length = words.end - words.start
    at = np.concatenate(([0], np.cumsum(length + 1)))  # of each word in the words joined by spaces
    parts = []
    for n in sorted({min(width, c) for c in counts.tolist() if c}):
        first, h = windows(words, n)
        item = np.searchsorted(words.first, first, side="right") - 1
        mine = np.minimum(counts[item], width) == n
        first, h, item = first[mine], h[mine], item[mine]
        parts.append((h, item, at[first], at[first + n] - 1))
    hashes, item, start, end = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    order = np.argsort(hashes, kind="stable")
    seen = np.zeros(1 << BITS, bool)
    seen[hashes >> np.uint64(64 - BITS)] = True
    lengths = sorted({min(width, c) for c in counts.tolist() if c})
    return Index([n for n, _ in items], words.text(0, len(words.start)), lengths, hashes[order], item[order].astype(np.int32), start[order], end[order], seen)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hits(words: Words, held: Index) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """For each text the merged spans of its hit words (numbered in the text) and the names of the items that hit them."""
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    for n in held.lengths:
        first, h = windows(words, n)
        maybe = np.flatnonzero(held.seen[h >> np.uint64(64 - BITS)])
        found = np.searchsorted(held.hash, h[maybe])
        maybe = maybe[held.hash[np.minimum(found, len(held.hash) - 1)] == h[maybe]]
        text = np.searchsorted(words.first, first[maybe], side="right") - 1
        for j, hj, t in zip(first[maybe].tolist(), h[maybe], text.tolist(), strict=True):
            if mine := held.items_of(hj, words.text(j, j + n)):
                base = int(words.first[t])
                spans.setdefault(t, []).append((j - base, j - base + n))
                items.setdefault(t, set()).update(mine)
    return [(_merged(spans.get(t, [])), sorted({held.names[i] for i in items.get(t, ())})) for t in range(len(words.first) - 1)]


def _places(words: Words, text: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Bytes of a text (in `data`) from the first to the last word of each span."""
    base = int(words.first[text])
    return [(int(words.start[base + a]), int(words.end[base + b - 1])) for a, b in spans]


PART = T.StructType([T.StructField("marks", T.ArrayType(T.LongType())), T.StructField("found", T.ArrayType(T.StringType()))])
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("cleaned", T.StringType()),
    ]
)
ARROW = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.ArrayType(T.LongType()): pa.list_(pa.int64()), T.ArrayType(T.StringType()): pa.list_(pa.string())}


def _described(words: Words, texts: list[bytes | None], found: list[tuple[list, list]], cleaned: bool) -> list[tuple]:
    """ADDED for each text; spans as code points, start and end by turns; cleaned without them (null for null)."""
    rows, offset = [], 0
    for t, (raw, (spans, items)) in enumerate(zip(texts, found, strict=True)):
        points, kept, at, chars = [], [], 0, 0
        for a, b in _places(words, t, spans):
            lo, hi = a - offset, b - offset
            kept.append(raw[at:lo])
            chars += len(raw[at:lo].decode())
            points.append(chars)
            chars += len(raw[lo:hi].decode())
            points.append(chars)
            at = hi
        kept.append((raw or b"")[at:])
        without = None if raw is None or not cleaned else b"".join(kept).decode()
        rows.append((int(words.first[t + 1] - words.first[t]), sum(b - a for a, b in spans), items, points, without))
        offset += len(raw or b"") + 1
    return rows


def _mapped(docs: DataFrame, added: T.StructType, rows, without: tuple[str, ...] = ()) -> DataFrame:
    """`docs` less `without`, with `added` from rows(block, texts): a row for each text of a block of Arrow rows."""
    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in without), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            texts = [None if t is None else encoded(t) for t in block.column(block.schema.get_field_index("text")).to_pylist()]
            made = [pa.array(c, ARROW[f.dataType]) for c, f in zip(zip(*rows(block, texts), strict=True), added.fields, strict=True)]
            kept = [(c, n) for c, n in zip(block.columns, block.schema.names, strict=True) if n not in without]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), *made], [*(n for _, n in kept), *added.names])

    return small_batches(docs).mapInArrow(run, schema)


def _parts(benchmark: DataFrame, limit: int) -> int:
    """How many parts the benchmark's bytes need, some room left for parts of unequal size."""
    held = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 if held <= limit else -(-2 * held // limit)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, limit: int = LIMIT, cleaned: bool = True, without: tuple[str, ...] = ()) -> DataFrame:
    """`docs` (doc_id, text, any others) less `without`, with n_words, n_hit, items (sorted names), spans and cleaned.

    Counts the benchmark's bytes when called, and with several parts also writes their hits.
    """
    spark = docs.sparkSession
    benchmark = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").where("text is not null")
    docs = docs.drop(*ADDED.names)
    parts = _parts(benchmark, limit)
    dealt = benchmark.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))

    def held(part: int):
        items = dealt.where(F.col("part") == part).select("item_id", "text")
        return spark.sparkContext.broadcast(index([(r.item_id, r.text) for r in items.collect()], width))

    if parts == 1:
        shared = held(0)

        def rows(block: pa.RecordBatch, texts: list[bytes | None]) -> list[tuple]:
            words = words_of([t or b"" for t in texts])
            return _described(words, texts, hits(words, shared.value), cleaned)

        return _mapped(docs, ADDED, rows, without)

    scratch, some = Scratch(spark), None
    named = packed(docs, "doc_id", "text").withColumn("_key", F.sha2("text", 256))

    def hit_rows(shared):
        def rows(block: pa.RecordBatch, texts: list[bytes | None]) -> list[tuple]:
            return [([x for s in spans for x in s], items) for spans, items in hits(words_of([t or b"" for t in texts]), shared.value)]

        return rows

    for part in range(parts):
        mine = _mapped(named.select("_key", "text"), PART, hit_rows(held(part)), without=("text",)).where(F.size("marks") > 0).dropDuplicates(["_key"])
        mine = scratch.write(mine, f"hits-{part}")
        some = mine if some is None else some.unionByName(mine)
    united = some.groupBy("_key").agg(F.flatten(F.collect_list("marks")).alias("_marks"), F.flatten(F.collect_list("found")).alias("_found"))  # a row for each part
    joined = named.join(united, "_key", "left")

    def rows_united(block: pa.RecordBatch, texts: list[bytes | None]) -> list[tuple]:
        words = words_of([t or b"" for t in texts])
        column = lambda name: block.column(block.schema.get_field_index(name)).to_pylist()
        found = [(_merged(list(zip(m[::2], m[1::2], strict=True))), sorted(set(i))) for m, i in zip((x or [] for x in column("_marks")), (x or [] for x in column("_found")), strict=True)]
        return _described(words, texts, found, cleaned)

    united = _mapped(joined, ADDED, rows_united, ("_key", "_marks", "_found", *without))
    outside = ("doc_id", "text")
    return united.select(*(F.col(c if c in outside else f"_row.{c}").alias(c) for c in docs.columns if c not in without), *ADDED.names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """The rows and columns of `docs` without hit spans in their text, or (remove="documents") without the documents that have any."""
    if remove not in ("spans", "documents"):
        raise ValueError('remove must be "spans" or "documents"')
    found = scan(packed(docs, "doc_id", "text"), benchmark, width, limit, cleaned=remove == "spans")
    if remove == "documents":
        return unpacked(found.where("n_hit = 0"), docs)
    return unpacked(found.withColumn("text", F.col("cleaned")), docs)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"), cleaned=False, without=("text",))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rn, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
windows AS (
  SELECT rn, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT rn, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)),
found AS (SELECT rn, windows.k, i, item FROM windows JOIN grams USING (k, s)),
places AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rn, k, i FROM found)) GROUP BY rn),
named AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rn, item FROM found) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (rn) LEFT JOIN named USING (rn)
"""
