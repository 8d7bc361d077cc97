"""Fill-in-the-middle: each text is cut twice between units and put together anew as prefix, suffix, middle (or suffix first).

A unit begins where a predicate of two neighbouring bytes holds. Texts are cut into chunks that overlap by one byte, so a
chunk counts the boundaries in it without the others; numpy counts the chunks of a whole block of documents side by side.
Prefix sums over the counts give every document's number of units and route the ranks of its two cuts to the chunks that
own them, and only those chunks are scanned again for the place. Texts never leave the task that read them: no shuffle.

Defined cases: a null text counts as empty; an empty text, and one that contains a marker, stays as it is (form "plain");
a null doc_id draws as "null"; repeated rows draw alike; texts of any length go through whole, in groups of chunks of
at most GROUP * CHUNK bytes; an empty table gives an empty table; of other columns only those that the result adds are
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import blocks, encoded, small_batches, table

PREFIX, SUFFIX, MIDDLE = MARKERS = b"<P>", b"<S>", b"<M>"
CHUNK = 4096
GROUP = 1024
BLOCK_BYTES = 4 << 20
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

# Does a unit begin at the right byte of a neighbouring pair?
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "line": lambda left, right: left == 10,
    "word": lambda left, right: SPACES[left] & ~SPACES[right],
    "character": lambda left, right: (right & 0xC0) != 0x80,
}

Piece = tuple[int, str, bytes, int | None, int | None]  # units, form, output, characters of prefix and middle


def _begins(data: np.ndarray, lo: int, hi: int, firsts: np.ndarray, begin: Callable) -> np.ndarray:
    """For data[lo:hi], whether a unit begins at each byte: at a text's first one always, else by its pair with the byte before."""
    right = data[lo:hi]
    left = data[lo - 1 : hi - 1] if lo else np.concatenate((data[:1], right[:-1]))
    found = begin(left, right)
    found[firsts[np.searchsorted(firsts, lo) : np.searchsorted(firsts, hi)] - lo] = True
    return found


class Chunks:
    """The chunks of some texts that lie one after the other in `data`, with prefix sums of units and characters."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, begin: Callable, chunk: int = CHUNK):
        self.data, self.begin = data, begin
        length = np.diff(offsets)
        per_text = -(-length // chunk)
        self.first_chunk = np.concatenate(([0], np.cumsum(per_text)))
        inside = np.arange(self.first_chunk[-1]) - np.repeat(self.first_chunk[:-1], per_text)
        self.at = np.append(np.repeat(offsets[:-1], per_text) + inside * chunk, offsets[-1])
        self.firsts = offsets[:-1][length > 0]
        units, chars = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        for lo in range(0, len(inside), GROUP):
            hi = min(lo + GROUP, len(inside))
            a, b = self.at[lo], self.at[hi]
            units[lo + 1 : hi + 1] = np.add.reduceat(_begins(data, a, b, self.firsts, begin), self.at[lo:hi] - a, dtype=np.int64)
            chars[lo + 1 : hi + 1] = np.add.reduceat(UNITS["character"](data[a:b], data[a:b]), self.at[lo:hi] - a, dtype=np.int64)
        self.units, self.chars = np.cumsum(units), np.cumsum(chars)

    def counts(self) -> np.ndarray:
        """Units of each text."""
        return self.units[self.first_chunk[1:]] - self.units[self.first_chunk[:-1]]

    def place(self, text: int, rank: int) -> tuple[int, int]:
        """The byte and the character at which a text's first `rank` units end: where its next one begins, or the text's end."""
        lo, hi = self.first_chunk[text], self.first_chunk[text + 1]
        before = self.units[lo]
        if before + rank >= self.units[hi]:
            return int(self.at[hi]), int(self.chars[hi] - self.chars[lo])
        owner = int(np.searchsorted(self.units, before + rank, side="right")) - 1
        a, b = self.at[owner], self.at[owner + 1]
        here = np.flatnonzero(_begins(self.data, a, b, self.firsts, self.begin))[before + rank - self.units[owner]]
        chars = np.count_nonzero((self.data[a : a + here] & 0xC0) != 0x80)
        return int(a + here), int(self.chars[owner] - self.chars[lo] + chars)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits from a document's id."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def transformed(texts: list[bytes], ids: list[int | None], seed: int = 7, percent: int = 100, spm_percent: int = 50, unit: str = "line", chunk: int = CHUNK) -> list[Piece]:
    joined = b"".join(texts)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    chunks = Chunks(np.frombuffer(joined, np.uint8), offsets, UNITS[unit], chunk)
    out: list[Piece] = []
    for i, (n, text) in enumerate(zip(chunks.counts().tolist(), texts, strict=True)):
        h1, h2, h3, h4 = draws(ids[i], seed)
        if not text or any(m in text for m in MARKERS) or h3 % 100 >= percent:
            out.append((n, "plain", text, None, None))
            continue
        (a, a_chars), (b, b_chars) = (chunks.place(i, r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
        start = int(offsets[i])
        prefix, middle, suffix = text[: a - start], text[a - start : b - start], text[b - start :]
        if h4 % 100 < spm_percent:
            out.append((n, "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), a_chars, b_chars - a_chars))
        else:
            out.append((n, "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), a_chars, b_chars - a_chars))
    return out


def restored(output: bytes, form: str) -> bytes:
    """The text that `transformed` was given, from what it made."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    start, rest = output[len(first) :].split(second, 1)
    end, middle = rest.split(MIDDLE, 1)
    return end + middle + start if form == "spm" else start + middle + end


PIECE = [("n", T.LongType()), ("form", T.StringType()), ("output", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]


def _pieces(block: pa.RecordBatch, **options) -> list[Piece]:
    column = lambda name: block.column(block.schema.get_field_index(name)).to_pylist()
    return transformed([encoded(t) for t in column("text")], column("doc_id"), **options)


def _added(docs: DataFrame, names: list[tuple[str, T.DataType]], rows: Callable[[pa.RecordBatch], list[tuple]], without: tuple[str, ...] = ()) -> DataFrame:
    """`docs` less the columns of `without`, and with those of `names`, from a row for each row of a block."""
    added = [T.StructField(*n) for n in names]
    docs = docs.drop(*(n for n, _ in names))
    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in without), *added])
    types = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            made = [pa.array(c, t) for c, t in zip(zip(*rows(block), strict=True), types, strict=True)]
            kept = [(c, n) for c, n in zip(block.columns, block.schema.names, strict=True) if n not in without]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), *made], [*(n for _, n in kept), *(f.name for f in added)])

    return small_batches(docs).mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, unit: str = "line") -> DataFrame:
    """`docs` (doc_id, text, any others) with n, form, output (the new text), prefix_chars and middle_chars.

    Of a hundred texts `percent` are cut, and of those `spm_percent` begin with the suffix. `unit` is a name in UNITS.
    """

    def rows(block: pa.RecordBatch) -> list[tuple]:
        return [(n, form, out.decode(errors="surrogatepass"), p, m) for n, form, out, p, m in _pieces(block, seed=seed, percent=percent, spm_percent=spm_percent, unit=unit)]

    return _added(docs, PIECE, rows)


def restore(made: DataFrame) -> DataFrame:
    """`made` with restored: the texts that `fill_in_middle` was given (empty for null), from its output and form alone."""
    schema = T.StructType([*made.drop("restored").schema.fields, T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "output", BLOCK_BYTES):
            column = lambda name: block.column(block.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            texts = [restored(encoded(o), f).decode(errors="surrogatepass") for o, f in zip(column("output"), column("form"), strict=True)]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(texts, pa.string())], [*block.schema.names, "restored"])

    return small_batches(made.drop("restored")).mapInArrow(run, schema)


def digests(docs: DataFrame, **options) -> DataFrame:
    """What `fill_in_middle` and `restore` give, as SHA-256 digests taken where the texts are made, so that none returns."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def rows(block: pa.RecordBatch) -> list[tuple]:
        return [(n, form, p, m, sha(out), sha(restored(out, form))) for n, form, out, p, m in _pieces(block, **options)]

    names = [PIECE[0], PIECE[1], *PIECE[3:], ("output_sha256", T.StringType()), ("restored_sha256", T.StringType())]
    return _added(docs, names, rows, without=("text",))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS r1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS r2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM lines),
cut AS (
  SELECT *, coalesce(array_to_string(u[1:least(r1, r2)], ''), '') AS p, coalesce(array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(r1, r2) + 1:], ''), '') AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""
