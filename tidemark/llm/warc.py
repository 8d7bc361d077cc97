"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame for each record.

Archives are rows with a binary `content` of bounded size, so any store that Spark reads or writes will do;
`spark.read.format("binaryFile")` gives such rows for .warc.zst files as well.

The reader takes archives of other writers too: the dictionary frame may itself be compressed or be absent, skippable
frames may stand between records, and records of other types (warcinfo, request, metadata, resource, conversion) pass
with their block as payload, whose length and, if it is given, digest are checked.

Defined cases: null html is an empty payload; a null page_id is kept and counts as smaller than any other; rows that
repeat the largest page_id of equal payloads are all responses; a null url is written as `urn:none`; bytes of a url
outside printable ASCII are percent-encoded; payloads of any length are written whole, each in one frame; an empty table
gives no archives and no records; further columns are ignored. A damaged archive raises ValueError with the archive's
name and the record's offset. Records without a page (of other writers) have a null page_id.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, encoded, small_batches, split_join, table

SKIPPABLE = b"\x5d\x2a\x4d\x18"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 4 << 20
DICT_BYTES, SAMPLES, SAMPLE_BYTES = 16 << 10, 256, 4 << 10
ZSTD = b"\x28\xb5\x2f\xfd"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

ARCHIVES = "archive string, n_records int, content binary"
RECORDS = (
    "archive string, record_id string, page_id long, record_type string, target_uri string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary"
)

_FIELDS = pa.schema(
    [(k, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for k, t in (x.split() for x in RECORDS.split(", "))]
)


def classified(pages: DataFrame, revisit_from: int = 1000) -> DataFrame:
    """page_id, url, html, digest (SHA-1), n (bytes) and response_id: for a revisit, the page that has the response.

    The largest page_id of equal payloads is found by a pre-aggregated sum-up of slim rows and joined back: the payloads
    themselves move only if repeats are too many to broadcast, and then the copies of one page are dealt over many tasks.
    A revisit's html is null, as its record has no payload.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    hashed = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    slim = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    repeated = (
        slim.where(F.col("bytes") >= revisit_from)
        .groupBy("digest")
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and largest is not null")
    )
    older = ~F.col("page_id").eqNullSafe(F.col("largest")) & F.col("largest").isNotNull()
    return split_join(hashed, repeated, "digest", "page_id", pages.count(), "left").select(
        "page_id", "url", F.when(~older, F.col("html")).alias("html"), "digest", F.col("bytes").alias("n"), F.when(older, F.col("largest")).alias("response_id")
    )


def _record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    page = re.fullmatch(r"<urn:page:(-?[0-9]+)>", record_id or "")
    return int(page[1]) if page else None


def record_bytes(page_id, url, payload: bytes, digest: str, n: int, response_id, date: str) -> bytes:
    """One WARC record. A revisit has no payload of its own: its digest and full length are in the headers."""
    fields = {
        "WARC-Type": "response" if response_id is None else "revisit",
        "WARC-Record-ID": _record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": "urn:none" if url is None else quote(encoded(url), safe="".join(map(chr, range(33, 127)))),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    }
    if response_id is not None:
        fields |= {
            "WARC-Refers-To": _record_id(response_id),
            "WARC-Profile": REVISIT_PROFILE,
            "X-Full-Payload-Length": n,
        }
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    block = http + (payload if response_id is None else b"")
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode("ascii") + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from the first records of an archive; too few to train on become raw content."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        raw = b"\n".join(samples)[:DICT_BYTES].ljust(8, b"\n")
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes]) -> bytes:
    """An archive: the dictionary in a skippable frame, then a frame for each record."""
    dictionary = trained([r[:SAMPLE_BYTES] for r in records[:SAMPLES]])
    to = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
    raw = dictionary.as_bytes()
    return b"".join([SKIPPABLE, len(raw).to_bytes(4, "little"), raw, *map(to.compress, records)])


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary that a leading frame holds, which may be compressed."""
    if raw[:4] == ZSTD:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind)


def _skipped(content: bytes, at: int, name: str) -> int:
    """Where the skippable frame at `at` ends."""
    end = at + 8 + int.from_bytes(content[at + 4 : at + 8], "little")
    if len(content) < at + 8 or end > len(content):
        raise ValueError(f"{name}: skippable frame at {at} is cut off")
    return end


def frames(content: bytes, name: str = "") -> Iterator[tuple[int, bytes]]:
    """Offset and content of every frame of a record. A leading skippable frame is the dictionary; without one there is none."""
    at, opener = 0, zstandard.ZstdDecompressor()
    if content[:4] == SKIPPABLE:
        at = _skipped(content, 0, name)
        if at > 8:
            try:
                opener = zstandard.ZstdDecompressor(dict_data=_dictionary(content[8:at]))
            except zstandard.ZstdError as e:
                raise ValueError(f"{name}: dictionary frame: {e}") from e
    elif content and content[:4] != ZSTD:
        raise ValueError(f"{name}: neither a dictionary nor a record at the start")
    while at < len(content):
        if content[at + 1 : at + 4] == SKIPPABLE[1:] and content[at] >> 4 == 5:
            at = _skipped(content, at, name)
            continue
        one, parts, fed = opener.decompressobj(), [], at
        try:
            while not one.eof and fed < len(content):
                parts.append(one.decompress(content[fed : fed + 65536]))
                fed = min(fed + 65536, len(content))
        except zstandard.ZstdError as e:
            raise ValueError(f"{name}: frame at {at}: {e}") from e
        if not one.eof:
            raise ValueError(f"{name}: frame at {at} is cut off")
        yield at, b"".join(parts)
        at = fed - len(one.unused_data)


def parse_record(raw: bytes) -> dict:
    """Headers in lower case, and the block. ValueError for a record that isn't well-formed or has a wrong length."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line")
    fields: dict = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:60]!r}")
        fields[name.lower()] = value.strip()
    if missing := [k for k in REQUIRED if k not in fields]:
        raise ValueError(f"missing {', '.join(missing)}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length {fields['content-length']}")
    return fields | {"block": rest[:-4]}


def _digest(fields: dict) -> str | None:
    """Hex SHA-1 that a record states for its payload, in base 32 or hex; None for none or for another algorithm."""
    algorithm, _, value = fields.get("warc-payload-digest", "").partition(":")
    if algorithm.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


def _checked(fields: dict) -> tuple:
    """page_id, record_type, target_uri, payload_bytes, digest, refers_to, payload of a parsed record."""
    kind, uri, page = fields["warc-type"], fields.get("warc-target-uri"), _page_of(fields["warc-record-id"])
    digest, payload, http = _digest(fields), fields["block"], None
    if fields.get("content-type", "").startswith("application/http"):
        http, mark, payload = payload.partition(b"\r\n\r\n")
        if not mark:
            raise ValueError("no HTTP header")
    if kind == "revisit":
        if payload:
            raise ValueError("a revisit with a payload")
        whole = fields.get("x-full-payload-length")
        return page, kind, uri, None if whole is None else int(whole), digest, _page_of(fields.get("warc-refers-to")), None
    lines = http.split(b"\r\n")[1:] if http is not None and kind == "response" else []
    plain = not any(x.lower().startswith((b"transfer-encoding:", b"content-encoding:")) for x in lines)
    length = next((int(x.split(b":")[1]) for x in lines if x.lower().startswith(b"content-length:")), len(payload))
    sha1 = hashlib.sha1(payload).hexdigest()
    if plain and (length != len(payload) or digest not in (None, sha1)):
        raise ValueError("the payload doesn't have the length or digest of its headers")
    return page, kind, uri, len(payload), digest or sha1, None, payload


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """ARCHIVES from rows of `classified`: each holds about archive_bytes of records of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def packed() -> pa.RecordBatch:
            content = pack(held)
            name = hashlib.sha256(content).hexdigest()[:24] + ".warc.zst"
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": pa.array([len(held)], pa.int32()), "content": pa.array([content], pa.binary())})

        for batch in batches:
            for row in zip(*(batch.column(k) for k in ("page_id", "url", "html", "digest", "n", "response_id")), strict=True):
                page_id, url, html, digest, n, response_id = (x.as_py() for x in row)
                held.append(record_bytes(page_id, url, encoded(html), digest, n, response_id, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return small_batches(records).mapInArrow(run, ARCHIVES)


def read_archives(archives: DataFrame, name: str = "archive", with_payload: bool = True) -> DataFrame:
    """RECORDS of every archive (`content`, and a column with its name), each record checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, content in zip(batch.column(name), batch.column("content"), strict=True):
                label, rows = label.as_py(), []
                for at, raw in frames(content.as_py(), label):
                    try:
                        fields = parse_record(raw)
                        page_id, kind, uri, n, digest, refers_to, payload = _checked(fields)
                    except (ValueError, KeyError) as e:
                        raise ValueError(f"{label}: record at {at}: {e}") from e
                    rows.append((label, fields["warc-record-id"], page_id, kind, uri, n, digest, refers_to, payload if with_payload else None))
                yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS.names, r, strict=True)) for r in rows], schema=_FIELDS)

    return archives.select(name, "content").mapInArrow(run, RECORDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Scratch(spark).write(write_archives(classified(table(spark, sf_dir, "pages"))), "archives", "none")
    return read_archives(archives, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, n, max(page_id) AS largest FROM p WHERE n >= 1000 GROUP BY digest, n HAVING count(*) > 1)
SELECT page_id, p.n AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest AND p.n = g.n
"""
