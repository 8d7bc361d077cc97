"""Media columns: FLAC streams of 8-bit mono samples, written and read in numpy, many frames at a time.

A payload's bytes become samples by byte - 128. `encode` picks for each frame of 1,024 samples a constant, verbatim,
fixed or linear-prediction subframe and Rice-codes its residual; the seek table names every frame, so `decode` can take
all frames of a batch in lockstep, one sample of each at a time. Streams whose seek table is missing or incomplete are
read frame after frame. Checksums of frame headers (CRC-8), frames (CRC-16) and whole streams (MD5) are verified.

Defined cases: null text is an empty payload, padded to 64 zero bytes; equal texts give equal streams; an empty table
gives an empty result; texts of any length are cut into frames; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, encoded, small_batches, table

BLOCK = 1024
RATE = 8000
PAD = 64
BATCH_BYTES = 2 << 20
FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])
PRECISION = 10  # bits of a quantised LPC coefficient


@cache
def _crc_tables(width: int, poly: int, length: int) -> np.ndarray:
    """[distance from the end][byte]: what a byte adds to a CRC; CRCs from 0 are linear, so the terms are XORed."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    first = np.zeros(256, np.uint32)
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        first[byte] = c
    out = np.empty((length, 256), np.uint16)
    out[0] = first
    for d in range(1, length):
        last = out[d - 1].astype(np.uint32)
        out[d] = ((last << 8) & mask) ^ first[last >> (width - 8)]
    return out


def _crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, poly: int) -> np.ndarray:
    """CRC of each buf[start:end]."""
    sizes = ends - starts
    tables = _crc_tables(width, poly, 1 << int(max(sizes.max(), 64) - 1).bit_length())
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    within = np.arange(int(sizes.sum())) - np.repeat(offsets, sizes)
    at = within + np.repeat(starts, sizes)
    return np.bitwise_xor.reduceat(tables[np.repeat(sizes, sizes) - 1 - within, buf[at]], offsets)


def _frame_number(n: int) -> bytes:
    """The number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> size) & 0xFF | n, *reversed(tail)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _lpc(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, frame: np.ndarray, within: np.ndarray, order: int):
    """Quantised coefficients [frame, order] and shifts by Levinson-Durbin over every frame's autocorrelation."""
    n = len(starts)
    auto = np.empty((n, order + 1))
    auto[:, 0] = np.add.reduceat((x * x).astype(np.float64), starts)
    for lag in range(1, order + 1):
        product = np.zeros(len(x))
        product[lag:] = x[lag:].astype(np.float64) * x[:-lag]
        product[within < lag] = 0
        auto[:, lag] = np.add.reduceat(product, starts)
    a, err = np.zeros((n, order)), np.maximum(auto[:, 0], 1e-9)
    for i in range(order):
        k = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(axis=1)) / err
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        err = np.maximum(err * (1 - k * k), 1e-9)
    largest = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(largest)).astype(np.int64), 0, 14)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int64), shift


def encode(payloads: list[bytes], block: int = BLOCK, lpc_order: int = 2, seek: bool = True) -> list[bytes]:
    """A FLAC stream for each payload (of at least one byte)."""
    if not payloads:
        return []
    lengths = np.array([len(p) for p in payloads], np.int64)
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    x = joined.astype(np.int32) - 128
    per = -(-lengths // block)
    owner = np.repeat(np.arange(len(payloads)), per)
    number = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    sizes = np.minimum(block, lengths[owner] - number * block)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    count = len(sizes)
    frame = np.repeat(np.arange(count), sizes)
    within = np.arange(len(x)) - starts[frame]

    # Residuals of each predictor; the warm-up samples of a frame have none.
    choices = []
    for order in range(3):
        r = x.copy()
        for j, c in enumerate(FIXED[order], 1):
            r[j:] -= c * x[:-j]
        r[within < order] = 0
        choices.append((order, 0, r, None, None))
    if lpc_order:
        coefs, shift = _lpc(x, starts, sizes, frame, within, lpc_order)
        guess = np.zeros(len(x), np.int64)
        for j in range(lpc_order):
            guess[j + 1 :] += coefs[frame[j + 1 :], j] * x[: -j - 1]
        r = x - (guess >> shift[frame]).astype(np.int32)
        r[within < lpc_order] = 0
        choices.append((lpc_order, 1, r, coefs, shift))
    cost = []
    for order, lpc, r, _, _ in choices:
        mean = np.add.reduceat(np.abs(r), starts) / np.maximum(sizes - order, 1)
        cost.append((sizes - order) * (np.log2(mean + 0.5) + 2) + 8 * order + lpc * (9 + PRECISION * order))
    cost = np.array(cost)
    cost[:, :][np.array([c[0] for c in choices])[:, None] >= sizes[None, :]] = np.inf
    pick = cost.argmin(axis=0)
    order = np.array([c[0] for c in choices])[pick]
    is_lpc = np.array([c[1] for c in choices])[pick] == 1
    residual = choices[0][2]
    for i in range(1, len(choices)):
        residual = np.where(pick[frame] == i, choices[i][2], residual)
    u = _zigzag(residual.astype(np.int32))
    coded = within >= order[frame]
    u[~coded] = 0
    n_coded = sizes - order
    best_k = np.clip(np.floor(np.log2(np.maximum(np.add.reduceat(u, starts) / n_coded * 0.6931, 1e-9))).astype(np.int64), 0, 13)
    bits = [np.add.reduceat((u >> (best_k + d)[frame]) * coded, starts) + n_coded * (1 + best_k + d) for d in (0, 1)]
    k = best_k + (bits[1] < bits[0])
    rice_bits = np.minimum(*bits)

    low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
    constant = low == high
    side = np.where(is_lpc, 9 + PRECISION * order, 0)
    coded_bits = 8 + 8 * order + side + 10 + rice_bits
    verbatim = ~constant & (coded_bits >= 8 + 8 * sizes)
    body_bits = np.where(constant, 16, np.where(verbatim, 8 + 8 * sizes, coded_bits))

    heads = []
    for size, num in zip(sizes.tolist(), number.tolist(), strict=True):
        heads.append(b"\xff\xf8\x70\x02" + _frame_number(num) + (size - 1).to_bytes(2, "big"))
    head_len = np.array([len(h) + 1 for h in heads], np.int64)
    frame_len = head_len + (body_bits + 7) // 8 + 2
    at = np.concatenate(([0], np.cumsum(frame_len)[:-1]))
    total = int(frame_len.sum())

    bit = np.zeros(8 * total, np.uint8)
    base = 8 * (at + head_len)

    def put(positions, values, width):
        for j in range(width):
            bit[positions + j] = (values >> (width - 1 - j)) & 1

    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(is_lpc, 32 + order - 1, 8 + order)))
    put(base, kind << 1, 8)
    if constant.any():
        put(base[constant] + 8, x[starts[constant]] & 0xFF, 8)
    if (v := verbatim[frame]).any():
        put(base[frame[v]] + 8 + 8 * within[v], x[v] & 0xFF, 8)
    use = ~constant & ~verbatim
    warm = use[frame] & ~coded
    if warm.any():
        put(base[frame[warm]] + 8 + 8 * within[warm], x[warm] & 0xFF, 8)
    after = base + 8 + 8 * order
    f = np.flatnonzero(use & is_lpc)
    if len(f):
        put(after[f], np.full(len(f), PRECISION - 1), 4)
        put(after[f] + 4, shift[f], 5)
        for j in range(lpc_order):
            put(after[f] + 9 + PRECISION * j, coefs[f, j] & ((1 << PRECISION) - 1), PRECISION)
    after = after + side
    f = np.flatnonzero(use)
    put(after[f] + 6, k[f], 4)  # before it: method 0 and partition order 0, six bits of 0
    use_sample = use[frame] & coded
    fs, us = frame[use_sample], u[use_sample].astype(np.int64)
    ks = k[fs]
    q = us >> ks
    lens = q + 1 + ks
    ends = np.cumsum(lens)
    first = np.zeros(count, np.int64)
    bounds = np.searchsorted(fs, np.arange(count))
    inside = bounds < len(fs)
    first[inside] = (ends - lens)[bounds[inside]]
    stop = (after + 10)[fs] + (ends - lens) - first[fs] + q
    bit[stop] = 1
    for j in range(int(ks.max()) if len(ks) else 0):
        m = j < ks
        bit[stop[m] + 1 + j] = (us[m] >> (ks[m] - 1 - j)) & 1
    out = np.packbits(bit)
    flat_heads = np.frombuffer(b"".join(heads), np.uint8)
    raw_len = head_len - 1
    offs = np.concatenate(([0], np.cumsum(raw_len)[:-1]))
    out[np.arange(len(flat_heads)) - np.repeat(offs, raw_len) + np.repeat(at, raw_len)] = flat_heads
    out[at + head_len - 1] = _crcs(out, at, at + head_len - 1, 8, 0x07)
    crc = _crcs(out, at, at + frame_len - 2, 16, 0x8005)
    out[at + frame_len - 2], out[at + frame_len - 1] = crc >> 8, crc & 0xFF

    pcm = x.astype(np.int8)
    stops = np.cumsum(lengths)
    streams, f0 = [], 0
    for i, n in enumerate(lengths.tolist()):
        f1 = f0 + int(per[i])
        start = int(at[f0])
        end = int(at[f1 - 1] + frame_len[f1 - 1])
        sizes_i = frame_len[f0:f1]
        info = (
            block.to_bytes(2, "big") * 2
            + int(sizes_i.min()).to_bytes(3, "big")
            + int(sizes_i.max()).to_bytes(3, "big")
            + ((RATE << 44) | (0 << 41) | (7 << 36) | n).to_bytes(8, "big")
            + hashlib.md5(pcm[stops[i] - n : stops[i]].tobytes()).digest()
        )
        meta = b"fLaC" + bytes([0 if seek else 0x80]) + (34).to_bytes(3, "big") + info
        if seek:
            points = np.zeros(f1 - f0, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
            points["s"], points["o"], points["n"] = number[f0:f1] * block, at[f0:f1] - start, sizes[f0:f1]
            meta += b"\x83" + (18 * len(points)).to_bytes(3, "big") + points.tobytes()
        streams.append(meta + out[start:end].tobytes())
        f0 = f1
    return streams


def _metadata(stream: bytes) -> dict:
    """total samples, md5, first frame's offset and the seek points of a stream."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, found = 4, False, {"points": None}
    while not last:
        if at + 4 > len(stream):
            raise ValueError("metadata is cut off")
        last, kind, n = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                raise ValueError("only 8-bit mono streams are read here")
            found |= {"total": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            found["points"] = np.frombuffer(body, np.dtype([("s", ">u8"), ("o", ">u8"), ("n", ">u2")]))
        at += 4 + n
    return found | {"at": at}


class _Bits:
    """Reads bits at one position for each lane."""

    def __init__(self, buf: np.ndarray):
        self.words = np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))

    def window(self, pos: np.ndarray) -> np.ndarray:
        """The next bits at the top of a 64-bit word, 57 of them valid."""
        return self.words[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)

    def read(self, pos: np.ndarray, width: int) -> np.ndarray:
        return (self.window(pos) >> np.uint64(64 - width)).astype(np.int64)

    def zeros(self, pos: np.ndarray) -> np.ndarray:
        """Zero bits before the next 1."""
        found, at, lanes = np.zeros(len(pos), np.int64), pos.copy(), np.arange(len(pos))
        while len(lanes):
            top = (self.window(at) >> np.uint64(32)).astype(np.float64)
            n = 32 - np.frexp(top)[1]
            found[lanes] += n
            more = top == 0
            lanes, at = lanes[more], at[more] + 32
        return found


def _signed(v: np.ndarray, width) -> np.ndarray:
    return np.where(v >> (width - 1) & 1, v - (1 << width), v)


def _decode_frames(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_read_frames, where bits that lead out of the buffer are an error of the stream."""
    try:
        return _read_frames(buf, starts)
    except IndexError as e:
        raise ValueError("a frame is cut off") from e


def _read_frames(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples [frame, sample], sizes and ends of the frames at `starts`; buf has 16 spare bytes at its end."""
    read = _Bits(buf)
    n = len(starts)
    if (((buf[starts].astype(np.int64) << 8) | buf[starts + 1]) != 0xFFF8).any():
        raise ValueError("a frame doesn't start with its sync code")
    code, lead = buf[starts + 2] >> 4, buf[starts + 4].astype(np.int64)
    number_len = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, np.where(lead < 0xFC, 5, 6)))))
    at = starts + 4 + number_len
    two = (buf[at].astype(np.int64) << 8) | buf[at + 1]
    sizes = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7, code >= 8], [192, 576 << (np.clip(code, 2, 5).astype(np.int64) - 2), buf[at].astype(np.int64) + 1, two + 1, 256 << (np.clip(code, 8, 15).astype(np.int64) - 8)], 0)
    if (sizes == 0).any():
        raise ValueError("a frame has a reserved block size")
    at = at + np.select([code == 6, code == 7], [1, 2], 0)
    rate = buf[starts + 2] & 15
    at = at + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    if (_crcs(buf, starts, at, 8, 0x07) != buf[at]).any():
        raise ValueError("a frame header has a wrong CRC-8")
    pos = 8 * (at + 1)
    kind = read.read(pos, 8)
    if (kind & 0x81).any():
        raise ValueError("a subframe has a set padding bit or wasted bits, which 8-bit streams here don't have")
    kind >>= 1
    pos = pos + 8
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise ValueError("a subframe has a reserved type")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    width, most = int(sizes.max()), max(1, int(order.max()))
    out = np.zeros((n, width), np.int32)
    if constant.any():
        out[constant] = _signed(read.read(pos[constant], 8), 8)[:, None]
        pos[constant] += 8
    for j in range(width if verbatim.any() else 0):
        m = np.flatnonzero(verbatim & (j < sizes))
        out[m, j] = _signed(read.read(pos[m], 8), 8)
        pos[m] += 8
    for j in range(int(order.max())):
        m = np.flatnonzero(j < order)
        out[m, j] = _signed(read.read(pos[m], 8), 8)
        pos[m] += 8
    coefs, shift = np.zeros((n, most), np.int64), np.zeros(n, np.int64)
    for o, c in enumerate(FIXED):
        own = np.flatnonzero(fixed & (order == o))
        coefs[own[:, None], np.arange(len(c))] = c
    m = np.flatnonzero(lpc)
    if len(m):
        precision = read.read(pos[m], 4) + 1
        shift[m] = _signed(read.read(pos[m] + 4, 5), 5)
        pos[m] += 9
        for j in range(most):
            own = j < order[m]
            f, p = m[own], precision[own]
            coefs[f, j] = _signed((read.window(pos[f]) >> (64 - p).astype(np.uint64)).astype(np.int64), p)
            pos[f] += p

    # The residual: one sample of every frame that still has some, in steps.
    lanes = np.flatnonzero(fixed | lpc)
    if len(lanes):
        head = read.read(pos[lanes], 6)
        method, parts = head >> 4, head & 15
        if (method > 1).any():
            raise ValueError("a residual has a reserved method")
        pos[lanes] += 6
        by_size = np.argsort(-sizes[lanes], kind="stable")
        lanes, method, parts = lanes[by_size], method[by_size], parts[by_size]
        part = sizes[lanes] >> parts
        p, k, raw = pos[lanes], np.zeros(len(lanes), np.uint64), np.full(len(lanes), -1)
        first, size, c, s = order[lanes], sizes[lanes], coefs[lanes], shift[lanes]
        rows = np.zeros((width, len(lanes)), np.int32)  # a sample of all lanes lies together
        rows[: max(1, int(first.max()))] = out[lanes][:, : max(1, int(first.max()))].T
        even = bool((part == size).all())
        one, wide = np.uint64(1), np.uint64(63)
        for i in range(width):
            live = int(np.searchsorted(-size, -i, side="left"))
            if not live:
                break
            begins = (np.minimum(i, first[:live]) == first[:live]) & ((i == first[:live]) | ((i % part[:live] == 0) if not even else False))
            if begins.any():
                g = np.flatnonzero(begins)
                w = np.where(method[g] == 0, 4, 5)
                v = (read.window(p[g]) >> (64 - w).astype(np.uint64)).astype(np.int64)
                p[g] += w
                escaped = v == (1 << w) - 1
                raw[g] = -1
                k[g] = np.where(escaped, 0, v).astype(np.uint64)
                if escaped.any():
                    e = g[escaped]
                    raw[e] = read.read(p[e], 5)
                    p[e] += 5
            a = slice(0, live)
            q = read.zeros(p[a]) if i == 0 else None
            if q is None:
                window = read.window(p[a])
                top = (window >> np.uint64(32)).astype(np.float64)
                q = 32 - np.frexp(top)[1].astype(np.int64)
                if (long := (q > 31) | (q + k[a].astype(np.int64) > 55)).any():
                    g = np.flatnonzero(long)
                    q[g] = read.zeros(p[g])
                    window[g] = read.window(p[g] + q[g]) >> one  # as if 1 bit of the run were left
                    skip = q.astype(np.uint64)
                    skip[g] = 1
                else:
                    skip = q.astype(np.uint64)
            else:
                window = read.window(p[a] + q) >> one
                skip = np.ones(live, np.uint64)
            rest = ((window << (skip + one)) >> one) >> (wide - k[a])
            v = (q << k[a].astype(np.int64)) | rest.astype(np.int64)
            r = (v >> 1) ^ -(v & 1)
            used = q + 1 + k[a].astype(np.int64)
            if raw[a].max() >= 0:
                g = np.flatnonzero(raw[a] >= 0)
                w = raw[g]
                r[g] = np.where(w == 0, 0, _signed((read.window(p[g]) >> (64 - np.maximum(w, 1)).astype(np.uint64)).astype(np.int64), np.maximum(w, 1)))
                used[g] = w
            ready = i >= first[a]
            guess = np.zeros(live, np.int64)
            for j in range(min(most, i)):
                guess += c[a, j] * rows[i - 1 - j, a]
            value = r + (guess >> s[a])
            if ready.all():
                rows[i, a] = value
                p[a] += used
            else:
                rows[i, a] = np.where(ready, value, rows[i, a])
                p[a] += np.where(ready, used, 0)
        out[lanes] = rows.T
        pos[lanes] = p
    ends = (pos + 7) // 8
    crc = (buf[ends].astype(np.int64) << 8) | buf[ends + 1]
    if (_crcs(buf, starts, ends, 16, 0x8005) != crc).any():
        raise ValueError("a frame has a wrong CRC-16")
    return out, sizes, ends + 2


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its PCM blocks: (offset of the first sample, samples as unsigned bytes)."""
    if not streams:
        return []
    buf = np.frombuffer(b"".join([*streams, b"\0" * 16]), np.uint8).copy()
    metas = [_metadata(s) for s in streams]
    lengths = np.array([len(s) for s in streams], np.int64)
    base = np.cumsum(lengths) - lengths
    found: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    seekable, plain = [], []
    for i, m in enumerate(metas):
        pts = m["points"]
        whole = pts is not None and len(pts) and (np.cumsum(pts["n"].astype(np.int64))[:-1] == pts["s"][1:].astype(np.int64)).all() and int(pts["n"].astype(np.int64).sum()) == m["total"]
        (seekable if whole else plain).append(i)
    if seekable:
        owner = np.repeat(seekable, [len(metas[i]["points"]) for i in seekable])
        starts = np.concatenate([base[i] + metas[i]["at"] + metas[i]["points"]["o"].astype(np.int64) for i in seekable])
        at = np.concatenate([metas[i]["points"]["s"].astype(np.int64) for i in seekable])
        out, sizes, ends = _decode_frames(buf, starts)
        nexts = np.where(np.append(owner[1:] == owner[:-1], False), np.append(starts[1:], 0), (base + lengths)[owner])
        if (ends != nexts).any():
            raise ValueError("a frame doesn't end where the seek table says")
        unsigned = (out + 128).astype(np.uint8)
        for row, (i, size, first) in enumerate(zip(owner.tolist(), sizes.tolist(), at.tolist(), strict=True)):
            found[i].append((first, unsigned[row, :size].tobytes()))
    where = {i: int(base[i] + metas[i]["at"]) for i in plain}
    done = dict.fromkeys(plain, 0)
    while going := [i for i in plain if done[i] < metas[i]["total"]]:
        out, sizes, ends = _decode_frames(buf, np.array([where[i] for i in going], np.int64))
        for row, i in enumerate(going):
            found[i].append((done[i], (out[row, : sizes[row]] + 128).astype(np.uint8).tobytes()))
            done[i] += int(sizes[row])
            where[i] = int(ends[row])
    for i, (m, own) in enumerate(zip(metas, found, strict=True)):
        pcm = b"".join(b for _, b in own)
        signed = (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()
        if len(pcm) != m["total"] or m["md5"] not in (b"\0" * 16, hashlib.md5(signed).digest()):
            raise ValueError(f"stream {i}: the samples don't have the length or MD5 of the header")
    return found


def padded(text: str | None) -> tuple[int, bytes]:
    raw = encoded(text)
    return len(raw), raw + b"\0" * (-len(raw) % PAD or (PAD if not raw else 0))


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the FLAC stream of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BATCH_BYTES):
            texts = [padded(t) for t in block.column("text").to_pylist()]
            streams = encode([p for _, p in texts])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([n for n, _ in texts], pa.int64()), pa.array(streams, pa.binary())], ["doc_id", "n_bytes", "media"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(streams: DataFrame) -> DataFrame:
    """A row for each frame of `media`: doc_id, sample_offset, n_samples, pcm (unsigned 8-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "media", BATCH_BYTES):
            rows = [(i, at, len(pcm), pcm) for i, own in zip(block.column("doc_id").to_pylist(), decode(block.column("media").to_pylist()), strict=True) for at, pcm in own]
            ids, ats, sizes, pcms = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int64()), pa.array(sizes, pa.int32()), pa.array(pcms, pa.binary())], ["doc_id", "sample_offset", "n_samples", "pcm"])

    return small_batches(streams).select("doc_id", "media").mapInArrow(run, "doc_id long, sample_offset long, n_samples int, pcm binary")


def features(payload: bytes) -> str:
    """Least and largest sample, sum, energy and zero crossings of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"{x.min()}:{x.max()}:{x.sum()}:{(x * x).sum()}:{int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def described(streams: DataFrame) -> DataFrame:
    """Digests and features of what the stored streams decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "media", BATCH_BYTES):
            stored = block.column("media").to_pylist()
            out = []
            for stream, own in zip(stored, decode(stored), strict=True):
                payload = b"".join(b for _, b in own)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), features(payload)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("n_bytes"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return small_batches(streams).mapInArrow(run, schema)


def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(media(table(spark, sf_dir, "documents")))
