"""FLAC media columns: text payloads as 8-bit mono FLAC streams, and back.

Every frame holds 192 samples (a block size FLAC has a code for), coded by whichever is
shortest of a constant, a fixed predictor, a linear predictor of order 4 with partitioned
Rice residuals, or verbatim samples.  A seek point every four frames gives sample offsets
that can be reached without reading what is before; it also lets a task decode all runs
of four frames of a batch side by side in numpy, one sample of each run at a time.
Decoding reads Rice residuals and predictors of any order and verifies both checksums of
every frame and the stream's MD5.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .batches import chunks, map_arrow, narrow, texts

BLOCK = 192
SEEK_FRAMES = 4
RATE = 8000
PARTITIONS = 2  # as a power of two: four partitions of 48 samples
ORDER, PRECISION = 4, 8
#: Frames worked on at a time in a task.
SLICE = 8192


def _table(poly: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    c = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        c = np.where(c & top, (c << 1) ^ poly, c << 1) & mask
    return c


_CRC8 = _table(0x07, 8)
_CRC16 = _table(0x8005, 16)


def _reach(n: int) -> np.ndarray:
    """[distance to the end, byte] -> what that byte adds to a CRC-16."""
    out = np.empty((n, 256), np.uint16)
    row = _CRC16
    for d in range(n):
        out[d] = row
        row = ((row << 8) & 0xFFFF) ^ _CRC16[row >> 8]
    return out


_far = _reach(BLOCK + 64)


def _crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of adjoining ranges of ``data`` (``ends[i] == starts[i + 1]`` isn't needed)."""
    global _far
    n = ends - starts
    if len(n) and n.max() > len(_far):
        _far = _reach(int(n.max()) + 64)
    total = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(total[-1]) - np.repeat(total[:-1], n)
    parts = _far[np.repeat(n, n) - 1 - at, data[np.repeat(starts, n) + at]]
    return np.bitwise_xor.reduceat(parts, total[:-1]).astype(np.int64) if len(n) else np.zeros(0, np.int64)


def _frame_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8-like code of frame numbers below 2**21: (frames x 4 bytes, bytes used)."""
    used = 1 + (n >= 0x80) + (n >= 0x800) + (n >= 0x10000)
    out = np.zeros((len(n), 4), np.int64)
    out[:, 0] = np.choose(used - 1, [n, 0xC0 | n >> 6, 0xE0 | n >> 12, 0xF0 | n >> 18])
    for k in range(1, 4):
        out[:, k] = np.where(used > k, 0x80 | (n >> np.maximum(6 * (used - 1 - k), 0)) & 0x3F, 0)
    return out, used


def _rice(residual: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded residuals, parameter of each partition, bits in all) of frames x 192 residuals."""
    u = (residual << 1) ^ (residual >> 31)
    u[:, :order] = 0
    parts = u.reshape(len(u), 1 << PARTITIONS, -1)
    n = np.full(1 << PARTITIONS, parts.shape[2])
    n[0] -= order
    total = parts.sum(axis=2)
    k = np.clip(np.floor(np.log2(np.maximum(total / n * 0.7, 1))).astype(np.int32), 0, 14)
    bits = (parts >> k[:, :, None]).sum(axis=2) + n * (1 + k)
    return u, k, bits.sum(axis=1) + 4 * (1 << PARTITIONS) + 6


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(quantised coefficients, shift) of frames x 192 samples, by Levinson-Durbin."""
    # Whole numbers up to here, so that a frame's sums don't depend on what else is in the batch.
    y = (x - x.sum(axis=1, keepdims=True) // BLOCK) * np.rint(np.hanning(BLOCK + 2)[1:-1] * 64).astype(np.int64)
    r = np.stack([(y[:, k:] * y[:, : BLOCK - k]).sum(axis=1) for k in range(ORDER + 1)], axis=1).astype(float)
    error = r[:, 0] * 1.0001 + 1e-9
    a = np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = r[:, i + 1].copy()
        for j in range(i):
            k -= a[:, j] * r[:, i - j]
        k /= error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1].copy()
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(axis=1), 1e-6)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)).astype(np.int64) - 1, 0, 15)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int32), shift


def _pack(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Bytes of the fields, most significant bit first; a field may be wider than its value."""
    last = np.cumsum(widths) - 1
    bits = np.zeros(int(last[-1]) + 1 if len(last) else 0, np.uint8)
    for b in range(int(values.max()).bit_length() if len(values) else 0):
        bits[last[(values >> b) & 1 == 1] - b] = 1
    return np.packbits(bits)


def _encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each frame) of frames x 192 samples."""
    m = len(x)
    rows = np.arange(m)
    coef, shift = _predictors(x)
    guess = np.zeros_like(x)
    for j in range(ORDER):
        guess[:, ORDER:] += coef[:, j : j + 1] * x[:, ORDER - 1 - j : BLOCK - 1 - j]
    kinds = [  # (subframe type, order, residuals, bits beside them)
        (0b001000, 0, x.copy(), 0),
        (0b001001, 1, np.diff(x, axis=1, prepend=0), 8),
        (0b100000 | (ORDER - 1), ORDER, x - (guess >> shift[:, None].astype(np.int32)), 8 * ORDER + 9 + ORDER * PRECISION),
    ]
    coded = [_rice(r, order) for _, order, r, _ in kinds]
    cost = np.stack([c[2] + kind[3] for c, kind in zip(coded, kinds, strict=True)] + [np.full(m, 8 * BLOCK)], axis=1)
    pick = np.argmin(cost, axis=1)
    verbatim = pick == len(kinds)
    constant = (x == x[:, :1]).all(axis=1)
    pick = np.where(verbatim, 0, pick)
    u = np.stack([c[0] for c in coded])[pick, rows]
    k = np.stack([c[1] for c in coded])[pick, rows]
    order = np.array([kind[1] for kind in kinds])[pick]
    lpc = (pick == 2) & ~verbatim & ~constant
    plain = verbatim & ~constant
    order = np.where(plain | constant, 0, order)

    name, used = _frame_number(number)
    head = np.concatenate([np.tile([0xFF, 0xF8, 0x14, 0x02], (m, 1)), name], axis=1)
    crc = np.zeros(m, np.int64)
    for j in range(8):
        crc = np.where(j < 4 + used, _CRC8[crc ^ head[:, j]], crc)
    kind = np.where(constant, 0, np.where(plain, 1, np.array([q[0] for q in kinds])[pick]))
    coded_ = ~(plain | constant)
    width = lambda on, n: np.where(on, n, 0)
    values, widths = [head[:, j] for j in range(8)], [width(j < 4 + used, 8) for j in range(8)]
    values += [crc, kind << 1]
    widths += [np.full(m, 8)] * 2
    for j in range(ORDER):  # warm-up samples; of a constant the one sample
        values.append(x[:, j].astype(np.int64) & 0xFF)
        widths.append(width((j < order) | (constant & (j == 0)), 8))
    values += [np.full(m, PRECISION - 1), shift]
    widths += [width(lpc, 4), width(lpc, 5)]
    for j in range(ORDER):
        values.append(coef[:, j].astype(np.int64) & ((1 << PRECISION) - 1))
        widths.append(width(lpc, PRECISION))
    values.append(np.full(m, PARTITIONS))
    widths.append(width(coded_, 6))
    first = len(values)
    size = BLOCK >> PARTITIONS
    table, length = np.zeros((m, first + BLOCK + (1 << PARTITIONS) + 2), np.int64), np.zeros((m, first + BLOCK + (1 << PARTITIONS) + 2), np.int64)
    table[:, :first], length[:, :first] = np.stack(values, axis=1), np.stack(widths, axis=1)
    for p in range(1 << PARTITIONS):
        at = first + p * (size + 1)
        kp = k[:, p : p + 1].astype(np.int64)
        table[:, at], length[:, at] = kp[:, 0], width(coded_, 4)
        part = u[:, p * size : (p + 1) * size].astype(np.int64)
        raw = x[:, p * size : (p + 1) * size].astype(np.int64) & 0xFF
        table[:, at + 1 : at + 1 + size] = np.where(coded_[:, None], (1 << kp) | (part & ((1 << kp) - 1)), raw)
        within = (np.arange(p * size, (p + 1) * size) >= order[:, None]) & coded_[:, None]
        length[:, at + 1 : at + 1 + size] = np.where(within, (part >> kp) + 1 + kp, np.where(plain[:, None], 8, 0))
    total = length.sum(axis=1)
    length[:, -2] = -total % 8
    length[:, -1] = 16
    table[length == 0] = 0
    out = _pack(table.ravel(), length.ravel())
    n = (total + 7) // 8 + 2
    ends = np.cumsum(n)
    check = _crc16(out, ends - n, ends - 2)
    out[ends - 2], out[ends - 1] = check >> 8, check & 0xFF
    return out, n


def pad(data: bytes) -> bytes:
    """``data`` with bytes 32 up to a positive multiple of 192."""
    return data + b" " * (BLOCK - len(data) if len(data) < BLOCK else -len(data) % BLOCK)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload; lengths must be positive multiples of 192."""
    frames = np.array([len(p) // BLOCK for p in payloads], np.int64)
    data = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    first = np.concatenate(([0], np.cumsum(frames)))
    number = np.arange(first[-1]) - np.repeat(first[:-1], frames)
    made = [_encode_frames(data[i : i + SLICE].astype(np.int32), number[i : i + SLICE]) for i in range(0, len(data), SLICE)]
    body, n = np.concatenate([a for a, _ in made]).tobytes(), np.concatenate([b for _, b in made])
    at = np.concatenate(([0], np.cumsum(n)))
    out = []
    for p, f, low in zip(payloads, frames.tolist(), first[:-1].tolist(), strict=True):
        own = n[low : low + f]
        points = np.arange(0, f, SEEK_FRAMES)
        seek = np.zeros(len(points), [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        seek["sample"], seek["offset"], seek["count"] = points * BLOCK, at[low + points] - at[low], BLOCK
        md5 = hashlib.md5(data[low : low + f].tobytes(), usedforsecurity=False).digest()
        info = BLOCK.to_bytes(2) * 2 + int(own.min()).to_bytes(3) + int(own.max()).to_bytes(3) + (RATE << 44 | 7 << 36 | len(p)).to_bytes(8) + md5
        out.append(b"fLaC" + (34).to_bytes(4) + info + (0x83000000 | 18 * len(points)).to_bytes(4) + seek.tobytes() + body[at[low] : at[low + f]])
    return out


class _Bits:
    """Bit readers at many places of one buffer, moved together."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(padded) - 8,), ">u8", padded.tobytes(), strides=(1,))

    def peek(self, at: np.ndarray) -> np.ndarray:
        """64 bits of which 57 at least are good."""
        return self.words[np.minimum(at >> 3, len(self.words) - 1)].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.peek(at) >> np.uint64(64 - n)).astype(np.int64)


def _signed(v: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return v - ((v >> (n - 1)) << n)


_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _decode_frames(bits: _Bits, data: np.ndarray, start: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(192 x frames samples, where each frame ends) of the frames at the byte offsets ``start``."""
    m = len(start)
    name, used = _frame_number(number)
    head = np.concatenate([np.tile([0xFF, 0xF8, 0x14, 0x02], (m, 1)), name], axis=1)
    crc = np.zeros(m, np.int64)
    for j in range(8):
        on = j < 4 + used
        if (data[np.minimum(start + j, len(data) - 1)][on] != head[on, j]).any():
            raise ValueError("FLAC: not the frame header that was due")
        crc = np.where(on, _CRC8[crc ^ head[:, j]], crc)
    at = (start + 4 + used) * 8
    if (bits.take(at, 8) != crc).any():
        raise ValueError("FLAC: CRC-8 of a frame header is wrong")
    kind = bits.take(at + 8, 8) >> 1
    at = at + 16
    constant, plain = kind == 0, kind == 1
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | plain | fixed | lpc).all():
        raise ValueError("FLAC: unknown subframe")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    most = int(order.max(initial=0))
    coded = fixed | lpc
    x = np.zeros((BLOCK, m), np.int64)
    for j in range(max(most, 1)):
        on = (j < order) | (constant & (j == 0))
        x[j] = np.where(on, _signed(bits.take(at, 8), 8), 0)
        at = at + np.where(on, 8, 0)
    shift = np.zeros(m, np.int64)
    coef = np.zeros((most, m), np.int64)
    if lpc.any():
        precision = bits.take(at, 4) + 1
        shift = np.where(lpc, _signed(bits.take(at + 4, 5), 5), 0)
        at = at + np.where(lpc, 9, 0)
        for j in range(most):
            on = lpc & (j < order)
            coef[j] = np.where(on, _signed((bits.peek(at) >> (64 - precision).astype(np.uint64)).astype(np.int64), precision), 0)
            at = at + np.where(on, precision, 0)
    for o in range(1, 5):
        for j, c in enumerate(_FIXED[o]):
            if j < most:
                coef[j] = np.where(fixed & (order == o), c, coef[j])
    method = bits.take(at, 6)
    if (method[coded] >> 4 != 0).any():
        raise ValueError("FLAC: Rice codes with 4-bit parameters are read only")
    size = BLOCK >> np.where(coded, method & 15, 0)
    at = at + np.where(coded, 6, 0)
    k = np.zeros(m, np.int64)
    one = np.uint64(1)
    for t in range(BLOCK):
        w = bits.peek(at)
        begins = coded & ((t == order) | ((t > order) & (t % size == 0)))
        if begins.any():
            k = np.where(begins, (w >> np.uint64(60)).astype(np.int64), k)
            at = at + np.where(begins, 4, 0)
            w = bits.peek(at)
        reads = coded & (t >= order)
        zeros = np.zeros(m, np.int64)
        lead = 1086 - ((w & np.uint64(0xFFFFFFFFFFFFF800)).astype(np.float64).view(np.int64) >> 52)
        long = reads & (lead > 40)
        while long.any():
            zeros = zeros + np.where(long, 40, 0)
            w = np.where(long, bits.peek(at + zeros), w)
            lead = 1086 - ((w & np.uint64(0xFFFFFFFFFFFFF800)).astype(np.float64).view(np.int64) >> 52)
            long = reads & (lead > 40)
            if (zeros > 8 * len(data)).any():
                raise ValueError("FLAC: a residual without end")
        step = lead.clip(0, 62)
        low = ((w << (step + 1).astype(np.uint64)) >> one >> (63 - k).astype(np.uint64)).astype(np.int64)
        u = ((zeros + step) << k) | low
        residual = (u >> 1) ^ -(u & 1)
        guess = np.zeros(m, np.int64)
        for j in range(min(most, t)):
            guess += coef[j] * x[t - 1 - j]
        value = residual + (guess >> shift)
        x[t] = np.where(reads, value, np.where(plain, _signed((w >> np.uint64(56)).astype(np.int64), 8), np.where(constant & (t > 0), x[0], x[t])))
        at = at + np.where(reads, zeros + step + 1 + k, np.where(plain, 8, 0))
    end = (at + 7) // 8
    if (bits.take(end * 8, 16) != _crc16(data, start, end)).any():
        raise ValueError("FLAC: CRC-16 of a frame is wrong")
    return x, end + 2


def decode_many(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream; a damaged one raises ValueError."""
    body, units, shape = [], [], []
    base = 0
    for s, raw in enumerate(streams):
        if raw[:4] != b"fLaC":
            raise ValueError("FLAC: no stream marker")
        at, seek, info = 4, b"", b""
        while True:
            head = int.from_bytes(raw[at : at + 4])
            kind, n = head >> 24 & 0x7F, head & 0xFFFFFF
            part = raw[at + 4 : at + 4 + n]
            info, seek = (part if kind == 0 else info), (part if kind == 3 else seek)
            at += 4 + n
            if head >> 31 or at >= len(raw):
                break
        samples = int.from_bytes(info[10:18]) & ((1 << 36) - 1)
        if info[:4] != BLOCK.to_bytes(2) * 2 or (int.from_bytes(info[10:18]) >> 36) & 0xFF != 7 or samples % BLOCK:
            raise ValueError("FLAC: 8-bit mono streams of 192-sample frames are read only")
        points = np.frombuffer(seek, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]) if seek else np.zeros(1, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        first = (points["sample"] // BLOCK).astype(np.int64)
        units.append(np.stack([np.full(len(points), s), first, np.diff(first, append=samples // BLOCK), base + points["offset"].astype(np.int64)]))
        shape.append((samples, info[18:34]))
        body.append(raw[at:])
        base += len(raw) - at
    if not streams:
        return []
    data = np.frombuffer(b"".join(body), np.uint8)
    bits = _Bits(data)
    unit = np.concatenate(units, axis=1)
    low = np.concatenate(([0], np.cumsum([n for n, _ in shape])))
    out = np.empty(int(low[-1]), np.uint8)
    for i in range(0, unit.shape[1], SLICE):
        s, first, frames, at = unit[:, i : i + SLICE]
        for f in range(int(frames.max())):
            on = np.flatnonzero(frames > f)
            x, end = _decode_frames(bits, data, at[on], first[on] + f)
            at[on] = end
            spot = low[s[on]] + (first[on] + f) * BLOCK
            out[spot[:, None] + np.arange(BLOCK)] = x.T.astype(np.int8).view(np.uint8)
    made = []
    for (n, md5), a in zip(shape, low[:-1].tolist(), strict=True):
        pcm = out[a : a + n]
        if any(md5) and hashlib.md5(pcm.tobytes(), usedforsecurity=False).digest() != md5:
            raise ValueError("FLAC: the samples' MD5 is wrong")
        made.append((pcm ^ 0x80).tobytes())
    return made


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as a FLAC stream.

    A null text counts as empty and becomes one frame of padding; equal texts give equal
    streams; repeated rows stay repeated.
    """
    rows = narrow(df, doc_id=doc_id, text=text)
    fields = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def batch(b: pa.RecordBatch):  # noqa: ANN202
        data, offsets = texts(b.column(1))
        for i, j in chunks(offsets):
            raw = [data[a:z].tobytes() for a, z in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(r) for r in raw], pa.int64()), pa.array(encode_many([pad(r) for r in raw]), pa.binary())], names=fields.names)

    return map_arrow(rows, fields, batch)


def decode(df: DataFrame, doc_id: str = "doc_id", media: str = "media", samples: int = 64 * BLOCK) -> DataFrame:
    """(doc_id, sample_offset, n_samples, pcm): the unsigned 8-bit samples of each stream in blocks of ``samples``.

    A null stream has no blocks; a damaged one stops the job.
    """
    rows = narrow(df, doc_id=doc_id, media=media).filter("media is not null")
    fields = T.StructType([rows.schema["doc_id"], T.StructField("sample_offset", T.LongType()), T.StructField("n_samples", T.IntegerType()), T.StructField("pcm", T.BinaryType())])

    def batch(b: pa.RecordBatch):  # noqa: ANN202
        data, offsets = texts(b.column(1))
        for i, j in chunks(offsets):
            raw = [data[a:z].tobytes() for a, z in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
            made = [(row, a, pcm[a : a + samples]) for row, pcm in enumerate(decode_many(raw), start=i) for a in range(0, len(pcm), samples)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([m[0] for m in made], pa.int64())), pa.array([m[1] for m in made], pa.int64()), pa.array([len(m[2]) for m in made], pa.int32()), pa.array([m[2] for m in made], pa.binary())], names=fields.names)

    return map_arrow(rows, fields, batch)


def _feature(pcm: bytes) -> str:
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    turns = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum()) if len(x) else 0
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};turns={turns}"


def digest(media: DataFrame, doc_id: str = "doc_id", n_bytes: str = "n_bytes", column: str = "media") -> DataFrame:
    """What each stored stream holds, read back: sizes, digests and features of its samples."""
    rows = narrow(media, doc_id=doc_id, n_bytes=n_bytes, media=column)
    fields = T.StructType(
        [rows.schema["doc_id"]]
        + [T.StructField(n, T.LongType() if n in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes") else T.StringType()) for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")]
    )

    def batch(b: pa.RecordBatch):  # noqa: ANN202
        data, offsets = texts(b.column(2))
        for i, j in chunks(offsets):
            raw = [data[a:z].tobytes() for a, z in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
            pcm = decode_many(raw)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = [[len(p) for p in pcm], [sha(p) for p in pcm], [zlib.crc32(p[-16:]) for p in pcm], [len(r) for r in raw], [sha(r) for r in raw], [_feature(p) for p in pcm]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i)] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=fields.names)

    return map_arrow(rows, fields, batch)
