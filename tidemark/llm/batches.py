"""Arrow batches of texts as flat numpy arrays: bytes, words, word hashes.

All helpers work on the UTF-8 bytes of many texts at once, so that the cost of a
Python call is paid per batch and not per word.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Bytes of text that are worked on at a time inside a task; one longer text is taken alone.
CHUNK = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"")
    wide = np.int64 if kind == pa.large_binary() else np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, wide, count=n + 1, offset=column.offset * wide().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes (at least one row each)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Words are runs of bytes other than the ASCII white space 0x20 and 0x09-0x0D.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII letters, digits and all non-ASCII characters (after lower-casing).
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text and in all): runs of bytes of ``table``; none crosses texts."""
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] = inside[edge]
    edge = offsets[1:][np.diff(offsets) > 0] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """b**i and b**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up = np.empty(size, np.uint64)
        down = np.empty(size, np.uint64)
        for out, base in ((up, _BASE), (down, _INVERSE)):
            out[0], have, step = 1, 1, base
            while have < size:  # doubling: b**(have + i) = b**have * b**i
                more = min(have, size - have)
                out[have : have + more] = out[:more] * np.uint64(step)
                step, have = step * step % (1 << 64), have + more
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte run, the same wherever the run stands."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _power(high - low + 1)
        total = np.empty(high - low + 1, np.uint64)
        total[0] = 0
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive hashes (``len - width + 1`` of them, or none)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(_BASE)
        out += hashes[k : k + n]
    return mix(out)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i]`` to ``starts[i] + sizes[i]``, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def map_arrow(df: DataFrame, fields: T.StructType, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]) -> DataFrame:
    """``fn`` over the Arrow batches of ``df``; it gives one batch or several."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch)
            yield from [made] if isinstance(made, pa.RecordBatch) else made
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(each, fields)


def with_columns(df: DataFrame, text: str, fields: T.StructType, fn: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` and the columns ``fields`` that ``fn`` computes from its column ``text``.

    A column of ``df`` that bears the name of a new one (in any case) is replaced.
    """
    new = {x.lower() for x in fields.names}
    keep = [c for c in df.columns if c.lower() not in new]
    base = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free_name(df, "__text__")))
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=schema.names)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return base.mapInArrow(each, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has a column of that name in any case."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator reads, under its own names: others can't clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])
