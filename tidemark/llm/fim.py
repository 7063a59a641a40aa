"""Fill-in-middle: each document is cut at two code points and its parts put in another order.

Cuts are given in code points, texts are UTF-8 bytes, so a cut's byte has to be found. Texts are
divided into content-defined chunks: a rolling (gear) hash of the last 32 bytes says where one ends,
so a passage that many texts share falls into the same chunks wherever it stands.  What is needed of
a chunk, its boundary summary, is how many code points it holds and whether a marker lies inside.
Each worker keeps the summaries of the chunks it has met; an entry counts only if its content is
equal byte for byte.  Running sums of the summaries give a text's length and the chunk that holds a cut;
only that chunk is looked into.

No row is shuffled or collected; the memo holds a fixed number of bytes in two generations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .batches import chunks, map_arrow, mix, narrow, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_CONTINUATION = bytes(range(0x80, 0xC0))
#: Bytes that the rolling hash covers.
WINDOW = 32


def chunk_ends(data: np.ndarray, offsets: np.ndarray, mean: int = 512, most: int = 8192) -> np.ndarray:
    """Ends of the chunks of all texts, ascending; no chunk crosses a text or cuts a code point.

    An end lies where the hash of the last ``WINDOW`` bytes is below 2**32 / ``mean``; a stretch of more than
    ``most`` bytes without one is cut every ``most`` bytes.
    """
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):  # each step doubles the bytes that a value covers
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    ends = np.flatnonzero(h < (1 << 32) // mean) + 1
    # A window that reaches over the start of a text says nothing about it.
    text = np.searchsorted(offsets, ends - 1, side="right") - 1
    ends = ends[ends - offsets[text] >= WINDOW]
    ends = np.union1d(ends, offsets[1:][np.diff(offsets) > 0])
    sizes = np.diff(ends, prepend=0)
    if (sizes > most).any():
        long = np.flatnonzero(sizes > most)
        more = [np.arange(ends[i] - sizes[i] + most, ends[i], most) for i in long]
        ends = np.union1d(ends, np.concatenate(more))
    inner = ends[ends < len(data)]
    for _ in range(3):  # back to the start of a code point
        inner = np.where((inner < len(data)) & ((data[inner] & 0xC0) == 0x80), inner - 1, inner)
    return np.union1d(inner[inner > 0], offsets[1:][np.diff(offsets) > 0])


class Memo:
    """Boundary summaries (code points, whether a marker lies inside) by the content of chunks.

    The least recently used go when more than ``most`` bytes are kept, a generation at a time.
    """

    def __init__(self, most: int = 32_000_000) -> None:
        self.most, self.held, self.hits, self.misses = most, 0, 0, 0
        self.new: dict[bytes, tuple[int, bool]] = {}
        self.old: dict[bytes, tuple[int, bool]] = {}

    def summary(self, chunk: bytes) -> tuple[int, bool]:
        found = self.new.get(chunk)  # by hash, then by content
        if found is not None:
            self.hits += 1
            return found
        found = self.old.get(chunk)
        if found is None:
            self.misses += 1
            found = len(chunk.translate(None, _CONTINUATION)), any(m in chunk for m in _MARKS)
        else:
            self.hits += 1
        if self.held > self.most:
            self.old, self.new, self.held = self.new, {}, 0
        self.new[chunk] = found
        self.held += len(chunk) + 100
        return found


_memo = Memo()


class Cutter:
    """The texts of a batch: their lengths in code points, whether they hold a marker, and where a cut lies."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, memo: Memo) -> None:
        self.raw, self.data, self.offsets = data.tobytes(), data, offsets
        self.ends = chunk_ends(data, offsets)
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        found = [memo.summary(self.raw[a:z]) for a, z in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        # Code points before each chunk, and in all.
        self.before = np.concatenate(([0], np.cumsum([n for n, _ in found], dtype=np.int64))) if found else np.zeros(1, np.int64)
        marked = np.concatenate(([0], np.cumsum(np.array([m for _, m in found], bool) | self._seams()))) if found else np.zeros(1, np.int64)
        self.first = np.searchsorted(self.ends, offsets, side="right")  # chunks before each text
        self.n = np.diff(self.before[self.first])
        self.marked = np.diff(marked[self.first]) > 0

    def _seams(self) -> np.ndarray:
        """Whether a marker lies over the end of each chunk, within its text."""
        at, size = self.ends, len(self.data)
        end = self.offsets[np.searchsorted(self.offsets, at - 1, side="right")]  # of the chunk's text
        byte = lambda k: np.where((at + k >= 0) & (at + k < end), self.data[np.clip(at + k, 0, size - 1)], 0)
        a, b, c, d = byte(-2), byte(-1), byte(0), byte(1)
        letter = lambda x: (x == 0x50) | (x == 0x53) | (x == 0x4D)
        return ((a == 0x3C) & letter(b) & (c == 0x3E)) | ((b == 0x3C) & letter(c) & (d == 0x3E))

    def byte(self, row: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The byte at which code point ``cut[i]`` of text ``row[i]`` begins (its end, if it has no more)."""
        out = self.offsets[row].copy()
        aim = self.before[self.first[row]] + cut
        chunk = np.searchsorted(self.before, aim, side="left") - 1
        for i in np.flatnonzero(cut > 0).tolist():
            a, z = int(self.starts[chunk[i]]), int(self.ends[chunk[i]])
            begins, k = np.flatnonzero((self.data[a:z] & 0xC0) != 0x80), int(aim[i] - self.before[chunk[i]])
            out[i] = a + int(begins[k]) if k < len(begins) else z
        return out


def rearrange(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, share: int = 90, spm: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    The first four groups of eight hex digits of sha256("<seed>:<doc_id>") are the numbers h1 to h4. The
    prefix ends after the lesser of h1 % (n+1) and h2 % (n+1) of the n code points, the middle after the
    greater.  "plain": an empty text, one that holds a marker, or h3 % 100 >= ``share``; else "spm" if h4 % 100 <
    ``spm``, else "psm".  A null text is empty, a null id an empty one; equal rows give equal rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}")
    rows = narrow(df, doc_id=doc_id, text=text).select("doc_id", F.col("text").cast("string").alias("text"), *[number(k) for k in range(4)])
    fields = T.StructType([rows.schema["doc_id"], *[T.StructField(c, t) for c, t in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))]])

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = texts(b.column(1))
        h = [b.column(2 + k).to_numpy() for k in range(4)]
        for i, j in chunks(offsets):
            made = _rearranged(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], [x[i:j] for x in h], share, spm)
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *made], names=fields.names)

    return map_arrow(rows, fields, batch)


def _rearranged(data: np.ndarray, offsets: np.ndarray, h: list[np.ndarray], share: int, spm: int) -> list[pa.Array]:
    made = Cutter(data, offsets, _memo)
    one, two = h[0] % (made.n + 1), h[1] % (made.n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    plain = (made.n == 0) | made.marked | (h[2] % 100 >= share)
    swapped = h[3] % 100 < spm
    row = np.flatnonzero(~plain)
    x, y = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
    x[row], y[row] = made.byte(row, low[row]), made.byte(row, high[row])
    raw, out = made.raw, []
    for k, (start, a, z, end) in enumerate(zip(offsets[:-1].tolist(), x.tolist(), y.tolist(), offsets[1:].tolist(), strict=True)):
        if plain[k]:
            out.append(raw[start:end])
            continue
        parts = _MARKS[0], raw[start:a], _MARKS[1], raw[z:end], _MARKS[2], raw[a:z]
        out.append(b"".join(parts[2:4] + parts[:2] + parts[4:] if swapped[k] else parts))
    form = np.where(plain, "plain", np.where(swapped, "spm", "psm"))
    return [pa.array(made.n), pa.array(form.tolist(), pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(out, pa.binary()).cast(pa.string(), safe=False)]


def restored(output: Column, form: Column) -> Column:
    """The text again, from a rearranged one and its form.

    Texts with a marker are left plain, so the first of each marker is the one that was put in.
    """
    width = len(PREFIX)
    rest = F.substring(output, F.lit(width + 1), F.length(output))
    at = F.locate(PREFIX, rest), F.locate(SUFFIX, rest)
    cut = F.when(form == "psm", at[1]).otherwise(at[0])
    one = F.substring(rest, F.lit(1), cut - 1)
    tail = F.substring(rest, cut + width, F.length(rest))
    mid = F.locate(MIDDLE, tail)
    two, middle = F.substring(tail, F.lit(1), mid - 1), F.substring(tail, mid + width, F.length(tail))
    whole = F.when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return F.when(form == "plain", output).otherwise(whole)


def digests(rows: DataFrame) -> DataFrame:
    """``rearrange``'s rows with output_sha256 and restored_sha256 in place of the text."""
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
