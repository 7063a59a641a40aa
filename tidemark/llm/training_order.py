"""Token-id output in training order.

The token streams of all documents, each closed by an end mark, are laid end to end in a
fixed order (file and row of the source, so that it doesn't hang on how a scan packs its
splits) and cut into sequences of a fixed length.  A keyed Feistel permutation with
cycle-walking gives every sequence its global slot: a shuffle of the whole corpus that
any task can compute for itself.  Pieces of sequences are dealt out by shard, compressed
with those of the same batch that go to the same shard, and each task writes some shards of a
fixed stride: slot s is at token ``(s % per_shard) * length`` of shard ``s // per_shard``.
A token takes one, two or four bytes (little-endian), the least that hold the vocabulary and
two more ids.  A reader resumes at any slot by a seek, and a rerun writes the same bytes under
the same names.

Only token counts of runs of rows (one a scan task and file) go to the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .batches import mix, ragged, texts
from .scratch import new_folder

#: Tokens a task cuts at a time.
SLICE = 2_000_000


def token_width(vocabulary: int | None) -> int:
    """Bytes a token: 1 for the bytes of UTF-8 texts (no vocabulary), else 2 or, beyond 65,534 ids, 4."""
    return 1 if vocabulary is None else 2 if vocabulary <= (1 << 16) - 2 else 4


def marks(width: int) -> tuple[int, int]:
    """The two highest ids, which no vocabulary (and no UTF-8 byte) uses: the end of a document, and filling after the last one."""
    return (1 << 8 * width) - 1, (1 << 8 * width) - 2


def _tokens(column: pa.Array, vocabulary: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(tokens as stored, where each document starts in them and the end); a null is an empty document."""
    if vocabulary is None:
        return texts(column)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten()
    if values.null_count:
        raise ValueError("a list of ids holds a null")
    ids = values.to_numpy(zero_copy_only=False)
    if len(ids) and not 0 <= ids.min() <= ids.max() < vocabulary:
        raise ValueError(f"ids are from 0 to {vocabulary - 1}")
    return ids.astype(f"<u{token_width(vocabulary)}"), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Where a keyed permutation of range(n) sends each index.

    A balanced Feistel network over the least even number of bits that holds n; values outside
    range(n) are sent on (cycle-walking), four times on average at most.
    """
    if n <= 1:
        return np.zeros(len(index), np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(rounds)]
    out = np.asarray(index).astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> np.uint64(half), out[walk] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[walk] = left << np.uint64(half) | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def _breaks(files: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Places of a batch where a row doesn't follow the one before it in the same file (the first is one)."""
    new = np.ones(len(rows), bool)
    code = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    new[1:] = (np.diff(rows) != 1) | (np.diff(code) != 0)
    return np.flatnonzero(new)


def _runs(counted: DataFrame) -> list[tuple[str, int, int]]:
    """(file, first row, tokens) of each run of rows that a task reads one after the other."""
    fields = T.StructType([T.StructField("file", T.StringType()), T.StructField("first", T.LongType()), T.StructField("n", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            rows, n = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            at = _breaks(b.column(0), rows)
            sums = np.add.reduceat(n, at).tolist()
            for k, i in enumerate(at.tolist()):
                name = b.column(0)[i].as_py()
                if i == 0 and last == (name, int(rows[0]) - 1):
                    out[-1][2] += sums[0]
                else:
                    out.append([name, int(rows[i]), sums[k]])
            last = (b.column(0)[b.num_rows - 1].as_py(), int(rows[-1]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=fields.names)

    return sorted((r["file"], r["first"], r["n"]) for r in counted.mapInArrow(each, fields).collect())


def _pieces(rows: DataFrame, starts: dict[tuple[str, int], int], n: int, length: int, per_shard: int, key: int, vocabulary: int | None) -> DataFrame:
    """(shard, slots, ats, sizes, doc_ids, tokens): what the documents of a batch give to the sequences of a shard."""
    width = token_width(vocabulary)
    end = marks(width)[0]
    sent = rows.sparkSession.sparkContext.broadcast(starts)
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    fields = T.StructType([T.StructField("shard", T.LongType()), T.StructField("slots", longs), T.StructField("ats", ints), T.StructField("sizes", ints), T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)), T.StructField("tokens", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            numbers = b.column(1).to_numpy(zero_copy_only=False)
            tokens, offsets = _tokens(b.column(3), vocabulary)
            sizes = np.diff(offsets) + 1  # with the end mark
            at = _breaks(b.column(0), numbers)
            first = np.zeros(b.num_rows, np.int64)  # where each document starts in the whole stream
            for i, j in zip(at.tolist(), [*at[1:].tolist(), b.num_rows], strict=True):
                name = b.column(0)[i].as_py()
                if i or last != (name, int(numbers[0]) - 1):
                    if (name, int(numbers[i])) not in sent.value:
                        raise RuntimeError("the input changed between two reads")
                    place = sent.value[name, int(numbers[i])]
                first[i:j] = place + np.cumsum(sizes[i:j]) - sizes[i:j]
                place = int(first[j - 1] + sizes[j - 1])
            last = (b.column(0)[b.num_rows - 1].as_py(), int(numbers[-1]))
            i = 0
            before = np.concatenate(([0], np.cumsum(sizes)))
            while i < b.num_rows:  # some documents at a time, one at least
                j = max(i + 1, int(np.searchsorted(before, before[i] + SLICE, side="right")) - 1)
                yield make(tokens[offsets[i] : offsets[j]], sizes[i:j], first[i:j], b.column(2).slice(i, j - i))
                i = j

    def make(tokens: np.ndarray, sizes: np.ndarray, first: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        ends = np.cumsum(sizes)
        stream = np.full(int(ends[-1]), end, f"<u{width}")
        inner = np.ones(len(stream), bool)
        inner[ends - 1] = False
        stream[inner] = tokens
        # A document has a piece in each sequence it touches.
        sequence = first // length
        many = (first + sizes - 1) // length - sequence + 1
        doc = np.repeat(np.arange(len(sizes)), many)
        sequence = ragged(sequence, many)
        low = np.maximum(sequence * length, first[doc])
        size = np.minimum((sequence + 1) * length, first[doc] + sizes[doc]) - low
        slot = permute(sequence, n, key)
        order = np.argsort(slot, kind="stable")
        doc, low, size, slot = doc[order], low[order], size[order], slot[order]
        begin = low - first[doc] + (ends - sizes)[doc]
        shard = slot // per_shard
        new = np.flatnonzero(np.diff(shard, prepend=-1))
        cuts = np.append(new, len(shard)).astype(np.int32)
        packer = zstandard.ZstdCompressor(level=3)
        # A shard's tokens at a time: the places of all would take many times the tokens' own memory.
        packed = [packer.compress(stream[ragged(begin[a:z], size[a:z])].tobytes()) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(shard[new])]
            + [pa.ListArray.from_arrays(cuts, x) for x in (pa.array(slot), pa.array((low % length).astype(np.int32)), pa.array(size.astype(np.int32)), ids.take(pa.array(doc)))]
            + [pa.array(packed, pa.binary())],
            names=fields.names,
        )

    return rows.mapInArrow(each, fields)


def materialise(df: DataFrame, folder: str | None = None, length: int = 1024, per_shard: int = 4096, key: int = 20240101, doc_id: str = "doc_id", text: str = "text", ids: str | None = None, vocabulary: int | None = None, order: tuple[str, str] | None = None, per_task: int = 16) -> DataFrame:
    """Writes the shards into ``folder`` (a new one in the shared folder) and returns their index.

    The tokens are those of ``ids``, a column of lists of ints from 0 to ``vocabulary`` - 1, stored in
    two bytes each (65535 ends a document, 65534 fills up the last sequence) or, if the
    vocabulary has more than 65,534 ids, in four (2**32 - 1 and 2**32 - 2); an id outside the
    vocabulary stops the job.  Without ``ids`` they are the UTF-8 bytes of ``text``, a byte each
    (255 and 254).  Returned: (slot, shard, byte_offset, n_tokens, doc_ids, tokens_sha256), a row a
    sequence, as written and read back.  Null texts and lists are empty documents (an end mark alone);
    null ids are left out of ``doc_ids``; repeated rows are documents of their own.  Empty table:
    no shard, no row.

    ``order``: two columns, a file (or any name) and a long that counts its rows: documents are
    laid out by them, and the shards are the same however the table is split.  Each pair
    occurs once, without nulls.  Without it, the order is that of the table's partitions.  ``df`` must
    give the same rows in the same partitions each time it is read, as a stored table
    does; if it does not, the job stops.  A task writes ``per_task`` shards and holds one.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark, "shards")
    if (ids is None) != (vocabulary is None):
        raise ValueError("ids and vocabulary are given together")
    if vocabulary is not None and not 0 < vocabulary <= (1 << 32) - 2:
        raise ValueError("a vocabulary has 1 to 2**32 - 2 ids")
    width = token_width(vocabulary)
    filler = marks(width)[1]
    tokens = F.col(f"`{text}`").cast("binary") if ids is None else F.col(f"`{ids}`")
    size = F.octet_length("tokens") if ids is None else F.when(F.col("tokens").isNotNull(), F.size("tokens"))
    if order is None:
        at = [F.lpad(F.spark_partition_id().cast("string"), 10, "0"), F.monotonically_increasing_id()]
    else:
        at = [F.col(f"`{order[0]}`").cast("string"), F.col(f"`{order[1]}`").cast("long")]
    rows = df.select(at[0].alias("file"), at[1].alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), tokens.alias("tokens"))
    starts, total = {}, 0
    for name, first, many in _runs(rows.select("file", "row", (F.coalesce(size, F.lit(0)).cast("long") + 1).alias("n"))):
        if (name, first) in starts:
            raise ValueError("two rows have the same place in the order")
        starts[name, first] = total
        total += many
    n = -(-total // length)
    fields = T.StructType([T.StructField("slot", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("byte_offset", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(df.schema[doc_id].dataType)), T.StructField("tokens_sha256", T.StringType())])
    if not n:
        return spark.createDataFrame([], fields)
    pieces = _pieces(rows, starts, n, length, per_shard, key, vocabulary)
    shards = -(-n // per_shard)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, buffer, slots, ats, sizes, owners = None, None, [], [], [], []
        opener = zstandard.ZstdDecompressor()
        for b in batches:
            for i, s in enumerate(b.column(0).to_pylist()):
                if s != shard:
                    if shard is not None:
                        yield finish(shard, buffer, slots, ats, sizes, owners)
                    shard, slots, ats, sizes, owners = s, [], [], [], []
                    buffer = np.full(min(per_shard, n - s * per_shard) * length, filler, f"<u{width}")
                slot, at, size_ = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (1, 2, 3))
                buffer[ragged((slot % per_shard) * length + at, size_.astype(np.int64))] = np.frombuffer(opener.decompress(b.column(5)[i].as_py()), buffer.dtype)
                slots.append(slot)
                ats.append(at)
                sizes.append(size_)
                owners.append(b.column(4)[i].values)
        if shard is not None:
            yield finish(shard, buffer, slots, ats, sizes, owners)

    def finish(shard: int, buffer: np.ndarray, slots: list, ats: list, sizes: list, owners: list) -> pa.RecordBatch:
        count = len(buffer) // length
        spot, at, ids_ = np.concatenate(slots) % per_shard, np.concatenate(ats), pa.concat_arrays(owners)
        filled = np.bincount(spot, np.concatenate(sizes), count).astype(np.int64)
        short = int((filled != length).sum())
        if short > 1 or int(filled.sum()) not in (len(buffer), total - (n - count) * length):
            raise RuntimeError(f"shard {shard}: {short} sequences are not whole; the input changed between two reads")
        where, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(base, recursive=True)
        name = f"{base}/shard-{shard:08d}.bin"
        with where.open_output_stream(other := f"{base}/.{uuid.uuid4().hex}") as out:
            out.write(memoryview(buffer).cast("B"))
        where.move(other, name)  # whole or not at all: a second attempt replaces the first with the same bytes
        with where.open_input_stream(name) as back:
            stored = back.read()
        known = np.asarray(ids_.is_valid())
        spot, at, ids_ = spot[known], at[known], ids_.filter(pa.array(known))
        order_ = np.lexsort((at, spot))
        ends = np.concatenate(([0], np.cumsum(np.bincount(spot, minlength=count)))).astype(np.int32)
        stride = length * width
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(count) + shard * per_shard),
                pa.array(np.full(count, shard)),
                pa.array(np.arange(count) * stride),
                pa.array(filled.astype(np.int32)),
                pa.ListArray.from_arrays(ends, ids_.take(pa.array(order_)).cast(kind)),
                pa.array([hashlib.sha256(stored[k * stride : (k + 1) * stride]).hexdigest() for k in range(count)], pa.string()),
            ],
            names=fields.names,
        )

    kind = to_arrow_type(df.schema[doc_id].dataType)
    # Dealt by number: ranges would be drawn from a sample, for which the input is read once more.
    dealt = pieces.repartitionById(-(-shards // per_task), F.floor(F.col("shard") / per_task).cast("int")).sortWithinPartitions("shard")
    return dealt.mapInArrow(write, fields)


def read_slots(folder: str, first: int, count: int, length: int = 1024, per_shard: int = 4096, width: int = 1) -> Iterator[bytes]:
    """The sequences of slots ``first`` to ``first + count``, read by seeks in their shards; ``width``: bytes a token."""
    where, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    slot = first
    while slot < first + count:
        shard, k = divmod(slot, per_shard)
        many = min(per_shard - k, first + count - slot)
        with where.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek(k * length * width)
            data = f.read(many * length * width)
        yield from (data[i : i + length * width] for i in range(0, len(data), length * width))
        slot += many
