"""Benchmark decontamination: n-gram windows of benchmark items looked up in document texts.

The windows are hashed and broadcast in blocks of a fixed size (one block for any usual
benchmark; more are more passes over the texts, so nothing unbounded is ever broadcast).
Tasks hash all word windows of a batch of texts at once; what hits the table is compared
word for word.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import ALNUM, chunks, free_name, lower_ascii, map_arrow, narrow, runs, texts, with_columns, word_hashes, words
from .scratch import cut

#: Windows in one broadcast (some 60 MB at most with ten words each).
BLOCK = 400_000
_HITS = T.StructType([T.StructField("__n__", T.LongType()), T.StructField("__hits__", T.ArrayType(T.IntegerType())), T.StructField("__items__", T.ArrayType(T.StringType()))])


def item_windows(benchmark: DataFrame, width: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, width, hash, words): each run of ``width`` item words; a shorter item is one window, one without words none."""
    rows = narrow(benchmark, item=item_id, text=text).select(F.col("item").cast("string").alias("item"), "text")
    fields = T.StructType([T.StructField("item", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("words", T.BinaryType())])

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = texts(b.column(1))
        data = lower_ascii(data)
        starts, ends, first = words(data, offsets, ALNUM)
        hashes, raw = word_hashes(data, starts, ends), data.tobytes()
        out: list[tuple] = []
        for row, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            w = min(width, j - i)
            parts = [raw[a:z] for a, z in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)]
            for k, h in enumerate(runs(hashes[i:j], w).view(np.int64).tolist() if w else ()):
                out.append((b.column(0)[row].as_py(), w, h, b" ".join(parts[k : k + w])))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=fields.names)

    return map_arrow(rows, fields, batch)


class Table:
    """A block of windows, ready for look-ups by hash."""

    def __init__(self, rows: list):
        by: dict[int, dict[int, list[tuple[bytes, str]]]] = {}
        for r in rows:
            by.setdefault(r["width"], {}).setdefault(r["hash"] % (1 << 64), []).append((bytes(r["words"]), r["item"]))
        self.by = by
        self.sorted = {w: np.array(sorted(x), np.uint64) for w, x in by.items()}
        self.maybe = {}
        for w, h in self.sorted.items():
            self.maybe[w] = np.zeros(1 << 22, bool)
            self.maybe[w][(h & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, str]]]:
        """(words before each text, [(first word, width, text, item)]); ``data`` is in lower case."""
        starts, ends, first = words(data, offsets, ALNUM)
        hashes = word_hashes(data, starts, ends)
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        found = []
        for w, known in self.sorted.items():
            h = runs(hashes, w)
            at = np.flatnonzero(self.maybe[w][(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            if not len(at):
                continue
            spot = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            at = at[(known[spot] == h[at]) & (text_of[at] == text_of[at + w - 1])]
            for i in at.tolist():
                seen = b" ".join([data[a:z].tobytes() for a, z in zip(starts[i : i + w].tolist(), ends[i : i + w].tolist(), strict=True)])
                found += [(i, w, int(text_of[i]), item) for x, item in self.by[w][int(h[i])] if x == seen]
        return first, found


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _pass(get: Callable[[], Table]) -> Callable[[pa.Array], list[pa.Array]]:
    def column(values: pa.Array) -> list[pa.Array]:
        data, offsets = texts(values)
        counts, spans, names = np.zeros(len(offsets) - 1, np.int64), {}, {}
        for i, j in chunks(offsets):
            first, found = get().find(lower_ascii(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i])
            counts[i:j] = np.diff(first)
            for at, w, row, item in found:
                at -= int(first[row])
                spans.setdefault(i + row, []).append((at, at + w))
                names.setdefault(i + row, set()).add(item)
        flat = lambda k: [x for span in _merge(spans[k]) for x in span] if k in spans else []
        return [pa.array(counts), pa.array([flat(k) for k in range(len(counts))], pa.list_(pa.int32())), pa.array([sorted(names.get(k, ())) for k in range(len(counts))], pa.list_(pa.string()))]

    return column


def with_hits(df: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """``df`` with ``__n__`` (words), ``__hits__`` (ends of spans of hit words, flat) and ``__items__`` (items found, sorted).

    The item ids are taken as strings; an item without an id counts as the item "".
    """
    spark = df.sparkSession
    windows = cut(item_windows(benchmark, width, item_id, item_text).withColumn("item", F.coalesce("item", F.lit(""))).distinct())  # counted, then read by block
    blocks = max(1, -(-windows.count() // block))
    out, before = df, []
    for k in range(blocks):
        part = windows if blocks == 1 else windows.filter(F.pmod(F.col("hash"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast(part.collect())
        out = with_columns(out, text, _HITS, _pass(_lazy(sent)))
        if k < blocks - 1:
            before.append((free_name(df, f"__hits{k}__"), free_name(df, f"__items{k}__")))
            out = out.withColumnsRenamed({"__hits__": before[-1][0], "__items__": before[-1][1]})
    if before:
        # Spans of several passes: joined, then merged by the positions they cover.
        spans = F.concat("__hits__", *[h for h, _ in before])
        out = out.withColumn("__items__", F.array_sort(F.array_distinct(F.concat("__items__", *[i for _, i in before]))))
        pairs = F.array_sort(F.transform(F.sequence(F.lit(0), (F.size(spans) / 2).cast("int") - 1), lambda i: F.struct(F.get(spans, 2 * i).alias("a"), F.get(spans, 2 * i + 1).alias("z"))))
        joined = F.aggregate(
            pairs,
            F.array().cast("array<int>"),
            lambda acc, p: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) >= p["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.get(acc, F.size(acc) - 1), p["z"])))).otherwise(F.concat(acc, F.array(p["a"], p["z"]))),
        )
        out = out.withColumn("__hits__", F.when(F.size(spans) > 0, joined).otherwise(spans)).drop(*[c for pair in before for c in pair])
    return out


def _lazy(sent) -> Callable[[], Table]:  # noqa: ANN001
    """The table of a broadcast, built once in each worker."""

    name = uuid.uuid4().hex

    def get() -> Table:
        if name not in _tables:
            _tables.clear()
            _tables[name] = Table(sent.value)
        return _tables[name]

    return get


_tables: dict[str, Table] = {}


def scan(df: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans) of every row.

    Words: runs of characters that are not ASCII punctuation, space or control, A-Z in lower
    case.  A word is hit if an occurrence of an item's window covers it.  Null and wordless
    texts have no words and no hits; repeated rows stay repeated; without items nothing is hit.
    ``hit_spans``: [first, end) word numbers, flat.
    """
    rows = with_hits(narrow(df, doc_id=doc_id, text=text), benchmark, width, **options).drop("text")
    covered = F.aggregate(F.transform("__hits__", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, b: a + b).cast("long")
    return rows.select(
        "doc_id",
        F.col("__n__").alias("n_words"),
        covered.alias("n_hit"),
        F.size("__items__").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items__", ",").cast("binary"), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
        F.col("__hits__").alias("hit_spans"),
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", drop: bool = True, **options: object) -> DataFrame:
    """``df`` without contaminated documents, or (``drop=False``) with the hit spans cut out of their texts.

    Columns and their order stay as they are; null texts stay.
    """
    own = {c: free_name(df, c) for c in df.columns if c.lower() in _HITS.names}  # columns that bear our names
    back = {new: old for old, new in own.items()}
    df = df.withColumnsRenamed(own)
    columns = df.columns
    rows = with_hits(df, benchmark, width, text, **options)
    clean = F.size("__hits__") == 0
    if drop:
        return rows.filter(clean).select(*[F.col(f"`{c}`") for c in columns]).withColumnsRenamed(back)

    def cut(values: pa.Array, hits: list) -> list:
        out = []
        for value, spans in zip(values.to_pylist(), hits, strict=True):
            if not spans:
                out.append(value)
                continue
            raw = value.encode()
            data = np.frombuffer(raw, np.uint8)
            starts, ends, _ = words(lower_ascii(data), np.array([0, len(raw)]), ALNUM)
            kept, at = [], 0
            for a, z in zip(spans[::2], spans[1::2], strict=True):
                kept.append(raw[at : starts[a]])
                at = ends[z - 1]
            out.append((b"".join(kept) + raw[at:]).decode())
        return out

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        names = b.schema.names
        made = cut(b.column(names.index(text)), b.column(names.index("__hits__")).to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if c == text else b.column(names.index(c)) for c in columns], names=columns)

    return map_arrow(rows, df.schema, batch).withColumnsRenamed(back)
