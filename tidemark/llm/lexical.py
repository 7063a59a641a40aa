"""Ranked lexical search: the documents of highest score for each item, by an automaton over the texts.

All terms of the items make one Aho-Corasick automaton, each with a separator on both sides as a guard, so
that a term is found only where a whole word stands. It is broadcast in blocks of a fixed size (one for any
usual item table; more are more passes) and run over the texts; what it puts out maps to terms, and
terms to items.  No index of the documents is made:

* a first scan counts documents, their terms, and for each item term the documents that hold it; a task
  gives one row a term;
* a second scan counts again, scores each document in its task, and keeps an item's best rows there.  Of these
  a window keeps the best, first within shares of the tasks, then over all.

Scores are 64-bit integers, so they don't depend on the order of sums.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .batches import byte_class, chunks, narrow, ragged, texts, words
from .scratch import cut

#: Term bytes (after lower-casing): ASCII letters and digits, and all of other characters.
_TERM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: A-Z in lower case, separators as spaces.
_FOLD = np.where(_TERM, np.arange(256), 0x20).astype(np.uint8)
_FOLD[0x41:0x5B] += 0x20
_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Item terms in one automaton, and cells (item, document) that are scored at a time.
BLOCK = 200_000
CELLS = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id in the scan: last among equal scores.
_NO_ID = (1 << 63) - 1
_MATCH = np.dtype([("end", np.int64), ("term", np.int64)])


class Matcher:
    """The automaton of the terms: (text, term, occurrences) of many texts at once."""

    def __init__(self, terms: list[str]) -> None:
        self.size = len(terms)
        self.automaton = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            # A character a byte: places are byte numbers, and any bytes can be searched.
            self.automaton.add_word(f" {term.encode().decode('latin-1')} ", k)
        if terms:
            self.automaton.make_automaton()

    def count(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text, with repeats; text, term and occurrences of each pair found)."""
        starts, _, first = words(data, offsets, _TERM)
        n = np.diff(first)
        if not self.size or not len(starts):
            none = np.zeros(0, np.int64)
            return n, none, none, none
        # A space before, between and after the texts.
        room = np.full(len(data) + len(offsets), 0x20, np.uint8)
        room[np.arange(len(data)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = _FOLD[data]
        found = np.fromiter(self.automaton.iter(room.tobytes().decode("latin-1")), _MATCH)
        text = np.searchsorted(offsets[1:] + np.arange(1, len(offsets)), found["end"] - 1, side="right")
        pair, tf = np.unique(text * self.size + found["term"], return_counts=True)
        return n, pair // self.size, pair % self.size, tf.astype(np.int64)


class Best:
    """The ``top`` rows (score, then lesser id) of each item among those added."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.items = top, items
        self.floor = np.ones(items, np.int64)  # what a row must reach
        self.rows = [np.zeros(0, np.int64) for _ in range(3)]  # item, score, id

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.floor[:, None])
        if not len(item):
            return
        item, score, key = (np.concatenate(x) for x in zip(self.rows, (item, scores[item, doc], ids[doc]), strict=True))
        order = np.lexsort((key, -score, item))
        item, score, key = item[order], score[order], key[order]
        place = np.arange(len(item)) - np.searchsorted(item, item, side="left")
        full = item[place == self.top - 1]
        self.floor[full] = score[place == self.top - 1]
        kept = place < self.top
        self.rows = [item[kept], score[kept], key[kept]]


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term), each once: the maximal runs of term characters, A-Z in lower case.  Rows of one id are one item."""
    rows = narrow(items, item_id=item_id, text=text)
    found = F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(_PATTERN), 0)
    return rows.select("item_id", F.explode(found).alias("term")).distinct()


def _scan(rows: DataFrame, fields: T.StructType, make: Callable[[], "_Counter"]) -> DataFrame:
    """One table of a task's texts (doc, text): what its counter gives at the end."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make()
        for b in batches:
            ids = b.column(0).to_numpy()
            data, offsets = texts(b.column(1))
            for i, j in chunks(offsets):
                counter.add(ids[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield pa.RecordBatch.from_arrays(counter.result(), names=fields.names)

    return rows.mapInArrow(each, fields)


class _Counter:
    """Counts of a task: for each term the texts with it; after the terms, the texts with a term, and all terms."""

    def __init__(self, matcher: Matcher) -> None:
        self.matcher, self.counts = matcher, np.zeros(matcher.size + 2, np.int64)

    def add(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        n, _, term, _ = self.matcher.count(data, offsets)
        self.counts[:-2] += np.bincount(term, minlength=self.matcher.size)
        self.counts[-2:] += np.count_nonzero(n), int(n.sum())

    def result(self) -> list[pa.Array]:
        known = np.flatnonzero(self.counts)
        return [pa.array(known), pa.array(self.counts[known])]


class _Scorer:
    """The best texts of each item in a task."""

    def __init__(self, matcher: Matcher, plan: "Plan", top: int) -> None:
        self.matcher, self.plan, self.best = matcher, plan, Best(plan.items, top)

    def add(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        p = self.plan
        n, text, term, tf = self.matcher.count(data, offsets)
        m = 50 + (50 * n * p.documents) // max(1, p.terms)
        points = p.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[text]))
        step = max(1, CELLS // max(1, p.items))
        for i in range(0, len(n), step):
            a, z = np.searchsorted(text, (i, i + step))
            size = min(step, len(n) - i)
            scores = np.zeros(p.items * size, np.int64)
            many = p.many[term[a:z]]
            item = p.item[ragged(p.first[term[a:z]], many)]
            np.add.at(scores, item * size + np.repeat(text[a:z] - i, many), np.repeat(points[a:z], many))
            self.best.add(scores.reshape(p.items, size), ids[i : i + size])

    def result(self) -> list[pa.Array]:
        return [pa.array(x) for x in self.best.rows]


class Plan:
    """Weights of the terms and the items that hold each."""

    def __init__(self, items: int, pairs: list[tuple[int, int]], weight: np.ndarray, documents: int, terms: int) -> None:
        rows = np.array(sorted(pairs), np.int64).reshape(-1, 2)  # term, item
        self.items, self.item, self.weight, self.documents, self.terms = items, rows[:, 1].copy(), weight, documents, terms
        self.many = np.bincount(rows[:, 0], minlength=len(weight))
        self.first = np.cumsum(self.many) - self.many


_made: dict[str, Matcher] = {}


def _matcher(name: str, terms: list[str]) -> Matcher:
    """The automaton of a broadcast, built once in each worker."""
    if name not in _made:
        _made.clear()
        _made[name] = Matcher(terms)
    return _made[name]


def _counted(name: str, sent: object) -> _Counter:
    return _Counter(_matcher(name, sent.value))


def _scored(name: str, sent: object, plan: object, top: int) -> _Scorer:
    return _Scorer(_matcher(name, sent.value), plan.value, top)


def search(docs: DataFrame, items: DataFrame, top: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0, the highest first, ties by lesser doc_id.

    A term's weight w is floor(1000 ln((2 N + 2) / (2 df + 1))); a document's m is 50 + 50 n N div L;
    its score sums w * (10**9 tf div (1000 tf + 20 m)) over the item's terms, once each.  N: documents with a
    term, L: all their terms, n: those of a document, df: documents with the term, tf: its occurrences.

    A null text has no terms; a document without an id is ranked last among equals.  Rows of a document id that is repeated
    are documents of their own, rows of an item id are one item; an item without terms or hits gets no row.  No documents or
    no items: no rows.
    """
    spark = docs.sparkSession
    rows = narrow(docs, doc_id=doc_id, text=text).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    asked = cut(item_terms(items, item_id, item_text))
    blocks = max(1, -(-asked.count() // block))
    kind = T.StructType([asked.schema["item_id"], *[T.StructField(c, t) for c, t in (("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType()))]])
    out = None
    for k in range(blocks):
        # Whole items in a block: an item's score is summed in one pass.
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        found = _block(spark, rows, part.collect(), asked.schema["item_id"], top)
        out = found if out is None else out.unionByName(found)
    return out.select(*[F.col(c).cast(kind[c].dataType).alias(c) for c in kind.names])


def _block(spark, rows: DataFrame, asked: list, id_field: T.StructField, top: int) -> DataFrame:  # noqa: ANN001
    ids = list(dict.fromkeys(r["item_id"] for r in asked))
    terms = sorted({r["term"] for r in asked})
    item_of, term_of, name = {x: i for i, x in enumerate(ids)}, {x: i for i, x in enumerate(terms)}, uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(terms)
    counts = T.StructType([T.StructField("term", T.LongType()), T.StructField("n", T.LongType())])
    totals = _scan(rows, counts, lambda: _counted(name, sent)).groupBy("term").agg(F.sum("n").alias("n"))
    known = {r["term"]: r["n"] for r in totals.collect()}  # a row a term of the block, and two
    n, every = known.get(len(terms), 0), known.get(len(terms) + 1, 0)
    df = np.array([known.get(i, 0) for i in range(len(terms))], np.float64)
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    plan = spark.sparkContext.broadcast(Plan(len(ids), [(term_of[r["term"]], item_of[r["item_id"]]) for r in asked], weight, n, every))
    best = T.StructType([T.StructField(c, T.LongType()) for c in ("item", "score", "doc")])
    found = _scan(rows, best, lambda: _scored(name, sent, plan, top))
    order = [F.desc("score"), F.asc("doc")]
    for keys in (["item", F.pmod(F.xxhash64("doc"), F.lit(64))], ["item"]):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", id_field.dataType)]))
    return found.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), "score")
