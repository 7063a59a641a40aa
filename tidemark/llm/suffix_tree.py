"""Language-model scores from a probabilistic suffix tree.

The model reads the bytes of a text's words, lower-cased (A-Z), one space between words and
an end mark after the last.  Contexts grow one symbol a level: those that make up at least
``p_min`` of the training symbols are counted (level by level, over all training texts, so
there are at most 1 / ``p_min`` of them a level whatever the corpus size), and a context is
kept if its next-symbol distribution diverges from that of its suffix: share of the
context x Kullback-Leibler divergence >= ``divergence``.  Distributions are smoothed towards
the suffix's.  Kept contexts, and the prefixes that lead to them, become the states of an
automaton whose state is always the longest kept suffix of what was read; a text is
scored by one table look-up a symbol, many stretches of text side by side.

Beside it stands a word baseline (add-one unigrams).  Word counts grow with the corpus:
words that make up at least 1 / HEAD of the tokens (so HEAD of them at most) are
broadcast, the rest are joined by a shuffle in which, by that rule, no key is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import NOT_SPACE, chunks, lower_ascii, map_arrow, narrow, texts, word_hashes, words
from .scratch import stored

END = 10  # never inside a word
HEAD = 1 << 20
_END_WORD = np.uint64(0x0E4D0E4D0E4D0E4D)
_STRETCH = 512
#: Bytes of text worked on at a time: keys of several depths are held for each.
PIECE = 600_000


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, where each text starts in them and the end, (starts, ends, first) of its words); ``data`` in lower case."""
    starts, ends, first = words(data, offsets, NOT_SPACE)
    n = np.diff(first)
    length = ends - starts
    row = np.repeat(np.arange(len(n)), n)
    size = np.bincount(row, length + 1, len(n)).astype(np.int64) + (n == 0)
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(at[-1]), 32, np.uint8)
    empty_before = np.cumsum(n == 0)
    letters = np.repeat(np.arange(len(starts)) + empty_before[row], length) + np.arange(int(length.sum()))
    out[letters] = data[NOT_SPACE[data]]
    out[at[1:] - 1] = END
    return out, at, (starts, ends, first)


def _keys(symbols: np.ndarray, depth: int) -> np.ndarray:
    """For each place whose context has ``depth`` symbols: the context (latest symbol lowest) above the next symbol.

    Before the first symbol stands an end mark; a context never reaches beyond one.
    """
    x = np.concatenate(([END], symbols)).astype(np.uint64)
    n = len(symbols)
    place = np.arange(1, n + 1)
    if depth == 0:
        return x[1:]
    ends = np.where(x == END, np.arange(n + 1), 0)
    last = np.maximum.accumulate(ends)[:-1]  # the end mark before each place
    good = place[place - depth >= last]
    key = x[good].copy()
    for j in range(1, depth + 1):
        key |= x[good - j] << np.uint64(8 * j)
    return key


def _spot(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def count_contexts(rows: DataFrame, depths: list[int], allowed: np.ndarray | None = None) -> DataFrame:
    """(depth, key, n) over all ``rows`` (text); ``allowed``: only contexts among these."""
    fields = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
    sent = None
    if allowed is not None:
        filter_ = np.zeros(1 << 22, bool)
        filter_[_spot(allowed)] = True
        sent = rows.sparkSession.sparkContext.broadcast((np.packbits(filter_), np.sort(allowed)))

    def each(batches):  # noqa: ANN001, ANN202
        ok, exact = (np.unpackbits(sent.value[0]).astype(bool), sent.value[1]) if sent is not None else (None, None)
        kept: dict[int, list] = {d: [] for d in depths}

        def shrink(d: int) -> None:
            keys = np.concatenate([k for k, _ in kept[d]])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([c for _, c in kept[d]])[order]
            new = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
            kept[d] = [(keys[new], np.add.reduceat(n, new) if len(new) else n)]

        for b in batches:
            data, offsets = texts(b.column(0))
            for i, j in chunks(offsets, PIECE):
                symbols, _, _ = stream(lower_ascii(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i])
                for d in depths:
                    keys = _keys(symbols, d)
                    if ok is not None:
                        keys = keys[ok[_spot(keys >> np.uint64(8))]]
                    keys, n = np.unique(keys, return_counts=True)
                    if ok is not None:  # the bit table lets some others pass
                        context = keys >> np.uint64(8)
                        good = exact[np.minimum(np.searchsorted(exact, context), len(exact) - 1)] == context
                        keys, n = keys[good], n[good]
                    kept[d].append((keys, n))
                    if sum(len(k) for k, _ in kept[d]) > 1_000_000:
                        shrink(d)
        for d in depths:
            if kept[d]:
                shrink(d)
                keys, n = kept[d][0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), d, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=fields.names)

    return rows.select("text").mapInArrow(each, fields).groupBy("depth", "key").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """``symbol``: byte -> column; ``move`` and ``score``: states x columns (next state, log10 probability)."""

    symbol: np.ndarray
    move: np.ndarray
    score: np.ndarray
    root: int
    start: int
    depth: int
    contexts: list[bytes]

    def scores(self, symbols: np.ndarray) -> np.ndarray:
        """The log10 probability of each symbol of a stream that starts a text."""
        n = len(symbols)
        lanes = -(-n // _STRETCH)
        x = np.full(lanes * _STRETCH + self.depth, self.symbol[END], np.int64)
        x[self.depth : self.depth + n] = self.symbol[symbols]
        width = self.move.shape[1]
        move, score = self.move.ravel(), self.score.ravel()
        state = np.full(lanes, self.root, np.int64)
        base = np.arange(lanes) * _STRETCH
        out = np.empty((_STRETCH, lanes))
        for t in range(_STRETCH + self.depth):  # the first symbols only lead to the state
            at = state * width + x[base + t]
            if t >= self.depth:
                out[t - self.depth] = score[at]
            state = move[at].astype(np.int64)
        return out.T.ravel()[:n]


def grow(tables: dict[int, tuple[np.ndarray, np.ndarray]], p_min: float, divergence: float, strength: float) -> Tree:
    """A tree from {depth: (keys, counts)}."""
    total = int(tables[0][1].sum()) if 0 in tables else 0
    seen = np.union1d(tables[0][0].astype(np.int64) & 255, [END]) if 0 in tables else np.array([END])
    width = len(seen)  # the column after the last stands for all symbols never seen
    unseen = 256 - width
    symbol = np.full(256, width, np.int64)
    symbol[seen] = np.arange(width)
    counts: dict[bytes, np.ndarray] = {b"": np.zeros(width + 1, np.int32)}
    for depth in sorted(tables):
        keys, n = tables[depth]
        context, column = keys >> np.uint64(8), symbol[(keys & np.uint64(255)).astype(np.int64)]
        order = np.argsort(context, kind="stable")
        context, column, n = context[order], column[order], n[order]
        first = np.flatnonzero(np.diff(context, prepend=context[:1] + np.uint64(1))) if len(context) else np.zeros(0, np.int64)
        enough = np.add.reduceat(n, first) >= p_min * total if len(first) else []
        for i, a in enumerate(first):
            if depth == 0 or enough[i]:
                z = first[i + 1] if i + 1 < len(first) else len(context)
                row = np.zeros(width + 1)
                row[column[a:z]] = n[a:z]
                counts[int(context[a]).to_bytes(depth, "big")] = row  # oldest symbol first
    base = counts[b""] + 1.0
    base[-1] = unseen
    distribution = {b"": base / (total + 256)}
    for context in sorted(counts, key=lambda c: (len(c), c)):
        if not context:
            continue
        parent = context[1:]
        while parent not in distribution:
            parent = parent[1:]
        n, before = counts.pop(context), distribution[parent]
        p = (n + strength * before) / (n.sum() + strength)
        some = before > 0
        if n.sum() / total * float((p[some] * np.log(p[some] / before[some])).sum()) >= divergence:
            distribution[context] = p
    states = set(distribution) | {bytes([END])}
    states |= {c[:k] for c in states for k in range(1, len(c))}
    order = sorted(states, key=lambda c: (len(c), c))
    index = {c: i for i, c in enumerate(order)}
    move = np.zeros((len(order), width + 1), np.int32)
    score = np.zeros((len(order), width + 1), np.float32)
    for c in order:
        i = index[c]
        if c:
            link = c[1:]
            while link not in index:
                link = link[1:]
            score[i] = score[index[link]]
        if c in distribution:
            p = distribution[c]
            score[i, :-1] = np.log10(p[:-1])
            score[i, -1] = np.log10(p[-1] / unseen) if unseen else 0.0
    # A move leads to the context and its symbol if that is a state, else to where the suffix's move leads.
    children: dict[bytes, list[tuple[int, int]]] = {}
    for c in order:
        if c:
            children.setdefault(c[:-1], []).append((int(symbol[c[-1]]), index[c]))
    for c in order:
        i = index[c]
        if c:
            link = c[1:]
            while link not in index:
                link = link[1:]
            move[i] = move[index[link]]
        for column, target in children.get(c, ()):
            move[i, column] = target
    start = index[bytes([END])]
    move[:, symbol[END]] = start
    return Tree(symbol, move, score, index[b""], start, max(tables, default=0), order)


def fit(training: DataFrame, depth: int = 6, p_min: float = 1e-5, divergence: float = 2e-7, strength: float = 5.0) -> Tree:
    """A tree from all of ``training`` (text).  Null texts count as empty; no rows: a uniform tree.

    The tree has at most ``depth`` / ``p_min`` contexts; ``depth`` is 7 at most (a context and
    its next symbol make one 64-bit key).
    """
    if not 0 < depth <= 7:
        raise ValueError("depth is from 1 to 7")
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    got = count_contexts(training, [0, 1, 2]).toPandas()
    total = int(got.loc[got["depth"] == 0, "n"].sum())
    for d in range(3):
        part = got[got["depth"] == d]
        tables[d] = part["key"].to_numpy().astype(np.int64).view(np.uint64), part["n"].to_numpy().astype(np.int64)
    for d in range(3, depth + 1):
        keys, n = tables[d - 1]
        allowed = keys[n >= p_min * total]
        if not total or not len(allowed):
            break
        got = count_contexts(training, [d], allowed).toPandas()  # at most 256 rows for each of 1 / p_min contexts
        tables[d] = got["key"].to_numpy().astype(np.int64).view(np.uint64), got["n"].to_numpy().astype(np.int64)
    return grow(tables, p_min, divergence, strength)


def count_words(training: DataFrame) -> DataFrame:
    """(w, n): hashes and counts of all tokens of ``training`` (text), the end of each text among them."""
    fields = T.StructType([T.StructField("w", T.LongType()), T.StructField("n", T.LongType())])

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = texts(b.column(0))
        made = []
        for i, j in chunks(offsets, PIECE):
            x = lower_ascii(data[offsets[i] : offsets[j]])
            starts, ends, _ = words(x, offsets[i : j + 1] - offsets[i], NOT_SPACE)
            made.append(word_hashes(x, starts, ends))
        w, n = np.unique(np.concatenate([*made, np.full(b.num_rows, _END_WORD)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=fields.names)

    return map_arrow(training.select("text"), fields, batch).groupBy("w").agg(F.sum("n").alias("n"))


def held_out(doc_id: F.Column) -> F.Column:
    """The fold that is not learned from; a row without an id is neither held out nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Null and wordless texts are the end mark alone.  Repeated rows are scored (and, outside the
    fold, learned from) each.  Nothing to learn from: uniform scores.
    """
    spark = df.sparkSession
    rows = narrow(df, doc_id=doc_id, text=text)
    training = rows.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    tree = spark.sparkContext.broadcast(fit(training, **options))
    counts = stored(count_words(training), "words")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, kinds = int(sums["n"] or 0), int(sums["v"])
    bottom = total + kinds + 1
    head = counts.filter(F.col("n") >= max(1.0, total / HEAD)).orderBy("w").toPandas() if total else None
    w = head["w"].to_numpy().astype(np.int64).view(np.uint64) if head is not None else np.zeros(0, np.uint64)
    order = np.argsort(w)
    n = head["n"].to_numpy().astype(np.int64)[order] if head is not None else np.zeros(0, np.int64)
    known = spark.sparkContext.broadcast((w[order], np.log10((n + 1) / bottom)))
    del head

    fields = T.StructType(
        [rows.schema["doc_id"]]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("head_known", T.LongType()), T.StructField("head_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
        + [T.StructField("tail_w", T.ArrayType(T.LongType())), T.StructField("tail_n", T.ArrayType(T.IntegerType()))]
    )

    def batch(b: pa.RecordBatch):  # noqa: ANN202
        data, offsets = texts(b.column(1))
        common, value = known.value
        for i, j in chunks(offsets, PIECE):
            x = lower_ascii(data[offsets[i] : offsets[j]])
            symbols, at, (starts, ends, first) = stream(x, offsets[i : j + 1] - offsets[i])
            scores = np.add.reduceat(tree.value.scores(symbols), at[:-1])
            m = j - i
            n_words = np.diff(first)
            h = np.concatenate([word_hashes(x, starts, ends), np.full(m, _END_WORD)])
            row = np.concatenate([np.repeat(np.arange(m), n_words), np.arange(m)])
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.flatnonzero((np.diff(h, prepend=h[:1] + np.uint64(1)) != 0) | (np.diff(row, prepend=-1) != 0))
            n = np.diff(new, append=len(h))
            h, row = h[new], row[new]
            spot = np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0))
            hit = common[spot] == h if len(common) else np.zeros(len(h), bool)
            head_score = np.bincount(row[hit], value[spot[hit]] * n[hit], m) if hit.any() else np.zeros(m)
            head_known = np.bincount(row[hit], n[hit], m).astype(np.int64)
            tail = np.concatenate(([0], np.cumsum(np.bincount(row[~hit], minlength=m)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, m), pa.array(n_words + 1), pa.array(head_known), pa.array(head_score), pa.array(scores)]
                + [pa.ListArray.from_arrays(tail, h[~hit].view(np.int64)), pa.ListArray.from_arrays(tail, n[~hit].astype(np.int32))],
                names=fields.names,
            )

    scored = stored(map_arrow(rows, fields, batch).withColumn("row", F.monotonically_increasing_id()), "scored")
    tails = scored.select("row", F.explode(F.arrays_zip("tail_w", "tail_n")).alias("t")).select("row", F.col("t.tail_w").alias("w"), F.col("t.tail_n").alias("k"))
    rare = counts.filter(F.col("n") < max(1.0, total / HEAD))
    c = F.coalesce("n", F.lit(0))
    sums_ = tails.join(rare, "w", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10((c + 1) / F.lit(float(bottom)))).alias("tail_score"),
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("tail_known"),
    )
    return scored.drop("tail_w", "tail_n").join(sums_, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"),
        "score",
    )
