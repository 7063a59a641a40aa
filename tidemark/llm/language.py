"""Language identification with error-correcting output codes.

Every language gets a codeword.  For each bit a binary classifier over hashed byte
n-grams (naive Bayes log-odds of the languages with a 1 against those with a 0) predicts
the bit of a text; loss-weighted decoding adds up the logistic losses of each codeword's
bits, weighted by how well the bit separates the training languages, and takes the
codeword with the least loss.  A text whose best two codewords are close is ambiguous.

Training is one pass of counting (tasks add up arrays of counts, the shuffle carries
non-zero cells); the model is languages x buckets numbers, whatever the corpus size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import chunks, lower_ascii, map_arrow, narrow, texts
from .scratch import cut

_LETTER = regex.compile(r"\p{L}")
#: Most languages a model may have: the counts that go to the driver are this x buckets numbers. More (the column is then
#: hardly one of languages) stop the job; none is left out.
MOST_LANGUAGES = 512


def gram_ids(data: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for the trigram of bytes that ends at each byte (texts are told apart by the caller)."""
    x = lower_ascii(data).astype(np.uint32)
    x[(x < 97) & (x != 39)] = 32  # digits, punctuation and white space are one separator
    h = x * np.uint32(0x9E3779B1)
    h[1:] += x[:-1] * np.uint32(0x85EBCA77)
    h[2:] += x[:-2] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(12)) & np.uint32(buckets - 1)


def counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(lang, bucket, n): n-gram counts of each language in ``rows`` (lang, text)."""
    fields = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def each(batches):  # noqa: ANN001, ANN202
        total: dict[str, np.ndarray] = {}
        for b in batches:
            data, offsets = texts(b.column(1))
            names = b.column(0).to_pylist()
            for i, j in chunks(offsets):
                ids = gram_ids(data[offsets[i] : offsets[j]], buckets)
                ends = offsets[i : j + 1] - offsets[i]
                for k in range(i, j):
                    if names[k] not in total:
                        total[names[k]] = np.zeros(buckets, np.int64)
                    own = ids[ends[k - i] + 2 : ends[k - i + 1]]  # none reaches back into the text before
                    if len(own) < 4096:
                        np.add.at(total[names[k]], own, 1)
                    else:
                        total[names[k]] += np.bincount(own, minlength=buckets)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=fields.names)

    return rows.select("lang", "text").mapInArrow(each, fields).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n: int, bits: int) -> np.ndarray:
    """``n`` codewords of +1 and -1, far apart: greedily the candidate farthest from those before it.

    Candidates come from a fixed generator, so that the code depends on ``n`` and ``bits`` only.
    """
    random = np.random.default_rng(7)
    drawn = np.where(random.random((4000, bits)) < 0.5, -1, 1)
    chosen = [drawn[0]]
    least = (drawn != chosen[0]).sum(axis=1)
    while len(chosen) < n:
        k = int(np.argmax(least))
        chosen.append(drawn[k])
        least = np.minimum(least, (drawn != drawn[k]).sum(axis=1))
    code = np.array(chosen)
    if n > 1:  # a bit that is the same for all languages says nothing: split them there
        for b in np.flatnonzero(np.abs(code.sum(axis=0)) == n):
            code[:, b] = np.where((np.arange(n) >> (b % max(1, (n - 1).bit_length()))) & 1, 1, -1)
    return code


@dataclass
class Model:
    names: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log-odds of a 1
    trust: np.ndarray  # bits

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its probability, gap to the second) of texts x bits margins."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        rows = np.arange(len(best))
        gap = share[rows, best] - (share[rows, order[:, 1]] if loss.shape[1] > 1 else 0)
        return best, share[rows, best], gap


def fit(rows: DataFrame, buckets: int = 1 << 14, bits: int = 15, smoothing: float = 0.5) -> Model:
    """A model from all of ``rows`` (lang, text); rows without language or text are passed over.

    ``bits`` at least; more for many languages, so that codewords stay far apart.
    """
    table = cut(counts(rows.filter("lang is not null and text is not null"), buckets))  # read twice
    names = sorted(r["lang"] for r in table.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if not names:
        return Model([], np.zeros((0, bits)), np.zeros((buckets, bits), np.float32), np.ones(bits))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    bits = max(bits, 5 * (len(names) - 1).bit_length())
    cells = table.toPandas()
    n = np.zeros((len(names), buckets))
    n[cells["lang"].map({x: i for i, x in enumerate(names)}), cells["bucket"]] = cells["n"]
    share = n / np.maximum(n.sum(axis=1, keepdims=True), 1)  # every language weighs the same
    code = codewords(len(names), bits)
    eps = smoothing / buckets / 100
    plus = (share[:, :, None] * (code == 1)[:, None, :]).sum(axis=0) / np.maximum((code == 1).sum(axis=0), 1) + eps
    minus = (share[:, :, None] * (code == -1)[:, None, :]).sum(axis=0) / np.maximum((code == -1).sum(axis=0), 1) + eps
    weights = np.log(plus / minus)
    apart = (share @ weights) * code  # the mean margin of each language at each bit
    trust = np.maximum(apart.min(axis=0), 0) if len(names) > 1 else np.ones(bits)
    trust = trust / trust.sum() * bits if trust.sum() else np.ones(bits)
    return Model(names, code, weights.astype(np.float32), trust)


def predict(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", ambiguous: float = 0.5) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row, from its text alone.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned.
    ``ambiguous``: the best codeword's share leads the second's by less than that much.
    """
    rows = narrow(df, doc_id=doc_id, text=text)
    sent = df.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        n, bits = b.num_rows, m.weights.shape[1]
        data, offsets = texts(b.column(1))
        margins, lengths = np.zeros((n, bits)), np.diff(offsets)
        for i, j in chunks(offsets, 500_000):
            low = int(offsets[i])
            for a in range(low, int(offsets[j]), 500_000):  # pieces, for one very long text
                z = min(a + 500_000, int(offsets[j]))
                start = max(a - 2, low)
                each = m.weights[gram_ids(data[start:z], len(m.weights))][a - start :]
                at = np.arange(a, z)
                row = np.searchsorted(offsets, at, side="right") - 1
                each[at - offsets[row] < 2] = 0
                cut = np.flatnonzero(np.diff(row, prepend=-1))
                margins[row[cut]] += np.add.reduceat(each, cut, axis=0)
        # Evidence of neighbouring n-grams overlaps: a root of their number counts.
        margins /= np.maximum(lengths, 1)[:, None] ** 0.5
        has = np.array([_LETTER.search(v.as_py() or "") is not None for v in b.column(1)], bool) & (len(m.names) > 0)
        names, score, close = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
        if has.any():
            best, share, gap = m.predict(margins[has])
            names[has], score[has], close[has] = np.array(m.names, object)[best], share, gap < ambiguous
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(close)], names=fields.names)

    return map_arrow(rows, fields, batch)


def held_out(doc_id: F.Column) -> F.Column:
    """The fold that is not learned from; a row without an id is not held out, nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options: float) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous): learned from the rows with a language outside the fold, applied to all."""
    rows = narrow(df, doc_id=doc_id, text=text, lang=lang)
    model = fit(rows.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text"), **options)
    return predict(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
