"""Quality classification by hierarchical empirical Bayes.

1. Document evidence: a logistic regression on surface statistics of the whole text, fitted
   on a bounded sample of the labelled rows.
2. Site evidence: the mean score of each host, and of each path below it, as Beta posteriors.
   The prior of a host is the global rate, that of a path is its host's posterior; the strength
   of each prior is estimated from the spread between the groups (empirical Bayes), so sparse
   sites shrink to the prior and dense ones speak for themselves.
3. The document's log-odds are moved from the rate the classifier was trained at to the rate
   of its path, the document itself left out of that rate.

Groups are partial aggregates (sum, sum of squares, count): a hot host costs one row a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import NOT_SPACE, byte_class, chunks, free_name, texts, with_columns, word_hashes, words
from .lookup import left_lookup
from .scratch import cut

_UPPER, _LOWER = byte_class((65, 90)), byte_class((97, 122))
_DIGIT, _HIGH, _STOP = byte_class((48, 57)), byte_class((128, 255)), byte_class((44, 44), (46, 46))
_OTHER = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _STOP | byte_class((9, 13), (32, 32)))
FEATURES = ["log_words", "word_bytes", "upper", "digit", "high", "stop", "other", "other_words", "distinct_words", "distinct_lines", "long_words", "short_text"]


def features(values: pa.Array) -> np.ndarray:
    """Texts x FEATURES: shares of byte classes, lengths, and shares of distinct words and lines."""
    data, offsets = texts(values)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    line = ~byte_class((10, 10))
    for i, j in chunks(offsets):
        x, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        size = np.maximum(np.diff(o), 1)

        def share(table: np.ndarray, x: np.ndarray = x, o: np.ndarray = o, size: np.ndarray = size) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(table[x])))
            return (total[o[1:]] - total[o[:-1]]) / size

        def distinct(table: np.ndarray, x: np.ndarray = x, o: np.ndarray = o) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            starts, ends, first = words(x, o, table)
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            h = word_hashes(x, starts, ends)
            order = np.lexsort((h, row))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
            return np.bincount(row[order][new], minlength=len(n)) / np.maximum(n, 1), n, row, ends - starts

        kinds, n, row, length = distinct(NOT_SPACE)
        lines, n_lines, _, _ = distinct(line)
        starts, ends, _ = words(x, o, NOT_SPACE)
        odd = np.concatenate(([0], np.cumsum(_OTHER[x])))
        marked = np.bincount(row, (odd[ends] - odd[starts] > 0).astype(float), len(n))
        out[i:j] = np.stack(
            [np.log1p(n), np.bincount(row, length, len(n)) / np.maximum(n, 1), share(_UPPER), share(_DIGIT), share(_HIGH), share(_STOP), share(_OTHER), marked / np.maximum(n, 1), kinds, lines, np.bincount(row, length > 25, len(n)) / np.maximum(n, 1), n < 5],
            axis=1,
        )
        del n_lines
    return out


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant
    rate: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.concatenate([z, z**2 / 4], axis=1)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)


def fit(documents: DataFrame, labels: DataFrame, rows: int = 20_000, ridge: float = 1.0, rounds: int = 30) -> Classifier:
    """A classifier from ``documents`` (doc_id, text) and ``labels`` (doc_id, label 0/1, one row an id).

    At most ``rows`` labels are used: those of least xxhash64(doc_id), so the sample doesn't depend
    on the layout.  They are broadcast to the documents, whose texts are not shuffled.  Null labels
    and texts are passed over.  One class only, or no rows: a constant.
    """
    sample = cut(labels.filter("label is not null and doc_id is not null").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows))
    fields = T.StructType([T.StructField("__x__", T.ArrayType(T.DoubleType()))])
    chosen = documents.filter("text is not null").join(F.broadcast(sample), "doc_id")
    got = with_columns(chosen, "text", fields, lambda v: [_nested(features(v))]).groupBy("doc_id").agg(F.min("label").alias("label"), F.min("__x__").alias("__x__")).collect()
    if not got:
        return Classifier(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(2 * len(FEATURES) + 1), 0.5)
    x, y = np.array([r["__x__"] for r in got]), np.array([float(r["label"]) for r in got])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.concatenate([z, z**2 / 4, np.ones((len(z), 1))], axis=1)
    rate = (y.sum() + 1) / (len(y) + 2)
    w = np.zeros(z.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    if 0 < y.sum() < len(y):
        pull = np.full(len(w), ridge)
        pull[-1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
            w = w + np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
    return Classifier(mean, scale, w, float(rate))


def _nested(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())


def with_evidence(df: DataFrame, model: Classifier, text: str = "text", name: str = "doc_log_odds") -> DataFrame:
    """``df`` and the classifier's log-odds of each whole text (null: as empty)."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return with_columns(df, text, T.StructType([T.StructField(name, T.DoubleType())]), lambda v: [pa.array(sent.value.log_odds(features(v)))])


def _strength(groups: DataFrame, s: str, n: str, prior: F.Column) -> float:
    """The prior's weight in documents, by moments: p(1-p) / variance between groups - 1, from 1 to 1e6."""
    m = F.col(s) / F.col(n)
    row = groups.filter(F.col(n) > 1).agg(
        F.sum(n).alias("n"),
        F.sum(F.col(n) * (m - prior) ** 2).alias("spread"),
        F.sum(F.col(n) * prior * (1 - prior)).alias("most"),
        F.sum(prior * (1 - prior)).alias("noise"),
    ).first()
    if not row["n"] or not row["most"]:
        return 1.0
    between = max(row["spread"] - row["noise"], 0.0) / row["n"]
    within = row["most"] / row["n"]
    return float(min(max(within / between - 1, 1.0), 1e6)) if between else 1e6


def posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """Paths (host, path, path_n, path_s, host_n, host_s, host_k, path_k) from (host, path, p), and the global rate."""
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("p").alias("path_s")))
    total = paths.agg(F.sum("path_n").alias("n"), F.sum("path_s").alias("s")).first()
    rate = min(max((total["s"] or 0.0) / (total["n"] or 1), 1e-3), 1 - 1e-3)
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"))
    host_k = _strength(hosts, "host_s", "host_n", F.lit(rate))
    both = paths.withColumnRenamed("host", "h").join(hosts, F.col("h").eqNullSafe(F.col("host"))).drop("h")
    mean = (F.col("host_s") + host_k * rate) / (F.col("host_n") + host_k)
    path_k = _strength(both, "path_s", "path_n", mean)
    return both.withColumn("host_k", F.lit(host_k)).withColumn("path_k", F.lit(path_k)), rate


def with_site(df: DataFrame, url: str = "url", host: str = "host", path: str = "path", depth: int = 1) -> DataFrame:
    """``df`` and the lower-cased host of each URL and the first ``depth`` folders of its path ("/" if there is none).

    A null URL, or one without a host, has neither.  Columns of these names are replaced.
    """
    u = F.col(f"`{url}`")
    name = F.lower(F.nullif(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    folders = F.slice(F.filter(F.split(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != ""), 1, depth)
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (host.lower(), path.lower())]
    return df.select(*keep, name.alias(host), F.when(name.isNotNull(), F.concat(F.lit("/"), F.array_join(folders, "/"))).alias(path))


def classify(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality", threshold: float = 0.5, sample: int = 20_000) -> DataFrame:
    """``documents`` and ``doc_log_odds``, ``host_rate``, ``path_rate``, ``quality_p`` and ``keep``.

    ``labels``: (doc_id, ``label``); several labels of one id count by their mean, rounded.
    ``host_rate`` and ``path_rate`` are posteriors without the document itself.  Null hosts and
    paths are groups of their own; null and empty texts are scored as empty; repeated rows each
    count.  Input columns with the names of new ones are replaced.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("y")).groupBy("doc_id").agg(F.round(F.avg("y")).alias("label"))
    model = fit(documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), known, sample)
    new = {"doc_log_odds", "host_rate", "path_rate", "quality_p", "keep"}
    columns = [c for c in documents.columns if c.lower() not in new]
    scored = with_evidence(documents.select(*[F.col(f"`{c}`") for c in columns]), model, text)
    p = 1 / (1 + F.exp(-F.col("doc_log_odds")))
    key = lambda h, q: F.sha2(F.to_json(F.struct(h.cast("string").alias("h"), q.cast("string").alias("p"))), 256)
    groups, rate = posteriors(scored.select(F.col(f"`{host}`").alias("host"), F.col(f"`{path}`").alias("path"), p.alias("p")))
    names = {c: free_name(documents, f"__{c}__") for c in ("key", "path_n", "path_s", "host_n", "host_s", "host_k", "path_k")}
    groups = cut(groups.select(key(F.col("host"), F.col("path")).alias(names["key"]), *[F.col(c).alias(n) for c, n in names.items() if c != "key"]))
    joined = left_lookup(scored.withColumn(names["key"], key(F.col(f"`{host}`"), F.col(f"`{path}`"))), groups, names["key"], groups.count())
    g = {c: F.col(n) for c, n in names.items()}
    host_rate = (g["host_s"] - p + g["host_k"] * rate) / (g["host_n"] - 1 + g["host_k"])
    path_rate = (g["path_s"] - p + g["path_k"] * F.col("host_rate")) / (g["path_n"] - 1 + g["path_k"])
    clip = lambda x: F.least(F.greatest(x, F.lit(1e-3)), F.lit(1 - 1e-3))
    base = float(np.log(rate / (1 - rate)))
    final = F.col("doc_log_odds") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - base
    out = joined.withColumn("host_rate", clip(host_rate)).withColumn("path_rate", clip(path_rate)).withColumn("quality_p", 1 / (1 + F.exp(-final)))
    return out.withColumn("keep", F.col("quality_p") >= threshold).select(*[F.col(f"`{c}`") for c in columns], "doc_log_odds", "host_rate", "path_rate", "quality_p", "keep")
