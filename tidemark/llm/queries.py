"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import boilerplate, bpe, contamination, fim, flac, hnsw, language, lexical, licenses, quality, simhash, suffix_tree, training_order
from .scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"), shingle=4, distance=4)


@_query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10).drop("hit_spans")


SQL["op10_decontaminate"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM b WHERE len(w) > 0)
), x AS (
  SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i))
), h AS (
  SELECT r, p, x.n, item FROM x JOIN i ON x.n = i.n AND x.s = i.s
), c AS (
  SELECT r, count(DISTINCT q) AS hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r
), t AS (
  SELECT r, count(DISTINCT item) AS items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""


@_query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boilerplate.drop_boilerplate(_table(spark, sf_dir, "documents"), ratio=0.1, least=3)
    return rows.select("doc_id", "source", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


SQL["op5_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
t AS (SELECT source, count(*) AS pages FROM d WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT DISTINCT r, source, trim(x, ' ') AS line FROM (SELECT r, source, unnest(l) AS x FROM d WHERE source IS NOT NULL)),
b AS (SELECT m.source, line FROM m JOIN t USING (source) WHERE line <> '' GROUP BY m.source, line, pages HAVING count(*) >= 3 AND count(*) > 0.1 * pages),
g AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
c AS (SELECT doc_id, d.source, text, l, CASE WHEN bad IS NULL THEN l ELSE list_filter(l, lambda x: trim(x, ' ') = '' OR NOT list_contains(bad, trim(x, ' '))) END AS k FROM d LEFT JOIN g USING (source))
SELECT doc_id, source, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l) - len(k), 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN text IS NULL THEN NULL ELSE array_to_string(k, chr(10)) END) AS text_sha256
FROM c
"""


@_query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


@_query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "source", "lang", "doc_log_odds", "host_rate", "path_rate", "quality_p", "keep")


@_query
def op7_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digest(flac.encode(_table(spark, sf_dir, "documents")))


@_query
def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(_table(spark, sf_dir, "documents"))


@_query
def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # In the order of the given files, whatever the splits; the ids are kept, since they are read twice.
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = stored(bpe.encode(docs, path, public_tokenizers.PATTERN, keep=("file", "row"), short=64, memo=100_000), "ids", compression="zstd", **{"parquet.compression.codec.zstd.level": "9"})
    return training_order.materialise(rows, length=1024, per_shard=4096, ids="ids", vocabulary=len(bpe.read_ranks(path)), order=("file", "row"))


@_query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


@_query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.rearrange(_table(spark, sf_dir, "documents"), seed=1, share=90, spm=20))


SQL["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
x AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, z - a) AS m, substring(t, z + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM x
"""


@_query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), top=50)


SQL["op13_lexical_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), l AS (
  SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY r
), c AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l
), t AS (
  SELECT r, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM b) GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM b JOIN t USING (term) JOIN w USING (term) JOIN l USING (r), c GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""


@_query
def op12_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(_table(spark, sf_dir, "embeddings"), every=50, top=5)
