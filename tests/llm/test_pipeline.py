"""The stages on a small table: columns, and what each decides."""

import random

import public_tokenizers  # noqa: F401

import corpus_pipeline
from tidemark.llm import graph, lookup
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    r = random.Random(11)
    words = [f"{a}{b}" for a in "ba de fi go lu ma ne".split() for b in "ra se ti mo nu".split()]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(14)
    rows, labels = [], []
    for i in range(120):
        junk = i % 6 == 0
        body = " ".join(w.upper() + "!!" for w in text(60).split()) if junk else text(60) + ".\n" + text(30)
        rows.append((i, "shared head line\n" + body, "en", "src0", 0))
        labels.append((i, int(not junk), 0))
    rows.append((200, rows[1][1], "en", "src0", 0))
    rows.append((201, text(40) + " " + passage + " " + text(40), "en", "src0", 0))
    base = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, base)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        seen[name] = {d.doc_id: d for d in docs.collect()}
    assert set(seen["quality"]) == {i for i in range(120) if i % 6} | {200, 201}
    assert all("shared head line" not in d.text and d.n_chars == len(d.text) for d in seen["line_dedup"].values())
    assert set(seen["line_dedup"]) - set(seen["simhash"]) == {200}
    assert set(seen["simhash"]) - set(seen["decontaminate"]) == {201}
    out = {o.doc_id for o in corpus_pipeline.run(spark, base).collect()}
    assert out == set(seen["decontaminate"])


def test_components(spark):
    r = random.Random(12)
    edges = [(i, i + 1) for i in range(0, 40)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    got = {g.node: g.root for g in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {v: root(v) for v in parent}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lookup_beyond_the_broadcast_bound(spark):
    left = spark.range(500).withColumn("k", F.col("id") % 3)
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    few, many = (sorted(map(tuple, lookup.left_lookup(left, right, "k", n).select("id", "v").collect()), key=str) for n in (2, 10**9))
    assert few == many and len(few) == 500
