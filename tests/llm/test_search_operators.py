"""Fill-in-middle, ranked search and graph neighbours against brute force on small tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim, hnsw, lexical

DOC = "doc_id long, text string, n string, form string, score string, rank string"


def table(spark, rows):
    """Documents with columns named as the operators name theirs."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOC)


# Fill-in-middle


def brute_fim(doc_id, text):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    r = random.Random(4)
    shared = "".join(r.choice("abc déß\n \U0001f926漢") for _ in range(4000))
    rows = [(i, "".join(r.choice("xyz é漢\U0001f926<PSM>") for _ in range(r.randint(0, 90)))) for i in range(150)]
    rows += [(200 + i, shared[: r.randint(0, 500)] + shared + shared[r.randint(0, 500) :]) for i in range(40)]
    rows += [(300, None), (301, ""), (302, "a"), (303, "漢"), (None, "no id at all"), (304, "<"), (305, "<P"), (306, "P><S"), (307, "x" * 100_000), (308, "é" * 50_000), (309, shared * 100)]
    rows += [(i, f"{'q' * (500 + i)}<M>{shared[:900]}") for i in range(310, 340)]
    rows += [(i, f"{shared[: 700 + i]}<{'P' if i % 2 else '>'}>") for i in range(340, 380)]
    return rows + [rows[3], rows[3], (3, rows[4][1])]


def test_fill_in_middle_equals_brute_force(spark):
    rows = fim_rows()
    got = fim.rearrange(table(spark, rows).repartition(3))
    with_text = got.withColumn("again", fim.restored(F.col("output"), F.col("form")))
    found = collections.Counter((g.doc_id, g.n, g.form, g.prefix_chars, g.middle_chars, g.output, g.again) for g in with_text.collect())
    assert found == collections.Counter((i, *brute_fim(i, t), t or "") for i, t in rows)
    assert {g[2] for g in found} == {"plain", "psm", "spm"}
    assert fim.digests(fim.rearrange(table(spark, []))).count() == 0


def test_chunks_are_the_same_wherever_a_passage_stands():
    r = random.Random(1)
    passage = bytes(r.choice(b"abcdefgh ") for _ in range(20_000))

    def pieces(text):
        data = np.frombuffer(text, np.uint8)
        ends = fim.chunk_ends(data, np.array([0, len(data)]))
        assert ends[-1] == len(data) and (np.diff(ends, prepend=0) > 0).all() and np.diff(ends, prepend=0).max() <= 8192
        return {text[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)}

    a, b = pieces(b"one beginning" + passage + b"end"), pieces(b"a quite different and longer beginning" * 9 + passage)
    assert len(a & b) >= len(a) - 4 > 10


def test_memo_keeps_a_bounded_number_of_bytes():
    memo = fim.Memo(most=10_000)
    for i in range(3000):
        assert memo.summary(f"chunk {i} <P>".encode() + b"x" * 50) == (len(f"chunk {i} <P>") + 50, True)
        assert memo.summary("漢é".encode()) == (2, False)
    assert len(memo.new) + len(memo.old) < 300 and memo.hits > 2900


# Ranked search

TERM = re.compile("[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_search(docs, items, top):
    words = [terms(t) for _, t in docs]
    n, total = sum(1 for w in words if w), sum(map(len, words))
    counts = [collections.Counter(w) for w in words]
    df = collections.Counter(t for c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = collections.Counter()
    for i, own in asked.items():
        rows = []
        for (d, _), c, w in zip(docs, counts, words, strict=True):
            m = 100 - 50 + (50 * len(w) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out.update((i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(rows, key=lambda x: x[:3])[:top]))
    return out


def search_rows():
    r = random.Random(9)
    words = "The river RIVER stone-age été Été groß niño 42 x7 cat's dog don't über a b c d e f g h i j k l m".split()
    docs = [(i, r.choice([" ", ", ", "\n", "--"]).join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " .,;\t"), (None, "river stone 42"), (203, "river " * 30_000 + "stone"), (204, "river"), (205, "river"), (-5, "river"), docs[4], docs[4]]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 6)))) for i in range(15)] + [(50, None), (51, ""), (52, "unknown words only"), (53, "RIVER river River"), (54, "stone"), (54, "dog")]
    return docs, items


@pytest.mark.parametrize(("top", "block"), [(50, lexical.BLOCK), (3, 7), (1, 1)])
def test_search_equals_brute_force(spark, top, block):
    docs, items = search_rows()
    benchmark = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, rank string")
    got = lexical.search(table(spark, docs).repartition(4), benchmark, top=top, block=block).collect()
    assert collections.Counter((g.item_id, g.rank, g.doc_id, g.score) for g in got) == brute_search(docs, items, top)


def test_search_of_empty_tables(spark):
    docs, items = search_rows()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(table(spark, []), benchmark).count() == 0
    assert lexical.search(table(spark, docs), benchmark.filter("false")).count() == 0
    assert lexical.search(table(spark, [(1, None)]), benchmark).count() == 0


def test_best_rows_do_not_depend_on_the_order_of_batches():
    r = np.random.default_rng(2)
    scores, ids = r.integers(0, 6, (3, 400)), r.permutation(400)
    whole = lexical.Best(3, 10)
    whole.add(scores, ids)
    parts = lexical.Best(3, 10)
    for i in range(0, 400, 7):
        parts.add(scores[:, i : i + 7], ids[i : i + 7])
    assert [x.tolist() for x in whole.rows] == [x.tolist() for x in parts.rows]
    for item in range(3):
        expected = sorted((-s, d) for s, d in zip(scores[item].tolist(), ids.tolist(), strict=True) if s > 0)[:10]
        at = whole.rows[0] == item
        assert list(zip((-whole.rows[1][at]).tolist(), whole.rows[2][at].tolist(), strict=True)) == expected


# Graph neighbours

VEC = "vec_id long, embedding array<float>, rank string, score string, query_id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "a", "b", "c") for i, v in rows], VEC)


def brute_near(rows, every, top):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for q in [i for i in good if i % every == 0]:
        a = good[q]
        near = [(-float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), i) for i, b in good.items() if i != q and len(b) == len(a)]
        out[q] = sorted((round(s, 12), i) for s, i in near)[:top]
    return out


@pytest.mark.parametrize("per_shard", [hnsw.SHARD, 500])
def test_neighbours_against_brute_force(spark, per_shard):
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 24)) * 2
    rows = [(i, (centres[i % 20] + r.normal(size=24)).tolist() if i % 2 else r.normal(size=24).tolist()) for i in range(3000)]
    rows += [(4000 + i, rows[7][1]) for i in range(300)]  # a vector that many rows have, a query among them
    got = collections.defaultdict(list)
    for g in hnsw.search(vectors(spark, rows), every=50, top=5, per_shard=per_shard, per_block=40).collect():
        got[g.query_id].append((g.rank, g.vec_id, g.score))
    expected = brute_near(rows, 50, 5)
    assert set(got) == set(expected)
    hits = 0
    for q, own in got.items():
        own = sorted(own)
        assert [k for k, _, _ in own] == [1, 2, 3, 4, 5] and all(i != q for _, i, _ in own)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in expected[q]})
    assert hits / (5 * len(expected)) >= 0.95
    for q in (4000, 4050, 4250):  # of equal vectors those of least id
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in expected[q]]


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1, 0]), (1, [2, 0]), (2, [0, 0]), (3, None), (4, [1, None]), (5, [float("nan"), 1]), (6, [float("inf"), 1]), (7, []), (None, [1, 1]), (8, [1, 1]), (9, [-1, 0]), (50, [1, 2, 3]), (51, [3, 2, 1]), (8, [1, 1]), (100, [0, 0]), (150, [5])]
    got = sorted((g.query_id, g.rank, g.vec_id, round(g.score, 9)) for g in hnsw.search(vectors(spark, rows), every=50, top=5).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, round(math.sqrt(0.5), 9)), (0, 3, 9, -1.0), (50, 1, 51, round(10 / 14, 9))]
    assert hnsw.search(vectors(spark, []), every=50).count() == 0
    assert hnsw.search(vectors(spark, [(1, [1, 2])]), every=50).count() == 0


def test_graph_arrays_are_flat_and_bounded():
    x = hnsw._unit(np.random.default_rng(3).normal(size=(2000, 16)))
    graph = hnsw.Graph.built(x, [2000, 130, 9, 1])
    for level, size in zip(graph.levels, (2000, 130, 9, 1), strict=True):
        assert level.shape == (size, 32 if size == 2000 else 16) and level.max() < size and level.min() >= -1
        for i, row in enumerate(level):
            own = row[row >= 0].tolist()
            assert len(set(own)) == len(own) and i not in own
