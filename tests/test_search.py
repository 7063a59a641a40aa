"""Exact searches with bounds, quantiles by ranges, the weight sweep and the smaller sinks, against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import collaborative, evaluation, hybrid, neighbours, rankings
from tidemark.sources import readers, writers


class Counted:
    """The pairs of vectors that are multiplied, counted by the blocks' sizes."""

    def __init__(self, monkeypatch):
        self.rows = []
        met = neighbours._met

        def spy(pairs, left, right, *rest):
            sizes = right.groupBy("block").agg(F.count("*").alias("k"))
            self.rows.append(pairs.join(sizes, "block").agg(F.sum("k")).first()[0] or 0)
            return met(pairs, left, right, *rest)

        monkeypatch.setattr(neighbours, "_met", spy)


def brute(x, y, top, same, need=None, positive=False):
    out = []
    for i, a in x.items():
        s = [(-round(float(np.dot(a, b)), 9), j) for j, b in y.items() if not (same and i == j)]
        s = [p for p in s if p[0] < 0] if positive else s
        out += [(i, j, -v) for v, j in sorted(s)[: (need or {}).get(i, top)]]
    return sorted(out)


def test_products_with_bounds_skip_blocks(spark, monkeypatch):
    seen = Counted(monkeypatch)
    r = np.random.default_rng(1)
    v = {i: (r.normal(size=3) * (20 / (1 + i % 40))).astype(np.float32).astype(float) for i in range(400)}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "id long, v array<float>")
    got = sorted((g.id, g.other, g.score) for g in neighbours.top_products(df, df, "id", "v", 5, rows_per_block=25, same=True).collect())
    expected = brute(v, v, 5, True)
    assert [g[:2] for g in got] == [e[:2] for e in expected] and all(abs(g[2] - e[2]) < 1e-6 for g, e in zip(got, expected, strict=True))
    assert sum(seen.rows) < 0.6 * len(v) ** 2
    need = spark.createDataFrame([(3, 9)], "id long, n int")
    assert len([g for g in neighbours.top_products(df, df, "id", "v", 2, rows_per_block=25, need=need).collect() if g.id == 3]) == 9
    equal = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(60)], "id long, v array<float>")
    assert sorted({g.other for g in neighbours.top_products(equal, equal, "id", "v", 3, rows_per_block=7).collect()}) == [0, 1, 2]
    assert neighbours.top_products(df, df.limit(0), "id", "v", 5).count() == 0


@pytest.mark.parametrize("rows_per_block", [20, 1024])
def test_sparse_search_with_bounds_skips_blocks(spark, monkeypatch, rows_per_block):
    seen = Counted(monkeypatch)
    r = random.Random(2)
    rows, vectors = [], {}
    for i in range(300):
        terms = {f"g{i % 12}": 5.0, f"h{i % 12}{r.randint(0, 3)}": 3.0, r.choice("abcdef"): 1.0}
        length = math.sqrt(sum(w * w for w in terms.values()))
        vectors[i] = {t: w / length for t, w in terms.items()}
        rows += [(i, t, w) for t, w in vectors[i].items()]
    names = sorted({t for v in vectors.values() for t in v})
    dense = {i: np.array([v.get(t, 0.0) for t in names]) for i, v in vectors.items()}
    df = spark.createDataFrame(rows, "id long, term string, weight double")
    got = sorted((g.id, g.other, g.score) for g in neighbours.sparse_top(df, df, top=6, same=True, rows_per_block=rows_per_block).collect())
    assert [(a, b, round(c, 7)) for a, b, c in got] == [(a, b, round(c, 7)) for a, b, c in brute(dense, dense, 6, True, positive=True)]
    if rows_per_block == 20:
        assert sum(seen.rows) < 0.5 * len(vectors) ** 2


def test_quantiles_by_ranges(spark):
    r = random.Random(3)
    for n in (1, 2, 7, 500):
        values = [r.choice([1, 2, 3, r.randint(1, 90)]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v long")
        got = {x.percentile: x.m for x in rankings.higher_quantiles(df, "v", (0.0, 0.5, 0.9, 0.95, 1.0)).collect()}
        assert got == {q: sorted(values)[math.ceil(q * (n - 1))] for q in (0.0, 0.5, 0.9, 0.95, 1.0)}
    assert rankings.higher_quantiles(df.limit(0), "v", (0.5,)).count() == 0


def test_sweep_equals_a_ranking_for_each_trial(spark):
    r = random.Random(4)
    rows = [(q, s, k + 1, m) for q in range(1, 9) for s in ("cf", "cb", "pop") for k, m in enumerate(r.sample(range(1, 40), r.randint(0, 25)))]
    candidates = spark.createDataFrame(rows, "request_id long, source string, rank int, movie_id long")
    n = {q: r.choice([0, 3, 25]) for q in range(1, 9)}
    requests = spark.createDataFrame(sorted(n.items()), "request_id long, n long")
    gone = {(q, r.randint(1, 40)) for q in range(1, 9) for _ in range(5)}
    genre = {m: f"g{m % 5}" for m in range(1, 38)}
    targets = {q: r.randint(1, 40) for q in range(1, 9)}
    got = evaluation.weight_sweep(candidates, requests, spark.createDataFrame(sorted(gone), "request_id long, movie_id long"), spark.createDataFrame(sorted(genre.items()), "movie_id long, genre string"), spark.createDataFrame(sorted(targets.items()), "user_id long, target long"), caps=(0, 2), floors=(0.0, 0.5), populars=(0.0, 0.3), top=10)
    for x in got.collect():
        hits = users = 0
        items = set()
        for q in n:
            share = min(n[q] / 20, 1)
            w = {"cf": share, "cb": 1 - (1 - x.floor) * share, "pop": x.pop}
            score = collections.defaultdict(float)
            for s in w:
                own = [m for a, b, _, m in rows if a == q and b == s and (q, m) not in gone]
                for k, m in enumerate(own):
                    if w[s] > 0:
                        score[m] += w[s] / (60 + k + 1)
            order = sorted(score, key=lambda m: (-round(score[m], 12), m))
            early, late, met = [], [], collections.Counter()
            for m in order:
                met[genre.get(m)] += 1
                (late if x.cap and m in genre and met[genre[m]] > x.cap else early).append(m)
            final = (early + late)[:10]
            users += bool(final)
            hits += targets[q] in final
            items |= set(final)
        assert (x.users_scored, x.hit_rate_10, x.distinct_items) == (users, pytest.approx(hits / users, abs=1e-6), len(items))
    assert got.count() == 8


def test_lists_are_filled_up_from_the_tiers(spark):
    rows = spark.createDataFrame([(1, 1, 5, 0.9, ["cf"]), (1, 2, 6, 0.8, ["cb"])], "request_id long, rank int, movie_id long, score double, sources array<string>")
    asks = spark.createDataFrame([(1, "Drama "), (2, None), (3, "drama")], "request_id long, preferred_genre string")
    genres = spark.createDataFrame([("DRAMA", k, 10 + k) for k in range(1, 3)], "genre string, rank int, movie_id long")
    top = spark.createDataFrame([(k, 20 + k) for k in range(1, 5)], "rank int, movie_id long")
    near = spark.createDataFrame([(3, 1, 5)], "request_id long, rank int, movie_id long")
    gone = spark.createDataFrame([(1, 11), (2, 21)], "request_id long, movie_id long")
    got = collections.defaultdict(list)
    for x in hybrid.backfill(rows, hybrid.tier_rows(asks, near, genres, top), gone, asks, 5).orderBy("request_id", "rank").collect():
        got[x.request_id].append((x.movie_id, x.tier, x.level))
    assert got == {1: [(5, 0, 3), (6, 0, 3), (12, 2, 3), (21, 3, 3), (22, 3, 3)], 2: [(22, 3, 3), (23, 3, 3), (24, 3, 3)], 3: [(5, 1, 3), (11, 2, 3), (12, 2, 3), (21, 3, 3), (22, 3, 3)]}


def test_known_users_and_samples(spark, tmp_path):
    asks = spark.createDataFrame([(1,), (2,), (None,)], "user_id long")
    factors = spark.createDataFrame([(2, [0.1])], "id int, features array<float>")
    assert {(r.user_id, r.known) for r in collaborative.known_users(asks, factors).collect()} == {(1, False), (2, True), (None, False)}
    writers.write_sample(spark.range(500).withColumn("t", F.lit("a,b")), str(tmp_path / "s"), ["id"], 7)
    back = readers.read_csv(spark, str(tmp_path / "s"), "id long, t string")
    assert sorted((r.id, r.t) for r in back.collect()) == [(i, "a,b") for i in range(7)]


def test_source_rows_over_several_splits(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    for f in range(3):
        (folder / f"part-{f}.csv").write_text("a,b\n" + "".join(f"{f * 4000 + i},{'x' * (i % 50)}\n" for i in range(4000)))
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, "40000")
    try:
        df = readers.with_source_row(readers.read_csv(spark, str(folder), "a long, b string", multiline=False))
        assert df.rdd.getNumPartitions() > 4
        assert df.filter("a <> source_row").count() == 0 and df.count() == 12_000
    finally:
        spark.conf.set(name, old)


def test_json_of_any_shape(spark, tmp_path):
    files = {
        "a.json": '\n [\n{"event_id": "1"},\n{"event_id": "2", "value": 3}\n,\n7 ]\n', "b.jsonl": '{"event_id": "3"}\n\n5\nnot json\n[{"event_id": "x"}]\n{"event_id": 4}\n',
        "c.json": '[{"event_id": "9"},\n{"event_id": "10"}', "d.json": "", "e.json": '{"event_id": "5", "other": [1]}', "f.txt": '{"event_id": "no"}',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    events, bad = readers.read_events(spark, str(tmp_path))
    assert sorted((e.event_id, e.value) for e in events.collect()) == [("1", None), ("2", "3"), ("3", None), ("4", None), ("5", None)]
    assert bad.first().skipped == 4


def test_bucketed_tables_meet_without_a_shuffle(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    a, b = (writers.write_bucketed(rows, f"file://{tmp_path}/{n}", "k", 4) for n in "ab")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b.groupBy("k").agg(F.count("*").alias("n")), "k")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.agg(F.sum("n")).first()[0] == 20_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
