"""Searches over distinct vectors, joins that are not broadcast by the size of files."""

import random

import pytest

from tidemark.operators import collaborative, content, neighbours


def _brute(left, right, top, same):
    out = {}
    for a, x in left.items():
        scored = [(-round(sum(x.get(t, 0) * w for t, w in y.items()), 9), b) for b, y in right.items() if not (same and a == b)]
        out[a] = [(b, -s) for s, b in sorted(scored) if s < 0][:top]
    return out


@pytest.mark.parametrize("same", [False, True])
def test_equal_vectors_are_searched_once_and_lose_no_row(spark, monkeypatch, same):
    rng = random.Random(5)
    kinds = [{f"t{rng.randrange(6)}": rng.choice([0.25, 0.5, 0.75]) for _ in range(3)} for _ in range(9)]
    rows = {i: kinds[i % len(kinds)] for i in range(1, 300)}
    table = spark.createDataFrame([(i, t, w) for i, v in rows.items() for t, w in v.items()], "id long, term string, weight double")
    met, own = [], neighbours._sparse_top
    monkeypatch.setattr(neighbours, "_sparse_top", lambda x, y, *rest: (met.append((x.count(), y.count())), own(x, y, *rest))[1])
    found = {}
    for r in neighbours.sparse_top(table, table, top=40, same=same, rows_per_block=4).collect():
        found.setdefault(r["id"], []).append((r["other"], r["score"]))
    assert max(met[0]) <= len(kinds)
    want = _brute(rows, rows, 40, same)
    assert {i: sorted(v, key=lambda p: (-p[1], p[0])) for i, v in found.items()} == want


def test_excluded_pairs_are_not_broadcast_by_the_size_of_their_files(spark):
    bad = spark.createDataFrame([(1, 2)], "request_id long, movie_id long")
    vectors = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0)], "movie_id long, term string, weight double")
    profile = spark.createDataFrame([(1, "a", 1.0)], "request_id long, term string, weight double")
    factors = spark.createDataFrame([(1, [1.0]), (2, [0.5])], "id long, features array<float>")
    by_text = content.rank_by_profile(profile, vectors, bad)
    by_factor = collaborative.recommend(factors.selectExpr("id as user_id"), factors, factors, bad.withColumnRenamed("request_id", "user_id"))
    for out in (by_text, by_factor):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftAnti" in x]
    assert [r["movie_id"] for r in by_text.collect()] == [1]
