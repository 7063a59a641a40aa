"""What a task or a state holds doesn't grow with the tables: files, lists of barred items, states that are read once a batch."""

import os

import numpy as np
import pandas as pd

from tidemark.functions.events import EventSettings
from tidemark.operators import collaborative, neighbours
from tidemark.plans import adapters, event_queries, ranking_queries
from tidemark.streaming import events as streams

SF = "/root/testdata/sf0.001"


def test_order_lines_stand_in_files_of_bounded_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(event_queries, "LINES_PER_FILE", 500)
    monkeypatch.setattr(adapters, "scratch_folder", lambda _, name: str(tmp_path / name))
    n = adapters.table(spark, SF, "lineitem").count()
    rows = event_queries.source_rows(spark, SF).collect()
    assert sorted(r.source_row for r in rows) == list(range(n)) and [r.source_row for r in sorted(rows)] == list(range(n))
    assert len([f for f in os.listdir(tmp_path / "csv") if f.endswith(".csv")]) == -(-n // 500) > 5


def test_barred_items_make_no_list_longer(spark, monkeypatch):
    wanted, search = [], collaborative.top_products
    monkeypatch.setattr(collaborative, "top_products", lambda *a, need=None, **k: wanted.append(need) or search(*a, need=need, **k))
    rows = ranking_queries.recommend_given_factors(spark, SF).collect()
    e = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in adapters.table(spark, SF, "embeddings").collect()}
    expected = []
    for i in (i for i in e if i % 50 == 0):
        best = sorted((-round(float(e[i] @ e[j]), 9), j) for j in e if j % 7 != i % 3)[:10]
        expected += [(i, k + 1, j) for k, (_, j) in enumerate(best)]
    assert sorted((r.user_id, r["rank"], r.movie_id) for r in rows) == sorted(expected)
    assert wanted and all(w is None for w in wanted)


def test_best_scores_are_those_of_a_whole_sort():
    r = np.random.default_rng(3)
    s = np.round(r.normal(size=(300, 80)), 1) + r.choice([0, 4e-10], size=(300, 80))  # ties, and scores that differ only beyond nine places
    s[r.random(s.shape) < 0.1] = -np.inf
    ids, others, n = np.arange(300), np.arange(80) * 2, r.integers(1, 90, 300)
    last, edge = np.where(r.random(300) < 0.5, np.round(r.normal(size=300), 1), -np.inf), r.integers(0, 160, 300).astype(float)
    for end in (False, True):
        got = neighbours._best(s.copy(), ids, others, n, -0.5, last if end else None, edge if end else None)
        expected = []
        for i in range(300):
            row = [(-round(x, 9), o) for x, o in zip(s[i], others, strict=True) if np.isfinite(x) and round(x, 9) > -0.5]
            row = [(x, o) for x, o in row if not end or -x > last[i] or (-x == last[i] and o <= edge[i])]
            expected += [(i, o, -x) for x, o in sorted(row)[: n[i]]]
        assert list(got.itertuples(index=False, name=None)) == expected


class Value:
    """A value state that counts its reads and writes."""

    def __init__(self):
        self.kept, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, value):
        self.calls += 1
        self.kept = value


class Handle:
    def __init__(self):
        self.values = []

    def getValueState(self, name, schema, *rest):  # noqa: N802
        self.values.append(Value())
        return self.values[-1]


def test_a_state_is_read_and_written_once_a_batch():
    kinds = ["watch", "like", "share"]
    batch = lambda k: pd.DataFrame([(k * 100 + i, i % 7, kinds[i % 3], 1.0, 1000.0 * i + k) for i in range(60)], columns=["event_id", "movie_id", "event_type", "weight", "t"])
    for processor in (streams._Profile(pd.Timestamp("2026-01-01", tz="UTC"), EventSettings(half_life_days=0)), streams._TrainingRows(EventSettings())):
        handle = Handle()
        processor.init(handle)
        for k in (1, 2):
            out = pd.concat(processor.handleInputRows((5,), iter([batch(k)]), None))
        assert sorted(out["movie_id"]) == list(range(7))
        assert len(handle.values) == 1 and handle.values[0].calls == 4
