"""Components by forests within tasks, by one task and by rounds."""

import random

import numpy as np

from tidemark.llm import graph


def test_components_need_few_jobs_and_equal_those_by_rounds(spark, monkeypatch):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(-200, 200)] + [(r.randint(1000, 1400), r.randint(1000, 1400)) for _ in range(150)] + [(5000, k) for k in range(4800, 4900)] + [(9, 9), (None, 3), (4, None)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    context = spark.sparkContext
    context.setJobGroup("components", "")
    one = sorted(map(tuple, graph.connected_components(df).collect()))
    jobs = len(context.statusTracker().getJobIdsForGroup("components"))
    context.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(graph, "ONE_TASK", 10)
    assert one == sorted(map(tuple, graph.connected_components(df).collect())) and len(one) == len({v for e in edges for v in e if None not in e})
    assert jobs <= 8


def test_labels_are_the_least_nodes():
    r = np.random.default_rng(4)
    a, b = r.integers(-300, 300, 200), r.integers(-300, 300, 200)
    want = {int(v): int(v) for v in np.concatenate([a, b])}
    for _ in want:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            want[x] = want[y] = min(want[x], want[y])
    nodes, root = graph.labelled(a, b)
    assert dict(zip(nodes.tolist(), root.tolist(), strict=True)) == want
    assert [len(x) for x in graph.labelled(a[:0], b[:0])] == [0, 0]
