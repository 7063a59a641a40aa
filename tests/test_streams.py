"""Streams against the batch operators on the same events, with replayed, late and repeated ones."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions.events import EventSettings
from tidemark.operators import feedback, splits
from tidemark.streaming import events as streams

NOW = datetime(2026, 7, 27, 12, tzinfo=timezone.utc)
COLUMNS = "event_id long, user_id long, movie_id long, event_type string, value string, timestamp timestamp"


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


def drawn(seed, n, users=6, movies=4, days=100):
    r = random.Random(seed)
    kinds = ["click", "share", "share", "comment", "comment", "like", "dislike", "watch", "odd"]
    return [(seed * 1000 + i, r.randint(1, users), r.randint(1, movies), r.choice(kinds), r.choice(["0.7", "0.2", "-0.5", None]), NOW - timedelta(milliseconds=r.randint(0, days * 86_400_000))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_continuous_merge_equals_the_batch_merge(spark, tmp_path, rocksdb):
    old = spark.createDataFrame([(u, m, 4.0, "rating", NOW) for u in range(1, 60) for m in (2, 9)], "user_id long, movie_id long, interaction_value double, interaction_type string, timestamp timestamp")
    for policy in ("prefer_rating", "prefer_event"):
        table, files, progress = (str(tmp_path / f"{policy}-{x}") for x in ("table", "files", "progress"))
        streams.lay_out(old, table, buckets=8)
        every, written, kept = [], [], []
        for k in range(3):
            rows = drawn(k + 1, 60) if k < 2 else [(x[0], 2, *x[2:]) for x in drawn(3, 25)]  # the last batch is of one user
            every += rows
            frame(spark, rows + rows[:5]).coalesce(1).write.mode("append").json(files)  # five events come twice
            files_before = {p: os.stat(p).st_mtime_ns for p in parquet(table)}
            streams.run_merge(streams.event_stream(spark, files, late="200 days"), table, progress, 8, policy)
            new = frame(spark, every)
            expected = splits.merge_eras(old, feedback.training_rows(new, F.lit(NOW)), policy)
            written.append(rows_of(spark.read.parquet(table)))
            assert written[-1] == rows_of(expected)
            kept.append(sum(p in files_before and os.stat(p).st_mtime_ns == files_before[p] for p in parquet(table)))
        assert kept[2] == 7  # one bucket was written anew
        # The first batch's rows come again after the last one.
        again = feedback.training_rows(frame(spark, drawn(1, 60)), F.lit(NOW))
        streams.merge_into(table, 8, policy)(again, 0)
        assert rows_of(spark.read.parquet(table)) == written[-1]


def parquet(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]


def rows_of(df):
    return sorted((r.user_id, r.movie_id, round(r.interaction_value, 6), r.interaction_type, r.timestamp) for r in df.collect())


def test_event_stream_counts_an_event_once(spark, tmp_path):
    files = str(tmp_path / "in")
    rows = drawn(4, 30)
    for part in (rows[:20], rows[10:], rows):
        frame(spark, part).coalesce(1).write.mode("append").json(files)
    out = str(tmp_path / "out")
    streams.event_stream(spark, files, late="300 days", files=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "p")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == sorted(x[0] for x in rows)


def test_valid_counts_at_three_times(spark, tmp_path, rocksdb):
    settings = EventSettings(valid_days=20)
    files, folder = str(tmp_path / "in"), str(tmp_path / "counts")
    rows = sorted(drawn(5, 200), key=lambda x: x[-1]) + [(9000, 1, 1, "like", None, None)]
    for k in range(3):
        part = rows[67 * k : 67 * k + 67]
        frame(spark, part).coalesce(1).write.mode("append").json(files)
        got = {r.user_id: r.valid_count for r in streams.run_latest(streams.live_valid_counts(streams.json_stream(spark, files), "1 hour", settings), folder).collect()}
        seen = rows[: 67 * k + 67]
        mark = max(x[-1] for x in seen if x[-1]) - timedelta(hours=1)
        expected = {r.user_id: r.valid_count for r in feedback.valid_counts(frame(spark, seen), F.lit(mark), settings).collect()}
        assert got == expected
    assert min(expected.values()) < 40  # events have left


def test_profiles_of_late_events(spark, tmp_path, rocksdb):
    files = str(tmp_path / "in")
    rows = drawn(6, 150)
    frame(spark, rows).repartition(4).write.json(files)
    stream = streams.json_stream(spark, files, files=1)
    got = {(p.user_id, p.movie_id): (round(p.score, 5), p.events_counted, p.types) for p in streams.run_profiles(streams.live_profiles(stream, "2026-07-27 12:00:00"), str(tmp_path / "live")).collect()}
    batch = feedback.profile(frame(spark, rows), F.lit("2026-07-27 12:00:00").cast("timestamp")).collect()
    assert got == {(p.user_id, p.movie_id): (round(p.score, 5), p.events_counted, ",".join(p.types)) for p in batch}
