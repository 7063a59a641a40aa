"""Event streams: files in, live profiles, merging, daily counters."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.events import EventSettings
from tidemark.functions.scalars import score_to_rating
from tidemark.operators import feedback, splits

EVENT = "event_id long, user_id long, movie_id long, event_type string, value string, timestamp timestamp"
_PROFILE = "user_id long, movie_id long, score double, events_counted long, types string"


def json_stream(spark: SparkSession, folder: str, schema: str = EVENT, files: int = 100) -> DataFrame:
    """New JSON-lines files of ``folder`` as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).json(folder)


def event_stream(spark: SparkSession, folder: str, late: str = "30 days", schema: str = EVENT, files: int = 100) -> DataFrame:
    """New JSON-lines files of ``folder`` as they come; an event id counts once within the watermark."""
    rows = json_stream(spark, folder, schema, files)
    return rows.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["event_id"])


#: A user's events in flat arrays, one value a user: of types without a cap sums and counts, of capped ones the newest events (time, id, weight).
_HELD = ("s_movie array<long>, s_kind array<string>, s_total array<double>, s_n array<long>, "
         "c_movie array<long>, c_kind array<string>, c_t array<double>, c_i array<long>, c_w array<double>, m_movie array<long>, m_last array<double>")  # fmt: skip


class _Held:
    """A user's state while rows are taken in: sums and newest events by (movie, type), and each movie's last time."""

    def __init__(self, value: tuple | None):
        v = [list(x) for x in value] if value else [[] for _ in range(11)]
        self.sums = {(int(m), k): (float(t), int(n)) for m, k, t, n in zip(*v[:4], strict=True)}
        self.newest: dict[tuple, list] = {}
        for m, k, t, i, w in zip(*v[4:9], strict=True):
            self.newest.setdefault((int(m), k), []).append((float(t), int(i), float(w)))
        self.last = {int(m): float(t) for m, t in zip(*v[9:], strict=True)}

    def take(self, at: tuple, events: list[tuple[float, int, float]], cap: int | None) -> None:
        """``events`` of one movie and type; a late event takes its place by its time."""
        if cap is None:
            total, n = self.sums.get(at, (0.0, 0))
            self.sums[at] = total + sum(e[2] for e in events), n + len(events)
        else:
            self.newest[at] = sorted([*self.newest.get(at, ()), *events], key=lambda e: (-e[0], e[1]))[:cap]

    def value(self) -> tuple:
        sums = [(m, k, t, n) for (m, k), (t, n) in self.sums.items()]
        newest = [(m, k, *e) for (m, k), events in self.newest.items() for e in events]
        column = lambda rows, i: [r[i] for r in rows]
        return (*[column(sums, i) for i in range(4)], *[column(newest, i) for i in range(5)], list(self.last), list(self.last.values()))


def _timed(rows: DataFrame) -> DataFrame:
    """What the states need of weighed events; ``t``: seconds, events without a time before all others."""
    t = F.coalesce(F.unix_micros("timestamp") / 1e6, F.lit(float("-inf")))
    return rows.select("user_id", "event_id", "movie_id", "event_type", F.col("weight").cast("double").alias("weight"), t.alias("t"))


def _by_spot(rows: Iterator[pd.DataFrame]) -> dict[tuple, list]:
    """The rows' events (time, id, weight) by (movie, type)."""
    found: dict[tuple, list] = {}
    for part in rows:
        for m, k, t, i, w in zip(*(part[c].tolist() for c in ("movie_id", "event_type", "t", "event_id", "weight")), strict=True):
            found.setdefault((int(m), k), []).append((t, int(i), w))
    return found


class _Profile(StatefulProcessor):
    """State of a user: for capped types the newest events, for others sums of weights as of ``as_of``; one value, so that it is read and written once a batch."""

    def __init__(self, as_of: pd.Timestamp, settings: EventSettings):
        self.as_of, self.s = as_of.timestamp(), settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("events", _HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = _Held(self.state.get())
        for at, events in _by_spot(rows).items():
            held.take(at, [(t, i, w * self._fade(t)) for t, i, w in events], self.s.caps.get(at[1]))
        self.state.update(held.value())
        movies: dict[int, list] = {}
        for (movie, kind), (total, n) in [*held.sums.items(), *((at, (sum(e[2] for e in events), len(events))) for at, events in held.newest.items())]:
            entry = movies.setdefault(movie, [0.0, 0, set()])
            entry[0] += total
            entry[1] += n
            entry[2].add(kind)
        yield pd.DataFrame([(int(key[0]), m, round(e[0], 6), e[1], ",".join(sorted(e[2]))) for m, e in sorted(movies.items())], columns=["user_id", "movie_id", "score", "events_counted", "types"])

    def _fade(self, t: float) -> float:
        if self.s.half_life_days <= 0 or t == float("-inf"):
            return 1.0
        return 0.5 ** (max(self.as_of - t, 0.0) / 86400 / self.s.half_life_days)

    def close(self) -> None:
        pass


def live_profiles(events: DataFrame, as_of: str, settings: EventSettings | None = None) -> DataFrame:
    """(user_id, movie_id, score, events_counted, types): a user's whole profile each time events of theirs come in.

    Equal to the batch profile of the same events, late ones included.
    """
    s = settings or EventSettings()
    good = feedback.weigh(events, s).filter("reason is null").withColumn("event_type", F.lower(F.trim("event_type")))
    processor = _Profile(pd.Timestamp(as_of, tz="UTC"), s)
    return _timed(good).groupBy("user_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=_PROFILE, outputMode="Update", timeMode="None")


def run_profiles(profiles: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of profiles over all its input, each batch written below ``folder``; the last profile of each user."""
    spark = profiles.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/profiles/batch={number}")

    profiles.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema(T.StructType([*T._parse_datatype_string(_PROFILE).fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/profiles")
    last = written.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return written.join(last, ["user_id", "batch"]).drop("batch")


class _TrainingRows(StatefulProcessor):
    """State of a user: for each movie and type what counts (as in ``_Profile``, without decay), for each movie the time of its last event."""

    def __init__(self, settings: EventSettings):
        self.s = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("events", _HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, met = _Held(self.state.get()), set()
        for at, events in _by_spot(rows).items():
            met.add(at[0])
            held.last[at[0]] = max(held.last.get(at[0], float("-inf")), *(e[0] for e in events))
            good = [e for e in events if e[2] == e[2]]  # the others have no weight
            if good:
                held.take(at, good, self.s.caps.get(at[1]))
        self.state.update(held.value())
        score: dict[int, float] = {}
        for (movie, _), total in [*((at, v[0]) for at, v in held.sums.items()), *((at, sum(e[2] for e in events)) for at, events in held.newest.items())]:
            if movie in met:
                score[movie] = score.get(movie, 0.0) + total
        out = [(int(key[0]), m, x, round(held.last[m] * 1e6)) for m, x in score.items() if held.last[m] > float("-inf")]
        yield pd.DataFrame(out, columns=["user_id", "movie_id", "score", "micros"])

    def close(self) -> None:
        pass


def live_training_rows(events: DataFrame, settings: EventSettings | None = None) -> DataFrame:
    """A stream of training rows (user_id, movie_id, interaction_value, interaction_type, timestamp): a pair's row anew each time events of it come in.

    The last row of each pair is that of ``feedback.training_rows`` over all events so far: what caps hold is kept
    from batch to batch.
    """
    s = settings or EventSettings()
    rows = feedback.weigh(events, s).filter("user_id is not null and movie_id is not null").withColumn("event_type", F.lower(F.trim("event_type")))
    rows = rows.select("event_id", "user_id", "movie_id", "event_type", F.when(F.col("reason").isNull(), F.col("weight")).alias("weight"), "timestamp")
    made = _timed(rows).groupBy("user_id").transformWithStateInPandas(statefulProcessor=_TrainingRows(s), outputStructType="user_id long, movie_id long, score double, micros long", outputMode="Append", timeMode="None")
    return made.select("user_id", "movie_id", F.round(score_to_rating(F.round("score", 6)), 6).alias("interaction_value"), F.lit("event").alias("interaction_type"), F.timestamp_micros("micros").alias("timestamp"))


def _in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))


def lay_out(interactions: DataFrame, path: str, buckets: int = 64) -> None:
    """The interactions (user_id, movie_id, interaction_value, interaction_type, timestamp) as a table of user buckets, for ``merge_into``."""
    rows = _in_buckets(interactions, buckets).withColumn("batch", F.lit(-1).cast("long"))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(path)


def merge_into(path: str, buckets: int = 64, policy: str = "prefer_rating") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges ``live_training_rows`` into the table that ``lay_out`` wrote at ``path``.

    Only the buckets of users with new rows are read, and written anew beside the old ones, which they replace at
    the end of the job; the other buckets' files stay.  A row says of which batch it is and the latest counts, so
    a batch that runs again, even after later ones, changes nothing.
    """

    def each(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = _in_buckets(rows, buckets).withColumn("batch", F.lit(number).cast("long")).persist()
        try:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # no more than there are buckets
            if touched:
                old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
                merged = splits.upsert(old.select(*new.columns), new, policy)
                merged.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        finally:
            new.unpersist()

    return each


def run_merge(events: DataFrame, path: str, progress: str, buckets: int = 64, policy: str = "prefer_rating") -> None:
    """Merges what a stream of events has to give by now; ``progress`` holds the state between runs."""
    live_training_rows(events).writeStream.foreachBatch(merge_into(path, buckets, policy)).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()


class _Window(StatefulProcessor):
    """State of a user: the times of the usable events in rising order and how many have none; one timer, for when the next one leaves."""

    def __init__(self, days: int):
        self.span = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("times", "ms array<long>, timeless long, timer long")

    def _settle(self, key: tuple, ms: list[int], timeless: int, timer: int, now: int) -> pd.DataFrame:
        """The user's row once what has left is out of the state; the timer stands for the first that is left."""
        ms = ms[bisect.bisect_right(ms, now - self.span - 1):]
        leaves = ms[0] + self.span + 1 if ms else 0
        if leaves != timer:
            if timer > now:
                self.handle.deleteTimer(timer)
            if leaves:
                self.handle.registerTimer(leaves)
        self.state.update((ms, timeless, leaves))
        return pd.DataFrame([(int(key[0]), len(ms) + timeless)], columns=["user_id", "valid_count"])

    def _known(self) -> tuple[list[int], int, int]:
        value = self.state.get()
        return ([int(x) for x in value[0]], int(value[1]), int(value[2])) if value else ([], 0, 0)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms, timeless, timer = self._known()
        for part in rows:
            good = part["ms"][part["valid"]]
            timeless += int(good.isna().sum())  # events without a time never leave
            ms += good.dropna().astype("int64").tolist()
        yield self._settle(key, sorted(ms), timeless, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._settle(key, *self._known(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def live_valid_counts(events: DataFrame, late: str = "1 hour", settings: EventSettings | None = None) -> DataFrame:
    """A stream of (user_id, valid_count): a user's usable events of the last ``valid_days`` before the watermark, anew when one comes or leaves.

    Equal to ``feedback.valid_counts`` as of the watermark.  Event-time timers take old events out of the state.
    """
    s = settings or EventSettings()
    rows = events.filter("user_id is not null").withWatermark("timestamp", late)
    usable = feedback.is_valid_interaction(F.lit("0001-01-02").cast("timestamp"), s)  # at any age
    ms = F.unix_millis("timestamp")
    rows = rows.select("user_id", usable.alias("valid"), ms.alias("ms"), "timestamp")
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=_Window(s.valid_days), outputStructType="user_id long, valid_count long", outputMode="Update", timeMode="EventTime")


def run_latest(rows: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of (user_id, ...) rows over what it has to give by now; the last row of each user of all runs in ``folder``."""
    spark = rows.sparkSession
    schema = T.StructType([*rows.schema.fields, T.StructField("at", T.LongType()), T.StructField("batch", T.LongType())])

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema(schema).parquet(f"{folder}/rows")
    fields = [f.name for f in rows.schema.fields]
    last = written.groupBy("user_id").agg(F.max_by(F.struct(*fields), F.struct("batch", "at")).alias("r"))
    return last.select("r.*")


def daily_ignored(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, reason, event_type, n) of events that don't count; works on streams and tables."""
    bad = feedback.weigh(events).filter("reason is not null")
    if bad.isStreaming:
        bad = bad.withWatermark("timestamp", late)
    return bad.groupBy(F.window("timestamp", "1 day"), "reason", "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "reason", "event_type", "n")
