"""Queries: events, profiles, training rows, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import events as E
from tidemark.operators import feedback, splits

from . import adapters as A
from .oracle import sql
from .registry import query


@query("c12_translate", """
SELECT event_id, CASE WHEN event_id % 10 = 9 THEN NULL ELSE t END AS event_type, CASE WHEN event_id % 10 <> 9 THEN v END AS value FROM (
  SELECT event_id, CASE event_type WHEN 'view' THEN CASE WHEN value / 100 >= 0.95 THEN 'complete' ELSE 'watch' END WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'share' WHEN 'error' THEN CASE WHEN floor(value) = 1 THEN 'like' ELSE 'dislike' END ELSE 'teleport' END AS t,
    CASE event_type WHEN 'view' THEN CASE WHEN value / 100 >= 0.95 THEN 1.0 ELSE value / 100 END WHEN 'click' THEN 1.0 WHEN 'purchase' THEN 1.0 WHEN 'error' THEN CASE WHEN floor(value) = 1 THEN 1.0 ELSE -1.0 END ELSE value END AS v FROM events)""")
def translate(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "Watch").when(F.col("event_type") == "purchase", "share").when(F.col("event_type") == "error", "reaction").when(F.col("event_type") == "click", " click ").otherwise("teleport")
    value = F.when(F.col("event_type") == "view", F.col("value") / 100).when(F.col("event_type") == "error", F.floor("value")).otherwise(F.col("value"))
    got = E.translate(kind, F.when(F.col("event_id") % 10 == 9, "clear"), value.cast("string"), F.lit(None).cast("string"))
    return e.select("event_id", got.alias("t")).select("event_id", "t.event_type", "t.value")


@query("c13_ids", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') END AS stamp FROM events""")
def ids(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")))
    key = F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("#click#1"))).otherwise(F.lit("plain"))
    return e.select("event_id", E.coerce_id(text).alias("user_id"), E.timestamp_or_key(F.lit(None).cast("string"), key).alias("stamp"))


@query("c14_sentiment", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN -1.0 WHEN 3 THEN NULL ELSE least(greatest(round(value / 100 - 1, 6), -1), 1) END AS sentiment FROM events""")
def sentiments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    value = F.when(k == 0, " Positive ").when(k == 1, "mixed").when(k == 2, "NEG").when(k == 3, "great film").otherwise(F.round(F.col("value") / 100 - 1, 6).cast("string"))
    return A.table(spark, d, "events").select("event_id", E.sentiment(value).alias("sentiment"))


@query("c15_event_weights", sql("SELECT event_id, round(weight, 6) AS weight, reason FROM weighed"))
def event_weights(spark: SparkSession, d: str) -> DataFrame:
    return feedback.weigh(A.events(spark, d)).select("event_id", F.round("weight", 6).alias("weight"), "reason")


@query("c16_decay", sql("SELECT event_id, round(pow(0.5, greatest(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(timestamp), 0) / 86400e6 / 30), 9) AS factor FROM ev"))
def decayed(spark: SparkSession, d: str) -> DataFrame:
    return A.events(spark, d).select("event_id", F.round(E.decay(F.col("timestamp"), A.as_of(), 30.0), 9).alias("factor"))


@query("j1_profile", sql("SELECT user_id, movie_id, score, events_counted, types FROM profile"))
def profile(spark: SparkSession, d: str) -> DataFrame:
    return feedback.profile(A.events(spark, d), A.as_of()).withColumn("types", F.array_join("types", ","))


@query("j1_counters", sql("SELECT user_id, count(*) FILTER (NOT capped) AS counted, count(*) FILTER (capped) AS capped, any_value(ignored) AS ignored FROM counted RIGHT JOIN (SELECT user_id, count(*) FILTER (reason IS NOT NULL) AS ignored FROM weighed GROUP BY user_id) USING (user_id) GROUP BY user_id"))
def counters(spark: SparkSession, d: str) -> DataFrame:
    return feedback.counters(A.events(spark, d), A.as_of())


@query("j1_ignored", sql("SELECT reason, event_type, count(*) AS n FROM weighed WHERE reason IS NOT NULL GROUP BY 1, 2"))
def ignored(spark: SparkSession, d: str) -> DataFrame:
    return feedback.ignored_by_reason(A.events(spark, d))


@query("j2_preferences", sql("""SELECT user_id, movie_id, score, score <= -5 AS disliked, CASE WHEN score > 0 THEN round(score / max(CASE WHEN score > 0 THEN score END) OVER (PARTITION BY user_id), 6) END AS weight,
  CASE WHEN score > 0 THEN row_number() OVER (PARTITION BY user_id, score > 0 ORDER BY score DESC, movie_id) END AS place FROM profile"""))
def preferences(spark: SparkSession, d: str) -> DataFrame:
    out = feedback.preferences(feedback.profile(A.events(spark, d), A.as_of()))
    return out.select("user_id", "movie_id", "score", "disliked", "weight", F.col("place").cast("long").alias("place"))


@query("j3_truncated", sql("SELECT user_id, greatest(count(*) - 50, 0) AS truncated, least(count(*), 50) AS kept FROM ev GROUP BY user_id"))
def truncated(spark: SparkSession, d: str) -> DataFrame:
    newest, cut = feedback.recent(A.events(spark, d), 50)
    return cut.join(newest.groupBy("user_id").agg(F.count("*").alias("kept")), "user_id")


@query("j4_valid_counts", sql("""SELECT user_id, n AS valid_count, CASE WHEN user_id % 7 = 0 THEN 'guest' WHEN n < 5 THEN 'onboarding_user' ELSE 'returning_user' END AS scenario_hint FROM (
  SELECT user_id, count(*) FILTER (event_type IN ('watch', 'complete', 'like', 'rating', 'share', 'comment') AND (event_type <> 'watch' OR value >= 0.5) AND (event_type <> 'comment' OR value IS NOT NULL) AND timestamp >= TIMESTAMP '2024-02-20 00:00:00' - INTERVAL 30 DAY) AS n FROM ev GROUP BY user_id)"""))
def valid_counts(spark: SparkSession, d: str) -> DataFrame:
    s = E.EventSettings(valid_days=30)
    out = feedback.valid_counts(A.events(spark, d), F.lit("2024-02-20 00:00:00").cast("timestamp"), s)
    return out.withColumn("scenario_hint", feedback.scenario_hint(F.col("user_id"), F.col("user_id") % 7 != 0, F.col("valid_count")))


@query("j6_user_profiles", sql("""SELECT user_id, counted, capped, ignored, string_agg(movie_id || ':' || events_counted || ':' || types, ' ' ORDER BY score DESC, movie_id) AS movies FROM profile JOIN (
  SELECT user_id, count(*) FILTER (NOT capped) AS counted, count(*) FILTER (capped) AS capped, any_value(ignored) AS ignored FROM counted RIGHT JOIN (SELECT user_id, count(*) FILTER (reason IS NOT NULL) AS ignored FROM weighed GROUP BY user_id) USING (user_id) GROUP BY user_id
) USING (user_id) GROUP BY ALL"""))
def user_profiles(spark: SparkSession, d: str) -> DataFrame:
    out = feedback.user_profiles(A.events(spark, d), A.as_of())
    return out.select("user_id", "counted", "capped", "ignored", F.array_join(F.transform("movies", lambda m: F.concat_ws(":", m["movie_id"].cast("string"), m["events_counted"].cast("string"), F.array_join(m["types"], ","))), " ").alias("movies"))


@query("j7_requests", sql("""SELECT user_id, CASE WHEN n < 5 THEN 'onboarding_user' ELSE 'returning_user' END AS scenario_hint, n AS valid_interaction_count_90d, recent, (
    SELECT coalesce(string_agg(m, ',' ORDER BY m), '') FROM (SELECT movie_id AS m FROM profile p WHERE p.user_id = u.user_id AND score <= -5 UNION SELECT u.user_id % 5)) AS exclude
FROM (SELECT user_id, count(*) FILTER (event_type IN ('watch', 'complete', 'like', 'rating', 'share', 'comment') AND (event_type <> 'watch' OR value >= 0.5) AND (event_type <> 'comment' OR value IS NOT NULL) AND timestamp >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 90 DAY) AS n,
  string_agg(movie_id, ',' ORDER BY nth) FILTER (nth <= 50) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, event_id) AS nth FROM ev) GROUP BY user_id) u"""))
def recommend_requests(spark: SparkSession, d: str) -> DataFrame:
    e = A.events(spark, d)
    given = e.select("user_id").distinct().withColumn("exclude_movie_ids", F.array(F.col("user_id") % 5))
    out = feedback.recommend_requests(e, given, A.as_of())
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return out.select("user_id", "scenario_hint", "valid_interaction_count_90d", join("recent_movies").alias("recent"), join("exclude_movie_ids").alias("exclude"))


_TRAIN = """SELECT user_id, movie_id, round(CASE WHEN score >= 0 THEN 3 + least(score / 15, 1) * 2 ELSE 3 + greatest(score / 15, -1) * 2.5 END, 6) AS interaction_value, 'event' AS interaction_type, timestamp
FROM (SELECT user_id, movie_id, round(sum(weight), 6) AS score FROM counted WHERE NOT capped GROUP BY 1, 2) JOIN (SELECT user_id, movie_id, max(timestamp) AS timestamp FROM ev GROUP BY 1, 2) USING (user_id, movie_id)"""


@query("j8_training_rows", sql(_TRAIN))
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    return feedback.training_rows(A.events(spark, d), A.as_of()).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("g11_merge", sql(f"""SELECT 'prefer_rating' AS policy, interaction_type, count(*) AS n FROM (SELECT user_id, movie_id, 'rating' AS interaction_type FROM ratings UNION ALL SELECT user_id, movie_id, 'event' FROM ({_TRAIN}) ANTI JOIN ratings USING (user_id, movie_id)) GROUP BY ALL
UNION ALL SELECT 'prefer_event', interaction_type, count(*) FROM (SELECT user_id, movie_id, 'event' AS interaction_type FROM ({_TRAIN}) UNION ALL SELECT user_id, movie_id, 'rating' FROM ratings ANTI JOIN ({_TRAIN}) USING (user_id, movie_id)) GROUP BY ALL"""))
def merged(spark: SparkSession, d: str) -> DataFrame:
    old = A.ratings(spark, d).select("user_id", "movie_id", F.col("rating").alias("interaction_value"), F.lit("rating").alias("interaction_type"), "timestamp")
    new = feedback.training_rows(A.events(spark, d), A.as_of())
    each = [splits.merge_eras(old, new, p).groupBy("interaction_type").agg(F.count("*").alias("n")).select(F.lit(p).alias("policy"), "interaction_type", "n") for p in ("prefer_rating", "prefer_event")]
    return each[0].unionByName(each[1])


@query("a6_export_since", """
SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-15 00:00:00' OR event_id % 20 = 0) AS kept, count(*) FILTER (ts < TIMESTAMP '2024-01-15 00:00:00' AND event_id % 20 <> 0) AS older,
  count(*) FILTER (event_id % 20 = 0) AS without_time FROM events""")
def export_since(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.sources import readers

    e = A.events(spark, d).withColumn("timestamp", F.when(F.col("event_id") % 20 != 0, F.col("timestamp")))
    return readers.since(e, F.lit("2024-01-15 00:00:00").cast("timestamp"))[1].select("kept", "older", "without_time")


@query("a5_json_files", """
SELECT event_id, user_id, event_type FROM (SELECT event_id % 4 AS file, event_id, CAST(user_id AS VARCHAR) AS user_id, event_type FROM events) WHERE file < 3
UNION ALL SELECT -1, (SELECT CAST(count(*) FILTER (event_id % 4 = 3) + 1 AS VARCHAR) FROM events), 'skipped'""")
def json_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of lines, of arrays in one line and over many, of lines that can't be used, and an array that isn't closed."""
    from tidemark.sources import readers

    e = A.table(spark, d, "events").select("event_id", "user_id", "event_type")
    folder, k = A.scratch_folder(spark, "json"), F.col("event_id") % 4
    record = F.to_json(F.struct("event_id", "user_id", "event_type"))
    odd = F.when(F.col("event_id") % 8 == 3, F.lit('"a text"')).otherwise(F.substring(record, F.lit(2), F.length(record)))
    # 64 arrays of each kind, a file each.
    arrays = lambda rows, sep: rows.groupBy((F.col("event_id") % 64).alias("g")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), sep), F.lit("]")).alias("value")).select("value")
    files = {
        "lines": e.filter(k == 0).select(record.alias("value")),
        "odd": e.filter(k == 3).select(odd.alias("value")),
        "arrays": arrays(e.filter(k == 1), ","),
        "long": arrays(e.filter(k == 2), "\n ,\n"),
        "open": spark.range(1).select(F.lit('[{"event_id": "9"},').alias("value")),
    }
    for name, rows in files.items():
        rows.write.option("maxRecordsPerFile", 1 if name in ("arrays", "long") else 0).text(f"{folder}/{name}.json")
    events, bad = readers.read_events(spark, folder, pattern="*.txt")
    return events.select(F.col("event_id").cast("long").alias("event_id"), "user_id", "event_type").unionByName(bad.select(F.lit(-1).cast("long").alias("event_id"), F.col("skipped").cast("string").alias("user_id"), F.lit("skipped").alias("event_type")))


#: So many order lines stand in a CSV file: what a task sorts doesn't grow with the table.
LINES_PER_FILE = 1_000_000


@query("a2_source_rows", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS source_row FROM lineitem")
def source_rows(spark: SparkSession, d: str) -> DataFrame:
    """The order lines as CSV files in order, of a million lines or so, read back with their row numbers."""
    from tidemark.sources import readers

    folder = A.scratch_folder(spark, "csv")
    t = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    t.repartitionByRange(max(5, -(-t.count() // LINES_PER_FILE)), "l_orderkey", "l_linenumber", "l_partkey").sortWithinPartitions("l_orderkey", "l_linenumber", "l_partkey").write.option("header", True).csv(folder)
    rows = readers.with_source_row(readers.read_csv(spark, folder, t.schema, multiline=False))
    return rows.select("l_orderkey", "l_linenumber", "source_row")
