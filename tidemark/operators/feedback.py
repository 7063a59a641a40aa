"""Event streams as scores a user and movie, request inputs, training rows, and the promotion gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.events import EventSettings, coerce_id, decay, sentiment, weight
from tidemark.functions.scalars import score_to_rating, to_number

DEFAULT = EventSettings()


def weigh(events: DataFrame, s: EventSettings = DEFAULT) -> DataFrame:
    """``events`` with ``weight`` or, where an event does not count, ``reason``."""
    w = weight(F.col("event_type"), F.col("value"), coerce_id(F.col("movie_id")), s)
    return events.withColumn("_w", w).withColumn("weight", F.col("_w.weight")).withColumn("reason", F.col("_w.reason")).drop("_w")


def counted(events: DataFrame, as_of: Column, s: EventSettings = DEFAULT, half_life_days: float | None = None) -> DataFrame:
    """Events that count, newest first within (user, movie, type), with ``capped`` and their decayed weight."""
    good = weigh(events, s).filter("reason is null").withColumn("event_type", F.lower(F.trim("event_type")))
    newest = W.partitionBy("user_id", "movie_id", "event_type").orderBy(F.desc_nulls_last("timestamp"), "event_id")
    cap = F.lit(None).cast("int")
    for kind, most in s.caps.items():
        cap = F.when(F.col("event_type") == kind, most).otherwise(cap)
    fade = decay(F.col("timestamp"), as_of, s.half_life_days if half_life_days is None else half_life_days)
    return good.withColumn("capped", F.coalesce(F.row_number().over(newest) > cap, F.lit(False))).withColumn("decayed", F.col("weight") * fade)


def profile(events: DataFrame, as_of: Column, s: EventSettings = DEFAULT, half_life_days: float | None = None) -> DataFrame:
    """(user_id, movie_id, score, events_counted, types): capped, decayed sums, rounded to six places."""
    rows = counted(events, as_of, s, half_life_days).filter("not capped")
    return rows.groupBy("user_id", "movie_id").agg(F.round(F.sum("decayed"), 6).alias("score"), F.count("*").alias("events_counted"), F.array_sort(F.collect_set("event_type")).alias("types"))


def counters(events: DataFrame, as_of: Column, s: EventSettings = DEFAULT) -> DataFrame:
    """(user_id, counted, capped, ignored)."""
    ignored = weigh(events, s).groupBy("user_id").agg(F.count_if(F.col("reason").isNotNull()).alias("ignored"))
    good = counted(events, as_of, s).groupBy("user_id").agg(F.count_if(~F.col("capped")).alias("counted"), F.count_if("capped").alias("capped"))
    return ignored.join(good, "user_id", "left").select("user_id", F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("capped", F.lit(0)).alias("capped"), "ignored")


def ignored_by_reason(events: DataFrame, s: EventSettings = DEFAULT) -> DataFrame:
    """(reason, event_type, n) of the events that don't count."""
    return weigh(events, s).filter("reason is not null").groupBy("reason", F.coalesce(F.nullif(F.lower(F.trim("event_type")), F.lit("")), F.lit("<empty>")).alias("event_type")).agg(F.count("*").alias("n"))


def preferences(profiles: DataFrame, s: EventSettings = DEFAULT) -> DataFrame:
    """Profiles with ``disliked``, ``weight`` (score over the user's best, null if not positive) and the place among the liked."""
    user = W.partitionBy("user_id")
    best = F.max(F.when(F.col("score") > 0, F.col("score"))).over(user)
    liked = W.partitionBy("user_id", F.col("score") > 0).orderBy(F.desc("score"), "movie_id")
    return profiles.withColumn("disliked", F.col("score") <= s.dislike_at).withColumn("weight", F.when(F.col("score") > 0, F.round(F.col("score") / best, 6))).withColumn("place", F.when(F.col("score") > 0, F.row_number().over(liked)))


def recent(events: DataFrame, most: int = DEFAULT.most_events) -> tuple[DataFrame, DataFrame]:
    """(each user's newest ``most`` events, (user_id, truncated))."""
    order = W.partitionBy("user_id").orderBy(F.desc_nulls_last("timestamp"), "event_id")
    ranked = events.withColumn("nth", F.row_number().over(order))
    cut = events.groupBy("user_id").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("truncated"))
    return ranked.filter(F.col("nth") <= most), cut


def is_valid_interaction(as_of: Column, s: EventSettings = DEFAULT) -> Column:
    """Whether an event shows usable history.  Without a time it counts; a rating with a bad value does too."""
    t = F.lower(F.trim("event_type"))
    fresh = F.col("timestamp").isNull() | (F.col("timestamp") >= as_of - F.make_dt_interval(F.lit(s.valid_days)))
    ok = F.when(t == "watch", F.coalesce(to_number(F.col("value")) >= s.watch_threshold, F.lit(False))).when(t == "comment", sentiment(F.col("value")).isNotNull()).otherwise(True)
    return t.isin(*s.valid_types) & ok & fresh


def valid_counts(events: DataFrame, as_of: Column, s: EventSettings = DEFAULT) -> DataFrame:
    return events.groupBy("user_id").agg(F.count_if(is_valid_interaction(as_of, s)).alias("valid_count"))


def scenario_hint(user_id: Column, onboarded: Column, valid_count: Column, s: EventSettings = DEFAULT) -> Column:
    return F.when(user_id.isNull() | ~F.coalesce(onboarded, F.lit(False)), "guest").when(F.coalesce(valid_count, F.lit(0)) < s.enough_for_cf, "onboarding_user").otherwise("returning_user")


def user_profiles(events: DataFrame, as_of: Column, s: EventSettings = DEFAULT) -> DataFrame:
    """One row a user: hint, counters and an array of movies by score (movie_id, score, weight, disliked, events, types)."""
    newest, cut = recent(events, s.most_events)
    rows = preferences(profile(newest, as_of, s), s)
    nested = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "movie_id", "score", "weight", "disliked", "events_counted", "types"))).alias("movies"))
    base = cut.join(counters(newest, as_of, s), "user_id", "left").join(valid_counts(newest, as_of, s), "user_id", "left").join(nested, "user_id", "left")
    return base.withColumn("scenario_hint", scenario_hint(F.col("user_id"), F.lit(True), F.col("valid_count"), s))


def recommend_requests(events: DataFrame, given: DataFrame, as_of: Column, s: EventSettings = DEFAULT, most: int = 50) -> DataFrame:
    """(user_id, scenario_hint, valid_interaction_count_90d, recent_movies, exclude_movie_ids).

    ``given``: (user_id, exclude_movie_ids); the disliked movies are added.  ``recent_movies``: the newest ``most`` events' movies.
    """
    newest, _ = recent(events, s.most_events)
    lists = newest.filter(F.col("nth") <= most).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "movie_id"))), lambda x: x["movie_id"]).alias("recent_movies"))
    bad = preferences(profile(newest, as_of, s), s).filter("disliked").groupBy("user_id").agg(F.collect_set("movie_id").alias("disliked"))
    none = F.array().cast("array<bigint>")
    out = valid_counts(newest, as_of, s).join(lists, "user_id", "left").join(bad, "user_id", "left").join(given, "user_id", "left")
    return out.select(
        "user_id",
        scenario_hint(F.col("user_id"), F.lit(True), F.col("valid_count"), s).alias("scenario_hint"),
        F.col("valid_count").alias("valid_interaction_count_90d"),
        F.coalesce("recent_movies", none).alias("recent_movies"),
        F.array_sort(F.array_union(F.coalesce("disliked", none), F.coalesce("exclude_movie_ids", none))).alias("exclude_movie_ids"),
    )


def training_rows(events: DataFrame, as_of: Column, s: EventSettings = DEFAULT) -> DataFrame:
    """(user_id, movie_id, interaction_value, interaction_type, timestamp): scores without decay as ratings.

    The time is the latest of any event of the pair, counted or not; pairs without one, and
    events without a user, are left out.
    """
    known = events.filter("user_id is not null")
    scores = profile(known, as_of, s, half_life_days=0)
    last = known.groupBy("user_id", "movie_id").agg(F.max("timestamp").alias("timestamp"))
    return scores.join(last.filter("timestamp is not null"), ["user_id", "movie_id"]).select("user_id", "movie_id", F.round(score_to_rating(F.col("score")), 6).alias("interaction_value"), F.lit("event").alias("interaction_type"), "timestamp")


def promotion_gate(candidate: DataFrame, baseline: DataFrame, previous: DataFrame, least_users: int = 1000, tolerance: float = 0.05, metric: str = "hit_rate_10", low: float = 0.8, high: float = 1.25) -> DataFrame:
    """One row: whether the candidate may be promoted, and each condition.

    The inputs have (users_scored, ``metric``), one row or none; no candidate: no promotion; no
    previous model: nothing to fall behind.
    """
    one = F.lit(1).alias("one")
    side = lambda df, n: df.select(one, F.col("users_scored").alias(f"users_{n}"), F.col(metric).alias(f"metric_{n}")).limit(1)
    rows = candidate.sparkSession.range(1).select(one).join(side(candidate, "new"), "one", "left").join(side(baseline, "base"), "one", "left").join(side(previous, "old"), "one", "left")
    enough = F.coalesce(F.col("users_new") >= least_users, F.lit(False))
    beats = F.coalesce(F.col("metric_new") > F.col("metric_base"), F.lit(False))
    holds = F.col("metric_new").isNotNull() & F.coalesce(F.col("metric_new") >= F.col("metric_old") * (1 - tolerance), F.lit(True))
    ratio = F.col("users_new") / F.col("users_old")
    return rows.select(
        enough.alias("enough_users"), beats.alias("beats_popularity"), holds.alias("not_worse_than_previous"),
        F.coalesce((ratio < low) | (ratio > high), F.lit(False)).alias("protocol_mismatch"),
        (enough & beats & holds).alias("promote"),
    )
