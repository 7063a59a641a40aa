"""Chronological splits, their audit, merging of interaction eras, sampling of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def chronological(interactions: DataFrame, validation: int = 1, test: int = 1, least: int = 3, value: str = "rating") -> DataFrame:
    """``interactions`` and ``split``: each user's last rows are test, those before validation, the rest train.

    Users with fewer than max(``least``, validation + test + 1) rows are train only.
    """
    user = W.partitionBy("user_id")
    last = user.orderBy(F.desc("timestamp"), F.desc("movie_id"), F.desc(value))
    n, place = F.count("*").over(user), F.row_number().over(last)
    split = F.when(n < max(least, validation + test + 1), "train").when(place <= test, "test").when(place <= test + validation, "validation").otherwise("train")
    return interactions.withColumn("split", split)


def split_details(parts: DataFrame) -> DataFrame:
    return parts.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("users"), F.countDistinct("movie_id").alias("movies"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def split_audit(parts: DataFrame, source: DataFrame) -> DataFrame:
    """(check, value): rows not accounted for, pairs in two splits, repeated pairs, rows older than the split before, held-out users and test movies that train lacks."""
    train, rest = parts.filter("split = 'train'"), parts.filter("split <> 'train'")
    pairs = parts.groupBy("user_id", "movie_id").agg((F.min("split") < F.max("split")).alias("mixed"), F.count("*").alias("n"))
    edges = parts.groupBy("user_id").agg(
        F.max(F.when(F.col("split") == "train", F.col("timestamp"))).alias("train_last"),
        F.min(F.when(F.col("split") == "validation", F.col("timestamp"))).alias("validation_first"),
        F.max(F.when(F.col("split") == "validation", F.col("timestamp"))).alias("validation_last"),
        F.min(F.when(F.col("split") == "test", F.col("timestamp"))).alias("test_first"),
        F.count_if(F.col("split") == "train").alias("in_train"),
        F.count_if(F.col("split") != "train").alias("held"),
    )
    checks = [
        parts.agg(F.count("*").alias("n")).crossJoin(source.agg(F.count("*").alias("m"))).select(F.lit("rows_missing").alias("check"), (F.col("m") - F.col("n")).alias("value")),
        pairs.agg(F.count_if("mixed").alias("value")).select(F.lit("pairs_in_two_splits").alias("check"), "value"),
        pairs.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("value")).select(F.lit("repeated_pairs").alias("check"), "value"),
        edges.agg(F.count_if((F.col("train_last") > F.col("validation_first")) | (F.col("train_last") > F.col("test_first")) | (F.col("validation_last") > F.col("test_first"))).alias("value")).select(F.lit("users_out_of_order").alias("check"), "value"),
        edges.agg(F.count_if((F.col("held") > 0) & (F.col("in_train") == 0)).alias("value")).select(F.lit("held_out_users_without_train").alias("check"), "value"),
        rest.filter("split = 'test'").select("movie_id").distinct().join(train.select("movie_id").distinct(), "movie_id", "left_anti").agg(F.count("*").alias("value")).select(F.lit("test_movies_not_in_train").alias("check"), "value"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def merge_eras(old: DataFrame, new: DataFrame, policy: str = "prefer_rating") -> DataFrame:
    """``old`` and ``new`` rows, one a user and movie.

    ``prefer_rating``: a new row is left out if the pair exists at all; ``prefer_event``: it
    replaces the old one.  Write the result to another place than it is read from.
    """
    pair = ["user_id", "movie_id"]
    if policy == "prefer_rating":
        return old.unionByName(new.join(old.select(*pair).distinct(), pair, "left_anti").select(*old.columns))
    if policy == "prefer_event":
        return old.join(new.select(*pair).distinct(), pair, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
    raise ValueError(f"unknown merge policy {policy!r}")


def upsert(old: DataFrame, new: DataFrame, policy: str = "prefer_rating") -> DataFrame:
    """``old`` and ``new`` with the event row of the latest ``batch`` for each pair, and the rows of other types, by the policy of ``merge_eras``.

    In one window over the pair; the same rows again, or older ones, change nothing.
    """
    if policy not in ("prefer_rating", "prefer_event"):
        raise ValueError(f"unknown merge policy {policy!r}")
    event = F.col("interaction_type") == "event"
    pair = W.partitionBy("user_id", "movie_id")
    nth = F.row_number().over(W.partitionBy("user_id", "movie_id", event).orderBy(F.desc("batch"), F.desc("timestamp"), F.desc("interaction_value")))
    rows = old.unionByName(new).withColumns({"__event__": event, "__nth__": nth, "__events__": F.max(event).over(pair), "__others__": F.max(~event).over(pair)})
    keep_event, keep_other = (F.lit(True), ~F.col("__events__")) if policy == "prefer_event" else (~F.col("__others__"), F.lit(True))
    kept = F.when(F.col("__event__"), (F.col("__nth__") == 1) & keep_event).otherwise(keep_other)
    return rows.filter(kept).select(*old.columns)


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(new_rows, pairs_known, pairs_added)."""
    pair = ["user_id", "movie_id"]
    known = old.select(*pair).distinct().withColumn("known", F.lit(1))
    return new.join(known, pair, "left").agg(F.count("*").alias("new_rows"), F.count("known").alias("pairs_known"), F.count_if(F.col("known").isNull()).alias("pairs_added"))


def sample_users(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All rows of ``n`` users: those of least hash, the same at any partitioning."""
    users = df.select("user_id").distinct().orderBy(F.xxhash64("user_id", F.lit(seed)), "user_id").limit(n)
    return df.join(users, "user_id", "left_semi")
