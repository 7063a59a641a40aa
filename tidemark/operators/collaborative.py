"""Implicit and explicit ALS on MLlib, exact batch recommendation from factors."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.scalars import confidence, preference

from .neighbours import top_lists, top_products


def training_matrix(ratings: DataFrame, positive: float = 4.0, negative: float = 2.5, neutral: str = "exclude", neutral_weight: float = 0.1, alpha: float = 40.0, least: int = 5) -> DataFrame:
    """(user_id, movie_id, w, confidence) of the rows an implicit model learns from.

    Ratings from ``positive`` on; those between ``negative`` and it only with policy
    ``low_confidence``, at ``neutral_weight``; then movies with ``least`` kept rows at least.
    """
    if neutral not in ("exclude", "low_confidence"):
        raise ValueError(f"unknown policy {neutral!r}")
    good, middle = F.col("rating") >= positive, (F.col("rating") > negative) & (F.col("rating") < positive)
    rows = ratings.filter(good | middle if neutral == "low_confidence" else good)
    weight = F.when(good, preference(F.col("rating"))).otherwise(neutral_weight)
    conf = F.when(good, confidence(F.col("rating"), alpha)).otherwise(1 + alpha * neutral_weight)
    kept = rows.withColumn("n", F.count("*").over(W.partitionBy("movie_id"))).filter(F.col("n") >= least)
    return kept.select("user_id", "movie_id", weight.alias("w"), conf.alias("confidence"))


def matrix_stats(ratings: DataFrame, matrix: DataFrame, positive: float = 4.0, negative: float = 2.5) -> DataFrame:
    """One row: rows of each class, and the size and sparsity of what is kept."""
    a = ratings.agg(
        F.count_if(F.col("rating") >= positive).alias("positive"),
        F.count_if((F.col("rating") > negative) & (F.col("rating") < positive)).alias("neutral"),
        F.count_if(F.col("rating") <= negative).alias("negative"),
    )
    b = matrix.agg(F.count("*").alias("kept"), F.countDistinct("user_id").alias("users"), F.countDistinct("movie_id").alias("movies"))
    return a.crossJoin(b).withColumn("sparsity", F.round(1 - F.col("kept") / (F.col("users") * F.col("movies")), 6))


def train_implicit(matrix: DataFrame, rank: int = 64, iterations: int = 20, reg: float = 0.05, alpha: float = 40.0, seed: int = 42) -> ALSModel:
    """An implicit model; Spark adds 1 to alpha x w itself, so w is passed, not the confidence."""
    if matrix.isEmpty():
        raise ValueError("no rows to train on")
    als = ALS(rank=rank, maxIter=iterations, regParam=reg, alpha=alpha, implicitPrefs=True, seed=seed, userCol="user_id", itemCol="movie_id", ratingCol="w", coldStartStrategy="drop", checkpointInterval=5)
    return als.fit(matrix.select(F.col("user_id").cast("int"), F.col("movie_id").cast("int"), F.col("w").cast("float")))


def train_explicit(ratings: DataFrame, rank: int = 50, iterations: int = 10, reg: float = 0.1, seed: int = 42) -> ALSModel:
    als = ALS(rank=rank, maxIter=iterations, regParam=reg, seed=seed, userCol="user_id", itemCol="movie_id", ratingCol="rating", coldStartStrategy="drop", checkpointInterval=5)
    return als.fit(ratings.select(F.col("user_id").cast("int"), F.col("movie_id").cast("int"), F.col("rating").cast("float")))


def negatives(ratings: DataFrame, negative: float = 2.5) -> DataFrame:
    """(user_id, movie_id) rated so low that they are not to be recommended."""
    return ratings.filter(F.col("rating") <= negative).select("user_id", "movie_id").distinct()


def known_users(requests: DataFrame, user_factors: DataFrame) -> DataFrame:
    ids = user_factors.select(F.col("id").cast("bigint").alias("user_id"), F.lit(True).alias("k"))
    return requests.join(ids, "user_id", "left").withColumn("known", F.coalesce("k", F.lit(False))).drop("k")


def recommend(users: DataFrame, user_factors: DataFrame, item_factors: DataFrame, excluded: DataFrame | None, top: int = 100) -> DataFrame:
    """(user_id, rank, movie_id, score, reason): each known user's best items by dot product, exactly.

    ``users``: (user_id); ``excluded``: (user_id, movie_id), taken out before the cut: each user's list
    is drawn as much longer as items are excluded for them.  None: nothing is.
    """
    wanted = user_factors.select(F.col("id").cast("bigint").alias("user_id"), "features").join(users.select("user_id").distinct(), "user_id", "left_semi")
    best = W.partitionBy("user_id").orderBy(F.desc("score"), "movie_id")
    columns = ["user_id", F.row_number().over(best).alias("rank"), "movie_id", "score", F.lit("similar_users").alias("reason")]
    items = item_factors.select(F.col("id").cast("bigint").alias("id"), "features")
    if excluded is None:
        out = top_products(wanted.withColumnRenamed("user_id", "id"), items, "id", "features", top)
        return out.select(F.col("id").alias("user_id"), F.col("other").alias("movie_id"), "score").select(*columns)
    bad = excluded.select("user_id", "movie_id").distinct().hint("merge")  # files are smaller than their rows: never broadcast by their size
    need = bad.groupBy(F.col("user_id").alias("id")).agg((F.count("*") + top).alias("n"))
    out = top_products(wanted.withColumnRenamed("user_id", "id"), items, "id", "features", top, need=need)
    rows = out.select(F.col("id").alias("user_id"), F.col("other").alias("movie_id"), "score").join(bad, ["user_id", "movie_id"], "left_anti")
    return rows.select(*columns).filter(F.col("rank") <= top)


def lists(users: DataFrame, item_factors: DataFrame, gone: DataFrame, top: int = 100) -> DataFrame:
    """(user_id, ids: the items of ``recommend`` in their order) of ``users`` (id, features); ``gone`` (id, gone: an array of excluded items)."""
    found = top_lists(users, item_factors.select(F.col("id").cast("bigint").alias("id"), "features"), "id", "features", top, gone=gone)
    return found.select(F.col("id").alias("user_id"), F.transform("l", lambda x: x["other"]).alias("ids"))
