"""Shrunk-mean rankings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.scalars import weighted_rating
from tidemark.sources import scratch


def movie_stats(interactions: DataFrame, value: str = "rating") -> DataFrame:
    return interactions.groupBy("movie_id").agg(F.count("*").alias("rating_count"), F.sum(value).alias("rating_sum"), F.avg(value).alias("average_rating"))


def higher_quantile(df: DataFrame, column: str, q: float, by: list[str] | None = None, name: str = "m") -> DataFrame:
    """The value at place ceil(q (n - 1)) from 0 on, in each group.

    Taken from a histogram of the values, so that the window runs over distinct values only.
    """
    if not by:
        return higher_quantiles(df, column, (q,), name).select(name)
    histogram = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("k"))
    order = W.partitionBy(*by).orderBy(column)
    upto = histogram.withColumn("upto", F.sum("k").over(order)).withColumn("n", F.sum("k").over(W.partitionBy(*by)))
    place = F.ceil(F.lit(float(q)) * (F.col("n") - 1)) + 1
    return upto.filter(F.col("upto") >= place).groupBy(*by).agg(F.min(column).alias(name))


def higher_quantiles(df: DataFrame, column: str, quantiles: tuple[float, ...], name: str = "m") -> DataFrame:
    """(percentile, ``name``): for each quantile the value at place ceil(q (n - 1)) from 0 on of the whole table.

    The histogram of the values stands in ranges; the ranges' sums, one number a partition, are added up on
    the driver, which says in what range each quantile lies.  Only there are values counted up, range by range.
    """
    spark = df.sparkSession
    fields = f"percentile double, {name} {df.schema[column].dataType.simpleString()}"
    histogram = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("k"))
    ranged = scratch.stored(histogram.repartitionByRange(column).withColumn("__part__", F.spark_partition_id()), "histogram")
    sums = ranged.groupBy("__part__").agg(F.sum("k").alias("k")).orderBy("__part__").collect()
    n, before, wanted = sum(r["k"] for r in sums), 0, []
    places = [(q, math.ceil(q * (n - 1)) + 1) for q in quantiles]
    for r in sums:
        wanted += [(r["__part__"], float(q), place - before) for q, place in places if before < place <= before + r["k"]]
        before += r["k"]
    if not wanted:
        return spark.createDataFrame([], fields)
    asked = F.broadcast(spark.createDataFrame(wanted, "__part__ int, percentile double, place long"))
    upto = F.sum("k").over(W.partitionBy("__part__").orderBy(column))
    return ranged.join(asked.select("__part__").distinct(), "__part__", "left_semi").withColumn("upto", upto).join(asked, "__part__").filter(F.col("upto") >= F.col("place")).groupBy("percentile").agg(F.min(column).alias(name))


def threshold_candidates(stats: DataFrame, quantiles: tuple[float, ...] = (0.8, 0.9, 0.95)) -> DataFrame:
    """(percentile, m, eligible): how many movies have at least the quantile's count."""
    stats = scratch.stored(stats, "stats")  # a row a movie, read for the quantiles and for the counts
    m = higher_quantiles(stats, "rating_count", quantiles)
    return stats.crossJoin(F.broadcast(m)).groupBy("percentile", "m").agg(F.count_if(F.col("rating_count") >= F.col("m")).alias("eligible"))


def global_mean(stats: DataFrame) -> DataFrame:
    return stats.agg((F.sum("rating_sum") / F.sum("rating_count")).alias("c"))


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with places from 1 on by ``order`` (a total order), for tables of any size.

    Rows are dealt out by ranges of the order and numbered within each; the ranges' sizes, one number
    a partition, are added up on the driver.  The ranges are kept, as others might be drawn the next time.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part__", F.spark_partition_id()).withColumn("__place__", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = scratch.stored(ranged, "ranges")
    starts, total = [], 0
    for r in ranged.groupBy("__part__").count().orderBy("__part__").collect():
        starts.append((r["__part__"], total))
        total += r["count"]
    offsets = rows.sparkSession.createDataFrame(starts, "__part__ int, __start__ long")
    placed = ranged.join(F.broadcast(offsets), "__part__")
    return placed.select(*[c for c in rows.columns if c != name], (F.col("__start__") + F.col("__place__") + 1).alias(name))


def first_rows(rows: DataFrame, order: list[Column], top: int, name: str = "rank") -> DataFrame:
    """The first ``top`` rows by ``order`` (a total order) with their places from 1 on: a distributed top-k, whose few rows make one list."""
    columns = [c for c in rows.columns if c != name]
    listed = rows.orderBy(*order).limit(top).agg(F.collect_list(F.struct(*columns)).alias("l"))
    return listed.select(F.posexplode("l").alias("p", "r")).select((F.col("p") + 1).alias(name), "r.*")


def _order() -> list[Column]:
    return [F.desc("score"), F.desc("rating_count"), F.desc("average_rating"), F.asc("movie_id")]


def _ranked(scored: DataFrame, by: list[str], top: int | None) -> DataFrame:
    out = scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*_order())))
    return out if top is None else out.filter(F.col("rank") <= top)


def _score() -> Column:
    return F.round(weighted_rating(F.col("average_rating"), F.col("rating_count"), F.col("c"), F.col("m")), 9)


def top_rated(stats: DataFrame, catalogue: DataFrame | None = None, q: float = 0.9, top: int | None = 100) -> DataFrame:
    """(rank, movie_id, score, average_rating, rating_count): movies with at least the quantile's count, by shrunk mean.

    Without a catalogue all rated movies are ranked; ``top`` None keeps all.  Scores are rounded
    to nine places before they are compared, so the order doesn't hang on the order of sums.
    """
    rated = stats if catalogue is None else stats.join(catalogue.select("movie_id").distinct(), "movie_id", "left_semi")
    rated = scratch.stored(rated, "rated")  # a row a movie, read for the quantile, the mean and the scores
    scalars = global_mean(rated).crossJoin(higher_quantile(rated, "rating_count", q))
    scored = rated.crossJoin(F.broadcast(scalars)).filter("rating_count >= m").withColumn("score", _score())
    columns = ["rank", "movie_id", "score", "average_rating", "rating_count"]
    if top is None:
        return numbered(scored, _order()).select(*columns)
    return first_rows(scored, _order(), top).select(*columns)


def by_count(stats: DataFrame, top: int | None = None) -> DataFrame:
    """(rank, movie_id): rated movies by their number of ratings, all or the first ``top`` (a number that one task can rank)."""
    if top is not None:
        return first_rows(stats, [F.desc("rating_count"), F.asc("movie_id")], top).select("rank", "movie_id")
    return numbered(stats, [F.desc("rating_count"), F.asc("movie_id")]).select("rank", "movie_id")


def by_genre(stats: DataFrame, movies: DataFrame, q: float = 0.9, top: int = 50, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rankings, coverage) for each element of the array column ``genres``.

    The threshold is the genre's own, the mean it shrinks to is that of the whole catalogue.  A
    genre with fewer than ``least`` eligible movies is not ranked.
    """
    rated = scratch.stored(stats.join(movies.select("movie_id", "genres"), "movie_id"), "rated")
    each = rated.select("movie_id", "rating_count", "average_rating", F.explode("genres").alias("genre")).distinct()
    m = higher_quantile(each, "rating_count", q, ["genre"])
    with_m = each.join(m, "genre")
    coverage = with_m.groupBy("genre", "m").agg(F.count("*").alias("rated"), F.count_if(F.col("rating_count") >= F.col("m")).alias("eligible")).withColumn("included", F.col("eligible") >= least)
    scored = with_m.join(coverage.filter("included").select("genre"), "genre", "left_semi").filter("rating_count >= m").crossJoin(F.broadcast(global_mean(rated))).withColumn("score", _score())
    return _ranked(scored, ["genre"], top).select("genre", "rank", "movie_id", "score", "average_rating", "rating_count"), coverage


def guest_lookup(requests: DataFrame, top: DataFrame, genres: DataFrame, limit: int = 20) -> DataFrame:
    """(request_id, ranking, warning, rank, movie_id, score) of requests (request_id, genre).

    Null, blank and ALL ask for the overall ranking; an unknown genre gets it with a warning.
    """
    wanted = F.lower(F.trim(F.coalesce("genre", F.lit(""))))
    asks = requests.select("request_id", wanted.alias("wanted"))
    known = genres.select(F.lower(F.trim("genre")).alias("wanted"), F.col("genre").alias("found")).distinct()
    routed = asks.join(F.broadcast(known), "wanted", "left").withColumn("warning", F.col("found").isNull() & ~F.col("wanted").isin("", "all"))
    both = genres.select("genre", "rank", "movie_id", "score").unionByName(top.select(F.lit(None).cast("string").alias("genre"), "rank", "movie_id", "score")).filter(F.col("rank") <= limit)
    return routed.join(both, routed["found"].eqNullSafe(both["genre"])).select("request_id", F.coalesce("found", F.lit("ALL")).alias("ranking"), "warning", "rank", "movie_id", "score")
