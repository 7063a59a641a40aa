"""Sinks: Parquet, JSON lines, CSV samples, serving tables, model versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, functions as F


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A table, all or nothing; never onto a path that ``df`` is read from."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_observed(df: DataFrame, path: str, metrics: dict[str, Column], by: list[str] | None = None) -> dict[str, int]:
    """``write_parquet``, and the ``metrics`` (aggregates by name) of the rows as they pass: no second scan."""
    seen = Observation()
    write_parquet(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), path, by)
    return {n: int(v or 0) for n, v in seen.get.items()}


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int | None = None) -> DataFrame:
    """A table at ``path`` in ``buckets`` files by hash of ``key``, as it is read back: what joins, groups or windows such tables by ``key`` needs no shuffle.

    As many buckets as the session has shuffle partitions, unless told otherwise; tables that are to meet need the same number.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tidemark_{uuid.uuid4().hex}"
    df.repartition(n, key).sortWithinPartitions(key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


#: The columns a backend may see, and the names some get there.
SERVING = {"movie_id": "movie_id", "title": "title", "release_year": "release_year", "genres": "genres", "overview": "overview", "poster_path": "poster_path", "vote_average": "vote_average", "vote_count": "vote_count", "popularity": "popularity", "runtime": "runtime", "original_language": "original_language", "production_companies": "companies", "production_countries": "countries"}


def movies_serving(movies: DataFrame) -> DataFrame:
    """The columns a backend may see, as far as ``movies`` has them, by id."""
    return movies.select(*[F.col(c).alias(name) for c, name in SERVING.items() if c in movies.columns]).orderBy("movie_id")


def json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as JSON with sorted keys; nulls stay, NaN becomes null, times are ISO in UTC."""
    columns = []
    for name in sorted(df.columns):
        kind = df.schema[name].dataType.simpleString()
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.nullif(c, F.lit(float("nan")).cast(kind))
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        columns.append(c.alias(name))
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def popular_movies(top: DataFrame, genres: DataFrame, interactions: DataFrame) -> DataFrame:
    """(ranking_type, genre, movie_ids, scores, generated_at): a row a ranking, arrays by rank; the time is that of the data."""
    both = top.select(F.lit("top_rated_all").alias("ranking_type"), F.lit(None).cast("string").alias("genre"), "rank", "movie_id", "score").unionByName(
        genres.select(F.lit("top_rated_genre").alias("ranking_type"), "genre", "rank", "movie_id", "score")
    )
    lists = both.groupBy("ranking_type", "genre").agg(F.array_sort(F.collect_list(F.struct("rank", "movie_id", "score"))).alias("all"))
    when = interactions.agg(F.max("timestamp").alias("generated_at"))
    return lists.select("ranking_type", "genre", F.transform("all", lambda x: x["movie_id"]).alias("movie_ids"), F.transform("all", lambda x: x["score"]).alias("scores")).crossJoin(F.broadcast(when))


def interaction_examples(interactions: DataFrame, n: int = 3) -> DataFrame:
    """The first rows in the form of events."""
    first = interactions.orderBy("user_id", "timestamp", "movie_id").limit(n)
    return first.select(F.col("user_id").cast("string").alias("user_id"), "movie_id", F.lit("rating").alias("event_type"), F.col("rating").alias("value"), "timestamp", F.lit(None).cast("string").alias("session_id"))


def write_sample(df: DataFrame, path: str, order: list[str], n: int = 100) -> None:
    df.orderBy(*order).limit(n).write.mode("overwrite").option("header", True).csv(path)


def publish_model(user_factors: DataFrame, item_factors: DataFrame, manifest: dict[str, object], root: str, version: str) -> None:
    """Factor tables and a manifest row below ``root/models/version``; an existing version is an error.

    The pointer moves on its own (``point_to``).
    """
    spark = user_factors.sparkSession
    base = f"{root}/models/{version}"
    user_factors.write.mode("errorifexists").parquet(f"{base}/user_factors")
    item_factors.write.mode("errorifexists").parquet(f"{base}/item_factors")
    row = [(version, {k: str(v) for k, v in manifest.items()})]
    spark.createDataFrame(row, "version string, manifest map<string,string>").write.mode("append").parquet(f"{root}/registry")


def point_to(spark, root: str, version: str) -> None:  # noqa: ANN001
    known = spark.read.parquet(f"{root}/registry").filter(F.col("version") == version)
    if known.isEmpty():
        raise ValueError(f"no published version {version!r}")
    spark.createDataFrame([(version,)], "version string").withColumn("since", F.current_timestamp()).write.mode("overwrite").parquet(f"{root}/latest")


def write_report(rules: DataFrame, path: str) -> None:
    """A small table of rules or metrics as JSON lines with sorted keys."""
    write_json_lines(rules, path)
