"""The driver's tables in the roles of a catalogue, raw ratings, id links and events.

Faults are planted by rule, so that every rejection reason is met.  The same rules
stand as SQL in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import cleaning
from tidemark.sources import scratch
from tidemark.sources.scratch import scratch_folder  # noqa: F401

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for what is read more than once."""
    return scratch.stored(df, name)


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


def raw_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as in a CSV file, with copies, bad ids, empty titles and poorer rows of the same id."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    base = p.select(
        (k * 4).alias("source_row"),
        F.when(k % 89 == 0, "not-an-id").otherwise(k.cast("string")).alias("id"),
        F.when(k % 83 == 0, F.lit(" nan ")).otherwise(F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).alias("title"),
        F.when(k % 7 == 0, F.lit(" N/A ")).otherwise(F.lit(" EN ")).alias("original_language"),
        ((k * 7 % 113) / 10.0).cast("string").alias("vote_average"),
        F.when(k % 11 == 0, "many").otherwise(F.col("p_size").cast("string")).alias("vote_count"),
        (k % 200 - 5).cast("string").alias("runtime"),
        F.col("p_retailprice").cast("string").alias("popularity"),
        F.when(k % 13 == 0, "soon").otherwise(F.concat((1860 + k % 200).cast("string"), F.lit("-05-17"))).alias("release_date"),
    )
    copy = base.filter("(source_row / 4) % 97 = 0").withColumn("source_row", F.col("source_row") + 1)
    poor = base.filter("(source_row / 4) % 79 = 0").withColumn("source_row", F.col("source_row") + 2).withColumn("vote_count", F.lit(None).cast("string"))
    return base.unionByName(copy).unionByName(poor)


def raw_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_movies`` with all columns of the raw catalogue: lists as Python literals and as JSON, empty, malformed and repeated."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_type", "p_brand", "p_size")
    k = F.col("k")
    genres = F.when(k % 23 == 0, "[{'id': ").when(k % 10 == 0, "[]").otherwise(F.format_string("[{'id': 1, 'name': '%s', 'x': None}, {'id': 2, 'name': ' %s '}, {'id': 3, 'name': '%s'}]", "p_type", "p_brand", F.lower("p_type")))
    wide = p.select(
        k,
        F.when(k % 5 == 0, " none ").otherwise(F.concat(F.lit("tt"), F.lpad(k.cast("string"), 7, "0"))).alias("imdb_id"),
        F.upper("p_name").alias("original_title"),
        F.when(k % 6 != 0, F.concat(F.lit("A  "), F.col("p_name"))).alias("overview"),
        F.when(k % 9 != 0, F.concat(F.lit("/p"), k.cast("string"))).alias("poster_path"),
        genres.alias("genres"),
        F.format_string('[{"id": %d, "name": "%s"}, {"id": %d, "name": "%s"}, {"id": 900, "name": "%s"}]', "p_size", "p_brand", "p_size", F.upper("p_brand"), "p_brand").alias("production_companies"),
        F.when(k % 4 == 0, '[{"iso_3166_1": "us", "name": ""}]').otherwise('[{"iso_3166_1": "fr", "name": "France"}, {"iso_3166_1": "FR", "name": "FRANCE"}]').alias("production_countries"),
    )
    rows = raw_movies(spark, sf_dir)
    return rows.withColumn("k", F.floor(F.col("source_row") / 4)).join(wide, "k").drop("k")


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: movie_id, title, genres, vote_count, vote_average."""
    p = table(spark, sf_dir, "part")
    return p.filter("p_partkey > 0").select(
        F.col("p_partkey").alias("movie_id"),
        F.col("p_name").alias("title"),
        F.array("p_type", "p_brand").alias("genres"),
        F.col("p_size").cast("long").alias("vote_count"),
        (F.col("p_partkey") * 7 % 101 / 10.0).alias("vote_average"),
    )


def keyword_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a content table: some of the catalogue's are missing, some are unknown there."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter("p_partkey % 17 <> 0").select(F.when(k % 61 == 0, k + 800000).otherwise(k).alias("id"))


def credit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter("p_partkey % 19 <> 0").select(F.when(k % 67 == 0, k + 800000).otherwise(k).alias("id"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    target = F.when(k % 50 == 7, None).when(k % 50 == 8, k + 900000).when(k % 100 == 99, k - 1).otherwise(k)
    return table(spark, sf_dir, "part").select(k.alias("source_row"), k.alias("source_id"), target.alias("target_id"))


def raw_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") % 97
    return li.join(o.hint("merge"), li["l_orderkey"] == o["o_orderkey"]).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_row"),
        F.when(k == 0, F.lit(-1)).otherwise(F.col("o_custkey")).alias("user_id"),
        F.when(k == 1, F.lit(-1)).when(k == 2, F.col("l_partkey") + 1000000).otherwise(F.col("l_partkey")).alias("source_movie_id"),
        F.when(k == 3, 9.5).otherwise(F.ceil(F.col("l_quantity") / 5) * 0.5).cast("double").alias("rating"),
        F.when(k == 4, 0).otherwise(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("epoch"),
    )


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.map_ids(links(spark, sf_dir), movies(spark, sf_dir))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.resolve_duplicates(cleaning.flag_ratings(raw_ratings(spark, sf_dir), mapping(spark, sf_dir)))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean ratings: user_id, movie_id, rating, timestamp."""
    return cleaning.latest_ratings(cleaning.flag_ratings(raw_ratings(spark, sf_dir), mapping(spark, sf_dir))).select("user_id", "movie_id", "rating", "timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"))


def as_events(e: DataFrame) -> DataFrame:
    """Interaction events: event_id, user_id, movie_id, event_type, value (text), timestamp."""
    odd = F.col("event_id") % 3
    kind = (
        F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "purchase", "share").when(F.col("event_type") == "view", "watch").when(F.col("event_type") == "signup", "comment")
        .when(odd == 0, "dislike").when(odd == 1, "rating").otherwise("teleport")
    )
    value = (
        F.when(F.col("event_type") == "view", F.round(F.col("value") / 100, 6))
        .when(F.col("event_type") == "signup", F.when(F.col("event_id") % 4 != 0, F.round(F.col("value") / 50 - 1, 6)))
        .when((F.col("event_type") == "error") & (odd == 1), F.ceil(F.least(F.col("value"), F.lit(50.0)) / 5) * 0.5)
        .otherwise(F.col("value"))
    )
    # Half of the events meet few movies often, so that caps are reached; the others many.
    key = F.get_json_object("props", "$.k").cast("long")
    movie = F.when(F.col("event_id") % 2 == 0, key % 5).otherwise(key)
    return e.select("event_id", "user_id", movie.alias("movie_id"), kind.alias("event_type"), value.cast("string").alias("value"), F.col("ts").cast("timestamp").alias("timestamp"))
