"""Queries: cleaning, rankings, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import scalars as S
from tidemark.operators import cleaning, rankings, splits

from . import adapters as A
from .oracle import CTES, sql
from .registry import query


@query(
    "g4_top_rated",
    sql("SELECT rank, movie_id, round(score, 6) AS score, round(average_rating, 6) AS average_rating, rating_count FROM top_rated"),
)
def top_rated(spark: SparkSession, d: str) -> DataFrame:
    out = rankings.top_rated(rankings.movie_stats(A.ratings(spark, d)), A.movies(spark, d))
    return out.select(F.col("rank").cast("long").alias("rank"), "movie_id", F.round("score", 6).alias("score"), F.round("average_rating", 6).alias("average_rating"), "rating_count")


@query("d1_movies_clean", sql("SELECT source_row, movie_id, title, original_language, vote_average, vote_count, runtime, popularity, CAST(release_year AS SMALLINT) AS release_year FROM flagged_movies WHERE rejection_reason IS NULL"))
def movies_clean(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.kept(cleaning.flag_movies(A.raw_movies(spark, d)))


@query("d3_movies_rejected", sql("SELECT source_row, raw_id, raw_title, rejection_reason, duplicate_of_movie_id FROM flagged_movies WHERE rejection_reason IS NOT NULL"))
def movies_rejected(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.rejected(cleaning.flag_movies(A.raw_movies(spark, d)))


@query("d4_movie_genres", sql("SELECT DISTINCT movie_id, unnest(genres) AS genre FROM movies"))
def movie_genres(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.child_table(A.movies(spark, d), "movie_id", "genres", "genre")


_WORDS_SQL = sql("""SELECT movie_id, string_agg(value, '|' ORDER BY spot) AS keywords FROM (
  SELECT movie_id, lower(value) AS f, arg_min(value, source_row * 10 + pos) AS value, min(source_row * 10 + pos) AS spot
  FROM (SELECT p_partkey // 10 + 1 AS movie_id, p_partkey AS source_row, unnest([p_type, upper(p_brand), lower(p_type)]) AS value, unnest([1, 2, 3]) AS pos FROM part)
  SEMI JOIN movies USING (movie_id) GROUP BY 1, 2
) GROUP BY movie_id""")


@query("d5_merged_lists", _WORDS_SQL)
def merged_lists(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    rows = p.select((F.floor(F.col("p_partkey") / 10) + 1).cast("string").alias("movie_id"), F.col("p_partkey").alias("source_row"), F.array("p_type", F.upper("p_brand"), F.lower("p_type")).alias("keywords"))
    out = cleaning.merge_lists(rows, "movie_id", "keywords", "source_row", A.movies(spark, d))
    return out.select("movie_id", F.array_join("keywords", "|").alias("keywords"))


@query("d6_id_mapping", sql("SELECT source_id AS raw_source_id, source_movie_id, movie_id, status FROM mapping"))
def id_mapping(spark: SparkSession, d: str) -> DataFrame:
    return A.mapping(spark, d)


@query("d7_mapping_status", sql("SELECT status, count(*) AS source_ids, CAST(sum(CASE WHEN movie_id IS NOT NULL AND n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS aliases FROM (SELECT *, count(*) OVER (PARTITION BY movie_id) AS n FROM mapping) GROUP BY status"))
def mapping_status(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.mapping_summary(A.mapping(spark, d))


@query("d8_rating_reasons", sql("SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM flagged_ratings GROUP BY 1"))
def rating_reasons(spark: SparkSession, d: str) -> DataFrame:
    flagged = cleaning.flag_ratings(A.raw_ratings(spark, d), A.mapping(spark, d))
    return flagged.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("d9_ratings_clean", sql("SELECT user_id, movie_id, rating, make_timestamp(epoch * 1000000) AS timestamp, source_movie_id, source_row FROM resolved WHERE reason IS NULL"))
def ratings_clean(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.ratings_clean(A.resolved(spark, d)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("d9_ratings_rejected", sql("SELECT source_row, user_id AS user_raw, source_movie_id AS source_raw, rating AS rating_raw, epoch AS epoch_raw, reason FROM resolved WHERE reason IS NOT NULL"))
def ratings_rejected(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.ratings_rejected(A.resolved(spark, d))


@query("d10_users", sql("SELECT user_id, count(*) AS rating_count, min(timestamp) AS first_rating, max(timestamp) AS last_rating FROM ratings GROUP BY user_id"))
def users(spark: SparkSession, d: str) -> DataFrame:
    out = cleaning.users_clean(A.ratings(spark, d))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_rating", "last_rating")})


@query(
    "d11_cleaning_summary",
    sql("""SELECT 'rows_in' AS metric, count(*) AS value FROM flagged_movies UNION ALL SELECT 'rows_out', count(*) FILTER (rejection_reason IS NULL) FROM flagged_movies
UNION ALL SELECT 'rows_removed', count(*) FILTER (rejection_reason IS NOT NULL) FROM flagged_movies
UNION ALL SELECT 'null_vote_count', count(*) FILTER (rejection_reason IS NULL AND vote_count IS NULL) FROM flagged_movies
UNION ALL SELECT 'null_release_year', count(*) FILTER (rejection_reason IS NULL AND release_year IS NULL) FROM flagged_movies
UNION ALL SELECT 'reason_' || rejection_reason, count(*) FROM flagged_movies WHERE rejection_reason IS NOT NULL GROUP BY 1"""),
)
def cleaning_summary(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.cleaning_summary(cleaning.flag_movies(A.raw_movies(spark, d)), "rejection_reason", ["vote_count", "release_year"])


@query("d12_restricted", sql("SELECT (SELECT count(*) FROM raw_ratings SEMI JOIN movies ON source_movie_id = movie_id) AS kept, (SELECT count(*) FROM raw_ratings ANTI JOIN movies ON source_movie_id = movie_id) AS dropped"))
def restricted(spark: SparkSession, d: str) -> DataFrame:
    kept, dropped = cleaning.restrict_to(A.raw_ratings(spark, d).withColumnRenamed("source_movie_id", "movie_id"), A.movies(spark, d))
    return kept.agg(F.count("*").alias("kept")).crossJoin(dropped)


@query("c_scalars", """
SELECT p_partkey, 'tt' || CASE WHEN p_partkey < 10000000 THEN lpad(CAST(p_partkey AS VARCHAR), 7, '0') ELSE CAST(p_partkey AS VARCHAR) END AS imdb_id,
  trim(regexp_replace(regexp_replace(lower(p_brand), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean_text,
  'genre_' || lower(p_type) || ' genre_' || replace(trim(regexp_replace(regexp_replace(lower(p_brand), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ', '_') AS tokens,
  round(1 + 40 * least(greatest((p_size / 10.0 - 3.5) / 1.5, 0), 1), 6) AS confidence,
  round(least(greatest(p_size, 0) / 20.0, 1), 6) AS cf, round(1 - 0.75 * least(greatest(p_size, 0) / 20.0, 1), 6) AS cb,
  round(CASE WHEN p_size >= 25 THEN 3.0 + least((p_size - 25) / 15.0, 1) * 2.0 ELSE 3.0 + greatest((p_size - 25) / 15.0, -1) * 2.5 END, 6) AS pseudo_rating,
  round(least(greatest((p_size / 10.0 - 3) / 2.0, -1), 1), 6) AS stars,
  least(greatest(round(p_size / 40.0 - (1 - p_size / 40.0), 6), -1), 1) AS classes
FROM part""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    p, size = A.table(spark, d, "part"), F.col("p_size")
    w = S.source_weights(size)
    return p.select(
        "p_partkey",
        S.imdb_id(F.col("p_partkey")).alias("imdb_id"),
        S.clean_free_text(F.col("p_brand")).alias("clean_text"),
        F.array_join(S.prefixed_tokens("genre", F.array("p_type", "p_brand")), " ").alias("tokens"),
        F.round(S.confidence(size / 10.0), 6).alias("confidence"),
        F.round(w["cf"], 6).alias("cf"),
        F.round(w["cb"], 6).alias("cb"),
        F.round(S.score_to_rating((size - 25).cast("double")), 6).alias("pseudo_rating"),
        F.round(S.sentiment_from_stars(size / 10.0), 6).alias("stars"),
        F.round(S.sentiment_from_classes(size / 40.0, 1 - size / 40.0), 6).alias("classes"),
    )


@query("c23_title_search", sql("SELECT movie_id, title, vote_count FROM movies WHERE contains(lower(title), 'ring') ORDER BY vote_count DESC, movie_id LIMIT 10"))
def title_search(spark: SparkSession, d: str) -> DataFrame:
    return S.title_search(A.movies(spark, d), "RING").select("movie_id", "title", "vote_count")


@query("g1_movie_stats", sql("SELECT movie_id, rating_count, rating_sum, round(average_rating, 6) AS average_rating FROM stats"))
def movie_stats(spark: SparkSession, d: str) -> DataFrame:
    return rankings.movie_stats(A.ratings(spark, d)).withColumn("average_rating", F.round("average_rating", 6))


@query("g3_thresholds", sql("""SELECT q AS percentile, min(rating_count) AS m, (SELECT count(*) FROM stats s WHERE s.rating_count >= min(x.rating_count)) AS eligible
FROM (SELECT rating_count, row_number() OVER (ORDER BY rating_count) AS rn, count(*) OVER () AS n FROM stats) x, (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) v(q) WHERE rn >= ceil(q * (n - 1)) + 1 GROUP BY q"""))
def thresholds(spark: SparkSession, d: str) -> DataFrame:
    return rankings.threshold_candidates(rankings.movie_stats(A.ratings(spark, d)))


@query("g5_genre_rankings", sql("SELECT genre, rank, movie_id, round(score, 6) AS score, round(average_rating, 6) AS average_rating, rating_count FROM genre_rated"))
def genre_rankings(spark: SparkSession, d: str) -> DataFrame:
    ranked, _ = rankings.by_genre(rankings.movie_stats(A.ratings(spark, d)), A.movies(spark, d))
    return ranked.withColumns({"rank": F.col("rank").cast("long"), "score": F.round("score", 6), "average_rating": F.round("average_rating", 6)})


@query("g6_genre_coverage", sql("SELECT genre, m, rated, eligible, included FROM genre_coverage"))
def genre_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rankings.by_genre(rankings.movie_stats(A.ratings(spark, d)), A.movies(spark, d))[1]


def requests(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "customer").filter("c_custkey > 0")
    k = F.col("c_custkey")
    genre = F.when(k % 5 == 0, None).when(k % 5 == 1, " ").when(k % 5 == 2, F.lit(" economy ")).when(k % 5 == 3, "Promo").otherwise("western")
    return c.select(k.alias("request_id"), genre.alias("genre"))


@query("g7_guest_lookup", sql("""SELECT request_id, coalesce(found, 'ALL') AS ranking, found IS NULL AND wanted NOT IN ('', 'all') AS warning, rank, movie_id, round(score, 6) AS score FROM (
  SELECT c_custkey AS request_id, lower(trim(coalesce(CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN ' economy ' WHEN 3 THEN 'Promo' ELSE 'western' END, ''))) AS wanted FROM customer WHERE c_custkey > 0
) LEFT JOIN (SELECT DISTINCT lower(trim(genre)) AS wanted, genre AS found FROM genre_rated) USING (wanted)
JOIN (SELECT genre, rank, movie_id, score FROM genre_rated UNION ALL SELECT NULL, rank, movie_id, score FROM top_rated) b ON found IS NOT DISTINCT FROM b.genre WHERE rank <= 20"""))
def guest_lookup(spark: SparkSession, d: str) -> DataFrame:
    stats, movies = A.stored(spark, rankings.movie_stats(A.ratings(spark, d)), "stats"), A.movies(spark, d)
    genres = A.stored(spark, rankings.by_genre(stats, movies)[0], "rankings")
    out = rankings.guest_lookup(requests(spark, d), rankings.top_rated(stats, movies), genres)
    return out.withColumns({"rank": F.col("rank").cast("long"), "score": F.round("score", 6)})


@query("g8_split", sql("SELECT user_id, movie_id, rating, timestamp, split FROM parts"))
def split(spark: SparkSession, d: str) -> DataFrame:
    return splits.chronological(A.ratings(spark, d)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("g8_split_minimum_30", sql("SELECT split, count(*) AS n FROM (SELECT CASE WHEN n < 30 THEN 'train' WHEN place <= 1 THEN 'test' WHEN place <= 2 THEN 'validation' ELSE 'train' END AS split FROM (SELECT count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, movie_id DESC, rating DESC) AS place FROM ratings)) GROUP BY split"))
def split_minimum(spark: SparkSession, d: str) -> DataFrame:
    return splits.chronological(A.ratings(spark, d), least=30).groupBy("split").agg(F.count("*").alias("n"))


@query("g9_split_details", sql("SELECT split, count(*) AS n_rows, count(DISTINCT user_id) AS users, count(DISTINCT movie_id) AS movies, min(timestamp) AS first, max(timestamp) AS last FROM parts GROUP BY split"))
def split_details(spark: SparkSession, d: str) -> DataFrame:
    out = splits.split_details(splits.chronological(A.ratings(spark, d)))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("e8_split_audit", sql("""SELECT 'rows_missing' AS "check", (SELECT count(*) FROM ratings) - (SELECT count(*) FROM parts) AS value
UNION ALL SELECT 'pairs_in_two_splits', count(*) FROM (SELECT 1 FROM parts GROUP BY user_id, movie_id HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'repeated_pairs', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM parts GROUP BY user_id, movie_id)
UNION ALL SELECT 'users_out_of_order', count(*) FROM (SELECT max(timestamp) FILTER (split = 'train') AS a, min(timestamp) FILTER (split = 'validation') AS b, max(timestamp) FILTER (split = 'validation') AS c, min(timestamp) FILTER (split = 'test') AS e FROM parts GROUP BY user_id) WHERE a > b OR a > e OR c > e
UNION ALL SELECT 'held_out_users_without_train', count(*) FROM (SELECT 1 FROM parts GROUP BY user_id HAVING count(*) FILTER (split <> 'train') > 0 AND count(*) FILTER (split = 'train') = 0)
UNION ALL SELECT 'test_movies_not_in_train', count(*) FROM (SELECT DISTINCT movie_id FROM parts WHERE split = 'test' AND movie_id NOT IN (SELECT movie_id FROM parts WHERE split = 'train'))"""))
def split_audit(spark: SparkSession, d: str) -> DataFrame:
    source = A.stored(spark, A.ratings(spark, d), "ratings")
    return splits.split_audit(A.stored(spark, splits.chronological(source), "splits"), source)


@query("g10_popularity", sql("""SELECT row_number() OVER (ORDER BY score DESC, rating_count DESC, average_rating DESC, movie_id) AS rank, movie_id, round(score, 6) AS score, rating_count FROM (
  SELECT s.*, round(rating_count / (rating_count + m) * average_rating + m / (rating_count + m) * c, 9) AS score FROM (SELECT movie_id, count(*) AS rating_count, avg(rating) AS average_rating FROM parts WHERE split = 'train' GROUP BY movie_id) s, (
    SELECT min(rating_count) AS m, (SELECT sum(rating) / count(*) FROM parts WHERE split = 'train') AS c FROM (SELECT rating_count, row_number() OVER (ORDER BY rating_count) AS rn, count(*) OVER () AS n FROM (SELECT count(*) AS rating_count FROM parts WHERE split = 'train' GROUP BY movie_id)) WHERE rn >= ceil(0.9::DOUBLE * (n - 1)) + 1)
  WHERE rating_count >= m)"""))
def popularity(spark: SparkSession, d: str) -> DataFrame:
    train = splits.chronological(A.ratings(spark, d)).filter("split = 'train'")
    out = rankings.top_rated(rankings.movie_stats(train), None, top=None)
    return out.select(F.col("rank").cast("long").alias("rank"), "movie_id", F.round("score", 6).alias("score"), "rating_count")


_WIDE = """SELECT f.movie_id, CASE WHEN p_partkey % 5 <> 0 THEN 'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS imdb_id, title, trim(regexp_replace(upper(p_name), '\\s+', ' ', 'g')) AS original_title,
  CASE WHEN p_partkey % 6 <> 0 THEN trim(regexp_replace('A ' || p_name, '\\s+', ' ', 'g')) END AS overview, CASE WHEN p_partkey % 23 = 0 OR p_partkey % 10 = 0 THEN '' ELSE p_type || '|' || p_brand END AS genres, original_language,
  CASE WHEN release_year IS NOT NULL THEN CAST(release_date AS TIMESTAMP) END AS release_date, CAST(release_year AS SMALLINT) AS release_year, CAST(runtime AS FLOAT) AS runtime,
  p_brand || '|' || p_brand AS production_companies, CASE WHEN p_partkey % 4 = 0 THEN 'US' ELSE 'France' END AS production_countries, CASE WHEN p_partkey % 9 <> 0 THEN '/p' || p_partkey END AS poster_path,
  CAST(vote_average AS FLOAT) AS vote_average, vote_count, CAST(popularity AS FLOAT) AS popularity
FROM flagged_movies f JOIN part ON p_partkey = source_row // 4 WHERE rejection_reason IS NULL"""


CTES["wide"] = "\n  " + _WIDE


@query("d2_catalogue", sql("SELECT * FROM wide"))
def wide_catalogue(spark: SparkSession, d: str) -> DataFrame:
    out = cleaning.catalogue(cleaning.flag_movies(A.raw_catalogue(spark, d)))
    return out.withColumns({c: F.array_join(c, "|") for c in ("genres", "production_companies", "production_countries")}).withColumn("release_date", F.col("release_date").cast("timestamp_ntz"))


@query("d11_full_summary", sql("""SELECT 'rows_in' AS metric, count(*) AS value FROM flagged_movies UNION ALL SELECT 'rows_out', count(*) FROM wide UNION ALL SELECT 'rows_removed', count(*) FROM flagged_movies WHERE rejection_reason IS NOT NULL
UNION ALL SELECT 'null_overview', count(*) FILTER (overview IS NULL) FROM wide UNION ALL SELECT 'null_release_year', count(*) FILTER (release_year IS NULL) FROM wide
UNION ALL SELECT 'warning_runtime_over', count(*) FILTER (runtime > 150) FROM wide UNION ALL SELECT 'warning_without_genres', count(*) FILTER (genres = '') FROM wide
UNION ALL SELECT 'reason_' || rejection_reason, count(*) FROM flagged_movies WHERE rejection_reason IS NOT NULL GROUP BY 1
UNION ALL SELECT unnest(['null_before_id', 'null_before_title', 'null_before_original_language', 'null_before_vote_average', 'null_before_vote_count', 'null_before_runtime', 'null_before_popularity', 'null_before_release_date', 'null_before_imdb_id', 'null_before_original_title', 'null_before_overview', 'null_before_poster_path', 'null_before_genres', 'null_before_production_companies', 'null_before_production_countries']),
  unnest([0, count(*) FILTER (trim(title) = 'nan'), count(*) FILTER (trim(original_language) = 'N/A'), 0, count(*) FILTER (vote_count IS NULL), 0, 0, 0, count(*) FILTER ((source_row // 4) % 5 = 0), 0, count(*) FILTER ((source_row // 4) % 6 = 0), count(*) FILTER ((source_row // 4) % 9 = 0), 0, 0, 0]) FROM all_movies"""))
def full_summary(spark: SparkSession, d: str) -> DataFrame:
    raw = A.stored(spark, A.raw_catalogue(spark, d), "raw")
    flagged = A.stored(spark, cleaning.flag_movies(raw), "flagged")
    return cleaning.cleaning_summary(flagged, "rejection_reason", ["overview", "release_year"], raw, {"runtime_over": F.col("runtime") > 150, "without_genres": F.size("genres") == 0})
