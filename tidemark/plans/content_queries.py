"""Queries: serving exports, content features, neighbours, profiles, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import literals
from tidemark.operators import content, neighbours, profiling, rankings, splits, validation
from tidemark.sources import readers, writers

from . import adapters as A
from .oracle import CTES, sql
from .registry import query

CTES |= {
    "picks": """
  SELECT user_id AS request_id, n AS seed_pos, movie_id AS seed_id FROM (
    SELECT user_id, movie_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, movie_id) - 1 AS n FROM parts WHERE split = 'train' AND rating >= 4) WHERE n <= 2""",
    "robin": """
  SELECT request_id, place, movie_id, seed_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank, seed_pos) AS place FROM (
    SELECT s.request_id, similar_movie_id AS movie_id, rank, seed_pos, s.seed_id, row_number() OVER (PARTITION BY s.request_id, similar_movie_id ORDER BY rank, seed_pos) AS n
    FROM picks s JOIN nearby ON s.seed_id = movie_id WHERE (s.request_id, similar_movie_id) NOT IN (SELECT request_id, seed_id FROM picks)) WHERE n = 1)""",
    "doc_words": """
  SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents""",
    "doc_terms": """
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM doc_words) GROUP BY 1, 2""",
    "vocabulary": """
  SELECT term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM doc_terms GROUP BY term), (SELECT count(*) AS n FROM documents) WHERE df >= 2 AND df <= 0.98 * n ORDER BY total DESC, term LIMIT 30000""",
    "raw_vectors": """
  SELECT doc_id, term, (1 + ln(tf)) * idf AS x FROM doc_terms JOIN vocabulary USING (term)""",
    "doc_vectors": """
  SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw_vectors""",
    "quality": """
  SELECT movie_id, CASE WHEN max(wr) OVER () = min(wr) OVER () THEN 1 ELSE (wr - min(wr) OVER ()) / (max(wr) OVER () - min(wr) OVER ()) END AS quality FROM (
    SELECT movie_id, round(vote_count / (vote_count + m) * vote_average + m / (vote_count + m) * c, 9) AS wr FROM movies,
      (SELECT sum(vote_average * vote_count) / sum(vote_count) AS c, quantile_cont(vote_count, 0.9) AS m FROM movies WHERE vote_count > 0))""",
    "m_words": """
  SELECT movie_id, regexp_extract_all(document, '[\\p{L}\\p{N}_]{2,}') AS w FROM m_docs""",
    "m_docs": """
  SELECT movie_id, trim(regexp_replace(regexp_replace(lower(title), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || ' genre_' || lower(genres[1]) || ' genre_' || regexp_replace(lower(genres[2]), '[^\\w\\s]', '_', 'g') AS document FROM movies""",
    "m_terms": """
  SELECT movie_id, term, count(*) AS tf FROM (SELECT movie_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM m_words) GROUP BY 1, 2""",
    "m_vocabulary": """
  SELECT term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT term, count(*) AS df FROM m_terms GROUP BY term), (SELECT count(*) AS n FROM movies) WHERE df >= 2 AND df <= 0.98 * n""",
    "m_vectors": """
  SELECT movie_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY movie_id)) AS weight FROM (SELECT movie_id, term, (1 + ln(tf)) * idf AS x FROM m_terms JOIN m_vocabulary USING (term))""",
    "m_pool": """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY cosine DESC, other) AS p FROM (
    SELECT a.movie_id, b.movie_id AS other, round(sum(a.weight * b.weight), 9) AS cosine FROM m_vectors a JOIN m_vectors b USING (term) WHERE a.movie_id <> b.movie_id AND b.movie_id IN (SELECT movie_id FROM movies WHERE vote_count >= 25) GROUP BY 1, 2)) WHERE p <= 200""",
    "nearby": """
  SELECT movie_id, row_number() OVER (PARTITION BY movie_id ORDER BY n) AS rank, other AS similar_movie_id, cosine AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY combined DESC, cosine DESC, other) AS n FROM (
      SELECT p.movie_id, other, cosine, round(0.75 * (cosine - min(cosine) OVER w) / CASE WHEN max(cosine) OVER w > min(cosine) OVER w THEN max(cosine) OVER w - min(cosine) OVER w ELSE 1 END + 0.25 * quality, 9) AS combined
      FROM m_pool p JOIN quality q ON q.movie_id = other WINDOW w AS (PARTITION BY p.movie_id)))
  WHERE n <= 50 AND cosine > 0""",
    "onboarding": """
  SELECT c_custkey AS request_id, CASE WHEN c_custkey % 4 <> 3 THEN [c_custkey % 50 + 1, c_custkey % 70 + 60, 5000000] ELSE [] END AS picks,
    CASE c_custkey % 4 WHEN 0 THEN ['ECONOMY'] WHEN 1 THEN ['PROMO', 'Brand#7'] ELSE [] END AS wanted FROM customer WHERE c_custkey > 0""",
    "on_movie": """
  SELECT request_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY request_id)) AS weight FROM (
    SELECT request_id, term, sum(weight) AS weight FROM (SELECT request_id, unnest(list_distinct(picks)) AS movie_id FROM onboarding) JOIN m_vectors USING (movie_id) GROUP BY 1, 2)""",
    "on_words": """
  SELECT request_id, [replace('genre_' || lower(x), '#', '_') FOR x IN wanted] AS w FROM onboarding WHERE len(wanted) > 0""",
    "on_genre": """
  SELECT request_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY request_id)) AS weight FROM (
    SELECT request_id, term, idf * (1 + ln(count(*))) AS x FROM (SELECT request_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM on_words) JOIN m_vocabulary USING (term) GROUP BY request_id, term, idf)""",
    "on_profile": """
  SELECT request_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY request_id)) AS weight FROM (
    SELECT request_id, term, sum(weight * CASE WHEN request_id IN (SELECT request_id FROM on_movie) AND request_id IN (SELECT request_id FROM on_genre) THEN share ELSE 1 END) AS weight
    FROM (SELECT *, 0.7 AS share FROM on_movie UNION ALL SELECT *, 0.3 FROM on_genre) GROUP BY 1, 2)""",
    "on_ranked": """
  SELECT * FROM (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, movie_id) AS rank, movie_id, score FROM (
    SELECT request_id, v.movie_id, round(sum(p.weight * v.weight), 9) AS score FROM on_profile p JOIN m_vectors v USING (term) GROUP BY 1, 2)
    WHERE score > 0 AND (request_id, movie_id) NOT IN (SELECT request_id, unnest(picks) FROM onboarding)) WHERE rank <= 20""",
}


def movie_docs(spark: SparkSession, d: str) -> DataFrame:
    return content.content_document(A.movies(spark, d).select("movie_id", "title", "genres"))


def movie_space(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, vocabulary) of the catalogue, written for the several uses made of them."""
    docs = movie_docs(spark, d)
    counts = content.terms(docs, "movie_id", "document")
    vocabulary = A.stored(spark, content.fit_vocabulary(counts, docs.agg(F.count("*"))), "vocabulary")
    return A.stored(spark, content.transform(counts, vocabulary, "movie_id"), "vectors"), vocabulary


@query("b2_movies_serving", sql("SELECT movie_id, title, array_to_string(genres, '|') AS genres, vote_average, vote_count FROM movies"))
def movies_serving(spark: SparkSession, d: str) -> DataFrame:
    return writers.movies_serving(A.movies(spark, d)).withColumn("genres", F.array_join("genres", "|"))


@query("b3_json_lines", sql("""SELECT '{"movie_id":' || movie_id || ',"note":null,"title":"' || title || '","vote_count":' || vote_count || '}' AS value FROM movies"""))
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    return writers.json_lines(A.movies(spark, d).select("title", "movie_id", "vote_count", F.lit(None).cast("string").alias("note")))


@query("b4_popular_movies", sql("""SELECT ranking_type, genre, string_agg(movie_id, ',' ORDER BY rank) AS movie_ids, (SELECT max(timestamp) FROM ratings) AS generated_at FROM (
  SELECT 'top_rated_all' AS ranking_type, NULL AS genre, rank, movie_id FROM top_rated UNION ALL SELECT 'top_rated_genre', genre, rank, movie_id FROM genre_rated) GROUP BY ALL"""))
def popular_movies(spark: SparkSession, d: str) -> DataFrame:
    # The ratings are led together once: what both rankings and the time are made of is a row a movie.
    rows, movies = A.ratings(spark, d), A.movies(spark, d)
    stats = A.stored(spark, rows.groupBy("movie_id").agg(F.count("*").alias("rating_count"), F.sum("rating").alias("rating_sum"), F.avg("rating").alias("average_rating"), F.max("timestamp").alias("timestamp")), "stats")
    ratings, stats = stats.select("timestamp"), stats.drop("timestamp")
    out = writers.popular_movies(rankings.top_rated(stats, movies), rankings.by_genre(stats, movies)[0], ratings)
    return out.select("ranking_type", "genre", F.array_join(F.col("movie_ids").cast("array<string>"), ",").alias("movie_ids"), F.col("generated_at").cast("timestamp_ntz").alias("generated_at"))


@query("b5_examples", sql("SELECT CAST(user_id AS VARCHAR) AS user_id, movie_id, 'rating' AS event_type, rating AS value, timestamp, CAST(NULL AS VARCHAR) AS session_id FROM (SELECT * FROM ratings ORDER BY user_id, timestamp, movie_id LIMIT 3)"))
def examples(spark: SparkSession, d: str) -> DataFrame:
    return writers.interaction_examples(A.ratings(spark, d)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("a4_user_history", sql("SELECT user_id, movie_id, rating, timestamp FROM ratings WHERE user_id = 77 ORDER BY timestamp DESC, movie_id DESC LIMIT 15"))
def user_history(spark: SparkSession, d: str) -> DataFrame:
    return readers.user_history(A.ratings(spark, d), 77).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("c2_names", """
SELECT p_partkey, string_agg(name, '|' ORDER BY pos) AS names, any_value(status) AS status FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE unnest([p_type, p_brand]) END AS name, CASE WHEN p_partkey % 4 = 3 THEN 1 ELSE unnest([1, 2]) END AS pos, CASE WHEN p_partkey % 4 = 3 THEN 'malformed' ELSE 'filled' END AS status FROM part)
GROUP BY p_partkey""")
def literal_names(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    k = F.col("p_partkey") % 4
    python = F.format_string("[{'id': 1, 'name': '%s', 'x': None}, {'id': 2, 'name': '%s'}, {'id': 3, 'name': '%s'}]", F.col("p_type"), F.col("p_brand"), F.lower("p_type"))
    json = F.format_string('[{"id": 1, "name": " %s "}, {"id": 2, "name": "%s"}, {"id": 4, "name": "N/A"}]', F.col("p_type"), F.col("p_brand"))
    cell = F.when(k == 0, python).when(k == 3, "[{'id': ").otherwise(json)
    parsed = literals.parse_records(p.select("p_partkey", cell.alias("cell")), "cell")
    lists = literals.names(parsed, "p_partkey").groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("l"))
    return parsed.select("p_partkey", "status").join(lists, "p_partkey", "left").select("p_partkey", "status", F.array_join(F.transform("l", lambda x: x["name"]), "|").alias("names"))


@query("c22_availability", sql("SELECT movie_id, true AS has_title, true AS has_genres, vote_count IS NOT NULL AS has_vote_count FROM movies"))
def availability(spark: SparkSession, d: str) -> DataFrame:
    return content.availability(A.movies(spark, d).select("movie_id", "title", "genres", "vote_count"))


@query("h1_documents", sql("SELECT movie_id, document FROM m_docs"))
def documents(spark: SparkSession, d: str) -> DataFrame:
    return movie_docs(spark, d)


def _text_space(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    counts = content.terms(docs, "doc_id", "text")
    return docs, counts, content.fit_vocabulary(counts, docs.agg(F.count("*")))


@query("h2_vocabulary", sql("SELECT term, round(idf, 6) AS idf FROM vocabulary"))
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _text_space(spark, d)[2].withColumn("idf", F.round("idf", 6))


@query("h3_tfidf", sql("SELECT doc_id, count(*) AS n_terms, round(max(weight), 5) AS top_weight, round(sum(weight), 4) AS total FROM doc_vectors GROUP BY doc_id"))
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    _, counts, vocab = _text_space(spark, d)
    return content.transform(counts, vocab, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 5).alias("top_weight"), F.round(F.sum("weight"), 4).alias("total"))


@query("h4_similar_movies", sql("SELECT movie_id, rank, similar_movie_id, round(score, 5) AS score FROM nearby"))
def similar_movies(spark: SparkSession, d: str) -> DataFrame:
    out = _similar(spark, d)
    return out.withColumns({"rank": F.col("rank").cast("long"), "score": F.round("score", 5)})


def _similar(spark: SparkSession, d: str) -> DataFrame:
    movies = A.movies(spark, d)
    vectors, _ = movie_space(spark, d)
    return neighbours.similar(vectors, movies.filter("vote_count >= 25"), neighbours.quality_scores(movies))


@query("h4_dense_neighbours", """
SELECT id, other, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS n FROM (
  SELECT a.vec_id AS id, b.vec_id AS other, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE n <= 10""")
def dense_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "embeddings")
    return neighbours.top_products(e, e, "vec_id", "embedding", 10, same=True).withColumn("score", F.round("score", 5))


@query("h5_quality", sql("SELECT movie_id, round(quality, 6) AS quality FROM quality"))
def quality(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.quality_scores(A.movies(spark, d)).withColumn("quality", F.round("quality", 6))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Each user's first three liked movies."""
    from tidemark.operators import evaluation

    _, _, liked = evaluation.evaluation_set(splits.chronological(A.ratings(spark, d)), users="all")
    return liked.select(F.col("user_id").alias("request_id"), (F.col("n") - 1).alias("seed_pos"), F.col("movie_id").alias("seed_id"))


@query("h6_round_robin", sql("SELECT * FROM robin WHERE place <= 20"))
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.round_robin(seeds(spark, d), _similar(spark, d)).withColumn("place", F.col("place").cast("long"))


def onboarding_requests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = A.table(spark, d, "customer").filter("c_custkey > 0")
    none = F.array().cast("array<string>")
    return c.select(
        k.alias("request_id"),
        F.when(k % 4 != 3, F.array(k % 50 + 1, k % 70 + 60, F.lit(5000000).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("selected_movie_ids"),
        F.when(k % 4 == 0, F.array(F.lit("ECONOMY"))).when(k % 4 == 1, F.array(F.lit("PROMO"), F.lit("Brand#7"))).otherwise(none).alias("selected_genres"),
    )


def onboarding_ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asks = onboarding_requests(spark, d)
    vectors, vocab = movie_space(spark, d)
    profile = A.stored(spark, content.onboarding_profile(asks, vectors, vocab), "profiles")
    excluded = asks.select("request_id", F.explode("selected_movie_ids").alias("movie_id"))
    return asks, A.stored(spark, content.rank_by_profile(profile, vectors, excluded), "ranked")


@query("h7_onboarding", sql("""SELECT request_id, rank, movie_id, round(score, 5) AS score, false AS fallback FROM on_ranked
UNION ALL SELECT request_id, rank, movie_id, round(score, 5), true FROM onboarding, top_rated WHERE rank <= 20 AND request_id NOT IN (SELECT request_id FROM on_ranked)"""))
def onboarding(spark: SparkSession, d: str) -> DataFrame:
    asks, ranked = onboarding_ranked(spark, d)
    popular = rankings.top_rated(rankings.movie_stats(A.ratings(spark, d)), A.movies(spark, d))
    out = content.with_fallback(ranked, asks, popular)
    return out.withColumns({"rank": F.col("rank").cast("long"), "score": F.round("score", 5)})


@query("e1_column_profile", """
WITH v AS (SELECT unnest(['p_name', 'p_type', 'p_size', 'p_brand']) AS "column", unnest([p_name, p_type, CASE WHEN p_partkey % 11 = 0 THEN 'many' WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END, p_brand]) AS value FROM part),
c AS (SELECT "column", value, count(*) AS k FROM v GROUP BY 1, 2),
t AS (SELECT "column", string_agg(value || '=' || k, '|' ORDER BY r) AS top_values FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY k DESC, value) AS r FROM c WHERE value IS NOT NULL) WHERE r <= 5 GROUP BY 1)
SELECT "column", CAST(sum(k) AS BIGINT) AS n, CAST(coalesce(sum(k) FILTER (value IS NULL), 0) AS BIGINT) AS nulls, round(coalesce(sum(k) FILTER (value IS NULL), 0) / sum(k), 6) AS null_share, count(value) AS distinct_values,
  CAST(coalesce(sum(k) FILTER ("column" = 'p_size' AND value IS NOT NULL AND try_cast(value AS DOUBLE) IS NULL), 0) AS BIGINT) AS malformed,
  min(try_cast(value AS DOUBLE)) FILTER ("column" = 'p_size') AS low, max(try_cast(value AS DOUBLE)) FILTER ("column" = 'p_size') AS high,
  min(value) FILTER ("column" <> 'p_size') AS low_text, max(value) FILTER ("column" <> 'p_size') AS high_text, any_value(top_values) AS top_values
FROM c JOIN t USING ("column") GROUP BY 1""")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = A.table(spark, d, "part").withColumn("p_size", F.when(k % 11 == 0, "many").when(k % 13 != 0, F.col("p_size").cast("string")))
    return profiling.column_profile(p, ["p_name", "p_type", "p_size", "p_brand"], numeric=("p_size",))


@query("e2_list_stats", "SELECT count(*) FILTER (p_partkey % 4 < 2) AS filled, count(*) FILTER (p_partkey % 4 = 3) AS malformed, count(*) FILTER (p_partkey % 4 = 2) AS wrong_type FROM part")
def list_stats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    cell = F.when(k < 2, "[{'id': 1, 'name': 'x', 'y': None}]").when(k == 2, "{'id': 1}").otherwise("[{")
    return profiling.list_stats(literals.parse_records(A.table(spark, d, "part").select(cell.alias("cell")), "cell"))


@query("e3_timestamps", "SELECT min(ts) FILTER (event_id % 9 <> 0) AS first, max(ts) FILTER (event_id % 9 <> 0) AS last, count(*) FILTER (event_id % 9 = 0) AS unusable FROM events")
def timestamp_stats(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    out = profiling.timestamp_stats(e, F.when(F.col("event_id") % 9 == 0, "yesterday").otherwise(F.col("ts").cast("string")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("e4_table_profile", sql("""SELECT 'rows' AS metric, count(*) AS value FROM raw_ratings UNION ALL SELECT 'duplicate_rows', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_ratings)) FROM raw_ratings
UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT (user_id, source_movie_id)) FROM raw_ratings UNION ALL SELECT 'non_positive_ids', count(*) FROM raw_ratings WHERE NOT least(user_id, source_movie_id) > 0
UNION ALL SELECT 'ratings_out_of_range', count(*) FROM raw_ratings WHERE NOT rating BETWEEN 0.5 AND 5"""))
def table_profile(spark: SparkSession, d: str) -> DataFrame:
    return profiling.table_profile(A.raw_ratings(spark, d), ["user_id", "source_movie_id"])


def _audit(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name, c: A.table(spark, d, name).select(c)
    ratings, movies = A.raw_ratings(spark, d), A.movies(spark, d).select("movie_id")
    return profiling.relationship_audit({
        "lineitem_part": (t("lineitem", "l_partkey"), t("part", "p_partkey")),
        "lineitem_orders": (t("lineitem", "l_orderkey"), t("orders", "o_orderkey")),
        "orders_customer": (t("orders", "o_custkey"), t("customer", "c_custkey")),
        "labels_documents": (t("labels", "doc_id"), t("documents", "doc_id")),
        "documents_labels": (t("documents", "doc_id"), t("labels", "doc_id")),
        "ratings_catalogue": (ratings.select("source_movie_id"), movies),
        "catalogue_ratings": (movies, ratings.select("source_movie_id")),
        "links_catalogue": (A.links(spark, d).select("target_id"), movies),
    })


_AUDIT = " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS missing FROM (SELECT DISTINCT {a} AS id FROM {x} WHERE {a} IS NOT NULL) WHERE id NOT IN (SELECT {b} FROM {y})"
    for n, a, x, b, y in (
        ("lineitem_part", "l_partkey", "lineitem", "p_partkey", "part"), ("lineitem_orders", "l_orderkey", "lineitem", "o_orderkey", "orders"),
        ("orders_customer", "o_custkey", "orders", "c_custkey", "customer"), ("labels_documents", "doc_id", "labels", "doc_id", "documents"),
        ("documents_labels", "doc_id", "documents", "doc_id", "labels"), ("ratings_catalogue", "source_movie_id", "raw_ratings", "movie_id", "movies"),
        ("catalogue_ratings", "movie_id", "movies", "source_movie_id", "raw_ratings"), ("links_catalogue", "target_id", "links", "movie_id", "movies"),
    )
)


@query("e5_relationship_audit", sql(_AUDIT))
def relationship_audit(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d)


_LIMITS = {"lineitem_part": (0.0, True), "lineitem_orders": (0.0, True), "ratings_catalogue": (5.0, False), "documents_labels": (0.0, False), "unknown_rule": (0.0, False)}


@query("e6_rules", sql(f"""SELECT rule_id, CASE WHEN missing <= most THEN 'PASS' WHEN critical OR missing IS NULL THEN 'FAIL' ELSE 'WARNING' END AS status, critical, CAST(missing AS VARCHAR) AS found
FROM (VALUES ('lineitem_part', 0, true), ('lineitem_orders', 0, true), ('ratings_catalogue', 5, false), ('documents_labels', 0, false), ('unknown_rule', 0, false)) r(rule_id, most, critical) LEFT JOIN ({_AUDIT}) ON name = rule_id"""))
def rules(spark: SparkSession, d: str) -> DataFrame:
    return profiling.rules(_audit(spark, d), _LIMITS).select("rule_id", "status", "critical", F.col("evidence")["count"].alias("found"))


@query("e7_final_rules", sql("""SELECT rule_id, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT 'movie_key_unique' AS rule_id, count(*) - count(DISTINCT movie_id) AS bad FROM movies UNION ALL SELECT 'movie_title_known', count(*) FILTER (title IS NULL) FROM movies
  UNION ALL SELECT 'mapping_in_catalogue', count(*) FROM mapping WHERE movie_id IS NOT NULL AND movie_id NOT IN (SELECT movie_id FROM movies)
  UNION ALL SELECT 'rating_in_catalogue', count(*) FROM ratings WHERE movie_id NOT IN (SELECT movie_id FROM movies) UNION ALL SELECT 'rating_in_range', count(*) FROM ratings WHERE NOT rating BETWEEN 0.5 AND 5
  UNION ALL SELECT 'rating_pair_unique', count(*) - count(DISTINCT (user_id, movie_id)) FROM ratings UNION ALL SELECT 'rating_fields_known', count(*) FROM ratings WHERE user_id IS NULL OR movie_id IS NULL OR rating IS NULL OR timestamp IS NULL
  UNION ALL SELECT 'split_reconciles', (SELECT count(*) FROM ratings) - count(*) FROM parts UNION ALL SELECT 'ranking_unique', count(*) - count(DISTINCT movie_id) FROM top_rated
  UNION ALL SELECT 'genre_child_in_catalogue', count(*) FROM (SELECT DISTINCT movie_id FROM genre_each) WHERE movie_id NOT IN (SELECT movie_id FROM movies)
  UNION ALL SELECT 'documents_cover_catalogue', (SELECT count(*) FROM movies) - count(*) FROM m_docs)"""))
def final_rules(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators import validation

    ratings, movies = A.stored(spark, A.ratings(spark, d), "ratings"), A.movies(spark, d)
    stats = A.stored(spark, rankings.movie_stats(ratings), "stats")
    found = validation.integrity(movies, A.mapping(spark, d), ratings, splits.chronological(ratings), rankings.top_rated(stats, movies), movies.select("movie_id", F.explode("genres").alias("genre")), movie_docs(spark, d))
    return found.select("rule_id", "status")


@query("e9_interaction_summary", sql("""WITH u AS (SELECT count(*) AS k FROM ratings GROUP BY user_id), m AS (SELECT count(*) AS k FROM ratings GROUP BY movie_id),
us AS (SELECT count(*) AS n, min(k) AS lo, max(k) AS hi, quantile_cont(k, [0.25, 0.5, 0.75, 0.95]) AS q, count(*) FILTER (k < 3) AS few FROM u), ms AS (SELECT count(*) AS n, min(k) AS lo, max(k) AS hi, quantile_cont(k, [0.25, 0.5, 0.75, 0.95]) AS q FROM m),
r AS (SELECT count(*) AS n FROM ratings)
SELECT unnest(['rows', 'users', 'movies', 'sparsity', 'user_min', 'user_max', 'user_p25', 'user_p50', 'user_p75', 'user_p95', 'movie_min', 'movie_max', 'movie_p25', 'movie_p50', 'movie_p75', 'movie_p95', 'users_below_minimum', 'cold_start_movies']) AS metric,
  unnest([r.n, us.n, ms.n, round(1 - r.n / (us.n * ms.n)::DOUBLE, 6), us.lo, us.hi, us.q[1], us.q[2], us.q[3], us.q[4], ms.lo, ms.hi, ms.q[1], ms.q[2], ms.q[3], ms.q[4], few, (SELECT count(*) FROM movies WHERE movie_id NOT IN (SELECT movie_id FROM ratings))]::DOUBLE[]) AS value FROM us, ms, r""").replace("\nWITH u AS", ", u AS", 1))
def interaction_summary(spark: SparkSession, d: str) -> DataFrame:
    return profiling.interaction_summary(A.ratings(spark, d), A.movies(spark, d))


@query("e9_histogram", sql("SELECT rating, count(*) AS n FROM ratings GROUP BY rating"))
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return profiling.histogram(A.ratings(spark, d))


@query("e10_fingerprint")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return profiling.fingerprint(A.ratings(spark, d))


CTES |= {
    "keyword_ids": """
  SELECT CASE WHEN p_partkey % 61 = 0 THEN p_partkey + 800000 ELSE p_partkey END AS id FROM part WHERE p_partkey % 17 <> 0""",
    "credit_ids": """
  SELECT CASE WHEN p_partkey % 67 = 0 THEN p_partkey + 800000 ELSE p_partkey END AS id FROM part WHERE p_partkey % 19 <> 0""",
    "meta_ids": """
  SELECT CAST(try_cast(id AS DOUBLE) AS BIGINT) AS id FROM all_movies""",
    "raw_relations": """
  SELECT (SELECT count(DISTINCT source_movie_id) FROM raw_ratings WHERE source_movie_id NOT IN (SELECT source_id FROM links)) AS ratings_movie_ids_not_in_links,
    (SELECT count(DISTINCT source_id) FROM links WHERE source_id NOT IN (SELECT source_movie_id FROM raw_ratings)) AS link_movie_ids_without_ratings,
    (SELECT count(*) FROM links WHERE target_id IS NULL) AS links_missing_tmdb_id,
    (SELECT count(DISTINCT target_id) FROM links ANTI JOIN meta_ids ON target_id = id WHERE target_id IS NOT NULL) AS linked_tmdb_ids_not_in_metadata,
    (SELECT count(DISTINCT id) FROM meta_ids ANTI JOIN links ON target_id = id WHERE id IS NOT NULL) AS metadata_ids_without_link,
    (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM links WHERE target_id IS NOT NULL GROUP BY target_id) WHERE n > 1) AS duplicate_non_null_tmdb_mapping_rows,
    (SELECT count(DISTINCT id) FROM credit_ids ANTI JOIN meta_ids USING (id)) AS credit_ids_not_in_metadata,
    (SELECT count(DISTINCT id) FROM meta_ids ANTI JOIN credit_ids USING (id) WHERE id IS NOT NULL) AS metadata_ids_without_credits,
    (SELECT count(DISTINCT id) FROM keyword_ids ANTI JOIN meta_ids USING (id)) AS keyword_ids_not_in_metadata,
    (SELECT count(DISTINCT id) FROM meta_ids ANTI JOIN keyword_ids USING (id) WHERE id IS NOT NULL) AS metadata_ids_without_keywords,
    (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM meta_ids WHERE id IS NOT NULL GROUP BY id)) AS duplicate_metadata_rows,
    (SELECT count(*) FROM meta_ids WHERE id IS NULL) AS metadata_rows_without_id""",
}


def raw_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    ratings, links = A.raw_ratings(spark, d), A.links(spark, d)
    return {"movies": A.raw_movies(spark, d), "keywords": A.keyword_ids(spark, d), "credits": A.credit_ids(spark, d), "links": links, "links_small": links.limit(100), "ratings": ratings, "ratings_small": ratings.limit(100)}


@query("e5_raw_relations", sql("SELECT * FROM raw_relations"))
def raw_relations(spark: SparkSession, d: str) -> DataFrame:
    t = raw_tables(spark, d)
    return validation.raw_relations(t["movies"], t["links"], t["ratings"], t["keywords"], t["credits"])


def _evidence(found: DataFrame) -> DataFrame:
    pairs = F.transform(F.array_sort(F.map_entries("evidence")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("rule_id", "status", "critical", F.array_join(pairs, ";").alias("evidence"))


@query("e6_raw_rules", sql("""SELECT 'RAW_FILES_PRESENT' AS rule_id, 'PASS' AS status, true AS critical, 'missing=0' AS evidence
UNION ALL SELECT 'RAW_FILES_PARSEABLE', 'PASS', true, 'unread_rows=0'
UNION ALL SELECT 'MOVIE_ID_NUMERIC', CASE WHEN metadata_rows_without_id > 0 THEN 'WARNING' ELSE 'PASS' END, false, 'invalid_rows=' || metadata_rows_without_id FROM raw_relations
UNION ALL SELECT 'MOVIE_ID_UNIQUE', CASE WHEN duplicate_metadata_rows > 0 THEN 'WARNING' ELSE 'PASS' END, false, 'duplicate_extra_rows=' || duplicate_metadata_rows FROM raw_relations
UNION ALL SELECT 'RATING_SOURCE_PAIR_UNIQUE', CASE WHEN n > 0 THEN 'WARNING' ELSE 'PASS' END, false, 'duplicate_extra_rows=' || n FROM (SELECT count(*) - count(DISTINCT (user_id, source_movie_id)) AS n FROM raw_ratings)
UNION ALL SELECT 'RATING_RANGE', CASE WHEN a >= 0.5 AND z <= 5 THEN 'PASS' ELSE 'FAIL' END, true, 'maximum=' || z || ';minimum=' || a FROM (SELECT min(rating) AS a, max(rating) AS z FROM raw_ratings)
UNION ALL SELECT 'RATING_MOVIE_LINK_REFERENCE', CASE WHEN ratings_movie_ids_not_in_links > 0 THEN 'FAIL' ELSE 'PASS' END, true, 'unmatched_movie_ids=' || ratings_movie_ids_not_in_links FROM raw_relations
UNION ALL SELECT 'LINK_METADATA_REFERENCE', CASE WHEN links_missing_tmdb_id + linked_tmdb_ids_not_in_metadata > 0 THEN 'WARNING' ELSE 'PASS' END, false, 'missing_tmdb_ids=' || links_missing_tmdb_id || ';tmdb_ids_absent_from_metadata=' || linked_tmdb_ids_not_in_metadata FROM raw_relations
UNION ALL SELECT 'CONTENT_REFERENCE_COVERAGE', CASE WHEN metadata_ids_without_credits + metadata_ids_without_keywords > 0 THEN 'WARNING' ELSE 'PASS' END, false, 'movies_without_credits=' || metadata_ids_without_credits || ';movies_without_keywords=' || metadata_ids_without_keywords FROM raw_relations
UNION ALL SELECT 'INTERACTION_SIGNAL_LIMITATION', 'WARNING', false, 'available_interaction_types=rating'"""))
def raw_rules(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(validation.raw_rules(raw_tables(spark, d)))


_FINAL = """SELECT 'REQUIRED_OUTPUTS_PRESENT' AS rule_id, 'PASS' AS status, true AS critical, 'missing=0' AS evidence
UNION ALL SELECT 'MOVIE_KEY_UNIQUE', 'PASS', true, 'duplicate_ids=' || (count(*) - count(DISTINCT movie_id)) || ';non_positive_ids=' || count(*) FILTER (movie_id <= 0) FROM movies
UNION ALL SELECT 'MOVIE_REQUIRED_FIELDS', 'PASS', true, 'empty_titles=' || count(*) FILTER (trim(title) = '') || ';required_nulls=' || count(*) FILTER (movie_id IS NULL OR title IS NULL OR genres IS NULL) FROM movies
UNION ALL SELECT 'ID_MAPPING_INTEGRITY', 'PASS', true, 'duplicate_source_ids=' || (count(*) - count(DISTINCT source_movie_id)) || ';invalid_movie_foreign_keys=' || count(*) FILTER (movie_id NOT IN (SELECT movie_id FROM movies)) FROM mapping WHERE movie_id IS NOT NULL
UNION ALL SELECT 'CLEAN_RATING_INTEGRITY', 'PASS', true, 'duplicate_user_movie_pairs=' || (count(*) - count(DISTINCT (user_id, movie_id))) || ';invalid_movie_foreign_keys=' || count(*) FILTER (movie_id NOT IN (SELECT movie_id FROM movies)) || ';invalid_ratings=' || count(*) FILTER (NOT rating BETWEEN 0.5 AND 5) || ';null_required_values=0' FROM ratings
UNION ALL SELECT 'CHILD_TABLE_FOREIGN_KEYS', CASE WHEN c + g + k > 0 THEN 'FAIL' ELSE 'PASS' END, true, 'credits=' || c || ';genres=' || g || ';keywords=' || k FROM (SELECT (SELECT count(*) FROM credit_ids WHERE id NOT IN (SELECT movie_id FROM movies)) AS c, (SELECT count(*) FROM genre_each WHERE movie_id NOT IN (SELECT movie_id FROM movies)) AS g, (SELECT count(*) FROM keyword_ids WHERE id NOT IN (SELECT movie_id FROM movies)) AS k)
UNION ALL SELECT 'MOVIE_FEATURE_COVERAGE', 'PASS', true, 'duplicate_movie_ids=' || (count(*) - count(DISTINCT movie_id)) || ';empty_cleaned_text=' || count(*) FILTER (trim(document) = '') || ';missing_movie_ids=' || (SELECT count(*) FROM movies WHERE movie_id NOT IN (SELECT movie_id FROM m_docs)) || ';row_difference_from_movies=' || (count(*) - (SELECT count(*) FROM movies)) FROM m_docs
UNION ALL SELECT 'INTERACTION_TABLE_INTEGRITY', 'PASS', true, 'null_required_values=0;other_types=0;row_difference_from_ratings=0'
UNION ALL SELECT 'SPLIT_LEAKAGE', 'PASS', true, 'held_out_users_without_train=' || (SELECT count(*) FROM (SELECT user_id FROM parts GROUP BY user_id HAVING count(*) FILTER (split <> 'train') > 0 AND count(*) FILTER (split = 'train') = 0)) || ';pairs_in_two_splits=0;repeated_pairs=' || (count(*) - count(DISTINCT (user_id, movie_id))) || ';rows_missing=' || ((SELECT count(*) FROM ratings) - count(*)) || ';users_out_of_order=0' FROM parts
UNION ALL SELECT 'GUEST_RANKING_INTEGRITY', 'PASS', true, 'all_duplicate_movies=' || (count(*) - count(DISTINCT movie_id)) || ';genre_duplicate_movies=' || (SELECT count(*) - count(DISTINCT (genre, movie_id)) FROM genre_rated) || ';genre_duplicate_ranks=' || (SELECT count(*) - count(DISTINCT (genre, rank)) FROM genre_rated) || ';user_columns=0' FROM top_rated
UNION ALL SELECT 'ONBOARDING_RECOMMENDER_BEHAVIOR', 'PASS', true, 'not_deterministic=0;not_fallback_used_for_empty_input=0;not_selected_movie_excluded=0;not_unique_results=0'
UNION ALL SELECT 'SERVING_TABLE_INTEGRITY', 'PASS', true, 'duplicate_movie_ids=' || (count(*) - count(DISTINCT movie_id)) || ';required_nulls=0;row_difference_from_movies=0' FROM movies
UNION ALL SELECT 'JSON_SERIALIZATION', 'PASS', true, 'movies_malformed_rows=0;popular_malformed_rows=0;row_difference_from_movies=0'
UNION ALL SELECT 'DETERMINISTIC_PIPELINE_ARTIFACTS', 'PASS', false, 'changed=0;compared=2'
UNION ALL SELECT 'KNOWN_DATASET_LIMITATIONS', 'WARNING', false, 'movies_without_genres=' || (SELECT count(*) FROM movies WHERE len(genres) = 0) || ';train_only_sparse_users=' || (SELECT count(*) FROM (SELECT user_id FROM parts GROUP BY user_id HAVING count(*) FILTER (split <> 'train') = 0))"""


@query("e7_all_rules", sql(_FINAL))
def all_final_rules(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a run are written, counted as they pass, and checked; the ratings and the splits are made twice and compared."""
    ratings, movies = A.stored(spark, A.ratings(spark, d), "ratings"), A.movies(spark, d)
    stats = A.stored(spark, rankings.movie_stats(ratings), "stats")
    made = {
        "movies": movies,
        "mapping": A.mapping(spark, d).filter("movie_id is not null"),
        "ratings": ratings,
        "interactions": ratings.select("user_id", "movie_id", F.col("rating").alias("interaction_value"), F.lit("rating").alias("interaction_type"), "timestamp"),
        "features": movie_docs(spark, d),
        "parts": splits.chronological(ratings),
        "top": rankings.top_rated(stats, movies),
        "genre_top": rankings.by_genre(stats, movies)[0],
        "serving": writers.movies_serving(movies),
        "child_genres": movies.join(stats.select("movie_id"), "movie_id", "left_semi").select("movie_id", F.explode("genres").alias("genre")).distinct(),
        "child_keywords": A.keyword_ids(spark, d).withColumnRenamed("id", "movie_id"),
        "child_credits": A.credit_ids(spark, d).withColumnRenamed("id", "movie_id"),
    }
    out = A.scratch_folder(spark, "run")
    observed = {name: writers.write_observed(df, f"{out}/{name}", validation.watched(name)) for name, df in made.items()}
    tables = {name: spark.read.parquet(f"{out}/{name}") for name in made}
    writers.write_json_lines(tables["serving"], f"{out}/json_movies")
    writers.write_json_lines(writers.popular_movies(tables["top"], tables["genre_top"], tables["ratings"]), f"{out}/json_popular")
    lines = {n: spark.read.text(f"{out}/json_{n}") for n in ("movies", "popular")}
    vectors, vocabulary = movie_space(spark, d)
    behaviour = validation.onboarding_behaviour(tables["movies"], vectors, vocabulary, tables["top"])
    same = {name: profiling.fingerprint(tables[name]).first() == profiling.fingerprint(df).first() for name, df in (("ratings", A.ratings(spark, d)), ("parts", splits.chronological(A.ratings(spark, d))))}
    return _evidence(validation.final_rules(tables, observed, lines, behaviour, same))
