"""The adapters' rules as DuckDB SQL: common table expressions that the queries' SQL builds on."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "raw_movies": """
  SELECT * FROM (
    SELECT p_partkey * 4 AS source_row, CASE WHEN p_partkey % 89 = 0 THEN 'not-an-id' ELSE CAST(p_partkey AS VARCHAR) END AS id,
      CASE WHEN p_partkey % 83 = 0 THEN ' nan ' ELSE '  ' || p_name || ' ' END AS title,
      CASE WHEN p_partkey % 7 = 0 THEN ' N/A ' ELSE ' EN ' END AS original_language,
      CAST(CAST(p_partkey * 7 % 113 AS DOUBLE) / 10.0 AS VARCHAR) AS vote_average,
      CASE WHEN p_partkey % 11 = 0 THEN 'many' ELSE CAST(p_size AS VARCHAR) END AS vote_count,
      CAST(p_partkey % 200 - 5 AS VARCHAR) AS runtime, CAST(p_retailprice AS VARCHAR) AS popularity,
      CASE WHEN p_partkey % 13 = 0 THEN 'soon' ELSE CAST(1860 + p_partkey % 200 AS VARCHAR) || '-05-17' END AS release_date
    FROM part)""",
    "all_movies": """
  SELECT * FROM raw_movies UNION ALL SELECT * REPLACE (source_row + 1 AS source_row) FROM raw_movies WHERE (source_row // 4) % 97 = 0
  UNION ALL SELECT * REPLACE (source_row + 2 AS source_row, NULL AS vote_count) FROM raw_movies WHERE (source_row // 4) % 79 = 0""",
    "typed_movies": """
  SELECT source_row, id AS raw_id, title AS raw_title, vote_count AS raw_votes, release_date,
    row_number() OVER (PARTITION BY id, title, original_language, vote_average, vote_count, runtime, popularity, release_date ORDER BY source_row) AS copy,
    CASE WHEN try_cast(id AS DOUBLE) > 0 AND try_cast(id AS DOUBLE) % 1 = 0 THEN CAST(try_cast(id AS DOUBLE) AS BIGINT) END AS movie_id,
    CASE WHEN lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) NOT IN ('', 'nan', 'none', 'null', 'n/a', 'na') THEN trim(regexp_replace(title, '\\s+', ' ', 'g')) END AS title,
    CASE WHEN lower(trim(original_language)) NOT IN ('', 'nan', 'none', 'null', 'n/a', 'na') THEN lower(trim(original_language)) END AS original_language,
    CASE WHEN try_cast(vote_average AS DOUBLE) BETWEEN 0 AND 10 THEN try_cast(vote_average AS DOUBLE) END AS vote_average,
    CASE WHEN try_cast(vote_count AS DOUBLE) >= 0 THEN CAST(round_even(try_cast(vote_count AS DOUBLE), 0) AS BIGINT) END AS vote_count,
    CASE WHEN try_cast(runtime AS DOUBLE) > 0 THEN try_cast(runtime AS DOUBLE) END AS runtime,
    CASE WHEN try_cast(popularity AS DOUBLE) >= 0 THEN try_cast(popularity AS DOUBLE) END AS popularity,
    CASE WHEN year(try_cast(release_date AS DATE)) BETWEEN 1870 AND 2030 THEN year(try_cast(release_date AS DATE)) END AS release_year
  FROM all_movies""",
    "flagged_movies": """
  SELECT *, CASE WHEN rejection_reason = 'duplicate_movie_id' THEN movie_id END AS duplicate_of_movie_id FROM (
    SELECT *, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY early IS NULL, movie_id ORDER BY known DESC, coalesce(vote_count, -1) DESC, source_row) > 1 THEN 'duplicate_movie_id' END) AS rejection_reason FROM (
      SELECT *, CASE WHEN copy > 1 THEN 'exact_duplicate_row' WHEN movie_id IS NULL THEN 'invalid_movie_id' WHEN title IS NULL THEN 'empty_title' END AS early,
        (title IS NOT NULL)::INT + (original_language IS NOT NULL)::INT + (raw_votes IS NOT NULL)::INT + (release_date IS NOT NULL)::INT + 2 AS known
      FROM typed_movies))""",
    "movies": """
  SELECT p_partkey AS movie_id, p_name AS title, [p_type, p_brand] AS genres, CAST(p_size AS BIGINT) AS vote_count, (p_partkey * 7 % 101) / 10.0 AS vote_average FROM part WHERE p_partkey > 0""",
    "links": """
  SELECT p_partkey AS source_id, CASE WHEN p_partkey % 50 = 7 THEN NULL WHEN p_partkey % 50 = 8 THEN p_partkey + 900000 WHEN p_partkey % 100 = 99 THEN p_partkey - 1 ELSE p_partkey END AS target_id FROM part""",
    "mapping": """
  SELECT source_id, CASE WHEN source_id > 0 THEN source_id END AS source_movie_id, CASE WHEN status = 'mapped' THEN target_id END AS movie_id, status FROM (
    SELECT source_id, target_id, CASE WHEN NOT source_id > 0 THEN 'invalid_movielens_movie_id' WHEN target_id IS NULL OR NOT target_id > 0 THEN 'missing_tmdb_mapping' WHEN movie_id IS NULL THEN 'movie_metadata_missing' ELSE 'mapped' END AS status
    FROM links LEFT JOIN movies ON movie_id = target_id)""",
    "raw_ratings": """
  SELECT l_orderkey * 10 + l_linenumber AS source_row, CASE WHEN l_orderkey % 97 = 0 THEN -1 ELSE o_custkey END AS user_id,
    CASE l_orderkey % 97 WHEN 1 THEN -1 WHEN 2 THEN l_partkey + 1000000 ELSE l_partkey END AS source_movie_id,
    CASE WHEN l_orderkey % 97 = 3 THEN 9.5 ELSE ceil(l_quantity / 5) * 0.5 END::DOUBLE AS rating,
    CASE WHEN l_orderkey % 97 = 4 THEN 0 ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS epoch
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "flagged_ratings": """
  SELECT r.source_row, r.user_id, r.source_movie_id, r.rating, r.epoch, m.movie_id,
    CASE WHEN NOT r.user_id > 0 THEN 'invalid_user_id' WHEN NOT r.source_movie_id > 0 THEN 'invalid_movielens_movie_id' WHEN NOT r.rating BETWEEN 0.5 AND 5 THEN 'invalid_rating' WHEN NOT r.epoch > 0 THEN 'invalid_timestamp'
      WHEN m.status IS NULL THEN 'missing_link_record' WHEN m.status IN ('missing_tmdb_mapping', 'movie_metadata_missing') THEN m.status WHEN m.movie_id IS NULL THEN 'unresolved_movie_mapping' END AS reason
  FROM raw_ratings r LEFT JOIN (SELECT * FROM mapping WHERE source_movie_id IS NOT NULL) m ON r.source_movie_id = m.source_movie_id""",
    "resolved": """
  SELECT source_row, user_id, source_movie_id, rating, epoch, movie_id, CASE WHEN place > 1 THEN CASE WHEN count(*) OVER (PARTITION BY user_id, movie_id, source_movie_id, place > 1) > 1 THEN 'duplicate_user_movie' ELSE 'duplicate_canonical_user_movie_alias' END END AS reason FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, movie_id ORDER BY epoch DESC, source_movie_id DESC, source_row DESC, rating DESC) AS place FROM flagged_ratings WHERE reason IS NULL)
  UNION ALL SELECT source_row, user_id, source_movie_id, rating, epoch, movie_id, reason FROM flagged_ratings WHERE reason IS NOT NULL""",
    "ratings": """
  SELECT user_id, movie_id, rating, make_timestamp(epoch * 1000000) AS timestamp FROM resolved WHERE reason IS NULL""",
    "stats": """
  SELECT movie_id, count(*) AS rating_count, sum(rating) AS rating_sum, avg(rating) AS average_rating FROM ratings GROUP BY movie_id""",
    "global_m": """
  SELECT min(rating_count) AS m, (SELECT sum(rating_sum) / sum(rating_count) FROM stats) AS c FROM (SELECT rating_count, row_number() OVER (ORDER BY rating_count) AS rn, count(*) OVER () AS n FROM stats) WHERE rn >= ceil(0.9::DOUBLE * (n - 1)) + 1""",
    "top_rated": """
  SELECT row_number() OVER (ORDER BY score DESC, rating_count DESC, average_rating DESC, movie_id) AS rank, movie_id, score, average_rating, rating_count FROM (
    SELECT *, round(rating_count / (rating_count + m) * average_rating + m / (rating_count + m) * c, 9) AS score FROM stats, global_m WHERE rating_count >= m)
  ORDER BY rank LIMIT 100""",
    "genre_each": """
  SELECT DISTINCT s.movie_id, rating_count, average_rating, unnest(genres) AS genre FROM stats s JOIN movies USING (movie_id)""",
    "genre_coverage": """
  SELECT genre, m, count(*) AS rated, count(*) FILTER (rating_count >= m) AS eligible, count(*) FILTER (rating_count >= m) >= 20 AS included
  FROM genre_each JOIN (
    SELECT genre, min(rating_count) AS m FROM (SELECT genre, rating_count, row_number() OVER (PARTITION BY genre ORDER BY rating_count) AS rn, count(*) OVER (PARTITION BY genre) AS n FROM genre_each) WHERE rn >= ceil(0.9::DOUBLE * (n - 1)) + 1 GROUP BY genre
  ) USING (genre) GROUP BY genre, m""",
    "genre_rated": """
  SELECT * FROM (SELECT genre, row_number() OVER (PARTITION BY genre ORDER BY score DESC, rating_count DESC, average_rating DESC, movie_id) AS rank, movie_id, score, average_rating, rating_count FROM (
    SELECT e.*, round(rating_count / (rating_count + g.m) * average_rating + g.m / (rating_count + g.m) * c, 9) AS score FROM genre_each e JOIN genre_coverage g USING (genre), global_m WHERE included AND rating_count >= g.m))
  WHERE rank <= 50""",
    "parts": """
  SELECT user_id, movie_id, rating, timestamp, CASE WHEN n < 3 THEN 'train' WHEN place <= 1 THEN 'test' WHEN place <= 2 THEN 'validation' ELSE 'train' END AS split FROM (
    SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, movie_id DESC, rating DESC) AS place FROM ratings)""",
    "ev": """
  SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS movie_id,
    CASE event_type WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'share' WHEN 'view' THEN 'watch' WHEN 'signup' THEN 'comment' ELSE CASE event_id % 3 WHEN 0 THEN 'dislike' WHEN 1 THEN 'rating' ELSE 'teleport' END END AS event_type,
    CASE WHEN event_type = 'view' THEN round(value / 100, 6) WHEN event_type = 'signup' THEN CASE WHEN event_id % 4 <> 0 THEN round(value / 50 - 1, 6) END WHEN event_type = 'error' AND event_id % 3 = 1 THEN ceil(least(value, 50.0) / 5) * 0.5 ELSE value END AS value,
    ts AS timestamp FROM events""",
    "weighed": """
  SELECT *, CASE WHEN reason IS NULL THEN CASE event_type WHEN 'rating' THEN (value - 3) * 5 WHEN 'comment' THEN 3 + 12 * least(greatest(value, -1), 1) WHEN 'click' THEN 2 WHEN 'watch' THEN 10 WHEN 'complete' THEN 12 WHEN 'like' THEN 15 WHEN 'dislike' THEN -15 WHEN 'share' THEN 15 END::DOUBLE END AS weight FROM (
    SELECT *, CASE WHEN event_type NOT IN ('click', 'watch', 'complete', 'like', 'dislike', 'rating', 'share', 'comment') THEN 'unsupported_event_type' WHEN event_type = 'rating' AND value IS NULL THEN 'malformed_value'
      WHEN event_type = 'comment' AND value IS NULL THEN 'missing_sentiment' WHEN event_type = 'watch' AND value < 0.5 THEN 'below_threshold' END AS reason FROM ev)""",
    "counted": """
  SELECT *, weight * pow(0.5, greatest(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(timestamp), 0) / 86400e6 / 30) AS decayed,
    event_type = 'share' AND nth > 3 OR event_type = 'comment' AND nth > 5 AS capped FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, movie_id, event_type ORDER BY timestamp DESC NULLS LAST, event_id) AS nth FROM weighed WHERE reason IS NULL)""",
    "profile": """
  SELECT user_id, movie_id, round(sum(decayed), 6) AS score, count(*) AS events_counted, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM counted WHERE NOT capped GROUP BY user_id, movie_id""",
}


def sql(select: str) -> str:
    """``select`` with the expressions it uses, directly or through others, before it."""
    order: list[str] = []
    met: set[str] = set()

    def add(text: str) -> None:
        for name in CTES:
            if name not in met and re.search(rf"\b{name}\b", text):
                met.add(name)
                add(CTES[name])
                order.append(name)

    add(select)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + select
