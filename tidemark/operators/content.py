"""Content documents, TF-IDF vectors, onboarding profiles and similarity to recent items."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.scalars import clean_free_text, prefixed_tokens, slug

from .neighbours import sparse_lists, sparse_top

# Latin letters with marks, by rule: those that decompose into an ASCII letter and marks.
_MARKED = [c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFKD", c)) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
_PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in _MARKED)


def strip_accents(c: Column) -> Column:
    return F.translate(c, "".join(_MARKED), _PLAIN)


def content_document(movies: DataFrame, cast_limit: int = 5) -> DataFrame:
    """(movie_id, document): title, overview and prefixed tokens; columns that ``movies`` lacks are passed over."""
    have = set(movies.columns)
    parts = [clean_free_text(F.col(c)) for c in ("title", "overview") if c in have]
    for prefix, column in (("genre", "genres"), ("keyword", "keywords"), ("cast", "cast_names"), ("director", "director_names"), ("company", "production_companies"), ("country", "production_countries")):
        if column in have:
            values = F.slice(column, 1, cast_limit) if prefix == "cast" else F.col(column)
            parts.append(F.array_join(prefixed_tokens(prefix, values), " "))
    if "original_language" in have:
        parts.append(F.when(slug(F.col("original_language")) != "", F.concat(F.lit("language_"), slug(F.col("original_language")))))
    if "release_year" in have:
        parts.append(F.concat(F.lit("year_"), F.col("release_year").cast("int").cast("string")))
    filled = F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))
    return movies.select("movie_id", F.array_join(filled, " ").alias("document"))


def availability(movies: DataFrame) -> DataFrame:
    """(movie_id, has_*): whether each text is known and each list filled."""
    kinds = {f.name: f.dataType.typeName() for f in movies.schema}
    return movies.select("movie_id", *[(F.coalesce(F.size(c), F.lit(0)) > 0 if k == "array" else F.col(c).isNotNull()).alias(f"has_{c}") for c, k in kinds.items() if c != "movie_id"])


def terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): counts of words of two letters or more and of pairs of neighbours."""
    plain = strip_accents(F.lower(F.coalesce(text, F.lit(""))))
    words = F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(key, words.alias("w")).select(key, F.explode(F.concat("w", pairs)).alias("term"))
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"))


def fit_vocabulary(counts: DataFrame, n_docs: DataFrame, least: int = 2, most: float = 0.98, size: int = 30_000) -> DataFrame:
    """(term, idf): the ``size`` most frequent terms in ``least`` documents at least and a share ``most`` at most.

    ``n_docs`` has one row and column.  Ties go to the term that comes first.
    """
    n = n_docs.toDF("n")
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).crossJoin(F.broadcast(n))
    kept = stats.filter((F.col("df") >= least) & (F.col("df") <= F.lit(most) * F.col("n"))).orderBy(F.desc("total"), "term").limit(size)
    return kept.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def transform(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, term, weight): (1 + ln tf) idf, unit length; terms outside the vocabulary are left out."""
    raw = counts.join(F.broadcast(vocabulary), "term").withColumn("x", (1 + F.log("tf")) * F.col("idf"))  # the vocabulary's size is bounded
    # A document's terms come together once, with their length.
    whole = raw.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "x"))).alias("v"))
    # Squares are added in the order of the terms, so equal documents have equal weights to the last bit.
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c["x"] * c["x"]))
    return whole.select(key, length.alias("length"), F.explode("v").alias("v")).select(key, "v.term", (F.col("v.x") / F.col("length")).alias("weight"))


def _unit(rows: DataFrame, key: str) -> DataFrame:
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(key)))
    return rows.withColumn("__length__", length).filter("__length__ > 0").withColumn("weight", F.col("weight") / F.col("__length__")).drop("__length__")


def onboarding_profile(requests: DataFrame, vectors: DataFrame, vocabulary: DataFrame, movie_share: float = 0.7) -> DataFrame:
    """(request_id, term, weight) from requests (request_id, selected_movie_ids, selected_genres).

    The mean of the selected movies' unit vectors and the vector of the genre tokens, weighed
    0.7 and 0.3 where both are there; unknown movies are passed over; unit length.

    One row a request and term with both sides' weights, whose lengths are taken in one window.
    """
    none = F.lit(None).cast("double")
    picks = requests.select("request_id", F.explode(F.array_distinct("selected_movie_ids")).alias("movie_id"))
    # The mean's direction is that of the sum.
    movie = picks.join(vectors.hint("merge"), "movie_id").select("request_id", "term", F.col("weight").alias("m"), none.alias("g"))
    tokens = requests.select("request_id", F.array_join(prefixed_tokens("genre", F.array_distinct("selected_genres")), " ").alias("text")).filter("text <> ''")
    counts = terms(tokens, "request_id", "text").join(F.broadcast(vocabulary), "term")  # the vocabulary's size is bounded
    genre = counts.select("request_id", "term", none.alias("m"), ((1 + F.log("tf")) * F.col("idf")).alias("g"))
    sides = movie.unionByName(genre).groupBy("request_id", "term").agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("m"), F.coalesce(F.sum("g"), F.lit(0.0)).alias("g"))
    length = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)).over(W.partitionBy("request_id")))
    both = (F.col("lm") > 0) & (F.col("lg") > 0)
    part = lambda c, l, s: F.when(F.col(l) > 0, F.col(c) / F.col(l) * F.when(both, s).otherwise(1.0)).otherwise(0.0)  # noqa: E731, E741
    mixed = sides.withColumns({"lm": length("m"), "lg": length("g")}).select("request_id", "term", (part("m", "lm", movie_share) + part("g", "lg", 1 - movie_share)).alias("weight"))
    return _unit(mixed, "request_id")


def rank_by_profile(profile: DataFrame, vectors: DataFrame, excluded: DataFrame, top: int = 20) -> DataFrame:
    """(request_id, rank, movie_id, score): items by dot product > 0 (rounded to nine places), without ``excluded`` (request_id, movie_id)."""
    bad = excluded.select("request_id", "movie_id").distinct().hint("merge")  # files are smaller than their rows: never broadcast by their size
    need = bad.groupBy(F.col("request_id").alias("id")).agg((F.count("*") + top).alias("n"))
    found = sparse_top(profile.select(F.col("request_id").alias("id"), "term", "weight"), vectors.select(F.col("movie_id").alias("id"), "term", "weight"), need, top)
    rows = found.select(F.col("id").alias("request_id"), F.col("other").alias("movie_id"), "score").join(bad, ["request_id", "movie_id"], "left_anti")
    order = W.partitionBy("request_id").orderBy(F.desc("score"), "movie_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("request_id", "rank", "movie_id", "score")


def lists_by_profile(profile: DataFrame, vectors: DataFrame, gone: DataFrame, top: int = 20) -> DataFrame:
    """(request_id, ids: the items of ``rank_by_profile`` in their order); ``gone`` (request_id, gone: an array of excluded items)."""
    found = sparse_lists(profile.select(F.col("request_id").alias("id"), "term", "weight"), vectors.select(F.col("movie_id").alias("id"), "term", "weight"), top=top, gone=gone.withColumnRenamed("request_id", "id"))
    return found.select(F.col("id").alias("request_id"), F.transform("l", lambda x: x["other"]).alias("ids"))


def with_fallback(ranked: DataFrame, requests: DataFrame, popular: DataFrame, top: int = 20) -> DataFrame:
    """``ranked`` and, for requests without a row there, the popular items; ``fallback`` tells which."""
    lost = requests.select("request_id").join(ranked.select("request_id").distinct(), "request_id", "left_anti")
    filled = lost.crossJoin(F.broadcast(popular.filter(F.col("rank") <= top).select("rank", "movie_id", "score")))
    return ranked.withColumn("fallback", F.lit(False)).unionByName(filled.withColumn("fallback", F.lit(True)))


def recent_profile(recent: DataFrame, vectors: DataFrame) -> DataFrame:
    """(request_id, term, weight): the weighted mean of the vectors of ``recent`` (request_id, movie_id, weight > 0), of unit length."""
    mean = recent.filter("weight > 0").withColumnRenamed("weight", "w").join(vectors.hint("merge"), "movie_id").groupBy("request_id", "term").agg(F.sum(F.col("w") * F.col("weight")).alias("weight"))
    return _unit(mean, "request_id")


def recent_similarity(recent: DataFrame, candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """(request_id, movie_id, similarity) of ``candidates`` to the weighted mean of ``recent`` (request_id, movie_id, weight > 0)."""
    liked = recent.filter("weight > 0")
    unit = recent_profile(recent, vectors).withColumnRenamed("weight", "p")
    # Only requests with a profile are led to the vectors.
    wanted = candidates.select("request_id", "movie_id").distinct().join(liked.select("request_id").distinct().hint("merge"), "request_id", "left_semi")
    return wanted.join(vectors.hint("merge"), "movie_id").join(unit.hint("merge"), ["request_id", "term"]).groupBy("request_id", "movie_id").agg(F.round(F.sum(F.col("p") * F.col("weight")), 9).alias("similarity"))
