"""Canonical tables from raw ones, with a reason for every row that is left out.

Each function flags rows in one pass and splits them after, so kept and rejected rows
always add up to the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import literals
from tidemark.functions.scalars import in_range, normalize_text, to_id, to_number, to_year


def first_reason(*reasons: tuple[str, Column]) -> Column:
    """The name of the first condition that holds, else null."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in reasons])


#: The raw columns whose filled cells are counted when rows of one id are compared, and the columns of the catalogue.
COMPLETE = ("title", "overview", "release_date", "genres", "poster_path", "original_language", "runtime", "vote_average", "vote_count")
CATALOGUE = ("movie_id", "imdb_id", "title", "original_title", "overview", "genres", "original_language", "release_date", "release_year", "runtime", "production_companies", "production_countries", "poster_path", "vote_average", "vote_count", "popularity")
_TEXTS = ("imdb_id", "original_title", "overview", "poster_path")
_LISTS = {"genres": literals.name_list, "production_companies": literals.company_list, "production_countries": literals.country_list}


def flag_movies(raw: DataFrame) -> DataFrame:
    """Raw text columns (source_row, id, title, original_language, vote_average, vote_count, runtime, popularity,
    release_date; imdb_id, original_title, overview, poster_path and the lists genres, production_companies, production_countries if
    there) as clean ones, with ``rejection_reason`` and ``duplicate_of_movie_id``.

    The reasons are looked for in this order: an exact copy of an earlier row, no usable id, no
    title, and a better row of the same id (more filled cells of ``COMPLETE``, more votes, earlier).
    """
    content = [c for c in raw.columns if c != "source_row"]
    copies = W.partitionBy(*content).orderBy("source_row")
    votes = to_number(F.col("vote_count"))
    lists = [c for c in _LISTS if c in raw.columns]
    rows = raw.withColumn("copy", F.row_number().over(copies))
    filled = sum((normalize_text(F.col(c)).isNotNull().cast("int") for c in COMPLETE if c in raw.columns), F.lit(0))
    for c in lists:
        rows = literals.parse_records(rows, c).withColumn(f"__{c}__", _LISTS[c](F.col("records"))).drop("records", "status")
    date = F.try_to_timestamp(F.col("release_date"))
    rows = rows.select(
        "source_row",
        F.col("id").alias("raw_id"),
        F.col("title").alias("raw_title"),
        "copy",
        filled.alias("known"),
        to_id(F.col("id")).alias("movie_id"),
        normalize_text(F.col("title")).alias("title"),
        normalize_text(F.col("original_language"), lower=True).alias("original_language"),
        in_range(to_number(F.col("vote_average")), 0, 10).alias("vote_average"),
        F.bround(in_range(votes, 0), 0).cast("long").alias("vote_count"),
        in_range(to_number(F.col("runtime")), above=0).alias("runtime"),
        in_range(to_number(F.col("popularity")), 0).alias("popularity"),
        to_year(F.col("release_date")).alias("release_year"),
        *([F.when(to_year(F.col("release_date")).isNotNull(), date).alias("release_date")] if "imdb_id" in raw.columns else []),
        *[normalize_text(F.col(c)).alias(c) for c in _TEXTS if c in raw.columns],
        *[F.col(f"__{c}__").alias(c) for c in lists],
    )
    early = first_reason(("exact_duplicate_row", F.col("copy") > 1), ("invalid_movie_id", F.col("movie_id").isNull()), ("empty_title", F.col("title").isNull()))
    rows = rows.withColumn("early", early)
    # Rows that are out already are groups of their own, however many they are.
    out = F.when(F.col("early").isNotNull(), F.col("source_row"))
    best = W.partitionBy(F.when(F.col("early").isNull(), F.col("movie_id")), out).orderBy(F.desc("known"), F.desc(F.coalesce("vote_count", F.lit(-1))), "source_row")
    rows = rows.withColumn("place", F.row_number().over(best))
    reason = F.coalesce("early", F.when(F.col("place") > 1, "duplicate_movie_id"))
    rows = rows.withColumn("rejection_reason", reason)
    return rows.withColumn("duplicate_of_movie_id", F.when(F.col("rejection_reason") == "duplicate_movie_id", F.col("movie_id"))).drop("copy", "early", "known", "place")


def catalogue(flagged: DataFrame) -> DataFrame:
    """The kept rows with the sixteen columns of ``CATALOGUE``; what the raw table lacks is null, or an empty list."""
    kinds = {"release_date": "timestamp", "release_year": "smallint", "runtime": "float", "vote_average": "float", "vote_count": "long", "popularity": "float", "movie_id": "long"}
    kind = lambda c: "array<string>" if c in _LISTS else kinds.get(c, "string")
    lack = lambda c: F.array().cast(kind(c)) if c in _LISTS else F.lit(None).cast(kind(c))
    return flagged.filter("rejection_reason is null").select(*[(F.col(c).cast(kind(c)) if c in flagged.columns else lack(c)).alias(c) for c in CATALOGUE])


def kept(flagged: DataFrame) -> DataFrame:
    return flagged.filter("rejection_reason is null").drop("rejection_reason", "duplicate_of_movie_id", "raw_id", "raw_title")


def rejected(flagged: DataFrame) -> DataFrame:
    return flagged.filter("rejection_reason is not null").select("source_row", "raw_id", "raw_title", "rejection_reason", "duplicate_of_movie_id")


def child_table(df: DataFrame, key: str, values: str, name: str) -> DataFrame:
    """Distinct (key, element) rows of an array column."""
    return df.select(key, F.explode(values).alias(name)).filter(F.col(name).isNotNull()).distinct()


def merge_lists(df: DataFrame, key: str, values: str, order: str, valid: DataFrame) -> DataFrame:
    """One row a key: its rows' lists in the order of ``order``, each value once in any case (first spelling, first place).

    ``key`` is cut to a whole number; keys not in ``valid`` are left out; no known value: an empty list.
    """
    rows = df.withColumn(key, F.col(key).try_cast("double").cast("long")).join(valid.select(key).distinct(), key, "left_semi")
    items = rows.select(key, order, F.posexplode(F.filter(values, lambda x: x.isNotNull())).alias("pos", "value"))
    firsts = items.groupBy(key, F.lower("value").alias("folded")).agg(F.min(F.struct(order, "pos", "value")).alias("first"))
    lists = firsts.groupBy(key).agg(F.array_sort(F.collect_list("first")).alias("all")).select(key, F.transform("all", lambda x: x["value"]).alias(values))
    return rows.select(key).distinct().join(lists, key, "left").withColumn(values, F.coalesce(values, F.array().cast("array<string>")))


def map_ids(links: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(source_movie_id, movie_id, status) of each row of ``links`` (source_row, source_id, target_id).

    status: mapped, invalid_movielens_movie_id, missing_tmdb_mapping or movie_metadata_missing;
    ``movie_id`` is null unless mapped.  Several rows of one source id count by the first mapped one, else the first.
    """
    ids = links.select("source_row", F.col("source_id").alias("raw_source_id"), to_id(F.col("source_id")).alias("source_movie_id"), to_id(F.col("target_id")).alias("target"))
    known = catalogue.select(F.col("movie_id").alias("target"), F.lit(True).alias("known")).distinct()
    rows = ids.join(known, "target", "left")
    status = F.coalesce(first_reason(("invalid_movielens_movie_id", F.col("source_movie_id").isNull()), ("missing_tmdb_mapping", F.col("target").isNull()), ("movie_metadata_missing", F.col("known").isNull())), F.lit("mapped"))
    rows = rows.withColumn("status", status)
    first = W.partitionBy("raw_source_id").orderBy((F.col("status") != "mapped").cast("int"), "source_row")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("raw_source_id", "source_movie_id", F.when(F.col("status") == "mapped", F.col("target")).alias("movie_id"), "status")


def mapping_summary(mapping: DataFrame) -> DataFrame:
    """(status, source_ids, aliases): source ids of each status, and those that share their target with another."""
    shared = W.partitionBy("movie_id", F.when(F.col("movie_id").isNull(), F.col("raw_source_id")))  # rows without a target are no group
    rows = mapping.withColumn("shares", F.when(F.col("movie_id").isNotNull() & (F.count("*").over(shared) > 1), 1).otherwise(0))
    return rows.groupBy("status").agg(F.count("*").alias("source_ids"), F.sum("shares").alias("aliases"))


def flag_ratings(raw: DataFrame, mapping: DataFrame, low: float = 0.5, high: float = 5.0) -> DataFrame:
    """Ratings (source_row, user_id, source_movie_id, rating, epoch) with ``movie_id`` and the first reason against them."""
    known = mapping.filter("source_movie_id is not null").select("source_movie_id", "movie_id", "status")
    rows = raw.select(
        "source_row",
        F.col("user_id").alias("user_raw"),
        F.col("source_movie_id").alias("source_raw"),
        F.col("rating").alias("rating_raw"),
        F.col("epoch").alias("epoch_raw"),
        to_id(F.col("user_id")).alias("user_id"),
        to_id(F.col("source_movie_id")).alias("source_movie_id"),
        in_range(to_number(F.col("rating")), low, high).alias("rating"),
        in_range(to_number(F.col("epoch")), above=0).alias("epoch"),
    ).join(known, "source_movie_id", "left")
    reason = first_reason(
        ("invalid_user_id", F.col("user_id").isNull()),
        ("invalid_movielens_movie_id", F.col("source_movie_id").isNull()),
        ("invalid_rating", F.col("rating").isNull()),
        ("invalid_timestamp", F.col("epoch").isNull()),
        ("missing_link_record", F.col("status").isNull()),
        ("missing_tmdb_mapping", F.col("status") == "missing_tmdb_mapping"),
        ("movie_metadata_missing", F.col("status") == "movie_metadata_missing"),
        ("unresolved_movie_mapping", F.col("movie_id").isNull()),
    )
    return rows.withColumn("reason", reason).withColumn("timestamp", F.timestamp_seconds("epoch"))


def resolve_duplicates(flagged: DataFrame) -> DataFrame:
    """The valid rows once a user and movie (the latest), the other rows with ``reason``.

    A loser is a ``duplicate_user_movie`` if another loser of the pair has its source id, else a
    ``duplicate_canonical_user_movie_alias``.
    """
    pair = ["user_id", "movie_id"]
    good = flagged.filter("reason is null")
    latest = W.partitionBy(*pair).orderBy(F.desc("timestamp"), F.desc("source_movie_id"), F.desc("source_row"), F.desc("rating"))
    ranked = good.withColumn("place", F.row_number().over(latest))
    same = F.count("*").over(W.partitionBy(*pair, "source_movie_id", F.col("place") > 1))
    label = F.when(F.col("place") > 1, F.when(same > 1, "duplicate_user_movie").otherwise("duplicate_canonical_user_movie_alias"))
    return ranked.withColumn("reason", label).drop("place").unionByName(flagged.filter("reason is not null"))


def latest_ratings(flagged: DataFrame) -> DataFrame:
    """What ``ratings_clean`` keeps of ``resolve_duplicates``: the valid rows once a user and movie, without the labels of the others, which take a window of their own."""
    order = F.struct("timestamp", "source_movie_id", "source_row", "rating")
    best = flagged.filter("reason is null").groupBy("user_id", "movie_id").agg(F.max(order).alias("x"))
    return best.select("user_id", "movie_id", "x.rating", "x.timestamp", "x.source_movie_id", "x.source_row")


def ratings_clean(resolved: DataFrame) -> DataFrame:
    return resolved.filter("reason is null").select("user_id", "movie_id", "rating", "timestamp", "source_movie_id", "source_row")


def ratings_rejected(resolved: DataFrame) -> DataFrame:
    return resolved.filter("reason is not null").select("source_row", "user_raw", "source_raw", "rating_raw", "epoch_raw", "reason")


def users_clean(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("user_id").agg(F.count("*").alias("rating_count"), F.min("timestamp").alias("first_rating"), F.max("timestamp").alias("last_rating"))


def cleaning_summary(flagged: DataFrame, reason: str, columns: list[str], raw: DataFrame | None = None, warnings: dict[str, Column] | None = None) -> DataFrame:
    """(metric, value): rows in, out and removed, rows of each reason, and nulls of ``columns`` among the rows kept.

    ``raw``: the table before, whose empty cells are counted by column; ``warnings``: conditions counted among the rows kept.
    """
    good = F.col(reason).isNull()
    wide = flagged.agg(
        F.count("*").alias("rows_in"),
        F.count_if(good).alias("rows_out"),
        F.count_if(~good).alias("rows_removed"),
        *[F.count_if(good & F.col(c).isNull()).alias(f"null_{c}") for c in columns],
        *[F.count_if(good & condition).alias(f"warning_{name}") for name, condition in (warnings or {}).items()],
    )
    long = _metrics(wide)
    if raw is not None:
        cells = [c for c in raw.columns if c != "source_row"]
        long = long.unionByName(_metrics(raw.agg(*[F.count_if(normalize_text(F.col(c).cast("string")).isNull()).alias(f"null_before_{c}") for c in cells])))
    reasons = flagged.filter(~good).groupBy(F.concat(F.lit("reason_"), F.col(reason)).alias("metric")).agg(F.count("*").alias("value"))
    return long.unionByName(reasons)


def _metrics(wide: DataFrame) -> DataFrame:
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in wide.columns])).alias("m")).select("m.*")


def restrict_to(df: DataFrame, catalogue: DataFrame, key: str = "movie_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in the catalogue, a row with the number of the others)."""
    ids = catalogue.select(key).distinct()
    return df.join(ids, key, "left_semi"), df.join(ids, key, "left_anti").agg(F.count("*").alias("dropped"))
