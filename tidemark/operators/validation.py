"""Integrity rules over the tables of a finished run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.scalars import to_number

from . import content, splits


def integrity(movies: DataFrame, mapping: DataFrame, ratings: DataFrame, parts: DataFrame, ranking: DataFrame, genres: DataFrame, documents: DataFrame) -> DataFrame:
    """(rule_id, bad, status, critical): rows against each rule, one job an input."""
    ids = movies.select("movie_id").distinct()
    count = lambda df, c: df.agg(c.alias("bad"))
    lost = lambda df: count(df.filter("movie_id is not null").join(ids, "movie_id", "left_anti"), F.count("*"))
    repeated = lambda df, *keys: count(df.groupBy(*keys).agg(F.count("*").alias("k")), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)))
    sizes = lambda a, b: a.agg(F.count("*").alias("x")).crossJoin(b.agg(F.count("*").alias("y"))).select((F.col("x") - F.col("y")).alias("bad"))
    found = {
        "movie_key_unique": repeated(movies, "movie_id"),
        "movie_title_known": count(movies, F.count_if(F.col("title").isNull())),
        "mapping_in_catalogue": lost(mapping),
        "rating_in_catalogue": lost(ratings),
        "rating_in_range": count(ratings, F.count_if(~F.col("rating").between(0.5, 5))),
        "rating_pair_unique": repeated(ratings, "user_id", "movie_id"),
        "rating_fields_known": count(ratings, F.count_if(F.col("user_id").isNull() | F.col("movie_id").isNull() | F.col("rating").isNull() | F.col("timestamp").isNull())),
        "split_reconciles": sizes(ratings, parts),
        "ranking_unique": repeated(ranking, "movie_id"),
        "genre_child_in_catalogue": lost(genres),
        "documents_cover_catalogue": sizes(movies, documents),
    }
    out = None
    for name, row in found.items():
        row = row.select(F.lit(name).alias("rule_id"), F.col("bad").cast("long").alias("bad"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("status", F.when(F.col("bad") == 0, "PASS").otherwise("FAIL")).withColumn("critical", F.lit(True))


# All rules of a run.
#
# Counts come to the driver as single rows of numbers; the rules are made of these there.

#: The raw tables that a run needs.
RAW_TABLES = ("movies", "keywords", "credits", "links", "links_small", "ratings", "ratings_small")


def presence(tables: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(space, id, n_<name>...): the rows that each table has of each id, for all tables in one shuffle of partial counts.

    ``tables``: name -> (space of its ids, table of one column).  Null ids count as an id of their own.
    """
    rows = None
    for name, (space, ids) in tables.items():
        part = ids.toDF("id").select(F.lit(space).alias("space"), F.col("id").cast("long").alias("id"), F.lit(name).alias("t"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("space", "id").agg(*[F.count_if(F.col("t") == name).alias(f"n_{name}") for name in tables])


def numbers(df: DataFrame) -> dict[str, int]:
    """A table of one row of counts."""
    return {k: int(v or 0) for k, v in df.first().asDict().items()}


def raw_relations(movies: DataFrame, links: DataFrame, ratings: DataFrame, keywords: DataFrame, credits_: DataFrame) -> DataFrame:
    """One row: the ten relations of the raw tables.

    movies: (id as text), links: (source_id, target_id), ratings: (source_movie_id), keywords and credits: (id).
    """
    known = presence({
        "ratings": ("source", ratings.select("source_movie_id")),
        "sources": ("source", links.select("source_id")),
        "links": ("target", links.select(to_number(F.col("target_id")))),
        "metadata": ("target", movies.select(to_number(F.col("id")))),
        "credits": ("target", credits_.select("id")),
        "keywords": ("target", keywords.select("id")),
    })
    here = lambda n: F.col(f"n_{n}") > 0
    only = lambda a, b: F.count_if(F.col("id").isNotNull() & here(a) & ~here(b))
    return known.agg(
        only("ratings", "sources").alias("ratings_movie_ids_not_in_links"),
        only("sources", "ratings").alias("link_movie_ids_without_ratings"),
        F.sum(F.when(F.col("id").isNull(), F.col("n_links"))).alias("links_missing_tmdb_id"),
        only("links", "metadata").alias("linked_tmdb_ids_not_in_metadata"),
        only("metadata", "links").alias("metadata_ids_without_link"),
        F.sum(F.when(F.col("id").isNotNull() & (F.col("n_links") > 1), F.col("n_links"))).alias("duplicate_non_null_tmdb_mapping_rows"),
        only("credits", "metadata").alias("credit_ids_not_in_metadata"),
        only("metadata", "credits").alias("metadata_ids_without_credits"),
        only("keywords", "metadata").alias("keyword_ids_not_in_metadata"),
        only("metadata", "keywords").alias("metadata_ids_without_keywords"),
        F.sum(F.when(F.col("id").isNotNull() & (F.col("n_metadata") > 1), F.col("n_metadata") - 1)).alias("duplicate_metadata_rows"),
        F.sum(F.when(F.col("id").isNull(), F.col("n_metadata"))).alias("metadata_rows_without_id"),
    )


def report(spark: SparkSession, rows: list[tuple[str, str, bool, dict[str, object]]]) -> DataFrame:
    """(rule_id, status, critical, evidence)."""
    return spark.createDataFrame([(i, s, c, {k: str(v) for k, v in e.items()}) for i, s, c, e in rows], "rule_id string, status string, critical boolean, evidence map<string,string>")


def _fails(evidence: dict[str, int]) -> str:
    return "FAIL" if any(evidence.values()) else "PASS"


def raw_rules(tables: dict[str, DataFrame], low: float = 0.5, high: float = 5.0) -> DataFrame:
    """The ten rules over the raw tables (``RAW_TABLES``; columns as in ``raw_relations``, ratings with user_id and rating).

    Rules that cleaning can mend give a WARNING, those it can't a critical FAIL (``profiling.stop_on_critical``).
    """
    spark = next(iter(tables.values())).sparkSession
    missing = [t for t in RAW_TABLES if t not in tables]
    present = ("RAW_FILES_PRESENT", "FAIL" if missing else "PASS", True, {"missing": len(missing)})
    if missing:
        return report(spark, [present])
    unread = sum(df.filter("_corrupt_record is not null").count() for df in tables.values() if "_corrupt_record" in df.columns)
    r = numbers(raw_relations(tables["movies"], tables["links"], tables["ratings"], tables["keywords"], tables["credits"]))
    spread = tables["ratings"].agg(F.min("rating").alias("a"), F.max("rating").alias("z")).first()
    pairs = numbers(tables["ratings"].groupBy("user_id", "source_movie_id").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") - 1).alias("n")))
    warn = lambda *names: "WARNING" if any(r[n] for n in names) else "PASS"
    inside = spread["a"] is not None and spread["a"] >= low and spread["z"] <= high
    return report(spark, [
        present,
        ("RAW_FILES_PARSEABLE", "FAIL" if unread else "PASS", True, {"unread_rows": unread}),
        ("MOVIE_ID_NUMERIC", warn("metadata_rows_without_id"), False, {"invalid_rows": r["metadata_rows_without_id"]}),
        ("MOVIE_ID_UNIQUE", warn("duplicate_metadata_rows"), False, {"duplicate_extra_rows": r["duplicate_metadata_rows"]}),
        ("RATING_SOURCE_PAIR_UNIQUE", "WARNING" if pairs["n"] else "PASS", False, {"duplicate_extra_rows": pairs["n"]}),
        ("RATING_RANGE", "PASS" if inside else "FAIL", True, {"minimum": spread["a"], "maximum": spread["z"]}),
        ("RATING_MOVIE_LINK_REFERENCE", _fails({"n": r["ratings_movie_ids_not_in_links"]}), True, {"unmatched_movie_ids": r["ratings_movie_ids_not_in_links"]}),
        ("LINK_METADATA_REFERENCE", warn("links_missing_tmdb_id", "linked_tmdb_ids_not_in_metadata"), False, {"missing_tmdb_ids": r["links_missing_tmdb_id"], "tmdb_ids_absent_from_metadata": r["linked_tmdb_ids_not_in_metadata"]}),
        ("CONTENT_REFERENCE_COVERAGE", warn("metadata_ids_without_credits", "metadata_ids_without_keywords"), False, {"movies_without_credits": r["metadata_ids_without_credits"], "movies_without_keywords": r["metadata_ids_without_keywords"]}),
        ("INTERACTION_SIGNAL_LIMITATION", "WARNING", False, {"available_interaction_types": "rating"}),
    ])


def _void(*columns: str) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))


def watched(name: str) -> dict[str, Column]:
    """What is counted of a table's rows while it is written (``writers.write_observed``)."""
    blank = lambda c: F.count_if(F.trim(c) == "")
    return {"rows": F.count(F.lit(1))} | {
        "movies": {"required_nulls": F.sum(_void("movie_id", "title", "genres")), "empty_titles": blank("title"), "non_positive_ids": F.count_if(F.col("movie_id") <= 0), "movies_without_genres": F.count_if(F.size("genres") == 0)},
        "ratings": {"null_required_values": F.sum(_void("user_id", "movie_id", "rating", "timestamp")), "invalid_ratings": F.count_if(~F.col("rating").between(0.5, 5))},
        "interactions": {"null_required_values": F.sum(_void("user_id", "movie_id", "interaction_value", "timestamp")), "other_types": F.count_if(F.col("interaction_type") != "rating")},
        "features": {"empty_cleaned_text": blank("document")},
        "serving": {"required_nulls": F.sum(_void("movie_id", "title", "genres"))},
    }.get(name, {})


#: Tables that the final rules need, besides child tables of the catalogue (child_<name>).
FINAL_TABLES = ("movies", "mapping", "ratings", "interactions", "features", "parts", "top", "genre_top", "serving")


def final_rules(tables: dict[str, DataFrame], observed: dict[str, dict[str, int]], json: dict[str, DataFrame], behaviour: dict[str, bool], same: dict[str, bool] | None = None) -> DataFrame:
    """The fifteen rules over a finished run.

    ``observed``: what was counted as the tables were written (``watched``); ``json``: written JSON lines (value) by name, "movies" among them;
    ``behaviour``: ``onboarding_behaviour``; ``same``: whether each table equals that of an earlier run, if there was one.
    """
    spark = next(iter(tables.values())).sparkSession
    missing = [t for t in FINAL_TABLES if t not in tables]
    rules: list[tuple[str, str, bool, dict[str, object]]] = [("REQUIRED_OUTPUTS_PRESENT", "FAIL" if missing else "PASS", True, {"missing": len(missing)})]
    if missing:
        return report(spark, rules)
    children = sorted(t for t in tables if t.startswith("child_"))
    keyed = ["movies", "mapping", "ratings", "features", "serving", *children]
    known = presence({t: ("movie", tables[t].select("movie_id")) for t in keyed})
    here = F.col("n_movies") > 0
    found = numbers(known.agg(
        *[F.sum(F.when(~here | F.col("id").isNull(), F.col(f"n_{t}"))).alias(f"lost_{t}") for t in keyed],
        *[F.sum(F.when(F.col(f"n_{t}") > 1, F.col(f"n_{t}") - 1)).alias(f"again_{t}") for t in keyed],
        F.count_if(here & (F.col("n_features") == 0)).alias("without_features"),
    ))
    again = lambda df, *keys: numbers(df.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.sum(F.col("k") - 1).alias("n")))["n"]
    o, add = observed, lambda name, evidence, critical=True: rules.append((name, _fails(evidence), critical, evidence))
    add("MOVIE_KEY_UNIQUE", {"duplicate_ids": found["again_movies"], "non_positive_ids": o["movies"]["non_positive_ids"]})
    add("MOVIE_REQUIRED_FIELDS", {k: o["movies"][k] for k in ("required_nulls", "empty_titles")})
    add("ID_MAPPING_INTEGRITY", {"duplicate_source_ids": again(tables["mapping"], "source_movie_id"), "invalid_movie_foreign_keys": found["lost_mapping"]})
    add("CLEAN_RATING_INTEGRITY", {"invalid_movie_foreign_keys": found["lost_ratings"], "invalid_ratings": o["ratings"]["invalid_ratings"], "null_required_values": o["ratings"]["null_required_values"], "duplicate_user_movie_pairs": again(tables["ratings"], "user_id", "movie_id")})
    add("CHILD_TABLE_FOREIGN_KEYS", {t.removeprefix("child_"): found[f"lost_{t}"] for t in children})
    add("MOVIE_FEATURE_COVERAGE", {"row_difference_from_movies": o["features"]["rows"] - o["movies"]["rows"], "duplicate_movie_ids": found["again_features"], "empty_cleaned_text": o["features"]["empty_cleaned_text"], "missing_movie_ids": found["without_features"]})
    add("INTERACTION_TABLE_INTEGRITY", {"row_difference_from_ratings": o["interactions"]["rows"] - o["ratings"]["rows"], "other_types": o["interactions"]["other_types"], "null_required_values": o["interactions"]["null_required_values"]})
    audit = {r["check"]: int(r["value"]) for r in splits.split_audit(tables["parts"], tables["ratings"]).collect()}  # six numbers
    add("SPLIT_LEAKAGE", {k: v for k, v in audit.items() if k != "test_movies_not_in_train"})
    user = [c for t in ("top", "genre_top") for c in tables[t].columns if "user" in c.lower()]
    add("GUEST_RANKING_INTEGRITY", {"all_duplicate_movies": again(tables["top"], "movie_id"), "genre_duplicate_movies": again(tables["genre_top"], "genre", "movie_id"), "genre_duplicate_ranks": again(tables["genre_top"], "genre", "rank"), "user_columns": len(user)})
    add("ONBOARDING_RECOMMENDER_BEHAVIOR", {f"not_{k}": int(not v) for k, v in behaviour.items()})
    add("SERVING_TABLE_INTEGRITY", {"row_difference_from_movies": o["serving"]["rows"] - o["movies"]["rows"], "duplicate_movie_ids": found["again_serving"], "required_nulls": o["serving"]["required_nulls"]})
    lines = {n: numbers(df.agg(F.count("*").alias("rows"), F.count_if(F.try_parse_json("value").isNull()).alias("malformed"))) for n, df in json.items()}
    add("JSON_SERIALIZATION", {**{f"{n}_malformed_rows": x["malformed"] for n, x in lines.items()}, "row_difference_from_movies": lines["movies"]["rows"] - o["movies"]["rows"]})
    changed = [t for t, v in (same or {}).items() if not v]
    rules.append(("DETERMINISTIC_PIPELINE_ARTIFACTS", "WARNING" if same is None else "FAIL" if changed else "PASS", bool(changed), {"compared": len(same or {}), "changed": len(changed)}))
    sparse = numbers(tables["parts"].groupBy("user_id").agg(F.count_if(F.col("split") != "train").alias("held")).agg(F.count_if(F.col("held") == 0).alias("n")))
    rules.append(("KNOWN_DATASET_LIMITATIONS", "WARNING", False, {"movies_without_genres": o["movies"]["movies_without_genres"], "train_only_sparse_users": sparse["n"]}))
    return report(spark, rules)


def onboarding_behaviour(movies: DataFrame, vectors: DataFrame, vocabulary: DataFrame, popular: DataFrame, top: int = 10) -> dict[str, bool]:
    """Whether a stated request (the least movie id and its first genre) gets the same list twice, of other movies, each once, and an empty one the popular list."""
    spark = movies.sparkSession
    first = movies.orderBy("movie_id").limit(1).select(F.lit(1).alias("request_id"), F.array("movie_id").alias("selected_movie_ids"), F.slice("genres", 1, 1).alias("selected_genres"))
    none = spark.sql("select 2 request_id, array(cast(0 as bigint)) selected_movie_ids, cast(array() as array<string>) selected_genres")
    asks = first.unionByName(none.withColumn("selected_movie_ids", F.filter("selected_movie_ids", lambda x: x > 0)))
    picked = asks.select("request_id", F.explode("selected_movie_ids").alias("movie_id"))

    def lists() -> list:
        ranked = content.rank_by_profile(content.onboarding_profile(asks, vectors, vocabulary), vectors, picked, top)
        return sorted((r["request_id"], r["rank"], r["movie_id"], r["fallback"]) for r in content.with_fallback(ranked, asks, popular, top).collect())  # two short lists

    one, two, chosen = lists(), lists(), {r["movie_id"] for r in picked.collect()}
    mine = [m for q, _, m, _ in one if q == 1]
    return {"deterministic": one == two, "selected_movie_excluded": not chosen & set(mine), "unique_results": len(mine) == len(set(mine)), "fallback_used_for_empty_input": all(f for q, _, _, f in one if q == 2) and any(q == 2 for q, _, _, _ in one)}
