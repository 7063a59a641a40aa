from pyspark.sql import functions as F

from tidemark.operators import cleaning, rankings


def test_latest_ratings_equal_resolved_ones_without_a_window(spark):
    rows = [(k, k % 3, k % 4, float(k % 2) + 1, 100 + k % 5, k % 7) for k in range(200)]
    flagged = spark.createDataFrame(rows, "source_row long, user_id long, movie_id long, rating double, epoch long, source_movie_id long")
    flagged = flagged.withColumn("timestamp", F.timestamp_seconds("epoch")).withColumn("reason", F.when(F.col("source_row") % 11 == 0, "invalid_rating"))
    columns = ["user_id", "movie_id", "rating", "timestamp", "source_movie_id", "source_row"]
    got = cleaning.latest_ratings(flagged)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cleaning.ratings_clean(cleaning.resolve_duplicates(flagged)).select(*columns).collect()))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_thresholds_make_their_statistics_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    stats = spark.range(100).select(F.col("id").alias("movie_id"), F.col("id").alias("rating_count")).mapInArrow(count, "movie_id long, rating_count long")
    got = {r["percentile"]: (r["m"], r["eligible"]) for r in rankings.threshold_candidates(stats).collect()}
    assert got == {0.8: (80, 20), 0.9: (90, 10), 0.95: (95, 5)} and made.value == 100
