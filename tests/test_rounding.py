"""Scores whose rounding lies half way, by their scaled double."""

from pyspark.sql import functions as F

from tidemark.functions.scalars import half_up


def test_half_way_scores_follow_their_scaled_double(spark):
    rows = spark.createDataFrame([(0.0080078125,), (0.25,), (0.1234567894,), (0.1234567896,)], "x double")
    assert [r["y"] for r in rows.select(half_up(F.col("x"), 9).alias("y")).collect()] == [0.008007812, 0.25, 0.123456789, 0.12345679]
