"""Joins with a small-or-large table by keys that may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .batches import free_name

#: Rows of the looked-up side up to which it is broadcast (of some ten bytes to a hundred each).
BROADCAST_ROWS = 100_000
SALTS = 32


def _lookup(df: DataFrame, table: DataFrame, key: str, rows: int, limit: int, salts: int, how: str) -> DataFrame:
    if rows <= limit:
        return df.join(F.broadcast(table), key, how)
    salt = free_name(df, free_name(table, "__salt__"))
    # By the row itself: a task that runs again after a lost executor deals its rows as before, in whatever order they come.
    parts = [F.col(f"`{c}`") for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]
    left = df.withColumn(salt, F.pmod(F.xxhash64(*parts), F.lit(salts)).cast("int"))
    right = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, salt], how).drop(salt)


def left_lookup(df: DataFrame, table: DataFrame, key: str, rows: int, limit: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """``df`` left join ``table`` (unique in ``key``, of ``rows`` rows).

    Up to ``limit`` rows the table is broadcast.  Beyond, each row of ``df`` gets one of
    ``salts`` and the table is repeated for each, so that a hot key is spread over as many tasks.
    Which salt a row gets doesn't change the result.
    """
    return _lookup(df, table, key, rows, limit, salts, "left")


def inner_lookup(df: DataFrame, table: DataFrame, key: str, rows: int, limit: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """As ``left_lookup``, with the rows of ``df`` whose key is in the table."""
    return _lookup(df, table, key, rows, limit, salts, "inner")


def skew_join(df: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``df`` join ``table`` by the long ``key`` (unique in ``table``), in which adaptive execution can split a hot key of ``df``.

    It can't where a side comes straight from an aggregate by that key, so the table's key is
    made a new value, for which the table is dealt out again.  A merge join: many small tables joined
    in a row needn't each pass through the driver.
    """
    twin = free_name(df, free_name(table, "__key__"))
    again = table.select(F.col(key).bitwiseXOR(F.lit(0)).alias(twin), *[F.col(c) for c in table.columns if c != key])
    return df.join(again.hint("merge"), df[key] == again[twin], how).drop(twin)
