"""Comparisons inside large groups, dealt to many tasks without pairing a group with itself row by row.

A group has a leader.  Rows near it are linked to it and are done: they are connected
already.  Only the rest (the free rows) are compared with all members, a block of each in a
task, and a task leaves a spanning forest.  So a family around one text costs its size, and
no link between rows that are not connected otherwise is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lookup import skew_join


def pairs_of_blocks(members: DataFrame, free: DataFrame, key: str, node: str, block: int) -> DataFrame:
    """(columns of both, side, i, j): members (side 0) and free rows (side 1) of a key, dealt so that each
    member meets each free row in one (key, i, j).  Both tables have the same columns."""
    of = free.groupBy(key).agg(F.count("*").alias("nf")).join(members.groupBy(key).agg(F.count("*").alias("nm")), key)
    sizes = of.select(key, F.ceil(F.col("nm") / block).cast("int").alias("im"), F.ceil(F.col("nf") / block).cast("int").alias("jf"))
    columns = members.columns
    spot = lambda size: F.pmod(F.xxhash64(node), F.col(size)).cast("int")
    each = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    left = skew_join(members, sizes, key).select(*columns, F.lit(0).alias("side"), spot("im").alias("i"), each("jf").alias("j"))
    right = skew_join(free, sizes, key).select(*columns, F.lit(1).alias("side"), spot("jf").alias("j"), each("im").alias("i"))
    return left.unionByName(right)
