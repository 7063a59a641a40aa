"""Scans: CSV, Parquet, JSON lines, exported interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.events import coerce_id

from . import scratch

EVENT = T.StructType([T.StructField(n, T.StringType()) for n in ("event_id", "user_id", "movie_id", "event_type", "value", "timestamp")])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = True) -> DataFrame:
    """A CSV file with a header and quoted cells; missing marks in text cells are left to the cleaning.

    Pass ``multiline=False`` where no cell holds a line end, so that large files are split.
    """
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE").csv(path)


def with_source_row(df: DataFrame) -> DataFrame:
    """``df``, as a reader of files gives it, and ``source_row``: 0, 1, 2, ... by the path of its files and the place in them.

    A task reads whole splits of files one after the other, so a row's place in its split is its place in the task less that of
    the split's first row.  The splits' sizes, a number each, are summed up in the order of path and start; nothing is sorted or moved.
    """
    spot = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.select(*df.columns, F.col("_metadata.file_path").alias("__file__"), F.col("_metadata.file_block_start").alias("__start__"), spot.alias("__spot__"))
    splits = rows.groupBy("__file__", "__start__").agg(F.count("*").alias("n"), F.min("__spot__").alias("first")).collect()
    offsets, total = [], 0
    for r in sorted(splits):
        offsets.append((r["__file__"], r["__start__"], total - r["first"]))
        total += r["n"]
    before = df.sparkSession.createDataFrame(offsets, "__file__ string, __start__ long, __before__ long")
    placed = rows.join(F.broadcast(before), ["__file__", "__start__"])  # a row a split
    return placed.select(*df.columns, (F.col("__before__") + F.col("__spot__")).alias("source_row"))


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def user_history(interactions: DataFrame, user_id: int, limit: int = 15) -> DataFrame:
    """A user's newest rows; the filter reaches the scan."""
    return interactions.filter(F.col("user_id") == user_id).orderBy(F.desc("timestamp"), F.desc("movie_id")).limit(limit)


def read_events(spark: SparkSession, path: str, schema: T.StructType = EVENT, pattern: str = "*.json*") -> tuple[DataFrame, DataFrame]:
    """(events, a row with the number of lines left out) of every file below ``path`` whose name fits ``pattern``.

    A file that begins with "[" holds one array of objects, over one line or many; if it can't be read, it counts as one line left out.
    Any other holds an object a line; lines that hold something else are counted.  Elements of an array that aren't objects are passed over.

    The files are read once, as lines; only the lines of array files are brought together, file by file.  Values are variants, so
    every file may have its own shape.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    spot = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    kept = scratch.stored(lines.select("value", F.col("_metadata.file_path").alias("file"), spot.alias("spot")).filter(F.trim("value") != ""), "lines")
    shapes = kept.groupBy("file").agg(F.min_by(F.ltrim("value").startswith("["), "spot").alias("array"))
    shaped = kept.join(shapes, "file")
    single = shaped.filter("not array").select(F.try_parse_json("value").alias("v"))
    single = single.select(F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")).alias("v"))
    text = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("spot", "value"))), lambda x: x["value"]))
    whole = shaped.filter("array").groupBy("file").agg(text.alias("value")).select(F.try_parse_json("value").alias("v"))
    elements = whole.filter("v is not null").select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    values = single.filter("v is not null").unionByName(elements)
    events = values.select(*[F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields])
    bad = single.select(F.col("v").isNull().alias("b")).unionByName(whole.select(F.col("v").isNull().alias("b")))
    return events, bad.agg(F.count_if("b").alias("skipped"))


def since(events: DataFrame, start: Column) -> tuple[DataFrame, DataFrame]:
    """(rows at or after ``start`` or without a time, counters).

    Rows without a usable user or movie are left out; types that are not scored stay in.
    """
    late = F.col("timestamp").isNull() | (F.col("timestamp") >= start)
    usable = coerce_id(F.col("user_id")).isNotNull() & coerce_id(F.col("movie_id")).isNotNull()
    counters = events.agg(
        F.count_if(late & usable).alias("kept"),
        F.count_if(~late).alias("older"),
        F.count_if(F.col("timestamp").isNull()).alias("without_time"),
        F.count_if(~usable).alias("unusable"),
    )
    return events.filter(late & usable), counters
