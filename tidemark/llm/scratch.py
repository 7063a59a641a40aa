"""Lineage cuts and scratch tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder.  Only where a session has none and its master is local
(unit tests, a laptop) is a temporary one made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path; sets Spark's checkpoint folder if it has none."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name of its own below the shared one (not created)."""
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; what follows reads it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table (``options`` of its writer) in the shared folder, read back with column pruning."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
