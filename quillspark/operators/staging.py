"""Written intermediate tables and checked broadcasts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only used by a local session that names no spark.checkpoint.dir, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Rows of a table that may travel to every executor.
SMALL_ROWS = 200_000


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all machines of a cluster share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(root or LOCAL_CHECKPOINTS).rstrip('/')}/quillspark/{what}-{uuid.uuid4().hex}"


def stage(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: df is written to the shared folder and read back."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A staged table, marked for broadcast if it has at most `most` rows; beyond, joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df over as many tasks as the session shuffles to, by the columns `by`: few rows in bytes with much work
    on each, which AQE would merge into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks at least as the session shuffles to: a small file is one task, and much work
    on each of its rows would run there alone. Large inputs have more splits than that and stay as they are."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
