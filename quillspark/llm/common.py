"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable
from functools import wraps

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Only used by a local session that names no spark.checkpoint.dir, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all machines of a cluster share. On a cluster
    that setting must be there; a local session, whose executor is the driver, can do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(root or LOCAL_CHECKPOINTS).rstrip('/')}/quillspark/{what}-{uuid.uuid4().hex}"


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row of docs as one struct, `row`, with further columns, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def unpacked(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(n).alias(n) for n in names])


def stage(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, with file statistics."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch on its way to a worker.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df; Arrow batches of texts stay small where the session leaves their size at Spark's default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, f"{64 << 20}b") == f"{64 << 20}b":
        df.sparkSession.conf.set(name, f"{BATCH_BYTES}b")
    return df


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives the worker's free memory back to the machine at its end, so
    that idle workers do not add to what later stages need."""
    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
