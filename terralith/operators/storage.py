"""Writing intermediate tables where driver and executors both reach them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder stands in for it in local mode (tests) only."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if where is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="terralith-")
        context.setCheckpointDir(where)
    return where


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again, and where it lies."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows of a task, on average, where a table is dealt out by its count.
TASK_ROWS = 500_000


def dealt(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """``df`` by its ``keys`` in as many partitions as its rows ask for, ``times`` so many where each row grows.

    What a task holds is bounded by ``TASK_ROWS`` at any size: neither the number of input files nor
    the merging of small partitions, which goes by their compressed bytes, decides it.
    """
    return df.repartition(partitions(df, times), *keys)


def partitions(df: DataFrame, times: int = 1) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() * times // TASK_ROWS))


def stored(df: DataFrame) -> DataFrame:
    return stored_at(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
