"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made in local mode (tests), where driver
    and executors are one process; elsewhere that is an error.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if where is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="terralith-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


#: Tables stored by this driver that have not been removed.
_TABLES: list[str] = []


@contextmanager
def scratch(spark: SparkSession, keep: list[str]) -> Iterator[None]:
    """Remove every table that is stored inside, except those whose paths are in ``keep`` at the end.

    For steps whose result is written: what they stored on the way is read by nothing afterwards.
    """
    before = len(_TABLES)
    yield
    for path in [x for x in _TABLES[before:] if x not in keep]:
        discard(spark, path)


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with files that survive the loss of any executor.
    """
    return stored(df, codec)[0]


def stored(df: DataFrame, codec: str = "zstd") -> tuple[DataFrame, str]:
    """``materialise`` with the path of the table, for ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _TABLES.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows that are worth a file of their own in a table of few columns.
FILE_ROWS = 200_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` narrow rows in as many partitions as that is worth, eight at least.

    Never more partitions than before. Small tables otherwise come in one tiny file for each
    shuffle partition, and files cost more than their rows.
    """
    return df.coalesce(max(8, -(-rows // FILE_ROWS)))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    if path in _TABLES:
        _TABLES.remove(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(column: str = "text"):
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
