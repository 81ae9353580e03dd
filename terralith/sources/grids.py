"""A Python data source for binary label grids, read in byte ranges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of labels that one partition reads.
SPLIT = 64 << 20
#: Longest header line.
_HEAD = 4096


class _Range(InputPartition):
    def __init__(self, offset: int, first: int, count: int):
        self.offset, self.first, self.count = offset, first, count


def _open(path: str):
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return files.open_input_file(at)


class LabelGridReader(DataSourceReader):
    """Plans byte ranges from the header and the file's size; each task reads its own."""

    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        with _open(self.path) as f:
            head, end, _ = f.read(_HEAD).partition(b"\n")
            if not end:
                raise ValueError("label grid: no header line")
            self.shape = tuple(int(x) for x in head.split()[:3])
            self.start = len(head) + 1
            if f.size() - self.start != 4 * self.shape[0] * self.shape[1] * self.shape[2]:
                raise ValueError("label grid: labels and dimensions differ")

    def partitions(self):
        total = self.shape[0] * self.shape[1] * self.shape[2]
        step = max(1, self.split // 4)
        return [_Range(self.start + 4 * at, at, min(step, total - at)) for at in range(0, total, step)] or [_Range(self.start, 0, 0)]

    def read(self, partition):
        import numpy as np

        nx, ny, _ = self.shape
        with _open(self.path) as f:
            for at in range(0, partition.count, 1 << 20):
                n = min(1 << 20, partition.count - at)
                labels = np.frombuffer(f.read_at(4 * n, partition.offset + 4 * at), "<i4")
                place = np.arange(partition.first + at, partition.first + at + n)
                columns = [place % nx, place // nx % ny, place // (nx * ny), labels]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in columns], ["ix", "iy", "iz", "label"])


class LabelGridSource(DataSource):
    """``spark.read.format("label_grid").load(path)``: a header line 'nx ny nz ...', then int32 with x fastest.

    Option ``split``: bytes of labels a partition reads.
    """

    @classmethod
    def name(cls) -> str:
        return "label_grid"

    def schema(self) -> str:
        return "ix int, iy int, iz int, label int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LabelGridReader(self.options)


def read_label_grid(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(ix, iy, iz, label) of a label file in as many partitions as its bytes are worth.

    For stores that Arrow opens (local and shared folders, S3, GCS, HDFS with its client);
    ``text.label_grid`` reads whole files through Spark from any other.
    """
    spark.dataSource.register(LabelGridSource)
    return spark.read.format("label_grid").option("split", str(split)).load(path)
