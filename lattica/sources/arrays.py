"""A data source for .npy arrays: spark.read.format("npy").load(path)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_PARTITION = 1_000_000
ROWS_AT_ONCE = 50_000


class Slice(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self):
        n = len(np.load(self.path, mmap_mode="r"))
        return [Slice(i, min(i + self.rows, n)) for i in range(0, n, self.rows)] or [Slice(0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        array = np.load(self.path, mmap_mode="r")
        for i in range(partition.start, partition.end, ROWS_AT_ONCE):
            part = np.array(array[i : min(i + ROWS_AT_ONCE, partition.end)])
            kind = _kind(array.dtype)
            value = pa.array(part.astype(kind)) if part.ndim == 1 else pa.array(list(part.reshape(len(part), -1).astype(kind)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part), dtype=np.int64)), value], names=["row_id", "value"])


def _kind(dtype: np.dtype):
    return np.float32 if dtype == np.float32 else np.float64 if dtype.kind == "f" else np.int64


class NpyDataSource(DataSource):
    """One row per entry of the first axis: row_id, and value, an array if there are more axes.

    Slices of the file are mapped into memory where they are read. Options: rows, the rows of a partition. Whole
    numbers and booleans come as BIGINT, other types of numbers as DOUBLE or, for 32 bits, FLOAT.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _path(self) -> str:
        return self.options["path"].removeprefix("file://")

    def schema(self) -> str:
        array = np.load(self._path(), mmap_mode="r")
        kind = {np.float32: "float", np.float64: "double", np.int64: "bigint"}[_kind(array.dtype)]
        return f"row_id bigint, value {kind if array.ndim == 1 else f'array<{kind}>'}"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self._path(), int(self.options.get("rows", ROWS_PER_PARTITION)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyDataSource)
