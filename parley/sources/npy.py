"""Matrices in ``.npy`` files as vector tables: rows are read by ranges that the header tells.

A file's header gives type and shape, so its rows are cut into ranges of equal bytes without reading
them, and a task reads one range. A folder is the matrix of its files in the order of their names; the
writer gives each task files of its own, named in order, and shows them all at once.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from parley.sources import files

RANGE_BYTES = 32 << 20
ROWS = "id bigint, embedding array<float>"


def header(path: str) -> tuple[np.dtype, int, int, int]:
    """(type, rows, columns, bytes before the first row) of a two-dimensional array."""
    system, inner = files.at(path)
    with system.open_input_file(inner) as source:
        head = io.BytesIO(source.read(1 << 16))
    version = np.lib.format.read_magic(head)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0)
                              else np.lib.format.read_array_header_2_0)(head)
    if len(shape) != 2 or by_column or kind.hasobject:
        raise ValueError(f"{path} is no matrix of numbers by rows")
    return kind, shape[0], shape[1], head.tell()


@dataclass
class _Range(InputPartition):
    path: str
    first: int  # row in the file
    rows: int
    number: int  # of the first row in the whole matrix


class NpySource(DataSource):
    """Data source ``npy``: (id, embedding), ids count rows from 0."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[InputPartition]:
        out, number = [], 0
        for path, _ in files.listed(self.path, ".npy"):
            kind, rows, columns, _ = header(path)
            step = max(1, self.size // max(1, kind.itemsize * columns))
            out += [_Range(path, at, min(step, rows - at), number + at) for at in range(0, rows, step)]
            number += rows
        return out or [_Range("", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        kind, _, columns, start = header(part.path)
        system, inner = files.at(part.path)
        with system.open_input_file(inner) as source:
            row = kind.itemsize * columns
            for at in range(0, part.rows, 4096):
                n = min(4096, part.rows - at)
                raw = source.read_at(n * row, start + (part.first + at) * row)
                if len(raw) < n * row:
                    raise ValueError(f"{part.path} breaks off at row {part.first + at + len(raw) // row}")
                x = np.frombuffer(raw, kind).astype(np.float32)
                offsets = pa.array(np.arange(0, n * columns + 1, max(columns, 1), dtype=np.int32)[:n + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.number + at + np.arange(n)), pa.ListArray.from_arrays(offsets, pa.array(x))],
                    names=["id", "embedding"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> files.Written:
        hidden, task, n = files.Hidden(), TaskContext.get().partitionId(), 0
        try:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index("embedding"))
                if not len(column):
                    continue
                sizes = set(column.value_lengths().to_pylist())
                if len(sizes) != 1 or None in sizes:
                    raise ValueError(f"vectors of different lengths: {sorted(map(str, sizes))[:5]}")
                x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)
                with hidden.create(self.path, f"part-{task:06d}-{n:06d}-{hidden.mark[:8]}.npy") as out:
                    np.lib.format.write_array(out, x, version=(1, 0), allow_pickle=False)
                n += 1
        except BaseException:
            hidden.drop()
            raise
        return files.Written(hidden.files, {})

    def commit(self, messages: list) -> None:
        files.reveal(messages)

    def abort(self, messages: list) -> None:
        for message in messages:
            if message:
                files.discard(message.files)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, embedding) of a file or folder; no rows where there is none yet."""
    spark.dataSource.register(NpySource)
    try:
        files.listed(path, ".npy")
    except FileNotFoundError:
        return spark.createDataFrame([], ROWS)
    return spark.read.format("npy").option("path", path).option("rangebytes", range_bytes).load()


def write(vectors: DataFrame, path: str) -> None:
    """Vectors of (id, embedding) in the order of their ids; ids are then the rows' numbers."""
    vectors.sparkSession.dataSource.register(NpySource)
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows.repartitionByRange("id").sortWithinPartitions("id").write.format("npy").option("path", path).mode("append").save()
