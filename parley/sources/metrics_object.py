"""The metrics of a run as one JSON object, written by many tasks.

The object holds the run's totals and one array per series. Rows are range partitioned by position;
each task writes its stretch of every array, and the commit strings the stretches together in order.
So neither a row nor a task ever holds a whole series, and the file appears when it is complete.
"""

from __future__ import annotations

import json
import shutil
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from parley.sources import files


@dataclass
class _Stretch(files.Written):
    part: int = 0


class MetricsObject(DataSource):
    """Data source ``metrics_object`` for rows whose columns are the arrays, in order."""

    @classmethod
    def name(cls) -> str:
        return "metrics_object"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["file"], self.options["totals"], schema.names[1:])


class _Writer(DataSourceArrowWriter):
    def __init__(self, file: str, totals: str, names: list[str]):
        self.folder, self.name = file.rstrip("/").rsplit("/", 1)
        self.totals, self.names = totals, names

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Stretch:
        hidden, open_, counts = files.Hidden(), {}, {}
        part = TaskContext.get().partitionId()
        try:
            for batch in batches:
                ends = batch.column(0).to_pylist()
                for k, name in enumerate(self.names):
                    # a series ends with its last value; only gaps before that are null
                    texts = [json.dumps(v) for v, end in zip(batch.column(k + 1).to_pylist(), ends) if end >> k & 1]
                    if not texts:
                        continue
                    if name not in open_:
                        open_[name] = hidden.create(self.folder, f"{part:06d}-{k}")
                    open_[name].write((", " * (name in counts) + ", ".join(texts)).encode())
                    counts[name] = counts.get(name, 0) + len(texts)
            for out in open_.values():
                out.close()
        except BaseException:
            hidden.drop()
            raise
        return _Stretch(hidden.files, counts, part)

    def commit(self, messages: list) -> None:
        stretches = sorted((m for m in messages if m), key=lambda m: m.part)
        whole = files.Hidden()
        system, folder = files.at(self.folder)
        with whole.create(self.folder, self.name) as out:
            out.write(self.totals.rstrip()[:-1].encode())
            first = self.totals.strip() == "{}"
            for k, name in enumerate(self.names):
                out.write(f'{"" if first else ", "}{json.dumps(name)}: ['.encode())
                first, more = False, False
                for message in stretches:
                    for _, hidden, part in message.files:
                        if part.endswith(f"-{k}"):
                            out.write(b", " * more)
                            with system.open_input_stream(f"{folder}/{hidden}") as source:
                                shutil.copyfileobj(source, out, 1 << 20)
                            more = True
                out.write(b"]")
            out.write(b"}\n")
        files.reveal([files.Written(whole.files, {})])
        self._clear(stretches)

    def abort(self, messages: list) -> None:
        self._clear([m for m in messages if m])

    @staticmethod
    def _clear(messages: list) -> None:
        for message in messages:
            files.discard(message.files)


def write(summary: DataFrame, series: DataFrame, file: str, position: str = "pos") -> None:
    """``summary``, one row, and ``series``, a row per position, as one object in ``file``."""
    series.sparkSession.dataSource.register(MetricsObject)
    names = [c for c in series.columns if c != position]
    last = series.agg(*[F.max(F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in names]).first()
    inside = F.lit(0)  # a bit for each series that has not ended yet
    for k, c in enumerate(names):
        if last[c] is not None:
            inside = inside + F.when(F.col(position) <= last[c], 1 << k).otherwise(0)
    totals = summary.select(F.to_json(F.struct("*")).alias("o")).first().o  # the one row of totals
    (series.repartitionByRange(position).sortWithinPartitions(position).select(inside.alias("inside"), *names)
     .write.format("metrics_object").option("file", file).option("totals", totals).mode("append").save())
