"""One pass over the rows, two sets of line files, one commit.

Every task writes its kept and its removed lines under hidden names; the commit shows them all. A
failed task, and an aborted job, leave neither.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from parley.sources import files


class SplitLines(DataSource):
    """Data source ``split_lines`` for rows (keep boolean, line string)."""

    @classmethod
    def name(cls) -> str:
        return "split_lines"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.targets = {True: options["kept"], False: options["removed"]}
        self.report = options["report"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> files.Written:
        hidden, open_, counts = files.Hidden(), {}, {"kept": 0, "removed": 0}
        name = f"part-{TaskContext.get().partitionId():05d}-{hidden.mark[:8]}.json"
        try:
            for batch in batches:
                for keep, folder in self.targets.items():
                    lines = batch.column(1).filter(pc.equal(batch.column(0), keep))
                    if not len(lines):
                        continue
                    if keep not in open_:
                        open_[keep] = hidden.create(folder, name)
                    open_[keep].write("".join(f"{x}\n" for x in lines.to_pylist()).encode())
                    counts["kept" if keep else "removed"] += len(lines)
            for out in open_.values():
                out.close()
        except BaseException:
            hidden.drop()
            raise
        return files.Written(hidden.files, counts)

    def commit(self, messages: list) -> None:
        files.put_text(self.report, json.dumps(files.reveal(messages)))

    def abort(self, messages: list) -> None:
        for message in messages:
            if message:
                files.discard(message.files)


def write(df: DataFrame, keep: Column, line: Column, kept: str, removed: str, report: str) -> tuple[int, int]:
    """Lines of rows where ``keep`` is true below ``kept``, all others below ``removed``; both counts."""
    df.sparkSession.dataSource.register(SplitLines)
    (df.select(F.coalesce(keep, F.lit(False)).alias("keep"), line.alias("line")).write.format("split_lines")
     .option("kept", kept).option("removed", removed).option("report", report).mode("append").save())
    counts = files.get_json(report)
    return counts.get("kept", 0), counts.get("removed", 0)
