"""Writers for dialogue files, state, split results and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.shape import for_export
from parley.session import scratch_path
from parley.sources import split_lines

BATCH_ROWS = 10_000


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def rewrite_with(existing: DataFrame, new: DataFrame, target: str) -> None:
    """Old rows and new rows under a fresh path; the path being read is never overwritten."""
    existing.unionByName(new, allowMissingColumns=True).write.mode("errorifexists").json(target)


def append_batches(df: DataFrame, path: str, rows: int = BATCH_ROWS) -> None:
    df.write.mode("append").option("maxRecordsPerFile", rows).json(path)


def append_hashes(df: DataFrame, path: str, column: str = "hash") -> None:
    df.select(F.col(column).alias("hash")).write.mode("append").json(path)


def append_vectors(df: DataFrame, path: str) -> None:
    """(id, embedding) rows added to the vector state."""
    df.select(F.col("id").cast("long").alias("id"),
              F.col("embedding").cast("array<float>").alias("embedding")
              ).write.mode("append").parquet(path)


def write_split(df: DataFrame, keep: Column, kept_path: str, removed_path: str,
                record: str | None = None) -> tuple[int, int]:
    """Kept rows to one path, the others to a second, in one pass and one commit; returns both counts.

    Rows are written as JSON of their columns, or as the text of the column ``record``.
    """
    line = F.to_json(F.struct("*")) if record is None else F.col(record)
    return split_lines.write(df, keep, line, kept_path, removed_path, scratch_path(df.sparkSession, "split"))


def write_dead_letters(failed: DataFrame, path: str) -> bool:
    return write_unless_empty(failed, path)


def write_unless_empty(df: DataFrame, path: str) -> bool:
    """Write nothing at all for an empty result; tells whether there was something."""
    if df.isEmpty():
        return False
    df.write.json(path)
    return True


def export(dialogues: DataFrame, path: str) -> None:
    """Published form of the corpus."""
    for_export(dialogues).write.json(path)


def write_run_metrics(summary: DataFrame, series: DataFrame, path: str) -> None:
    """Summary as one JSON object, the per-position series as lines beside it.

    The series stay rows: gathered into one object they would have to pass through one task.
    """
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    series.write.mode("overwrite").json(f"{path}/series")


def write_metrics_csv(series: DataFrame, summary: DataFrame, path: str) -> None:
    """Per-position metrics with the run totals repeated on each row."""
    from parley.operators.ordering import beside

    totals = summary.select(
        "total_dialogues_attempted", "total_dialogues_generated", "total_time_taken")
    beside(series, totals).select(
        "retries_per_dialogue", "request_latencies", "tokens_used_per_request", "dialogue_turns",
        *totals.columns).write.mode("overwrite").option("header", True).csv(path)
