"""Streaming form of the batch-after-batch generation run: drops of files, state, append-only output."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators import similarity
from parley.operators.dedup import append_unique
from parley.session import cut

MOST_BATCHES = 4  # batches that the files of a folder make when a run begins, at most
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_drops(spark: SparkSession, folder: str, schema: T.StructType, files: int = 1,
               most_batches: int = MOST_BATCHES) -> DataFrame:
    """Files of a folder as a stream, ``files`` of them per batch.

    Every batch runs a task for each partition of the state, and each reports to the driver. Where
    the files at hand would make more than ``most_batches`` batches, a batch takes more of them, so
    tasks and reports do not grow with files times partitions.
    """
    waiting = len(spark.read.schema(schema).json(folder).inputFiles())
    per_batch = max(files, math.ceil(waiting / most_batches))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)


def run_unique(drops: DataFrame, key: str, target: str, checkpoint: str) -> None:
    """Append rows with a key not met before to ``target`` until the drops are used up.

    Keys met are operator state, kept by RocksDB on disk and hashed over the tasks.
    """
    drops.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    (drops.dropDuplicates([key]).writeStream.format("json").outputMode("append")
     .option("path", target).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def run_append(drops: DataFrame, target: str, checkpoint: str) -> None:
    """Append every row to ``target`` as JSON lines."""
    (drops.writeStream.format("json").outputMode("append").option("path", target)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def run_unique_vectors(drops: DataFrame, target: str, checkpoint: str, *, key: str, position: str,
                       vector: str, threshold: float = 0.9, among_new: bool = True, cells: int = 64,
                       **search) -> None:
    """Append rows that are new by key and by similarity to everything accepted before.

    The accepted rows are themselves the state, in folders by cell: each batch reads only the cells
    in which something may be near one of its rows, and writes its own folder, so a repeated batch
    replaces its output instead of doubling it. Cells have fixed pivots, rows of the first batch.
    Keys met before are operator state where rows are held against each other; where they are not
    (``among_new=False``), copies in one batch all face the state, and keys are read from the table.
    """
    spark = drops.sparkSession
    schema = drops.schema
    if among_new:  # a key that comes again would be refused again
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        drops = drops.dropDuplicates([key])

    def accept(batch: DataFrame, number: int) -> None:
        batch = cut(batch)
        pivots = _fixed_pivots(spark, f"{target}/_pivots", batch.select(
            F.col(position).alias("id"), F.col(vector).alias("vec")), cells)
        placed = cut(with_cells(batch, vector, pivots, threshold))
        touched = sorted(r[0] for r in placed.select(F.explode("_near")).distinct().collect())  # of the fixed cells
        placed = placed.drop("_near")
        known = _accepted(spark, target, schema).where(F.col("batch") < number)
        near = known.where(F.col("cell").isin(touched)).select(F.col(position).alias("id"), F.col(vector).alias("vec"))
        keys = known.select(key) if not among_new else batch.limit(0).select(key)
        kept = append_unique(placed, keys, near, key=key, position=position,
                             vector=vector, threshold=threshold, among_new=among_new, **search)
        (kept.withColumnRenamed("_cell", "cell").repartition("cell")
         .write.mode("overwrite").partitionBy("cell").parquet(f"{target}/batch={number}"))

    (drops.writeStream.foreachBatch(accept).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def _fixed_pivots(spark: SparkSession, path: str, vectors: DataFrame, cells: int) -> np.ndarray:
    """Pivots of the stream: drawn from its first rows with a vector, the same ever after."""
    from parley.sources.readers import _or_empty

    def stored() -> DataFrame:
        return _or_empty(spark, T.StructType.fromDDL("cell int, vec array<double>"),
                         lambda: spark.read.schema("cell int, vec array<double>").parquet(path))

    found = stored().orderBy("cell").collect()  # at most ``cells`` rows
    if not found:
        drawn = similarity.pick_pivots(similarity.unit_vectors(vectors).drop("key"), cells).matrix
        if not drawn.size:
            return np.zeros((0, 0))
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(drawn)],
                              "cell int, vec array<double>").coalesce(1).write.mode("overwrite").parquet(path)
        return drawn
    return np.array([r.vec for r in found])


def with_cells(rows: DataFrame, vector: str, pivots: np.ndarray, threshold: float) -> DataFrame:
    """``rows`` with ``_cell``, that of the nearest pivot, and ``_near``, all cells to be looked at.

    A row within the search angle of ``x`` has its nearest pivot at most two search angles farther
    from ``x`` than the nearest pivot of ``x`` is; other cells cannot hold it. A row without
    direction is in cell -1 and looks at nothing.
    """
    reach = 2 * math.acos(min(1.0, max(-1.0, threshold))) + similarity.SLACK

    def place(column: pa.Array) -> pa.Array:
        cell, counts, near = np.full(len(column), -1, np.int32), np.zeros(len(column), np.int64), []
        valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        if len(valid) and len(pivots):
            x = similarity.to_matrix(column.take(pa.array(valid)).cast(pa.list_(pa.float64())))
            length = np.linalg.norm(x, axis=1)
            valid, x = valid[length > 0], x[length > 0] / length[length > 0, None]
            angle = np.arccos(np.clip(x @ pivots.T, -1, 1))
            cell[valid] = angle.argmin(axis=1)
            which, near = np.nonzero(angle <= angle.min(axis=1, keepdims=True) + reach)
            counts[valid] = np.bincount(which, minlength=len(valid))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(near, pa.int32()))
        return pa.StructArray.from_arrays([pa.array(cell), lists], ["cell", "near"])

    placed = F.arrow_udf(place, "struct<cell:int,near:array<int>>")(F.col(vector))
    return rows.withColumn("_placed", placed).select(
        *rows.columns, F.col("_placed.cell").alias("_cell"), F.col("_placed.near").alias("_near"))


def _accepted(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    from parley.sources.readers import _or_empty

    wide = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("cell", T.IntegerType())])
    return _or_empty(spark, wide, lambda: spark.read.schema(wide).parquet(target))


def read_accepted(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    return _accepted(spark, target, schema).drop("batch", "cell")
