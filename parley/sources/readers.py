"""Readers for dialogue files, state and run metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import records
from parley.operators.joins import zip_arrays
from parley.schemas import (
    DIALOGUE_JSON, HASH_STATE, METRIC_COLUMNS, PERSONA, RUN_METRICS_JSON, SEED, VECTOR_STATE,
)
from parley.sources import json_array, npy

CORRUPT = "_corrupt_record"


def read_strict(spark: SparkSession, path: str, schema: T.StructType = DIALOGUE_JSON, *,
                others: str | None = None, record: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped and a line that is not one JSON object fails the read.

    A field of another type than the schema's becomes null; ``shape.violations`` reports it. Fields
    outside the schema go to the VARIANT column ``others``, the whole canonical text to ``record``.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    return _typed(lines.select(records.canonical(F.col("value")).alias("value")), schema, others, record)


def _typed(lines: DataFrame, schema: T.StructType, others: str | None = None, record: str | None = None) -> DataFrame:
    """Columns of the schema from ``value``, the text of a record."""
    more = ([] if others is None else [records.other_fields(F.col("value"), schema).alias(others)]) + (
        [] if record is None else [F.col("value").alias(record)])
    return lines.select(F.from_json("value", schema).alias("r"), *more).select(
        "r.*", *[c for c in (others, record) if c is not None])


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType = DIALOGUE_JSON) -> tuple[DataFrame, DataFrame]:
    """JSON lines -> (records, bad lines as ``line``)."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json(
        "value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    good = parsed.where(~bad).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    return good, parsed.where(bad).select(F.col("value").alias("line"))


def read_array(spark: SparkSession, path: str, schema: T.StructType = DIALOGUE_JSON, *,
               others: str | None = None, record: str | None = None, chunk: int = json_array.CHUNK) -> DataFrame:
    """A file holding one JSON array, read in chunks by many tasks (see ``json_array``).

    Fields are read as in :func:`read_strict`; a file that is no array of objects fails with the place.
    """
    rows = json_array.read(spark, path, chunk)
    return _typed(rows.select(records.canonical(F.col("value")).alias("value")), schema, others, record)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Dialogue lines -> validated flat turn rows."""
    from parley.operators.shape import flatten_dialogues, require_valid, with_joined_lists

    return with_joined_lists(require_valid(flatten_dialogues(read_strict(spark, path))))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEED).parquet(path)


def read_personas(spark: SparkSession, path: str) -> DataFrame:
    """Personas with ``idx``, their place in the files, which are taken in the order of their names."""
    place = F.col("_metadata")
    rows = spark.read.schema(PERSONA).parquet(path).select(
        "*", place["file_path"].alias("_file"), place["row_index"].alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = sizes.select("_file", (F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))  # a row per file
    return rows.join(F.broadcast(before), "_file").select(
        (F.col("_before") + F.col("_row")).alias("idx"), *PERSONA.names)


def _or_empty(spark: SparkSession, schema: T.StructType, load) -> DataFrame:
    """State that has not been written yet is empty."""
    try:
        return load()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_known_ids(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("dialogue_id", T.StringType())])
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).json(path)).distinct()


def read_known_hashes(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(spark, HASH_STATE, lambda: spark.read.schema(HASH_STATE).json(path)).distinct()


def read_vector_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of ``.npy`` state, read by ranges of rows; empty where there is none yet."""
    return npy.read(spark, path)


def read_known_vectors(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(spark, VECTOR_STATE, lambda: spark.read.schema(VECTOR_STATE).parquet(path))


def read_run_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A metrics object -> (one-row summary, one row per position of its arrays)."""
    whole = spark.read.schema(RUN_METRICS_JSON).option("multiLine", True).json(path)
    arrays = [f.name for f in RUN_METRICS_JSON.fields if isinstance(f.dataType, T.ArrayType)]
    return whole.drop(*arrays), zip_arrays(whole, arrays)


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per-position metrics as text, for ``clean_metrics``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in METRIC_COLUMNS])
    return spark.read.schema(schema).option("header", True).csv(path)
