"""Stages that call a function supplied by the caller: embedding, moderation, generation.

Spark partitions and batches the rows; the function sees one batch (or one request) at a time.
A row whose call fails carries the error instead of stopping the job. Results are written once,
so a lost executor does not call an outside service again for finished stages.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import is_valid_generation, words
from parley.operators.similarity import from_matrix
from parley.session import cut

Embed = Callable[[Sequence[str]], np.ndarray]
Score = Callable[[str], dict[str, float]]
Generate = Callable[[dict, int], tuple[str, int]]


def embed(texts: DataFrame, key: str, column: str, function: Embed, batch: int = 64) -> DataFrame:
    """(key, embedding): length-1 vectors from a function over lists of texts."""
    schema = T.StructType([texts.schema[key], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                found = np.asarray(function(part["_text"].to_pylist()), dtype="float64")
                length = np.linalg.norm(found, axis=1, keepdims=True)
                found = found / np.where(length == 0, 1, length)
                yield pa.RecordBatch.from_arrays(
                    [part[key], from_matrix(found)], names=[key, "embedding"])

    return texts.select(key, F.coalesce(F.col(column), F.lit("")).alias("_text")).mapInArrow(run, schema)


def hashed_embedding(texts: DataFrame, key: str, column: str, dimension: int = 256) -> DataFrame:
    """(key, embedding) without a model: word counts by md5 bucket, scaled to length 1.

    A bucket is the first 24 bits of the word's md5, modulo the dimension; a text without words is
    the zero vector.
    """
    def bucket(word: Column) -> Column:
        return (F.conv(F.substring(F.md5(word), 1, 6), 16, 10).cast("long") % dimension).cast("int")

    schema = T.StructType([texts.schema[key], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part["_buckets"]
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                place = row * dimension + lists.flatten().to_numpy()
                counts = np.bincount(place, minlength=len(lists) * dimension).reshape(-1, dimension).astype(float)
                length = np.linalg.norm(counts, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays(
                    [part[key], from_matrix(counts / np.where(length == 0, 1, length))], names=[key, "embedding"])

    buckets = F.transform(words(F.coalesce(F.col(column), F.lit(""))), bucket)
    return texts.select(key, buckets.alias("_buckets")).mapInArrow(run, schema)


def moderate(texts: DataFrame, key: str, column: str, function: Score, threshold: float = 0.5) -> DataFrame:
    """(key, flagged, categories, category_scores, error) from a function text -> scores."""
    schema = T.StructType([
        texts.schema[key], T.StructField("flagged", T.BooleanType()),
        T.StructField("categories", T.MapType(T.StringType(), T.BooleanType())),
        T.StructField("category_scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("error", T.StringType()),
    ])

    def one(body: str):
        try:
            scores = {k: float(v) for k, v in function(body).items()}
        except Exception as problem:
            return None, None, None, repr(problem)
        flags = {k: v >= threshold for k, v in scores.items()}
        return any(flags.values()), flags, scores, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = pd.DataFrame([one(b) for b in rows["_text"]],
                               columns=["flagged", "categories", "category_scores", "error"])
            out.insert(0, key, rows[key].to_numpy())
            yield out

    return texts.select(key, F.coalesce(F.col(column), F.lit("")).alias("_text")).mapInPandas(run, schema)


def with_one_retry(rows: DataFrame, key: str, stage: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Run ``stage``, run it once more on the rows that failed: (results, rows that failed twice)."""
    first = cut(stage(rows))
    failed = rows.join(first.where("error is not null").select(key), key, "left_semi")
    second = cut(stage(failed))
    done = first.where("error is null").unionByName(second.where("error is null"))
    left = rows.join(second.where("error is not null").select(key), key, "left_semi")
    return done, left


def attempt(requests: DataFrame, key: str, function: Generate, number: int) -> DataFrame:
    """One call per request: (key, attempt, text, error, latency_s, tokens).

    ``function`` gets the request's other columns as a dict and the attempt number, and returns
    the text and the tokens it cost.
    """
    schema = T.StructType([
        requests.schema[key], T.StructField("attempt", T.IntegerType()),
        T.StructField("text", T.StringType()), T.StructField("error", T.StringType()),
        T.StructField("latency_s", T.DoubleType()), T.StructField("tokens", T.LongType()),
    ])
    inputs = [c for c in requests.columns if c != key]

    def one(values: dict):
        start = time.perf_counter()
        try:
            body, tokens = function(values, number)
            error = None if body else "empty"
        except Exception as problem:
            body, tokens, error = None, 0, repr(problem)
        return number, body, error, time.perf_counter() - start, tokens

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = pd.DataFrame([one(v) for v in rows[inputs].to_dict("records")],
                               columns=["attempt", "text", "error", "latency_s", "tokens"])
            out.insert(0, key, rows[key].to_numpy())
            yield out

    return requests.mapInPandas(run, schema)


def generate(requests: DataFrame, key: str, function: Generate, attempts: int = 3,
             valid: Callable[[Column], Column] = is_valid_generation) -> DataFrame:
    """One row per attempt with ``ok``; requests without a valid text are tried again.

    Each attempt is a stage over the requests still open, so a slow retry holds nothing else up.
    """
    requests = cut(requests)
    open_requests, tried = requests, None
    for number in range(1, attempts + 1):
        answers = cut(attempt(open_requests, key, function, number).withColumn(
            "ok", F.col("error").isNull() & F.coalesce(valid(F.col("text")), F.lit(False))))
        tried = answers if tried is None else tried.unionByName(answers)
        failed = answers.where("not ok").select(key)
        if failed.isEmpty():
            break
        open_requests = requests.join(failed, key, "left_semi")
    return tried


def outcomes(tried: DataFrame, key: str) -> DataFrame:
    """The last attempt of every request: (key, attempts, ok, text, error)."""
    last = F.max_by(F.struct("ok", "text", "error"), "attempt").alias("r")
    return tried.groupBy(key).agg(F.max("attempt").alias("attempts"), last).select(key, "attempts", "r.*")
