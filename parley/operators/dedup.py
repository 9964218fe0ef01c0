"""Exact and semantic deduplication, and unique appends to existing state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.joins import unseen
from parley.operators.similarity import near_existing
from parley.operators.survivors import greedy_survivors
from parley.session import cut


def first_positions(df: DataFrame, key: str, position: str) -> DataFrame:
    """The smallest position of each key; combines map-side, so copies never gather."""
    return df.groupBy(key).agg(F.min(position).alias(position)).select(position)


def flag_exact_duplicates(df: DataFrame, key: str, position: str) -> DataFrame:
    """Add ``is_duplicate``: an earlier row (by unique ``position``) has the same key.

    Rows are matched on their position, which is unique, so a key of many copies makes no task
    larger than another.
    """
    firsts = first_positions(df, key, position).withColumn("_first", F.lit(True))
    return df.join(firsts, position, "left").withColumn(
        "is_duplicate", F.col("_first").isNull()).drop("_first")


def drop_exact_duplicates(df: DataFrame, key: str, position: str) -> DataFrame:
    return df.join(first_positions(df, key, position), position, "left_semi")


def flag_semantic_duplicates(df: DataFrame, position: str, vector: str, threshold: float = 0.9,
                             **search) -> DataFrame:
    """(position, is_duplicate): greedy in position order over cosine similarity."""
    rows = df.select(F.col(position).alias("id"), F.col(vector).alias("vec"))
    return greedy_survivors(rows, threshold, **search).select(
        F.col("id").alias(position), (~F.col("kept")).alias("is_duplicate"))


def two_stage_duplicates(df: DataFrame, key: str, position: str, vector: str,
                         threshold: float = 0.9, **search) -> DataFrame:
    """(position, stage) of every duplicate: ``exact`` by key, then ``semantic`` among the rest."""
    rows = cut(flag_exact_duplicates(df.select(key, position, vector), key, position))
    exact = rows.where("is_duplicate").select(position, F.lit("exact").alias("stage"))
    rest = flag_semantic_duplicates(
        rows.where("not is_duplicate"), position, vector, threshold, **search)
    return exact.unionByName(
        rest.where("is_duplicate").select(position, F.lit("semantic").alias("stage")))


def split_duplicates(df: DataFrame, duplicates: DataFrame, position: str) -> tuple[DataFrame, DataFrame]:
    """(unique rows, duplicate rows)."""
    ids = cut(duplicates.select(position).distinct())
    return df.join(ids, position, "left_anti"), df.join(ids, position, "left_semi")


def append_unique(new: DataFrame, existing_hashes: DataFrame, existing_vectors: DataFrame, *,
                  key: str, position: str, vector: str, threshold: float = 0.9,
                  among_new: bool = True, **search) -> DataFrame:
    """Rows of ``new`` that may join the corpus.

    A row is refused when its key is known, or a known vector is at or above the threshold. With
    ``among_new`` each row is also held against the rows accepted before it (by ``position``);
    without, all of them face the state as it was at the start. Equal keys are taken to have
    equal vectors. ``existing_vectors`` is (id, vec).
    """
    fresh = unseen(new, existing_hashes, [key])
    if among_new:
        fresh = drop_exact_duplicates(fresh, key, position)
    fresh = cut(fresh)
    vectors = fresh.select(F.col(position).alias("id"), F.col(vector).alias("vec"))
    if among_new:
        kept = greedy_survivors(vectors, threshold, existing=existing_vectors, **search)
        kept = kept.where("kept").select(F.col("id").alias(position))
        return fresh.join(kept, position, "left_semi")
    near = near_existing(vectors, existing_vectors, threshold, **search)
    return fresh.join(near.select(F.col("id").alias(position)), position, "left_anti")
