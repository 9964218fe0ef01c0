"""Equi-joins that survive a hot key, and membership tests built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley import vocab
from parley.session import cut

HOT_ROWS = 1_000_000  # a key is worth separate treatment only beyond this many rows
SMALL_ROWS = 200_000  # most rows of a table that goes to every task
SMALL_BYTES = 64 * 1024 * 1024


def hot_keys(df: DataFrame, keys: Sequence[str], least: int = HOT_ROWS) -> DataFrame:
    """Keys with at least ``least`` rows (at most rows / least of them)."""
    return df.groupBy(*keys).count().where(F.col("count") >= least).select(*keys)


def _row_bytes(df: DataFrame) -> Column:
    """Estimated bytes of a row: measured for text and nested columns, fixed for the rest."""
    total = F.lit(16)
    for field in df.schema.fields:
        kind = field.dataType
        column = F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(column), F.lit(0)) + 16
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            total = total + F.coalesce(F.size(column), F.lit(0)) * 8 + 32
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0)) + 64
        else:
            total = total + 16
    return total


def is_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> bool:
    """Whether ``df`` may go to every task: both its rows and their bytes are counted."""
    counted = df.select(_row_bytes(df).alias("b")).limit(rows + 1).agg(F.count("*"), F.sum("b")).first()
    return counted[0] <= rows and (counted[1] or 0) <= size


def lookup(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner",
           least: int = HOT_ROWS, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Join ``df`` with ``other``, which has at most one row per key.

    A counted-small ``other`` is broadcast. Otherwise rows of hot keys meet it by broadcast: there
    are at most rows / ``least`` such keys, so that part of it is small by count; all other rows
    take the ordinary shuffle join.
    """
    keys = list(keys)
    if is_small(other, small_rows):
        return df.join(F.broadcast(other), keys, how)
    hot = cut(hot_keys(df, keys, least))
    if hot.isEmpty():
        return df.join(other, keys, how)
    matched = other.join(F.broadcast(hot), keys, "left_semi")
    hot = F.broadcast(hot)
    return (
        df.join(hot, keys, "left_semi").join(F.broadcast(matched), keys, how)
        .unionByName(df.join(hot, keys, "left_anti").join(other, keys, how))
    )


def unseen(df: DataFrame, state: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    """Rows whose key is not in ``state`` (seed used, text seen, id taken, input already done).

    A null key is never in the state.
    """
    keys = list(keys)
    return lookup(df, state.select(*keys).distinct(), keys, "left_anti", **kw)


def seen(df: DataFrame, state: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    """Rows whose key is in ``state``."""
    keys = list(keys)
    return lookup(df, state.select(*keys).distinct(), keys, "left_semi", **kw)


def flag_members(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """Add a boolean column telling whether ``key`` is among ``members``."""
    marked = members.select(key).distinct().withColumn("_in", F.lit(True))
    return lookup(df, marked, [key], "left").withColumn(
        name, F.coalesce("_in", F.lit(False))
    ).drop("_in")


def split_by_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is not in ``ids``, rows whose key is)."""
    flagged = flag_members(df, ids, key, "_removed").persist()
    return (
        flagged.where(~F.col("_removed")).drop("_removed"),
        flagged.where("_removed").drop("_removed"),
    )


def zip_positions(named: dict[str, DataFrame], position: str = "pos") -> DataFrame:
    """Full outer join of (position, value) tables; the shorter ones are padded with null."""
    zipped = None
    for name, table in named.items():
        table = table.select(position, name)
        zipped = table if zipped is None else zipped.join(table, position, "full_outer")
    return zipped


def zip_arrays(df: DataFrame, columns: Sequence[str], position: str = "pos") -> DataFrame:
    """Ragged array columns -> one row per position of each row, the shorter ones padded with null."""
    kinds = dict(df.dtypes)
    full = [F.coalesce(F.col(c), F.array().cast(kinds[c])).alias(c) for c in columns]
    zipped = df.select(*full).select(F.posexplode(F.arrays_zip(*columns)).alias(position, "_zipped"))
    return zipped.select(position, *[F.col("_zipped")[c].alias(c) for c in columns])


def categories_of(services: DataFrame, service: str = "service") -> DataFrame:
    """(service, category) for each given service: the general rows plus its own."""
    return services.withColumn("category", F.explode(vocab.categories_for(F.col(service))))
