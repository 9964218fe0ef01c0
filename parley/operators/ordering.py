"""Global order without a single-task window.

A window with no partition key moves the whole table into one task. Here rows are range
partitioned on the order, numbered inside their partition, and shifted by the number of rows
before it; the table of shifts has one row per partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import cut

_LOW_BITS = 33  # bits that count rows inside a partition in monotonically_increasing_id


def _placed(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` range partitioned and sorted, with its partition ``_part`` and row ``_row`` fixed."""
    mark = F.monotonically_increasing_id()
    return cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_mark", mark)
        .withColumn("_part", F.shiftright("_mark", _LOW_BITS))
        .withColumn("_row", F.col("_mark").bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))
        .drop("_mark")
    )


def _shifts(placed: DataFrame, amount: Column) -> DataFrame:
    """One row per range partition: ``amount`` summed before it and over all partitions."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return placed.groupBy("_part").agg(amount.alias("_amount")).select(
        "_part", F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias("_shift"),
        F.sum("_amount").over(Window.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )


def with_position(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """Add the 0-based global position of each row under ``order`` (which must be unique)."""
    placed = _placed(df, order)
    shifts = F.broadcast(_shifts(placed, F.count("*")))  # one row per partition
    return (
        placed.join(shifts, "_part")
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_part", "_row", "_shift", "_total")
    )


def with_group_position(
    df: DataFrame, group: str, *order: Column | str, name: str = "pos"
) -> DataFrame:
    """Add the 0-based position inside ``group`` and the group size ``<name>_size``.

    Groups may be of any size: a large one spans many range partitions.
    """
    placed = with_position(df, F.col(group), *order, name="_global")
    bounds = placed.groupBy(group).agg(
        F.min("_global").alias("_first"), F.count("*").alias(f"{name}_size")
    )
    from parley.operators.joins import lookup

    return (
        lookup(placed, bounds, [group])
        .withColumn(name, F.col("_global") - F.col("_first")).drop("_global", "_first")
    )


def over_recent_rows(
    df: DataFrame, position: str, reach: int, compute: Callable[[Window], dict[str, Column]],
    block_rows: int = 50_000,
) -> DataFrame:
    """Window expressions that look at most ``reach`` rows back, in blocks of equal size.

    Each block also gets the ``reach`` rows before it, of however many blocks; those copies are
    dropped again. ``compute`` receives a window ordered by ``position`` (no frame).
    """
    block = F.floor(F.col(position) / block_rows)
    ahead = F.sequence(block, F.floor((F.col(position) + reach) / block_rows))
    spread = df.withColumn("_home", block).withColumn("_block", F.explode(ahead))
    window = Window.partitionBy("_block").orderBy(position)
    return (
        spread.withColumns(compute(window))
        .where(F.col("_home") == F.col("_block")).drop("_home", "_block")
    )


def quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """One row with columns ``q0, q1, ...``: exact quantiles, linear between neighbours."""
    return quantiles_of(df, {column: probabilities}).toDF(*[f"q{i}" for i in range(len(probabilities))])


def quantiles_of(df: DataFrame, asked: Mapping[str, Sequence[float]], accuracy: int = 10_000,
                 held: int = 100_000) -> DataFrame:
    """One row with ``<column>_q<i>`` of every column asked for: exact, linear between neighbours.

    A sketch of each column brackets every rank; one more scan counts what lies below a bracket and
    on its ends and sorts what lies strictly inside, for all columns at once. A bracket holds a few
    parts in ``accuracy`` of the rows however often a value repeats, as values on its ends are only
    counted. One of more than ``held`` rows is sketched again, inside its ends. Nulls are left out.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in asked])
    near = 2 / accuracy  # the sketch errs by half of it

    def sketch(column: Column, shares: Iterable[float]) -> Column:
        return F.percentile_approx(column, [min(1.0, max(0.0, p + d)) for p in shares for d in (-near, near)], accuracy)

    first = values.agg(*[x for c, ps in asked.items() for x in (F.count(c), F.min(c), F.max(c), sketch(F.col(c), ps))]).first()
    sizes = {c: first[4 * k] for k, c in enumerate(asked)}
    extremes = {c: tuple(first[4 * k + 1:4 * k + 3]) for k, c in enumerate(asked)}
    open_ = {}  # (column, rank) -> (low end, high end, rows to expect inside, ends known to hold it)
    for k, (c, ps) in enumerate(asked.items()):
        for i, p in enumerate(ps if sizes[c] else ()):
            for rank in {math.floor(p * (sizes[c] - 1)), math.ceil(p * (sizes[c] - 1))}:
                open_[c, rank] = (*first[4 * k + 3][2 * i:2 * i + 2], 3 * near * sizes[c], extremes[c])
    found = {}
    while open_:
        brackets = sorted({(c, low, high, rows <= held) for (c, _), (low, high, rows, _) in open_.items()})
        counted = values.agg(*[x for b in brackets for x in _bracket(*b)]).first()
        narrow = []
        for (c, rank), (low, high, rows, outer) in list(open_.items()):
            k = 4 * brackets.index((c, low, high, rows <= held))
            below, on_low, inside, on_high = counted[k], counted[k + 1], counted[k + 2], counted[k + 3]
            within = len(inside) if rows <= held else inside
            at = rank - below - on_low
            if rank < below:
                open_[c, rank] = (outer[0], low, sizes[c], (outer[0], low))
            elif at >= within + on_high:
                open_[c, rank] = (high, outer[1], sizes[c], (high, outer[1]))
            elif at < 0 or at >= within:
                found[c, rank] = low if at < 0 else high
            elif rows <= held:
                found[c, rank] = inside[at]
            else:
                narrow.append((c, rank, low, high, (at + 0.5) / within, within))
            if (c, rank) in found:
                del open_[c, rank]
        if narrow:
            ends = values.agg(*[sketch(F.when((F.col(c) > low) & (F.col(c) < high), F.col(c)), [share])
                                for c, _, low, high, share, _ in narrow]).first()
            for (c, rank, *outer, _, within), (low, high) in zip(narrow, ends):
                open_[c, rank] = (low, high, 3 * near * within, tuple(outer))

    def at(c: str, p: float) -> float | None:
        if not sizes[c]:
            return None
        rank = p * (sizes[c] - 1)
        low, high = found[c, math.floor(rank)], found[c, math.ceil(rank)]
        return low + (high - low) * (rank - math.floor(rank))

    row = {f"{c}_q{i}": at(c, p) for c, ps in asked.items() for i, p in enumerate(ps)}
    return df.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"`{c}` double" for c in row))


def _bracket(c: str, low: float, high: float, gather: bool) -> list[Column]:
    """Rows below the low end, on it, between the ends (sorted, or counted), and on the high end."""
    v = F.col(c)
    inside = (v > low) & (v < high)
    return [F.count_if(v < low), F.count_if(v == low),
            F.array_sort(F.collect_list(F.when(inside, v))) if gather else F.count_if(inside),
            F.count_if((v == high) & F.lit(high != low))]


def approximate_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """One-pass form of ``quantiles`` with a rank error of at most rows / accuracy."""
    found = df.agg(F.percentile_approx(column, list(probabilities), accuracy).alias("q"))
    return found.select(*[
        F.get("q", F.lit(i)).cast("double").alias(f"q{i}") for i in range(len(probabilities))
    ])


def first_per_key(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The first row of each key by ``position``; combines map-side, so a hot key is harmless."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(position)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row of ``df`` (a scalar subquery, no join)."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return df.withColumn("_s", packed).select(*df.columns, "_s.*")
