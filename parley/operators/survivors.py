"""Greedy survivors of a similarity relation, in row order.

Visited in order, a row survives unless a surviving earlier row is at or above the threshold.
Run in rounds over blocks of rows. Inside a block the rows are visited in order at once: a row near a
survivor goes, a row near one that still waits, here or in another block, waits, and any other
survives. Then survivors remove what is near them in other blocks. So a chain of near rows costs a
round only where it crosses from one block to another, and a round needs only *one* near earlier row
of another block per waiting row: no list of pairs ever exists, however many copies a group has.

Rows that are counted to fit into every task are cut into blocks by their order and meet as one
matrix per block. Of more rows the first ones, as many as fit, are settled so, and what is near a
survivor of theirs goes; this repeats while it at least halves the rows, so all repeats together
read about twice the rows. What is then left has few near rows: there a block is a part of a cell
(see ``similarity``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import similarity as sim
from parley.session import cut

LEADERS = 2048
AHEAD_VALUES = 2_000_000  # values of the rows that are settled at once (16 MB as doubles)
HOME_ROWS = 4096  # rows of a block that is a part of a cell, at most
ORDER_BLOCK = 1024  # rows of a block where all rows fit into every task
WAITING, KEPT, REMOVED = 0, 1, 2


def greedy_survivors(
    vectors: DataFrame, threshold: float, *, existing: DataFrame | None = None,
    probes: int | None = None, cells: int | None = None,
    small_values: int = sim.SMALL_VALUES, block_rows: int | None = None,
    leaders: int = LEADERS, ahead_values: int = AHEAD_VALUES,
) -> DataFrame:
    """(id, kept) for every row of ``vectors`` = (id, vec); ids give the order.

    ``existing`` rows come before all others and always survive. Exact copies of an earlier
    vector are settled first: whatever decides the first one removes the others. ``probes``
    searches that many nearest cells only.
    """
    # inside, state rows have negative ids and rows to judge have ids from zero on
    vectors, low = sim.from_zero(vectors)
    # a vector without direction resembles nothing, so its row survives
    pointed = F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = vectors.select("id", pointed.alias("pointed"))
    waiting = cut(sim.unit_vectors(vectors).groupBy("key").agg(
        F.min("id").alias("id"), F.min_by("vec", "id").alias("vec")).select("id", "vec"))
    kept = []
    if existing is not None:
        existing = cut(sim.unit_vectors(sim.below_zero(existing)).select("id", "vec"))
        if not existing.isEmpty():
            kept.append(existing)
    dimension = sim.dimension_of(waiting)
    small = min(small_values, ahead_values)
    if probes is None and sim.fits(_pool(waiting, kept), dimension, small):
        return _answer(rows, low, _settle_small(waiting, kept, threshold))
    done = None
    if probes is None and small:
        if kept:
            near = sim.earlier_witness(waiting, kept[0], threshold, small_values=small_values, cells=cells,
                                       block_rows=block_rows)
            waiting = cut(waiting.join(near.select("id").distinct(), "id", "left_anti"))
            kept = []
        waiting, done = _settle_ahead(waiting, threshold, max(1, small // max(dimension, 1)))
    if not waiting.isEmpty():
        pivots = sim.pick_pivots(waiting, cells or sim.default_cells(waiting.count()))
        waiting = sim.place(waiting, pivots)
        kept = [sim.place(k, pivots) for k in kept]
        leaders = min(leaders, max(1, sim.SMALL_VALUES // max(dimension, 1)))
        search = {"probes": probes, "pivots": pivots, "block_rows": block_rows}
        waiting = cut(_with_home(waiting, min(block_rows or HOME_ROWS, HOME_ROWS)))
    fresh, kept = kept[-1] if kept else None, []
    while not waiting.isEmpty():
        if fresh is not None:
            near = sim.earlier_witness(waiting.drop("home"), fresh, threshold, small_values=small_values, **search)
            waiting = cut(waiting.join(near.select("id").distinct(), "id", "left_anti"))
        judged = cut(_settle_blocks(waiting, threshold, leaders, search))
        fresh = judged.where(F.col("status") == KEPT).drop("status", "home")
        waiting = judged.where(F.col("status") == WAITING).drop("status")
        kept.append(fresh)
    survivors = done
    for part in kept:
        part = part.where("id >= 0").select("id", F.lit(True).alias("kept"))
        survivors = part if survivors is None else survivors.unionByName(part)
    return _answer(rows, low, survivors)


def _answer(rows: DataFrame, low: int, survivors: DataFrame | None) -> DataFrame:
    """(id, kept) of all rows from (id, kept) of those that survive."""
    if survivors is None:
        survivors = rows.sparkSession.createDataFrame([], "id long, kept boolean")
    return rows.join(survivors, "id", "left").select(
        (F.col("id") + low).alias("id"), (F.coalesce("kept", F.lit(False)) | ~F.col("pointed")).alias("kept"))


def _pool(waiting: DataFrame, kept: list[DataFrame]) -> DataFrame:
    """All rows not removed so far; ``settled`` marks the survivors."""
    pool = waiting.withColumn("settled", F.lit(False))
    for part in kept:
        pool = pool.unionByName(part.withColumn("settled", F.lit(True)))
    return pool


def visit_in_order(near: np.ndarray, waits: np.ndarray) -> np.ndarray:
    """Status of a block's rows: ``near`` pairs (row, earlier row), ``waits`` on a row elsewhere."""
    status = np.full(len(near), WAITING)
    for i in range(len(near)):
        earlier = status[:i][near[i, :i]]
        if (earlier == KEPT).any():
            status[i] = REMOVED
        elif not waits[i] and (earlier == REMOVED).all():
            status[i] = KEPT
    return status


def _settle_small(waiting: DataFrame, kept: list[DataFrame], threshold: float) -> DataFrame:
    """(id, kept) of the survivors, where all rows were counted to fit into every task.

    The rows go out once, in order; a round sends one byte of status a row and gets one back.
    """
    spark = waiting.sparkSession
    _, table = sim.fetch_matrix(_pool(waiting, kept))
    ids, x = table["id"].to_numpy(), sim.to_matrix(table["vec"])
    status = np.where(table["settled"].to_numpy(zero_copy_only=False), KEPT, WAITING).astype("int8")
    shared = spark.sparkContext.broadcast(x)
    while (status == WAITING).any():
        now = status.copy()
        starts = [at for at in range(0, len(now), ORDER_BLOCK) if (now[at:at + ORDER_BLOCK] == WAITING).any()]

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    rows = at + np.flatnonzero(now[at:at + ORDER_BLOCK] == WAITING)
                    mine, before = shared.value[rows], np.flatnonzero(now[:at] != REMOVED)
                    gone, waits = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
                    for first in range(0, len(before), 2048):
                        some = before[first:first + 2048]
                        near = mine @ shared.value[some].T >= threshold
                        gone |= near[:, now[some] == KEPT].any(axis=1)
                        waits |= near[:, now[some] == WAITING].any(axis=1)
                    inside = at + np.flatnonzero(now[at:at + ORDER_BLOCK] == KEPT)
                    near = mine @ shared.value[inside].T >= threshold
                    gone |= (near & (inside < rows[:, None])).any(axis=1)
                    found = np.full(len(rows), REMOVED)
                    left = np.flatnonzero(~gone)
                    found[left] = visit_in_order(mine[left] @ mine[left].T >= threshold, waits[left])
                    yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(found)], names=["row", "status"])

        blocks = spark.createDataFrame([(at,) for at in starts], "at long").repartition(len(starts))
        found = blocks.mapInArrow(visit, "row long, status long").toArrow()
        status[found["row"].to_numpy()] = found["status"].to_numpy()
    survivors = ids[(status == KEPT) & (ids >= 0)].tolist()
    return spark.createDataFrame([(i,) for i in survivors], "id long").withColumn("kept", F.lit(True))


def _settle_ahead(waiting: DataFrame, threshold: float, ahead: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows left, survivors so far): the first ``ahead`` rows settled, while that at least halves the rows."""
    done, left = None, waiting.count()
    while left:
        bound = waiting.select("id").orderBy("id").limit(ahead).agg(F.max("id")).first()[0]
        first = waiting.where(F.col("id") <= bound)
        settled = cut(_settle_small(first, [], threshold))
        done = settled if done is None else done.unionByName(settled)
        leaders = first.join(F.broadcast(settled.select("id")), "id", "left_semi").toArrow()  # at most ``ahead``
        waiting = cut(_far_from(waiting.where(F.col("id") > bound), leaders, threshold))
        before, left = left, waiting.count()
        if 2 * left > before and left > ahead:
            break
    return waiting, done


def _far_from(rows: DataFrame, leaders: pa.Table, threshold: float) -> DataFrame:
    """``rows`` that are not near any of the ``leaders``, a table that fits in every task."""
    shared = rows.sparkSession.sparkContext.broadcast(sim.to_matrix(leaders["vec"]))
    step = max(1, sim.STEP_VALUES // max(leaders.num_rows, 1))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sim.slices(batches, step):
            near = (sim.to_matrix(batch["vec"]) @ shared.value.T >= threshold).any(axis=1)
            yield batch.filter(pa.array(~near))

    return rows.mapInArrow(sift, rows.schema)


def _with_home(placed: DataFrame, block_rows: int) -> DataFrame:
    """Add ``home``, the block of a row: a part of its cell of about ``block_rows`` rows."""
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    return placed.join(F.broadcast(sizes), "cell").withColumn(  # one row per pivot
        "home", F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), "parts")).drop("parts")


def _settle_blocks(waiting: DataFrame, threshold: float, leaders: int, search: dict) -> DataFrame:
    """``waiting`` with the ``status`` that its rows get in this round."""
    # The earliest waiting row of each cell, and the earliest of all, tell of most rows that they wait
    # without a full search: a large group of near copies spans many blocks and follows its heads.
    heads = waiting.groupBy("cell").agg(F.min("id").alias("id"), F.min_by("vec", "id").alias("vec"),
                                        F.min_by("home", "id").alias("home"))
    heads = heads.select("id", "vec", "home").unionByName(
        waiting.orderBy("id").limit(leaders).select("id", "vec", "home")).distinct()
    task = {"mode": "earlier", "threshold": float(threshold)}
    early = cut(sim.against_small(waiting, heads.toArrow(), task).select("id").distinct())
    rest = waiting.join(early, "id", "left_anti")
    late = sim.earlier_witness(rest, waiting, threshold, small_values=0, **search)
    waits = cut(late.select("id").distinct().unionByName(early))
    marked = waiting.join(waits.withColumn("waits", F.lit(True)), "id", "left").withColumn(
        "waits", F.coalesce("waits", F.lit(False)))

    def settle(block: pa.Table) -> pa.Table:
        block = block.sort_by("id")
        x = sim.to_matrix(block["vec"])
        status = visit_in_order(x @ x.T >= threshold, block["waits"].to_numpy(zero_copy_only=False))
        return block.drop_columns("waits").append_column("status", pa.array(status.astype("int32")))

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in waiting.schema.fields]
    return marked.select(*waiting.columns, "waits").groupBy("home").applyInArrow(settle, ", ".join([*names, "status int"]))
