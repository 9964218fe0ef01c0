"""Cosine similarity search over distributed vectors.

Vectors are cut into cells around a bounded set of pivots, and a query visits only the cells that
can hold an answer. With unit vectors the angle is a metric, so a cell whose nearest point is
farther than the search angle is skipped without losing anything: the search stays exact.
``probes`` visits a fixed number of nearest cells instead and may miss neighbours.

Cells that follow each other are bundled up to the size of a block, and a query is sent once to each
bundle with a cell it must visit, so its copies grow with the blocks of the table, not with its cells.
Candidates and queries of a bundle are cut into blocks of bounded size that meet pairwise in
separate tasks. A task emits, per query, its best few candidates and never the pairs it looked at.
A candidate side that is counted to fit is sent to every task whole, with no shuffle. Of a larger one,
where a query needs one witness only, a part goes ahead so, and only queries without a witness there go
to the bundles. Products of
blocks are made in steps of bounded size, whatever the sides; for the nearest rows they are sifted in
single precision, with room for its rounding, and what passes is computed in double.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.joins import lookup
from parley.session import cut

BLOCK_ROWS = 4096  # rows of one side in one block, at least
BLOCK_VALUES = 2_000_000  # values of one side in one block (16 MB as doubles)
STEP_VALUES = 2_000_000  # similarities that a task holds at once
TILE_ROWS, TILE_COLUMNS = 1024, 2048  # similarities that are sifted in single precision at once
SMALL_VALUES = 8_000_000  # values of a matrix that may go to every task (64 MB as doubles)
SLACK = 1e-7  # radians; covers rounding in the angle bounds
HIT_SCHEMA = "id long, nbr long, sim double, firm boolean"
NO_HITS = pa.table({"id": pa.array([], "int64"), "nbr": pa.array([], "int64"),
                    "sim": pa.array([], "float64"), "firm": pa.array([], "bool")})


@dataclass
class Pivots:
    """Unit pivot vectors, one per cell; a bounded driver-side table."""

    matrix: np.ndarray  # cells x dimension

    @property
    def cells(self) -> int:
        return len(self.matrix)


def numbered_vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, vec) in the form every search here takes."""
    return df.select(F.col(id_column).cast("long").alias("id"),
                     F.col(vector).cast("array<double>").alias("vec"))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vec, key): vectors scaled to length 1, and a key that exact copies share.

    Null and zero vectors have no direction, hence no neighbours, and are left out.
    """
    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch["vec"].is_valid())
            if batch.num_rows == 0:
                continue
            x = to_matrix(batch["vec"])
            length = np.linalg.norm(x, axis=1)
            usable = length > 0
            x = x[usable] / length[usable, None]
            ids = batch["id"].filter(pa.array(usable))
            keys = pa.array([hashlib.md5(row.tobytes()).digest() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, from_matrix(x), keys], names=["id", "vec", "key"])

    source = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    return source.mapInArrow(scale, "id long, vec array<double>, key binary")


def default_cells(n: int) -> int:
    return int(min(2048, max(1, math.isqrt(max(n, 1)))))


def to_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column of equal lengths -> 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def from_matrix(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.size + 1, max(x.shape[1], 1), dtype="int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1)))


def fetch_matrix(vectors: DataFrame) -> tuple[np.ndarray, pa.Table]:
    """A counted-small vector table on the driver, in id order."""
    table = vectors.toArrow().sort_by("id")
    return to_matrix(table["vec"]), table


def pick_pivots(vectors: DataFrame, cells: int) -> Pivots:
    """Rows in hash order serve as pivots, so dense regions get more of them."""
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(cells)
    return Pivots(fetch_matrix(picked)[0])


def train_pivots(vectors: DataFrame, cells: int, rows: int, rounds: int = 8, seed: int = 42) -> Pivots:
    """k-means centres from about 256 training rows per cell (for approximate search).

    ``rows`` is the table's size; the training rows stay spread over its partitions.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    parts = 1_000_000
    share = min(parts, math.ceil(256 * cells / max(rows, 1) * parts))
    training = vectors.where(F.pmod(F.xxhash64("id"), F.lit(parts)) < share).select(
        array_to_vector("vec").alias("features"))
    model = KMeans(k=cells, maxIter=rounds, seed=seed).fit(training)
    centres = np.vstack(model.clusterCenters())
    length = np.linalg.norm(centres, axis=1, keepdims=True)
    return Pivots(centres / np.where(length == 0, 1, length))


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def _schema_with(df: DataFrame, *added: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added]])


def place(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """Add ``cell`` (nearest pivot) and ``angle`` to it, and fix the result."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots.matrix)
    schema = _schema_with(vectors, ("cell", T.IntegerType()), ("angle", T.DoubleType()))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            angles = _angles(to_matrix(batch["vec"]), shared.value)
            cell = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype("int32")),
                 pa.array(angles[np.arange(len(cell)), cell])],
                names=[*batch.schema.names, "cell", "angle"],
            )

    return cut(vectors.mapInArrow(nearest, schema))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches cut small, so that a matrix of rows x cells stays small too."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@dataclass
class CellStats:
    rows: np.ndarray
    radius: np.ndarray  # largest angle in the cell; -1 where it is empty


def block_size(dimension: int) -> int:
    """Rows of one side in one block, for vectors of this length."""
    return max(BLOCK_ROWS, BLOCK_VALUES // max(dimension, 1))


def bundle_cells(stats: CellStats, block_rows: int) -> np.ndarray:
    """Bundle of each cell: cells that follow each other, up to ``block_rows`` rows; a larger one is alone."""
    out = np.zeros(len(stats.rows), "int64")
    number = held = 0
    for cell, n in enumerate(stats.rows.tolist()):
        if held and held + n > block_rows:
            number, held = number + 1, 0
        out[cell] = number
        held += n
    return out


def cell_stats(placed: DataFrame, cells: int) -> CellStats:
    """Size and radius per cell: one row per pivot."""
    stats = CellStats(np.zeros(cells, "int64"), np.full(cells, -1.0))
    for row in placed.groupBy("cell").agg(F.count("*"), F.max("angle")).collect():
        stats.rows[row[0]], stats.radius[row[0]] = row[1], row[2]
    return stats


def probe(queries: DataFrame, pivots: Pivots, stats: CellStats, bundles: np.ndarray, reach: str | None,
          probes: int | None = None, skip_own: bool = False) -> DataFrame:
    """Add ``visits``, the bundles of cells that each query must look at.

    ``reach`` names the column with the query's search angle; ``probes`` limits the visit to that
    many nearest cells. ``skip_own`` leaves out the bundle of the query's own cell.
    """
    shared = queries.sparkSession.sparkContext.broadcast((pivots.matrix, stats.radius))
    kept = [c for c in queries.columns if c not in ("cell", "angle")]
    schema = _schema_with(queries.select(*kept), ("visits", T.ArrayType(T.IntegerType())))
    starts = np.flatnonzero(np.r_[True, bundles[1:] != bundles[:-1]])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, radius = shared.value
        for batch in slices(batches):
            angles = _angles(to_matrix(batch["vec"]), matrix)
            wanted = np.broadcast_to(radius >= 0, angles.shape).copy()
            if reach is not None:
                limit = batch[reach].to_numpy(zero_copy_only=False)
                wanted &= angles - radius <= limit[:, None] + SLACK
            if probes is not None and probes < angles.shape[1]:
                ranked = np.where(radius >= 0, angles, np.inf)
                cutoff = np.partition(ranked, probes - 1, axis=1)[:, probes - 1]
                wanted &= ranked <= cutoff[:, None]
            wanted = np.logical_or.reduceat(wanted, starts, axis=1)
            if skip_own:
                own = bundles[batch["cell"].to_numpy(zero_copy_only=False)]
                wanted[np.arange(len(own)), own] = False
            which, found = np.nonzero(wanted)
            ends = np.searchsorted(which, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], lists], names=[*kept, "visits"])

    return queries.mapInArrow(visit, schema)


def _first_of_each(rows: np.ndarray, cols: np.ndarray, sims: np.ndarray, cid: np.ndarray, k: int) -> tuple:
    """The k best pairs of each row, in order; ties by the candidate's id."""
    # rounding makes equal similarities equal, so that the id decides
    rank = np.lexsort((cid[cols], -np.round(sims, 12), rows))
    rows, cols, sims = rows[rank], cols[rank], sims[rank]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[keep], cols[keep], sims[keep]


def _products(qvec: np.ndarray, cvec: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    step = max(1, STEP_VALUES // max(qvec.shape[1], 1))
    return np.concatenate([np.zeros(0), *[
        np.einsum("ij,ij->i", qvec[rows[at:at + step]], cvec[cols[at:at + step]]) for at in range(0, len(rows), step)]])


def _nearest(qid: np.ndarray, qvec: np.ndarray, cid: np.ndarray, cvec: np.ndarray, floor: np.ndarray, k: int) -> tuple:
    """Rows, columns and similarities of the k most similar others of each query, none below its floor."""
    slack = (cvec.shape[1] + 8) * 2.0 ** -23  # over the rounding of a product of unit vectors in single precision
    rough_q, rough_c = qvec.astype("float32"), cvec.astype("float32")
    width = min(len(cid), max(k + 1, min(len(cid) // 16, TILE_COLUMNS)))
    found = []
    for at in range(0, len(qid), TILE_ROWS):
        ids, tile = qid[at:at + TILE_ROWS], slice(at, at + TILE_ROWS)
        least = floor[tile] - 2e-12
        if (least < -1).any():  # no bound yet
            # the k-th best of a part lies no higher than that of all, and few others reach it
            part = qvec[tile] @ cvec[:width].T
            part[(ids[:, None] == cid[None, :width]) | ~np.isfinite(part)] = -np.inf
            kth = min(k, width) - 1
            least = np.maximum(least, -np.partition(-part, kth, axis=1)[:, kth] - 2e-12)
        held = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
        for first in range(0, len(cid), TILE_COLUMNS):
            rough = rough_q[tile] @ rough_c[first:first + TILE_COLUMNS].T
            rows, cols = np.divmod(np.flatnonzero(rough >= (least - slack).astype("float32")[:, None]), rough.shape[1])
            cols += first
            other = ids[rows] != cid[cols]
            rows, cols = rows[other], cols[other]
            sims = _products(qvec[tile], cvec, rows, cols)
            good = sims >= least[rows]
            held = tuple(np.r_[a, b[good]] for a, b in zip(held, (rows, cols, sims)))
            if len(held[0]) * 8 > STEP_VALUES:
                held = _first_of_each(*held, cid, k)
                last = np.flatnonzero(np.r_[held[0][1:] != held[0][:-1], True])
                full = np.bincount(held[0], minlength=len(ids))[held[0][last]] == k
                last = last[full]
                least[held[0][last]] = np.maximum(least[held[0][last]], held[2][last] - 2e-12)
        rows, cols, sims = _first_of_each(*held, cid, k)
        found.append((rows + at, cols, sims))
    return tuple(np.concatenate(x) for x in zip(*found))


def _best(task: dict, q: pa.Table, c: pa.Table) -> pa.Table:
    """Hits of the queries ``q`` among the candidates ``c``.

    ``mode`` is "nearest" (the k most similar, ties by id; where queries have a ``floor``, only those
    at least as similar as that) or "earlier" (one witness at or above
    the threshold that stands before the query: settled ones first, then the smallest id). Where
    both sides have a ``home``, "earlier" looks at rows of another one only. Where queries have ``bits``,
    they look only at the candidates whose number ``cell`` is among the bits set. Without queries or
    candidates there are no hits.
    """
    if q.num_rows == 0 or c.num_rows == 0:
        return NO_HITS
    qid = q["id"].to_numpy()
    cid = c["id"].to_numpy()
    cvec = to_matrix(c["vec"])
    order = slice(None)
    if (cid[1:] < cid[:-1]).any():
        order = np.argsort(cid, kind="stable")
        cid, cvec = cid[order], cvec[order]
    settled = c["settled"].to_numpy()[order].astype(bool) if "settled" in c.schema.names else None
    qvec = to_matrix(q["vec"])
    homes = None
    if "home" in q.schema.names and "home" in c.schema.names:
        homes = q["home"].to_numpy(), c["home"].to_numpy()[order]
    bits = None
    if "bits" in q.schema.names:
        cell = c["cell"].to_numpy()[order]
        bits = np.frombuffer(b"".join(q["bits"].to_pylist()), np.uint8).reshape(len(qid), -1)
    floor = q["floor"].to_numpy() if "floor" in q.schema.names else np.full(len(qid), -np.inf)
    if task["mode"] == "nearest" and bits is None:
        rows, cols, sims = _nearest(qid, qvec, cid, cvec, floor, task["k"])
        firm = settled[cols] if settled is not None else np.zeros(len(cols), bool)
        return pa.table([qid[rows], cid[cols], sims, firm], names=["id", "nbr", "sim", "firm"])
    out_q, out_n, out_s, out_f = [], [], [], []
    step = max(1, STEP_VALUES // max(len(cid), 1))
    for at in range(0, len(qid), step):
        ids = qid[at:at + step]
        sims = qvec[at:at + step] @ cvec.T
        if task["mode"] == "nearest":
            sims[ids[:, None] == cid[None, :]] = -np.inf
            unseen = np.unpackbits(bits[at:at + step], axis=1) == 0
            if unseen.any():
                sims[unseen[:, cell]] = -np.inf
            k = min(task["k"], sims.shape[1])
            # the k-th best of a part lies no higher than that of all, and few others reach it
            part = sims[:, :max(k + 1, sims.shape[1] // 16)]
            edge = -np.partition(-part, k - 1, axis=1)[:, k - 1]
            least = np.maximum(edge, floor[at:at + step]) - 2e-12
            rows, cols = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
            rows, cols, _ = _first_of_each(rows, cols, sims[rows, cols], cid, k)
        else:
            hit = (sims >= task["threshold"]) & (cid[None, :] < ids[:, None])
            if homes is not None:
                hit &= homes[0][at:at + step, None] != homes[1][None, :]
            rows = np.nonzero(hit.any(axis=1))[0]
            cols = hit[rows].argmax(axis=1)
            if settled is not None and settled.any():
                firm = hit & settled[None, :]
                has = firm[rows].any(axis=1)
                cols = np.where(has, firm[rows].argmax(axis=1), cols)
        out_q.append(ids[rows])
        out_n.append(cid[cols])
        out_s.append(sims[rows, cols])
        out_f.append(settled[cols] if settled is not None else np.zeros(len(cols), bool))
    return pa.table([np.concatenate(o) for o in (out_q, out_n, out_s, out_f)],
                    names=["id", "nbr", "sim", "firm"])


def against_small(queries: DataFrame, candidates: pa.Table, task: dict) -> DataFrame:
    """Search a candidate table that fits in every task."""
    shared = queries.sparkSession.sparkContext.broadcast(candidates.sort_by("id"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _best(task, pa.Table.from_batches([batch]), shared.value)
                yield from found.to_batches()

    home = ["home"] if "home" in queries.columns else []
    return queries.select("id", "vec", *home).mapInArrow(scan, HIT_SCHEMA)


def _with_witness(queries: DataFrame, candidates: pa.Table, task: dict) -> DataFrame:
    """``queries`` with the hit of those that have one among ``candidates``, which fit in every task.

    A query with a hit needs its vector no more: it is null.
    """
    shared = queries.sparkSession.sparkContext.broadcast(candidates.sort_by("id"))
    home = ["home"] if "home" in queries.columns else []
    queries = queries.select("id", "vec", *home)
    schema = _schema_with(queries, ("nbr", T.LongType()), ("sim", T.DoubleType()), ("firm", T.BooleanType()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hits = _best(task, pa.Table.from_batches([batch]), shared.value)
                at = pc.index_in(batch["id"], hits["id"].combine_chunks())
                vec = pc.if_else(at.is_null(), batch["vec"], pa.scalar(None, batch["vec"].type))
                found = [hits[c].combine_chunks().take(at) for c in ("nbr", "sim", "firm")]
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], vec, *[batch[c] for c in home], *found], names=schema.names)

    return queries.mapInArrow(scan, schema)


def in_blocks(queries: DataFrame, candidates: DataFrame, stats: CellStats, bundles: np.ndarray, task: dict,
              block_rows: int) -> DataFrame:
    """Search per bundle: ``queries`` have the bundles to look at in ``visits``, ``candidates`` their ``cell``.

    A bundle of many candidates (one large cell) is cut into blocks, every visit goes to all of them;
    a bundle with many visits is cut likewise on the query side. Each (candidate block, query block)
    is a task group of at most about ``block_rows`` rows per side.
    """
    spark = queries.sparkSession
    rows = np.bincount(bundles, stats.rows)
    cblocks = np.maximum(np.ceil(rows / block_rows), 1).astype("int64")
    qblocks = np.ones_like(cblocks)
    load = queries.select(F.explode("visits").alias("bundle")).groupBy("bundle").count()
    for bundle, n in load.collect():  # one row per bundle
        qblocks[bundle] = max(1, math.ceil(n / block_rows))
    plan = F.broadcast(spark.createDataFrame(
        [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(cblocks, qblocks))],
        "bundle int, _cb long, _qb long"))  # one row per bundle
    of_cell = F.broadcast(spark.createDataFrame(
        [(i, int(b)) for i, b in enumerate(bundles)], "cell int, bundle int"))  # one row per cell

    def upto(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    given = [c for c in queries.columns if c != "visits"]
    q = queries.select(*given, F.explode("visits").alias("bundle")).join(plan, "bundle").withColumn(
        "_q", F.pmod(F.xxhash64("id"), "_qb")).withColumn("_c", upto("_cb")).drop("_cb", "_qb")
    # fresh column identities: both sides may come from one table
    candidates = candidates.select(*[F.col(name).alias(name) for name in candidates.columns])
    c = candidates.join(of_cell, "cell").drop("cell").join(plan, "bundle").withColumn(
        "_c", F.pmod(F.xxhash64("id"), "_cb")).withColumn("_q", upto("_qb")).drop("_cb", "_qb")
    keys = ["bundle", "_c", "_q"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(task, left, right)

    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(meet, HIT_SCHEMA)


def keep_nearest(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked from 1 (most similar first, then smaller id)."""
    order = Window.partitionBy("id").orderBy(F.desc(F.round("sim", 12)), "nbr")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fits(df: DataFrame, dimension: int, limit: int = SMALL_VALUES) -> bool:
    """Whether the table's vectors stay below ``limit`` values; counts no further than that."""
    rows = max(1, limit // max(dimension, 1))
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def dimension_of(vectors: DataFrame) -> int:
    row = vectors.select(F.size("vec")).first()
    return row[0] if row else 0


def _distinct_vectors(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(one row per distinct vector under its smallest id, first k + 1 ids of every copy group).

    Copies would make every member the neighbour of every other; here a group is searched once.
    """
    firsts = cut(vectors.groupBy("key").agg(
        F.min("id").alias("rep"), F.min_by("vec", "id").alias("vec"), F.count("*").alias("copies")))
    copied = firsts.where("copies > 1").select("key")
    ranked = lookup(vectors.select("key", "id"), copied, ["key"], "left_semi").withColumn(
        "_r", F.row_number().over(Window.partitionBy("key").orderBy("id"))
    ).where(F.col("_r") <= k + 1).drop("_r")
    singles = firsts.where("copies = 1").select("key", F.col("rep").alias("id"))
    return firsts, ranked.unionByName(singles)


def nearest_neighbours(
    vectors: DataFrame, k: int = 10, *, probes: int | None = None, pivots: Pivots | None = None,
    cells: int | None = None, small_values: int = SMALL_VALUES, block_rows: int | None = None,
) -> DataFrame:
    """(id, nbr, sim, rank): the k most similar other rows of every row.

    Exact by default. First each row searches its own cell, which bounds the angle of its k-th
    neighbour; then it visits only the cells that reach inside that angle. With ``probes`` it
    visits that many nearest cells and the answer is approximate.

    Identical vectors are searched once and joined back to their copies afterwards.
    """
    vectors = cut(unit_vectors(vectors))
    reps, members = _distinct_vectors(vectors, k)
    distinct = reps.select(F.col("rep").alias("id"), "vec")
    task = {"mode": "nearest", "k": k}
    dimension = dimension_of(distinct)
    if probes is None and fits(distinct, dimension, small_values):
        hits = against_small(distinct, fetch_matrix(distinct)[1], task)
    else:
        n = distinct.count()
        if pivots is None:
            pivots = pick_pivots(distinct, cells or default_cells(n))
        placed = place(distinct, pivots)
        stats = cell_stats(placed, pivots.cells)
        block_rows = block_rows or block_size(dimension)
        if probes is not None:
            alone = np.arange(pivots.cells)
            asked = cut(probe(placed, pivots, stats, alone, None, probes))
            hits = in_blocks(asked, placed.drop("angle"), stats, alone, task, block_rows)
        else:
            bundles = bundle_cells(stats, block_rows)
            # literal list: as many entries as cells
            own_bundle = F.element_at(F.lit(bundles.tolist()), F.col("cell") + 1).cast("int")
            own = cut(keep_nearest(in_blocks(
                placed.select("id", "vec", F.array(own_bundle).alias("visits")), placed.drop("angle"),
                stats, bundles, task, block_rows), k))
            bound = own.where(F.col("rank") == k).select("id", F.greatest(
                F.least("sim", F.lit(1.0)), F.lit(-1.0)).alias("floor"))
            seeking = placed.join(bound, "id", "left").withColumn(
                "floor", F.coalesce("floor", F.lit(-1.0))).withColumn("reach", F.acos("floor"))
            asked = cut(probe(seeking, pivots, stats, bundles, "reach", skip_own=True).drop("reach"))
            rest = in_blocks(asked.withColumn("floor", F.col("floor") - 1e-9), placed.drop("angle"),
                             stats, bundles, task, block_rows)
            hits = own.drop("rank").unionByName(rest)
    best = keep_nearest(hits, k).select("id", "nbr", "sim", "rank")
    if reps.where("copies > 1").isEmpty():
        return best
    return _with_copies(cut(best), vectors, reps, members, k)


def trained_neighbours(vectors: DataFrame, k: int = 50, cells: int = 1000, probes: int = 50,
                       **search) -> DataFrame:
    """Approximate neighbours over trained cells, each row visiting its ``probes`` nearest ones.

    A small table gets fewer cells (the square root of its rows), so that training has enough to
    work on.
    """
    usable = cut(unit_vectors(vectors).drop("key"))
    n = usable.count()
    if n == 0:
        return nearest_neighbours(usable, k, **search)
    pivots = train_pivots(usable, max(1, min(cells, math.isqrt(n))), n)
    return nearest_neighbours(usable, k, probes=probes, pivots=pivots, **search)


def _with_copies(best: DataFrame, vectors: DataFrame, reps: DataFrame, members: DataFrame,
                 k: int) -> DataFrame:
    """Neighbours of distinct vectors -> neighbours of all rows.

    A row's answer needs at most k + 1 ids of any copy group, its own included.
    """
    groups = members.join(reps.select("key", "rep"), "key").groupBy(F.col("rep").alias("nbr")).agg(
        F.collect_list("id").alias("ids"))  # at most k + 1 ids each
    own = reps.select(F.col("rep"), F.col("rep").alias("nbr"), F.lit(1.0).alias("sim"))
    options = best.select(F.col("id").alias("rep"), "nbr", "sim").unionByName(own)
    expanded = lookup(options, groups, ["nbr"]).select("rep", F.explode("ids").alias("nbr"), "sim")
    ranked = expanded.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy(
        F.desc(F.round("sim", 12)), "nbr"))).where(F.col("_r") <= k + 1).drop("_r")
    lists = ranked.groupBy("rep").agg(F.collect_list(F.struct("nbr", "sim")).alias("found"))
    rows = lookup(vectors.select("id", "key"), reps.select("key", "rep"), ["key"]).select("id", "rep")
    answers = lookup(rows, cut(lists), ["rep"]).select("id", F.inline("found")).where("id <> nbr")
    return keep_nearest(answers, k).select("id", "nbr", "sim", "rank")


def near_existing(
    new: DataFrame, existing: DataFrame, threshold: float, *, probes: int | None = None,
    cells: int | None = None, small_values: int = SMALL_VALUES, block_rows: int | None = None,
) -> DataFrame:
    """Ids of ``new`` vectors with an ``existing`` one at or above the threshold.

    Both sides are (id, vec).
    """
    # existing rows get ids below every new one, which is what "earlier" compares
    existing = cut(unit_vectors(below_zero(existing)).drop("key"))
    new, low = from_zero(new)
    new = unit_vectors(new).drop("key")
    hits = earlier_witness(new, existing, threshold, probes=probes, cells=cells,
                           small_values=small_values, block_rows=block_rows)
    return hits.select((F.col("id") + low).alias("id")).distinct()


def from_zero(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(id, vec) with ids counted from the smallest, and that smallest id."""
    low = vectors.agg(F.min("id")).first()[0] or 0
    return vectors.select((F.col("id") - low).alias("id"), "vec"), low


def below_zero(vectors: DataFrame) -> DataFrame:
    """(id, vec) with ids mirrored to -1 and less."""
    vectors, _ = from_zero(vectors)
    return vectors.select((-F.col("id") - 1).alias("id"), "vec")


def earlier_witness(
    queries: DataFrame, candidates: DataFrame, threshold: float, *, probes: int | None = None,
    pivots: Pivots | None = None, cells: int | None = None, small_values: int = SMALL_VALUES,
    block_rows: int | None = None,
) -> DataFrame:
    """(id, nbr, sim, firm): a candidate of smaller id at or above the threshold for each query.

    Candidates may carry ``settled``; a settled witness is preferred and told by ``firm``. A query
    without any witness has no row; one searched in several blocks may have several.
    """
    task = {"mode": "earlier", "threshold": float(threshold)}
    dimension = dimension_of(candidates)
    if dimension == 0:  # no candidates
        return queries.sparkSession.createDataFrame([], HIT_SCHEMA)
    if probes is None and small_values and fits(candidates, dimension, small_values):
        return against_small(queries, candidates.toArrow(), task)
    early = None
    if probes is None and small_values and "settled" not in candidates.columns:
        # where vectors have many near ones, a block of candidates holds a witness of nearly every query
        parts = math.ceil(candidates.count() * dimension / min(small_values, BLOCK_VALUES))
        some = candidates.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == 0).select("id", "vec").toArrow()
        if some.num_rows:
            tried = cut(_with_witness(queries, some, task))
            early = tried.where("nbr IS NOT NULL").select("id", "nbr", "sim", "firm")
            queries = tried.where("nbr IS NULL").drop("nbr", "sim", "firm")
            if queries.isEmpty():
                return early
    if pivots is None:
        pivots = pick_pivots(candidates.select("id", "vec"), cells or default_cells(candidates.count()))
    placed = candidates if "cell" in candidates.columns else place(candidates, pivots)
    stats = cell_stats(placed, pivots.cells)
    block_rows = block_rows or block_size(dimension)
    bundles = bundle_cells(stats, block_rows) if probes is None else np.arange(pivots.cells)
    angle = math.acos(min(1.0, max(-1.0, threshold)))
    home = ["home"] if "home" in queries.columns else []
    asked = cut(probe(queries.select("id", "vec", *home).withColumn("reach", F.lit(angle)),
                      pivots, stats, bundles, "reach", probes).drop("reach"))
    late = in_blocks(asked, placed.drop("angle"), stats, bundles, task, block_rows)
    return late if early is None else early.unionByName(late)
