"""A stored index for approximate nearest neighbours: files by cell, the tree of pivots beside them.

Cells come from a tree. A cell of more than ``leaf_rows`` rows is split among pivots drawn from its
own rows by hash, one for a quarter as many rows, so dense regions get more cells, and the tree
deepens until every cell is small: the number of cells grows with the rows, their size does not. Rows lie in folders by ``shard``, a
hash of the cell, sorted by cell and block inside.

A search ranks cells by the similarity of query and pivot, takes the ``probes`` best, and reads the
folders of those alone (a partition filter). Cells are bundled, the more the larger the share of
them that a query visits, and a query goes once to each bundle with a bit for each cell it visits there:
its copies grow with the bundles, not with the cells. In a bundle, blocks of queries meet blocks of rows;
tasks give their few best candidates, never pairs. A tree that is counted to be small is sent to
every task; a larger one is descended level by level with joins that keep a beam per query.

Rows without a vector, or with one of no direction, have no neighbours and are not stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators import similarity as sim
from parley.session import cut

LEAF_ROWS = 1024
FAN = 64
SHARD_ROWS = 1 << 20
TREE = "parent string, cell string, vec array<double>"
ROOT = ""


def _split(rows: DataFrame, large: DataFrame, level: int, leaf_rows: int, fan: int) -> DataFrame:
    """``parent, cell, vec``: pivots for the cells of ``large`` (cell, n), about as many as needed."""
    wanted = F.least(F.lit(fan), F.ceil(4 * F.col("n") / leaf_rows)) + 2
    draw = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return rows.join(large, "cell").where(draw < wanted / F.col("n")).select(
        F.col("cell").alias("parent"),
        F.concat("cell", F.hex(F.xxhash64("id")), F.lit("/")).alias("cell"), "vec")


def _nearest_child(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return (x @ pivots.T).argmax(axis=1)


def _children(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """parent -> (names of its cells, their pivots)."""
    parents = np.array(table["parent"].to_pylist(), object)
    names, vectors = np.array(table["cell"].to_pylist(), object), sim.to_matrix(table["vec"])
    return {p: (names[parents == p], vectors[parents == p]) for p in set(parents)}


def _assign(rows: DataFrame, pivots: DataFrame, dimension: int, small_values: int, block_rows: int) -> DataFrame:
    """Rows of split cells moved to the nearest pivot's cell; others stay."""
    few = small_values // max(dimension, 1)
    table = pivots.limit(few + 1).toArrow() if few else None
    if table is not None and table.num_rows <= few:
        shared = rows.sparkSession.sparkContext.broadcast(_children(table))

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sim.slices(batches):
                cell, x = np.array(batch["cell"].to_pylist(), object), sim.to_matrix(batch["vec"])
                for parent in set(cell):
                    if parent in shared.value:
                        names, vectors = shared.value[parent]
                        mine = cell == parent
                        cell[mine] = names[_nearest_child(x[mine], vectors)]
                yield pa.RecordBatch.from_arrays([batch["id"], batch["vec"], pa.array(cell, pa.string())],
                                                 names=["id", "vec", "cell"])

        return rows.mapInArrow(move, "id long, vec array<double>, cell string")
    # too many pivots to send around: they meet the rows of their cell, which come in blocks
    split = pivots.select(F.col("parent").alias("cell")).distinct()
    blocks = rows.join(split, "cell").groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    dealt = rows.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks")
    copied = pivots.withColumnRenamed("cell", "child").withColumnRenamed("parent", "cell").join(blocks, "cell").select(
        "cell", "child", "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"id": pa.array([], "int64"), "vec": pa.array([], pa.list_(pa.float64())),
                             "cell": pa.array([], "string")})
        names = np.array(right["child"].to_pylist(), object)
        found = names[_nearest_child(sim.to_matrix(left["vec"]), sim.to_matrix(right["vec"]))]
        return pa.table({"id": left["id"], "vec": left["vec"], "cell": pa.array(found, pa.string())})

    moved = dealt.groupBy("cell", "block").cogroup(copied.groupBy("cell", "block")).applyInArrow(
        meet, "id long, vec array<double>, cell string")
    return rows.join(split, "cell", "left_anti").select("id", "vec", "cell").unionByName(moved)


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    _leaves: pa.Table | bool | None = None

    def tree(self) -> DataFrame:
        """``parent, cell, vec``: every cell but the root, with its pivot."""
        return self.spark.read.schema(TREE).parquet(f"{self.path}/tree")

    def cells(self) -> DataFrame:
        """``cell, shard, n, blocks`` of the cells that hold rows."""
        return self.spark.read.schema("cell string, shard int, n long, blocks long").parquet(f"{self.path}/cells")

    def rows(self, shards: list[int] | None = None) -> DataFrame:
        """``id, vec, cell, block`` of all rows, or of those in some folders."""
        found = self.spark.read.schema("id long, vec array<double>, cell string, block long, shard int").parquet(f"{self.path}/rows")
        return (found if shards is None else found.where(F.col("shard").isin(shards))).drop("shard")

    def leaves(self, small_values: int = sim.SMALL_VALUES) -> pa.Table | None:
        """``cell, vec, shard, n, blocks`` of all cells, where their pivots are counted to be few."""
        if self._leaves is None:
            found = self.cells().join(self.tree().drop("parent"), "cell", "left")
            width = found.agg(F.max(F.size("vec"))).first()[0] or 1
            rows = max(1, small_values // max(width, 1))
            table = found.limit(rows + 1).toArrow()
            self._leaves = table if small_values and table.num_rows <= rows else False
        return self._leaves or None

    def visits(self, queries: DataFrame, probes: int, small_values: int = sim.SMALL_VALUES) -> DataFrame:
        """``id, vec, cell``: the cells each query should see, best first by their pivots.

        ``queries`` is (id, vec) with vectors of length 1.
        """
        table = self.leaves(small_values)
        if table is None:
            return self._descend(queries, self.cells().select("cell"), self.tree(), probes)
        if table.num_rows == 1 and not table["vec"][0].is_valid:
            return queries.select("id", "vec", F.lit(ROOT).alias("cell"))
        table = table.filter(table["vec"].is_valid())
        shared = queries.sparkSession.sparkContext.broadcast(
            (np.array(table["cell"].to_pylist(), object), sim.to_matrix(table["vec"])))

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, pivots = shared.value
            keep = min(probes, len(names))
            for batch in sim.slices(batches, max(1, 16_384 // max(keep, 1))):
                if not keep:
                    continue
                likeness = sim.to_matrix(batch["vec"]) @ pivots.T
                best = np.argpartition(-likeness, keep - 1, axis=1)[:, :keep]
                part = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), keep)))
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["vec"], pa.array(names[best.ravel()], pa.string())], names=["id", "vec", "cell"])

        return queries.select("id", "vec").mapInArrow(rank, "id long, vec array<double>, cell string")

    def _descend(self, queries: DataFrame, used: DataFrame, tree: DataFrame, probes: int) -> DataFrame:
        from parley.functions.vectors import dot

        best = Window.partitionBy("id").orderBy(F.desc("likeness"), "cell")
        inner = cut(tree.select(F.col("parent").alias("cell")).distinct())
        open_ = queries.select("id", "vec", F.lit(ROOT).alias("cell"))
        found = None
        while True:
            # of every query at most ``probes`` cells, each with about ``FAN`` below it
            below = open_.join(tree.select(F.col("parent").alias("cell"), F.col("cell").alias("child"),
                                           F.col("vec").alias("pivot")), "cell")
            scored = below.select("id", "vec", F.col("child").alias("cell"), dot(F.col("vec"), F.col("pivot")).alias("likeness"))
            scored = scored if found is None else scored.unionByName(found)
            beam = cut(scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= probes).drop("r"))
            open_ = beam.join(inner, "cell", "left_semi")
            found = beam.join(inner, "cell", "left_anti")
            if open_.isEmpty():
                return found.join(used, "cell", "left_semi").select("id", "vec", "cell")
            open_ = open_.drop("likeness")

    def search(self, queries: DataFrame, k: int, probes: int, block_rows: int | None = None,
               small_values: int = sim.SMALL_VALUES) -> DataFrame:
        """``id, nbr, sim, rank`` of the ``k`` best rows found for each query (id, vec), not itself."""
        queries = sim.unit_vectors(queries).drop("key")
        table = self.leaves(small_values)
        if table is not None and not table["vec"].null_count and table.num_rows:
            hits = self._in_bundles(queries, table, k, probes, block_rows)
        else:
            hits = self._in_cells(queries, k, probes, block_rows or sim.BLOCK_ROWS, small_values)
        return sim.keep_nearest(hits, k).select("id", "nbr", "sim", "rank")

    def _in_bundles(self, queries: DataFrame, table: pa.Table, k: int, probes: int,
                    block_rows: int | None) -> DataFrame:
        """Hits of each query in its ``probes`` best cells, where there are few enough to list them."""
        table = table.sort_by([("shard", "ascending"), ("cell", "ascending")])
        names, pivots = table["cell"].to_pylist(), sim.to_matrix(table["vec"])
        keep = min(probes, len(names))
        block_rows = block_rows or sim.block_size(pivots.shape[1])
        rows = table["n"].to_numpy()
        bundles = sim.bundle_cells(sim.CellStats(rows, np.zeros(len(rows))), max(1, block_rows * keep // len(names)))
        first = np.flatnonzero(np.r_[True, bundles[1:] != bundles[:-1]])
        ends = np.r_[first[1:], len(names)]
        shared = self.spark.sparkContext.broadcast(pivots)

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sim.slices(batches, max(1, sim.STEP_VALUES // len(names))):
                likeness = sim.to_matrix(batch["vec"]) @ shared.value.T
                best = np.argpartition(-likeness, keep - 1, axis=1)[:, :keep]
                seen = np.zeros(likeness.shape, bool)
                seen[np.arange(len(best))[:, None], best] = True
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["vec"], pa.array([r.tobytes() for r in np.packbits(seen, axis=1)], pa.binary())],
                    names=["id", "vec", "bits"])

        def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
            """(batch, bundle, rows that visit it, their bits of its cells)"""
            for batch in sim.slices(batches, max(1, sim.STEP_VALUES // len(names))):
                packed = np.frombuffer(b"".join(batch["bits"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                seen = np.unpackbits(packed, axis=1, count=len(names))
                for bundle, (a, b) in enumerate(zip(first, ends)):
                    which = np.flatnonzero(seen[:, a:b].any(axis=1))
                    if len(which):
                        yield batch, bundle, which, seen[which, a:b]

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(len(first), np.int64)
            for _, bundle, which, _ in parted(batches):
                found[bundle] += len(which)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(first)), pa.int32()), pa.array(found)],
                                             names=["bundle", "n"])

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, bundle, which, seen in parted(batches):
                part = batch.take(pa.array(which))
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["vec"], pa.array([r.tobytes() for r in np.packbits(seen, axis=1)], pa.binary()),
                     pa.array(np.full(len(which), bundle), pa.int32())], names=["id", "vec", "bits", "bundle"])

        asked = cut(queries.select("id", "vec").mapInArrow(rank, "id long, vec array<double>, bits binary"))
        load = asked.mapInArrow(tally, "bundle int, n long").groupBy("bundle").agg(F.sum("n").alias("n")).collect()
        parts = np.zeros(len(first), np.int64)
        for r in load:  # one row per bundle
            parts[r.bundle] = -(-r.n // block_rows)
        # a cell that is a bundle of its own keeps the blocks it is stored in
        blocks = np.where(ends - first == 1, table["blocks"].to_numpy()[first], 1)
        plan = F.broadcast(self.spark.createDataFrame(
            [(i, int(p), int(n)) for i, (p, n) in enumerate(zip(parts, blocks)) if p],
            "bundle int, parts long, blocks long"))
        of_cell = F.broadcast(self.spark.createDataFrame(  # one row per cell
            [(name, int(i), int(at - first[i])) for at, (name, i) in enumerate(zip(names, bundles)) if parts[i]],
            "cell string, bundle int, number int"))
        shards = sorted({s for s, i in zip(table["shard"].to_pylist(), bundles) if parts[i]})
        q = (asked.mapInArrow(send, "id long, vec array<double>, bits binary, bundle int").join(plan, "bundle")
             .select("id", "vec", "bits", "bundle", F.pmod(F.xxhash64("id"), "parts").alias("part"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")))
        c = self.rows(shards).join(of_cell, "cell").join(plan, "bundle").select(
            "id", "vec", F.col("number").alias("cell"), "bundle",
            F.when(F.col("blocks") > 1, F.col("block")).otherwise(F.lit(0)).cast("long").alias("block"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        return _meet(q, c, ["bundle", "block", "part"], k)

    def _in_cells(self, queries: DataFrame, k: int, probes: int, block_rows: int, small_values: int) -> DataFrame:
        """Hits of each query in the cells that it visits, with a copy of the query for each."""
        asked = cut(self.visits(queries, probes, small_values))
        load = asked.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
        plan = cut(load.join(self.cells(), "cell"))
        shards = [r.shard for r in plan.select("shard").distinct().collect()]  # one number per folder
        q = asked.join(plan.select("cell", "parts", "blocks"), "cell").select(
            "id", "vec", "cell", F.pmod(F.xxhash64("id"), "parts").alias("part"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        c = self.rows(shards).join(plan.select("cell", "parts"), "cell").select(
            "id", "vec", "cell", "block",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        return _meet(q, c, ["cell", "block", "part"], k)


def _meet(queries: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each query in each group of ``keys``."""
    task = {"mode": "nearest", "k": k}

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return sim.NO_HITS
        return sim._best(task, left, right)

    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(meet, sim.HIT_SCHEMA)


def build(vectors: DataFrame, path: str, *, leaf_rows: int = LEAF_ROWS, fan: int = FAN,
          shard_rows: int = SHARD_ROWS, block_rows: int = sim.BLOCK_ROWS,
          small_values: int = sim.SMALL_VALUES) -> VectorIndex:
    """Write the index of ``vectors`` = (id, vec) under a fresh ``path``."""
    spark = vectors.sparkSession
    rows = cut(sim.unit_vectors(vectors).drop("key").withColumn("cell", F.lit(ROOT)))
    dimension = sim.dimension_of(rows)
    tree, level = None, 0
    while True:
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > leaf_rows)
        if tree is not None:
            # several pivots that all rows share the nearest of: one direction, which nothing divides
            one = split.where("pivots > 1").select(F.col("cell").alias("parent"), "n")
            large = large.withColumn("parent", F.regexp_replace("cell", "[^/]*/$", "")).join(
                one, ["parent", "n"], "left_anti").drop("parent")
        large = cut(large)
        if large.isEmpty():
            break
        pivots = cut(_split(rows, large, level, leaf_rows, fan))
        rows = cut(_assign(rows, pivots, dimension, small_values, block_rows))
        split = large.join(pivots.groupBy(F.col("parent").alias("cell")).agg(F.count("*").alias("pivots")), "cell")
        tree = pivots if tree is None else tree.unionByName(pivots)
        level += 1
    tree = spark.createDataFrame([], TREE) if tree is None else tree
    tree.write.parquet(f"{path}/tree")
    total = rows.count()  # from the files' footers
    shard = F.pmod(F.xxhash64("cell"), F.lit(max(1, math.ceil(total / shard_rows)))).cast("int")
    sizes = cut(rows.groupBy("cell").agg(F.count("*").alias("n")).select(
        "cell", shard.alias("shard"), "n", F.ceil(F.col("n") / block_rows).alias("blocks")))
    sizes.write.parquet(f"{path}/cells")
    (rows.join(sizes.select("cell", "shard", "blocks"), "cell")
     .select("id", "vec", "cell", F.pmod(F.xxhash64("id"), "blocks").alias("block"), "shard")
     .repartition("shard", "block").sortWithinPartitions("shard", "cell", "block")
     .write.partitionBy("shard").parquet(f"{path}/rows"))
    return VectorIndex(spark, path)
