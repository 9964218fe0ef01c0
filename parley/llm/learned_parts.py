"""Approximate nearest neighbours by learned partitions.

On a sample of the distinct vectors a graph of nearest neighbours is built and cut into balanced
parts, so that few neighbours lie apart. A linear softmax classifier learns which parts a vector's
neighbours lie in. It places every vector in its likeliest part and sends every query to the
likeliest few, where all candidates are compared exactly. How many parts a query visits follows
from the sample: the fewest that hold ``TARGET`` of its neighbours.

The sample has at most ``SAMPLE`` vectors, in the order of a hash; the index holds every row. Equal
vectors are searched once and stand for the smallest ``k + 1`` of their ids. Parts are split into
blocks of bounded size on both sides, so a task never holds a part whole.

Vectors without any structure are pruned by no partition; then most parts are visited.

Defined cases: rows without id, and vectors that are null, empty, zero, or hold a null or non-finite
component take no part, nor do vectors of another than the commonest length; repeated rows count
once; ties go to the smaller id; with fewer candidates than ``k`` all are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import cut

SAMPLE = 8192
GRAPH_K = 10
TARGET = 0.95
BLOCK = 4096
SLACK = 8


def valid_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, v, a, b``: vectors in double precision and two hashes that name them."""
    v = F.transform(column, lambda x: x.cast("double") + 0.0)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("v") == (lengths[0].n if lengths else 0))
    return (rows.withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64(F.lit(7), "v"))
            .dropDuplicates(["vec_id", "a", "b"]))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each row's ``k`` nearest others by inner product."""
    out = np.empty((len(x), k), np.int64)
    for first in range(0, len(x), 1024):
        s = x[first:first + 1024] @ x.T
        s[np.arange(len(s)), first + np.arange(len(s))] = -np.inf
        out[first:first + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def spread(near: np.ndarray, dims: int, rounds: int = 24, seed: int = 11) -> np.ndarray:
    """Rows of the graph's leading directions: random values averaged over neighbours again and again."""
    y = np.random.default_rng(seed).normal(size=(len(near), dims))
    for turn in range(rounds):
        y = y + sum(y[near[:, j]] for j in range(near.shape[1])) / near.shape[1]
        if turn % 3 == 2:
            y = np.linalg.qr(y)[0]
    return y / (np.linalg.norm(y, axis=1, keepdims=True) + 1e-12)


def balanced_cut(near: np.ndarray, parts: int, rounds: int = 30, room: float = 1.5,
                 seed: int = 11) -> np.ndarray:
    """Part of each row, none larger than ``room`` equal shares.

    Starts from centres in the graph's leading directions and moves rows to where most of their
    neighbours are, while there is room.
    """
    rng = np.random.default_rng(seed)
    n = len(near)
    limit = int(np.ceil(room * n / parts))
    y = spread(near, min(2 * parts, 64, n))
    centres = y[[rng.integers(n)]]
    for _ in range(parts - 1):  # each next one far from those before
        gap = np.maximum(1 - (y @ centres.T).max(axis=1), 0) ** 2 + 1e-12
        centres = np.vstack([centres, y[rng.choice(n, p=gap / gap.sum())]])
    for _ in range(15):
        near_centre = (y @ centres.T).argmax(axis=1)
        for p in range(parts):
            if (near_centre == p).any():
                centres[p] = y[near_centre == p].mean(axis=0)
                centres[p] /= np.linalg.norm(centres[p]) + 1e-12
    likeness = y @ centres.T
    choice = np.argsort(-likeness, axis=1, kind="stable")
    part, left = np.zeros(n, np.int64), np.full(parts, limit)
    for i in np.argsort(-likeness.max(axis=1), kind="stable").tolist():
        p = next(p for p in choice[i].tolist() if left[p])
        part[i] = p
        left[p] -= 1
    ends = np.repeat(np.arange(n), near.shape[1])
    both_from, both_to = np.r_[ends, near.ravel()], np.r_[near.ravel(), ends]
    for _ in range(rounds):
        ties = np.bincount(both_from * parts + part[both_to], minlength=n * parts).reshape(n, parts)
        best = ties.argmax(axis=1)
        gain = ties[np.arange(n), best] - ties[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if size[best[i]] < limit and rng.random() < 0.7:
                size[best[i]] += 1
                size[part[i]] -= 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    weights: np.ndarray
    bias: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.bias)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.weights + self.bias

    def place(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(axis=1)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """The likeliest parts of each row."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :self.probes]


def train(x: np.ndarray, parts: int, target: float = TARGET, steps: int = 300) -> Router:
    """Cuts the sample's graph and fits the classifier to where each row's neighbours lie."""
    n, dim = x.shape
    k = min(GRAPH_K, n - 1)
    if parts < 2 or k < 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), 1)
    near = neighbour_graph(x, k)
    part = balanced_cut(near, parts)
    aim = np.zeros((n, parts))
    np.add.at(aim, (np.repeat(np.arange(n), k), part[near].ravel()), 1 / (2 * k))
    aim[np.arange(n), part] += 0.5
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    w, b = np.zeros((dim, parts)), np.zeros(parts)
    moments = [np.zeros_like(w), np.zeros_like(b), np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, steps + 1):
        z = unit @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        miss = p / p.sum(axis=1, keepdims=True) - aim
        for i, (value, g) in enumerate(((w, unit.T @ miss / n + 1e-5 * w), (b, miss.mean(axis=0)))):
            m, v = moments[i], moments[i + 2]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    router = Router(w, b, parts)
    placed, order = router.place(x), router.visits(x)
    hit = (order[:, None, :] == placed[near][:, :, None]).argmax(axis=2)  # how far down each neighbour is
    for probes in range(1, parts + 1):
        if (hit < probes).mean() >= target:
            break
    router.probes = probes
    return router


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def search(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE,
           block: int = BLOCK, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``; ``is_query`` tells from ``vec_id``."""
    rows = cut(valid_vectors(vectors, id_column, column))
    few = Window.partitionBy("a", "b").orderBy("vec_id")
    distinct = cut(rows.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= k + 1)
                   .groupBy("a", "b").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"),
                                          F.first("v").alias("v")))
    queries = rows.where(is_query).select("vec_id", "a", "b")
    n = distinct.count()
    drawn = distinct.orderBy(F.xxhash64("a", "b"), "a", "b").limit(sample).select("v").toArrow()
    parts = 1
    while parts * 8 < np.sqrt(n) and parts * 64 < min(n, sample):
        parts *= 2
    router = train(_matrix(drawn.column("v")), parts)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                at = router.place(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())],
                                                 names=[*batch.schema.names, "part"])

    placed = cut(distinct.mapInArrow(place, "a long, b long, ids array<long>, v array<double>, part int"))
    blocks = {r.part: -(-r["count"] // block) for r in placed.groupBy("part").count().collect()}
    asked = cut(placed.join(queries.select("a", "b").distinct(), ["a", "b"], "left_semi").select("a", "b", "v"))
    query_blocks = max(1, -(-asked.count() * router.probes // (router.parts * block)))

    def visit(batches):
        for batch in batches:
            if batch.num_rows:
                units = [[p << 32 | c for p in row for c in range(blocks.get(p, 0))]
                         for row in router.visits(_matrix(batch.column("v"))).tolist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(units, pa.list_(pa.int64()))],
                                                 names=[*batch.schema.names, "units"])

    left = (asked.mapInArrow(visit, "a long, b long, v array<double>, units array<long>")
            .select("a", "b", "v", F.explode("units").alias("unit"),
                    F.pmod(F.xxhash64("a"), F.lit(query_blocks)).alias("turn")))
    in_part = F.create_map(*[F.lit(x) for p, c in (sorted(blocks.items()) or [(0, 1)]) for x in (p, c)])
    right = placed.select(
        "ids", "v", (F.shiftleft(F.col("part").cast("long"), 32)
                     + F.pmod(F.xxhash64("b"), in_part[F.col("part")])).alias("unit"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("turn"))

    def compare(asking: pa.Table, held: pa.Table) -> pa.Table:
        found = ([], [], [], [])
        if asking.num_rows and held.num_rows:
            q, c = _matrix(asking.column("v")), _matrix(held.column("v"))
            ids = held.column("ids").to_pylist()
            a, b = asking.column("a").to_pylist(), asking.column("b").to_pylist()
            take = min(len(c), k + 1 + SLACK)
            for first in range(0, len(q), 512):
                part = q[first:first + 512] @ c.T
                best = np.argpartition(-part, take - 1, axis=1)[:, :take]
                for i, near in enumerate(best):
                    # summed one way for every pair, so that equal vectors tie
                    exact = (q[first + i] * c[near]).sum(axis=1)
                    order = sorted(zip((-exact).tolist(), near.tolist()), key=lambda t: (t[0], ids[t[1]][0]))
                    pairs = [(-s, x) for s, j in order for x in ids[j]]
                    pairs.sort(key=lambda t: (-t[0], t[1]))
                    for column, value in zip(found, (a[first + i], b[first + i],
                                                     [s for s, _ in pairs[:k + 1]],
                                                     [x for _, x in pairs[:k + 1]])):
                        column.append(value)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()),
                         pa.array(found[2], pa.list_(pa.float64())), pa.array(found[3], pa.list_(pa.int64()))],
                        names=["a", "b", "scores", "ids"])

    near = (left.groupBy("unit", "turn").cogroup(right.groupBy("unit", "turn"))
            .applyInArrow(compare, "a long, b long, scores array<double>, ids array<long>"))
    merged = (near.groupBy("a", "b").agg(F.flatten(F.collect_list("scores")).alias("scores"),
                                         F.flatten(F.collect_list("ids")).alias("ids"))
              .select("a", "b", F.slice(F.array_sort(F.zip_with(
                  "scores", "ids", lambda s, i: F.struct((-s).alias("down"), i.alias("vec_id")))), 1, k + 1)
                  .alias("top")))
    return (queries.withColumnRenamed("vec_id", "query_id").join(merged, ["a", "b"])
            .select("query_id", F.posexplode(F.slice(F.filter(
                "top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)).alias("at", "near"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("near.vec_id").alias("vec_id"),
                    (-F.col("near.down")).alias("score")))
