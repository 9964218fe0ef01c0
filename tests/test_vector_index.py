"""The stored index against brute force, on both sizes of its tree."""

import numpy as np
import pytest

from parley.operators import vector_index
from parley.operators.survivors import greedy_survivors, visit_in_order

DEEP = {"small_values": 0, "fan": 3, "block_rows": 20}


def clustered(n, d=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(9, d))[rng.integers(0, 9, n)] + rng.normal(size=(n, d)) * 0.2
    x[: n // 5] = x[0]  # copies of one vector cannot be divided
    return x


def frame(spark, x, first=0):
    rows = [(first + i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(4)


def nearest(x, y, k):
    u, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    s = np.round(u @ v.T, 12)
    return [np.lexsort((np.arange(len(y)), -row))[:k].tolist() for row in s]


@pytest.mark.parametrize("build", [{}, DEEP])
def test_all_cells_give_the_exact_answer(spark, folder, build):
    x = clustered(300)
    index = vector_index.build(frame(spark, x), f"{folder}/index", leaf_rows=25, shard_rows=60, **build)
    cells = index.cells().collect()
    assert sum(c.n for c in cells) == 300 and len(cells) > 12
    assert sum(c.n > 25 for c in cells) <= 1  # that of the copies
    search = {k: v for k, v in build.items() if k != "fan"}
    queries = clustered(40, seed=0)[5:] + 0.01
    found = index.search(frame(spark, queries, 1000), 4, 10_000, **search).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.id - 1000, []).append(r.nbr)
    assert [got[i] for i in range(len(queries))] == nearest(queries, x, 4)


@pytest.mark.parametrize("build", [{}, DEEP])
def test_few_cells_find_most(spark, folder, build):
    x = clustered(400, seed=3)[80:]
    index = vector_index.build(frame(spark, x), f"{folder}/index", leaf_rows=40, shard_rows=40, **build)
    search = {k: v for k, v in build.items() if k != "fan"}
    cells = index.cells().count()
    found = {(r.id, r.nbr) for r in index.search(frame(spark, x), 5, cells // 3, **search).collect()}
    want = {(i, j) for i, row in enumerate(nearest(x, x, 6)) for j in [j for j in row if j != i][:5]}
    assert len(found & want) >= 0.9 * len(want)


def test_only_visited_folders_are_read(spark, folder):
    index = vector_index.build(frame(spark, clustered(300)), f"{folder}/index", leaf_rows=25, shard_rows=10)
    shards = [r.shard for r in index.cells().select("shard").distinct().collect()]
    plan = index.rows(shards[:2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert 0 < index.rows(shards[:2]).count() < 300


def test_rows_without_direction_and_empty_tables(spark, folder):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [2.0, 0.1])], "id long, vec array<double>")
    index = vector_index.build(rows, f"{folder}/few")
    assert [(r.id, r.nbr) for r in index.search(rows, 3, 1).orderBy("id").collect()] == [(3, 4), (4, 3)]
    empty = vector_index.build(rows.limit(0), f"{folder}/none")
    assert empty.search(rows, 3, 1).collect() == []
    assert index.search(rows.limit(0), 3, 1).collect() == []


def test_a_chain_takes_no_round_per_link(spark, monkeypatch):
    """24 vectors, each near the one before only: one visit of one block."""
    wide = np.zeros((24, 24))
    for i in range(24):
        wide[i, i] = 1
        wide[i, max(i - 1, 0)] += 1 if i else 0
    from parley.operators import survivors

    rounds = []
    original = survivors._settle_blocks
    monkeypatch.setattr(survivors, "_settle_blocks", lambda *a: rounds.append(1) or original(*a))
    got = greedy_survivors(frame(spark, wide), 0.4, small_values=0, cells=2)
    assert sorted(r.id for r in got.where("kept").collect()) == list(range(0, 24, 2))
    assert len(rounds) <= 3


def test_visits_wait_only_for_rows_elsewhere():
    near = np.zeros((4, 4), bool)
    near[1, 0] = near[2, 1] = near[3, 2] = True
    assert visit_in_order(near, np.zeros(4, bool)).tolist() == [1, 2, 1, 2]
    assert visit_in_order(near, np.array([True, False, False, False])).tolist() == [0, 0, 0, 0]
    near[2, 0] = True
    assert visit_in_order(near, np.array([False, True, False, False])).tolist() == [1, 2, 2, 1]


def test_a_query_goes_once_to_a_bundle_of_cells(spark, folder, monkeypatch):
    """Nine tenths of all cells are visited without a copy of the query for each."""
    x = np.random.default_rng(4).normal(size=(300, 8))
    index = vector_index.build(frame(spark, x), f"{folder}/index", leaf_rows=12, shard_rows=60)
    cells = index.cells().count()
    sent = []
    original = vector_index._meet
    monkeypatch.setattr(vector_index, "_meet", lambda q, *a: sent.append(q.count()) or original(q, *a))
    found = {(r.id, r.nbr) for r in index.search(frame(spark, x), 5, cells * 9 // 10, block_rows=100).collect()}
    assert cells > 30 and sent[0] <= 300 * 6
    assert found == {(r.id, r.nbr) for r in sim_of_cells(index, frame(spark, x), 5, cells * 9 // 10)}


def sim_of_cells(index, queries, k, probes):
    """The same cells, each searched alone."""
    from parley.operators import similarity

    hits = index._in_cells(similarity.unit_vectors(queries).drop("key"), k, probes, 100, similarity.SMALL_VALUES)
    return similarity.keep_nearest(hits, k).collect()
