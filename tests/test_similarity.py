"""Search and survivors against brute force, with and without the block path."""

import numpy as np
import pytest

from parley.operators import dedup, similarity
from parley.operators.survivors import greedy_survivors

BLOCKS = {"small_values": 0, "block_rows": 20, "cells": 9}


def clustered(n=260, d=12, seed=0):
    """Near copies, exact copies and loners; a third of the rows sit in one group."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    which = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 12, n))
    x = centres[which] + rng.normal(size=(n, d)) * 0.25
    x[which == 3] = centres[3]
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)],
                                 "id long, vec array<double>").repartition(5)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sequential(x, threshold, fixed=None):
    u = unit(x)
    kept_vectors = [] if fixed is None else list(unit(fixed))
    kept = []
    for i, v in enumerate(u):
        if not any(v @ w >= threshold for w in kept_vectors):
            kept.append(i)
            kept_vectors.append(v)
    return kept


@pytest.mark.parametrize("search", [{}, {**BLOCKS, "leaders": 4}])
@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_survivors_equal_the_sequential_loop(spark, threshold, search):
    x = clustered()
    got = greedy_survivors(frame(spark, x), threshold, **search).where("kept").collect()
    assert sorted(r.id for r in got) == sequential(x, threshold)


@pytest.mark.parametrize("search", [{}, BLOCKS])
def test_existing_rows_win(spark, search):
    x = clustered(200, seed=1)
    old, new = x[:80], x[80:]
    got = greedy_survivors(frame(spark, new), 0.8, existing=frame(spark, old), **search)
    assert sorted(r.id for r in got.where("kept").collect()) == sequential(new, 0.8, old)


@pytest.mark.parametrize("search", [{}, BLOCKS])
def test_near_existing(spark, search):
    x = clustered(200, seed=2)
    old, new = x[:90], x[90:]
    want = np.nonzero((unit(new) @ unit(old).T >= 0.9).any(axis=1))[0].tolist()
    got = similarity.near_existing(frame(spark, new), frame(spark, old), 0.9, **search)
    assert sorted(r.id for r in got.collect()) == want


@pytest.mark.parametrize("search", [{}, BLOCKS, {"small_values": 720, "cells": 9}])  # 720: 60 rows fit a task
@pytest.mark.parametrize("old", [[], [[0.0] * 12]])
def test_without_existing_rows_new_ones_face_each_other_only(spark, search, old):
    x = clustered(200, seed=4)
    existing = spark.createDataFrame([(i, v) for i, v in enumerate(old)], "id long, vec array<double>")
    got = greedy_survivors(frame(spark, x), 0.8, existing=existing, **search)
    assert sorted(r.id for r in got.where("kept").collect()) == sequential(x, 0.8)
    assert similarity.near_existing(frame(spark, x), existing, 0.8, **search).collect() == []
    assert similarity.near_existing(existing, frame(spark, x), 0.8, **search).collect() == []


def test_only_queries_without_a_witness_go_to_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.eye(12)[0] + rng.normal(size=(300, 12)) * 0.02
    x[220] = x[298] = -np.eye(12)[1]  # an old row and a new one away from all others
    x[299] = np.eye(12)[2]  # like no old row
    sent, in_blocks = [], similarity.in_blocks

    def counting(queries, *rest):
        sent.append(queries.count())
        return in_blocks(queries, *rest)

    monkeypatch.setattr(similarity, "in_blocks", counting)
    for old_rows, new_rows, most in ((x[:240], x[240:298], 0), (x[:240], x[240:], 2)):
        got = similarity.near_existing(frame(spark, new_rows), frame(spark, old_rows), 0.9,
                                       small_values=720, block_rows=20, cells=9)
        want = np.nonzero((unit(new_rows) @ unit(old_rows).T >= 0.9).any(axis=1))[0].tolist()
        assert sorted(r.id for r in got.collect()) == want
        assert sum(sent) <= most
    got = greedy_survivors(frame(spark, x[240:]), 0.9, existing=frame(spark, x[:240]), small_values=720, cells=9)
    assert sorted(r.id for r in got.where("kept").collect()) == sequential(x[240:], 0.9, x[:240])


@pytest.mark.parametrize("search", [{}, BLOCKS])
def test_neighbours_equal_brute_force(spark, search):
    x = clustered(180, seed=3)
    u = unit(x)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    want = {(i, int(j), r + 1) for i in range(len(x))
            for r, j in enumerate(sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:7])}
    got = similarity.nearest_neighbours(frame(spark, x), 7, **search).collect()
    assert {(r.id, r.nbr, r["rank"]) for r in got} == want


def test_chain_keeps_both_ends(spark):
    x = np.array([[1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])
    got = greedy_survivors(frame(spark, x), 0.7).collect()
    assert {r.id: r.kept for r in got} == {0: True, 1: False, 2: True}


def test_vectors_without_direction_survive(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, None), (2, [1.0, 0.0]), (3, [2.0, 0.0])],
                               "id long, vec array<double>")
    got = {r.id: r.kept for r in greedy_survivors(df, 0.9).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False}


def test_survivors_of_survivors_all_survive(spark):
    x = clustered(150, seed=4)
    kept = greedy_survivors(frame(spark, x), 0.8).where("kept").join(frame(spark, x), "id").select("id", "vec")
    assert greedy_survivors(kept, 0.8).where("not kept").count() == 0


def test_no_more_neighbours_than_rows(spark):
    got = similarity.nearest_neighbours(frame(spark, np.eye(3)), 10).collect()
    assert len(got) == 6


def test_approximate_search_recall(spark):
    x = clustered(400, seed=5)
    exact = {(r.id, r.nbr) for r in similarity.nearest_neighbours(frame(spark, x), 5).collect()}
    rough = {(r.id, r.nbr) for r in similarity.trained_neighbours(frame(spark, x), 5, cells=12, probes=4).collect()}
    assert len(exact & rough) / len(exact) > 0.9


def test_probed_survivors_cover(spark):
    x = clustered(200, seed=6)
    got = greedy_survivors(frame(spark, x), 0.9, probes=3, cells=6, block_rows=50).where("kept").count()
    assert len(sequential(x, 0.9)) <= got <= len(x)


def test_two_stages_and_split(spark):
    x = clustered(100, seed=7)
    df = frame(spark, x).selectExpr("id as pos", "vec", "if(id in (10, 20, 30), 'same', string(id)) as h")
    found = dedup.two_stage_duplicates(df, "h", "pos", "vec", 0.9)
    exact = {r.pos for r in found.where("stage = 'exact'").collect()}
    assert exact == {20, 30}
    rest = [i for i in range(100) if i not in exact]
    kept = {rest[i] for i in sequential(x[rest], 0.9)}
    unique, removed = dedup.split_duplicates(df, found, "pos")
    assert {r.pos for r in unique.collect()} == kept
    assert {r.pos for r in removed.collect()} == set(range(100)) - kept


def test_rows_are_settled_ahead_while_that_halves_them(spark):
    x = clustered(400, seed=8)
    got = greedy_survivors(frame(spark, x), 0.8, ahead_values=12 * 40, cells=6).where("kept").collect()
    assert sorted(r.id for r in got) == sequential(x, 0.8)
    old, new = x[:120], x[120:]
    got = greedy_survivors(frame(spark, new), 0.8, existing=frame(spark, old), ahead_values=12 * 40, cells=6)
    assert sorted(r.id for r in got.where("kept").collect()) == sequential(new, 0.8, old)
    loners = np.eye(90)  # nothing is near: the rest goes on in blocks
    got = greedy_survivors(frame(spark, loners), 0.5, ahead_values=90 * 10, cells=4).where("kept").count()
    assert got == 90


def test_a_query_goes_once_to_a_bundle_of_cells(spark):
    x = np.random.default_rng(9).normal(size=(300, 12))  # every query must see every cell
    placed = similarity.numbered_vectors(frame(spark, x), "id", "vec")
    placed = similarity.unit_vectors(placed).drop("key")
    pivots = similarity.pick_pivots(placed, 30)
    placed = similarity.place(placed, pivots)
    stats = similarity.cell_stats(placed, 30)
    bundles = similarity.bundle_cells(stats, 100)
    assert np.bincount(bundles, stats.rows).max() <= 100
    asked = similarity.probe(placed.selectExpr("*", "3.2D as reach"), pivots, stats, bundles, "reach")
    assert {len(r.visits) for r in asked.collect()} == {bundles[-1] + 1} and bundles[-1] < 6


def test_products_are_made_in_steps(spark):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    many, few = (similarity.from_matrix(unit(rng.normal(size=(n, 8)))) for n in (50_000, 1_500))
    candidates = pa.table({"id": np.arange(50_000), "vec": many})
    queries = pa.table({"id": np.arange(1_500) + 50_000, "vec": few})
    for task in ({"mode": "nearest", "k": 5}, {"mode": "earlier", "threshold": 0.9}):
        tracemalloc.start()
        similarity._best(task, queries, candidates)
        assert tracemalloc.get_traced_memory()[1] < 150 << 20
        tracemalloc.stop()


@pytest.mark.parametrize("rising", [False, True])
def test_few_products_of_the_nearest_are_made_in_double(monkeypatch, rising):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(3000, 16)))
    x[40:60] = x[40] + rng.normal(size=(20, 16)) * 1e-9  # single precision can't tell these apart
    x = unit(x)
    q = np.arange(0, 3000, 7)
    if rising:  # every later row is nearer, so no early bound holds
        q = q[:1]
        x = x[np.argsort(x @ x[0])]
        q[0] = 2999
    made = []
    products = similarity._products
    monkeypatch.setattr(similarity, "_products", lambda *a: made.append(len(a[2])) or products(*a))
    monkeypatch.setattr(similarity, "STEP_VALUES", 4000)
    ids = np.arange(3000) * 3
    table = pa.table({"id": ids, "vec": similarity.from_matrix(x)})
    for floor in (None, 0.5):
        asked = table.take(pa.array(q))
        if floor is not None:
            asked = asked.append_column("floor", pa.array(np.full(len(q), floor)))
        got = similarity._best({"mode": "nearest", "k": 6}, asked, table)
        s = np.round(x[q] @ x.T, 12)
        s[np.arange(len(q)), q] = -9
        want = {(ids[q[i]], ids[j]) for i in range(len(q)) for j in np.lexsort((ids, -s[i]))[:6]
                if floor is None or s[i, j] >= floor}
        assert set(zip(got["id"].to_pylist(), got["nbr"].to_pylist())) == want
    if not rising:
        assert sum(made) < len(q) * len(x) / 10
