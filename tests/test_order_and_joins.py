"""Global positions, quantiles, bounded windows and skew-proof joins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import dedup, joins, ordering, sampling
from parley.plans import run_metrics as metrics


def test_positions_follow_the_order(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    rows = ordering.with_position(df, F.desc("v")).collect()
    assert sorted((r.pos, r.v) for r in rows) == [(i, 999 - i) for i in range(1000)]


def test_group_positions_with_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(99).alias("g"), "id")
    rows = ordering.with_group_position(df, "g", "id").collect()
    by_group = {}
    for r in sorted(rows, key=lambda r: r.id):
        assert r.pos == by_group.setdefault(r.g, 0)
        by_group[r.g] += 1
    assert all(r.pos_size == by_group[r.g] for r in rows)


def test_quantiles_match_numpy(spark):
    values = np.random.default_rng(3).choice([1.0, 2.5, 7.0, 7.0, 7.0, 100.0], 501)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probabilities = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = ordering.quantiles(df, "v", probabilities).first()
    assert np.allclose(list(got), np.quantile(values, probabilities))


@pytest.mark.parametrize("search", [{}, {"accuracy": 50, "held": 3}])
def test_quantiles_of_several_columns_with_ties_and_nulls(spark, search):
    rng = np.random.default_rng(4)
    rows = [(float(a), int(b), None if c > 5 else float(c)) for a, b, c in zip(
        rng.normal(size=700), rng.integers(0, 4, 700), rng.integers(0, 9, 700))]
    df = spark.createDataFrame(rows, "a double, b long, c double").repartition(6)
    asked = {"a": [0, 0.013, 0.5, 0.99, 1], "b": [0.25, 0.5, 1], "c": [0.1, 0.9]}
    got = ordering.quantiles_of(df, asked, **search).first()
    for i, c in enumerate("abc"):
        v = np.array([r[i] for r in rows if r[i] is not None])
        for k, p in enumerate(asked[c]):
            assert got[f"{c}_q{k}"] == pytest.approx(np.quantile(v, p), abs=1e-12)


def test_quantiles_of_nothing(spark):
    got = ordering.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).first()
    assert got.q0 is None


def test_rolling_mean_across_blocks(spark):
    latency = np.random.default_rng(5).random(731)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(latency)], "pos long, request_latencies double")
    rows = {r.pos: r.rolling_mean for r in metrics.rolling_latency(df, 50, block_rows=100).collect()}
    assert len(rows) == 731
    assert all(rows[i] is None for i in range(49))
    assert all(np.isclose(rows[i], latency[i - 49:i + 1].mean()) for i in range(49, 731))


def test_retry_gaps_across_blocks(spark):
    hits = [3, 4, 10, 200, 201, 650]
    df = spark.createDataFrame([(i, 1.0 if i in hits else 0.0) for i in range(700)],
                               "pos long, retries_per_dialogue double")
    rows = metrics.retry_gaps(df, block_rows=2).collect()
    assert sorted(r.gap for r in rows) == sorted(np.diff(hits).tolist())


def test_hot_key_lookup_equals_plain_join(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    other = spark.range(0, 40).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    df = df.withColumn("k", F.col("k").cast("int"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(df.join(other, "k", how).collect())
        for least in (1000, 10**9):
            got = joins.lookup(df, other, ["k"], how, least=least, small_rows=0)
            assert sorted(got.collect()) == want


def test_size_check_counts_bytes(spark):
    wide = spark.range(50).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert joins.is_small(wide)
    assert not joins.is_small(wide, size=10_000)
    assert not joins.is_small(wide, rows=49)


def test_first_wins_with_a_hot_hash(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("h"))
    flags = {r.id: r.is_duplicate for r in dedup.flag_exact_duplicates(df, "h", "id").collect()}
    assert [i for i, d in flags.items() if not d and i % 3 > 0] == [1]
    assert not any(flags[i] for i in range(0, 900, 3))
    kept = dedup.drop_exact_duplicates(df, "h", "id")
    assert {r.id for r in kept.collect()} == {i for i, d in flags.items() if not d}


def test_split_is_disjoint_and_whole(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    kept, removed = joins.split_by_ids(df, df.where("k % 4 = 0"), "k")
    assert {r.k for r in kept.collect()} | {r.k for r in removed.collect()} == set(range(100))
    assert kept.join(removed, "k").count() == 0


def test_ragged_zip_pads(spark):
    df = spark.createDataFrame([([1, 2, 3], [9])], "a array<int>, b array<int>")
    rows = sorted(tuple(r) for r in joins.zip_arrays(df, ["a", "b"]).select("pos", "a", "b").collect())
    assert rows == [(0, 1, 9), (1, 2, None), (2, 3, None)]


def test_unknown_service_has_general_categories(spark):
    df = spark.createDataFrame([("Hotel",), ("spaceship",), (None,)], "service string")
    got = joins.categories_of(df).groupBy("service").count().collect()
    assert {r["service"]: r["count"] for r in got} == {"Hotel": 16, "spaceship": 9, None: 9}
    assert joins.categories_of(df).where("service = 'Hotel' and category = 'room_reservation'").count() == 1


def test_stratified_sample_meets_quotas(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 99 else "c") for i in range(100)], "id int, g string")
    rows = sampling.stratified_sample(df, "g", 101, "s", "id").collect()
    counts = {}
    for r in rows:
        counts[r.g] = counts.get(r.g, 0) + 1
    assert counts == {"a": 34, "b": 34, "c": 33}
    assert sorted(r["rank"] for r in rows) == list(range(101))


def test_balanced_usage_differs_by_one_at_most(spark):
    df = sampling.assign_size_class(spark.range(1000), "id", "s")
    usage = sampling.combination_usage(sampling.balanced_services(df, "id", "s"))
    for r in sampling.usage_spread(usage).collect():
        assert r.max_uses - r.min_uses <= 1


def test_half_of_a_class_goes(spark):
    df = spark.range(11).select(F.col("id").cast("string").alias("k"))
    assert sampling.thin_class(df, "k", "42").count() == 5
    assert sampling.thin_class(df.limit(0), "k", "42").count() == 0
