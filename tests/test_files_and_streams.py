"""Readers, writers, stages and streams on small files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import model_stage
from parley.plans import run_metrics as metrics
from parley.sources import readers, writers
from parley.streaming import ingest

LINE = {"dialogue_id": "d1", "services": ["taxi"], "num_lines": 6, "time_slot": [9, 12, "Late"],
        "turns": [{"turn_number": 1, "utterance": "ü", "intent": "i", "assistant_response": "a"}],
        "user_emotions": ["Happy"], "assistant_emotions": ["Patient"], "scenario_category": "c",
        "generated_scenario": "s", "regions": ["Rome"], "resolution_status": "Resolved"}


def put(folder, name, body):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as out:
        out.write(body)
    return path


def test_strict_reader(spark, folder):
    good = put(folder, "good.jsonl", json.dumps(LINE, ensure_ascii=False) + "\n\n" + json.dumps(LINE) + "\n")
    rows = readers.read_strict(spark, good).collect()
    assert len(rows) == 2 and rows[0].turns[0].utterance == "ü"
    assert json.loads(rows[0].time_slot) == [9, 12, "Late"]
    bad = put(folder, "bad.jsonl", json.dumps(LINE) + "\n{oops\n")
    with pytest.raises(Exception):
        readers.read_strict(spark, bad).collect()


def test_tolerant_reader_counts_bad_lines(spark, folder):
    path = put(folder, "mixed.jsonl", json.dumps(LINE) + "\n{oops\n\n" + json.dumps(LINE) + "\nno\n")
    good, bad = readers.read_tolerant(spark, path)
    assert good.count() == 2 and sorted(r.line for r in bad.collect()) == ["no", "{oops"]


def test_array_reader_and_length_filter(spark, folder):
    from parley.operators.filters import longer_than

    lines = [LINE | {"dialogue_id": str(i), "num_lines": n} for i, n in enumerate([5, 6, None, "6", True, 6.0])]
    path = put(folder, "array.json", json.dumps(lines, indent=2))
    kept = longer_than(readers.read_array(spark, path), 5).collect()
    assert [r.dialogue_id for r in kept] == ["1"]
    with pytest.raises(ValueError):
        readers.read_array(spark, put(folder, "object.json", json.dumps(LINE)))


def test_turn_reader(spark, folder):
    path = put(folder, "d.jsonl", json.dumps(LINE) + "\n")
    row = readers.read_turns(spark, path).first()
    assert (row.turn_number, row.time_slot_start, row.regions_str) == (1, 9, "Rome")
    broken = put(folder, "b.jsonl", json.dumps(LINE | {"generated_scenario": None}) + "\n")
    with pytest.raises(ValueError, match="null:generated_scenario"):
        readers.read_turns(spark, broken)


def test_absent_state_is_empty(spark, folder):
    assert readers.read_known_ids(spark, f"{folder}/none").count() == 0
    assert readers.read_known_hashes(spark, f"{folder}/none").count() == 0
    assert readers.read_known_vectors(spark, f"{folder}/none").count() == 0


def test_state_grows(spark, folder):
    rows = spark.createDataFrame([(1, "h1", [1.0])], "id long, hash string, embedding array<double>")
    for _ in range(2):
        writers.append_hashes(rows, f"{folder}/hashes")
        writers.append_vectors(rows, f"{folder}/vectors")
    assert readers.read_known_hashes(spark, f"{folder}/hashes").count() == 1
    assert readers.read_known_vectors(spark, f"{folder}/vectors").count() == 2


def test_split_and_conditional_writes(spark, folder):
    df = spark.range(10)
    counts = writers.write_split(df, F.when(F.col("id") != 5, F.col("id") > 3), f"{folder}/k", f"{folder}/r")
    assert counts == (5, 5)
    assert spark.read.json(f"{folder}/k").count() == 5 and spark.read.json(f"{folder}/r").count() == 5
    assert writers.write_unless_empty(df.limit(0), f"{folder}/nothing") is False
    assert writers.write_dead_letters(df, f"{folder}/dead") is True


def test_rewrite_refuses_an_existing_target(spark, folder):
    df = spark.range(3)
    writers.rewrite_with(df, df, f"{folder}/t")
    assert spark.read.json(f"{folder}/t").count() == 6
    with pytest.raises(Exception):
        writers.rewrite_with(df, df, f"{folder}/t")


def test_export_types(spark, folder):
    path = put(folder, "d.jsonl", json.dumps(LINE | {"time_slot": [9, None, "Late"]}) + "\n")
    writers.export(readers.read_strict(spark, path), f"{folder}/out")
    row = spark.read.json(f"{folder}/out").first()
    assert row.time_slot == ["9", "", "Late"] and row.num_lines == 6


def test_metrics_files(spark, folder):
    whole = {"total_dialogues_attempted": 4, "total_dialogues_generated": 2, "total_successful_dialogues": 2,
             "total_failed_dialogues": 1, "total_retries": 2, "retries_per_dialogue": [0, 2],
             "request_latencies": [1.5, 2.5, 3.5], "total_time_taken": 9.0, "tokens_used_per_request": [10, 20, 30],
             "dialogue_service_distribution": {"taxi": 2}, "dialogue_turns": [5, 6]}
    summary, series = readers.read_run_metrics(spark, put(folder, "metrics.json", json.dumps(whole)))
    assert series.count() == 3
    assert metrics.success_rate(summary).first().success_pct == 50.0
    writers.write_metrics_csv(series, summary, f"{folder}/csv")
    raw = readers.read_metrics_csv(spark, f"{folder}/csv")
    assert raw.count() == 3
    assert metrics.clean_metrics(raw).count() == 2
    merged = metrics.merge_runs(summary.unionByName(summary)).first()
    assert merged.total_dialogues_attempted == 8
    writers.write_run_metrics(summary, series, f"{folder}/m")
    assert spark.read.json(f"{folder}/m/series").count() == 3


def test_stage_errors_do_not_stop_the_job(spark):
    calls = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, "")], "id int, t string")

    def score(body):
        if body == "bad":
            raise RuntimeError("no")
        return {"x": float(len(body))}

    done, left = model_stage.with_one_retry(calls, "id", lambda d: model_stage.moderate(d, "id", "t", score))
    assert {r.id: r.flagged for r in done.collect()} == {1: True, 3: False}
    assert [r.id for r in left.collect()] == [2]


def test_generation_stops_when_all_are_valid(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "id int, user string")
    body = "<User>u</User><Intent>i</Intent><Assistant>a</Assistant>"
    tried = model_stage.generate(asked, "id", lambda v, n: (body if n > 1 or v["user"] == "a" else "x", 5))
    got = {r.id: (r.attempts, r.ok) for r in model_stage.outcomes(tried, "id").collect()}
    assert got == {1: (1, True), 2: (2, True)} and tried.count() == 3


def test_a_repeated_batch_replaces_its_output(spark, folder):
    rows = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])],
                                 "vec_id long, hash string, v array<double>")
    writers.append_lines(rows, f"{folder}/drops")
    for mark in ("m1", "m2"):  # a lost checkpoint replays batch 0
        ingest.run_unique_vectors(ingest.read_drops(spark, f"{folder}/drops", rows.schema, 100), f"{folder}/out",
                                  f"{folder}/{mark}", key="hash", position="vec_id", vector="v")
    assert ingest.read_accepted(spark, f"{folder}/out", rows.schema).count() == 2


def test_streamed_vectors_read_the_cells_they_touch(spark, folder):
    rng = np.random.default_rng(2)
    x = np.eye(6)[rng.integers(0, 6, 90)] * 3 + rng.normal(size=(90, 6)) * 0.25
    drops = []
    for n in range(3):
        part = [(int(i), f"h{i}", x[i].tolist()) for i in range(n, 90, 3)] + [(200 + n, "h0", x[0].tolist()), (300 + n, f"z{n}", [0.0] * 6)]
        drops.append(spark.createDataFrame(part, "vec_id long, hash string, v array<double>"))
        writers.append_lines(drops[-1].coalesce(1), f"{folder}/drops")
        ingest.run_unique_vectors(ingest.read_drops(spark, f"{folder}/drops", drops[0].schema, 100), f"{folder}/out",
                                  f"{folder}/m", key="hash", position="vec_id", vector="v", threshold=0.97, cells=9)
    kept, u = [], x / np.linalg.norm(x, axis=1, keepdims=True)
    for n in range(3):
        for i in range(n, 90, 3):
            if not any(u[i] @ u[j] >= 0.97 for j in kept):
                kept.append(i)
    got = sorted(r.vec_id for r in ingest.read_accepted(spark, f"{folder}/out", drops[0].schema).collect())
    assert got == sorted([*kept, 300, 301, 302])
    pivots = ingest._fixed_pivots(spark, f"{folder}/out/_pivots", None, 9)
    placed = {r.vec_id: r for r in ingest.with_cells(drops[0].union(drops[1]), "v", pivots, 0.97).collect() if r.vec_id < 90}
    assert any(len(r._near) < len(pivots) for r in placed.values())
    for a in placed.values():
        for b in placed.values():
            if u[a.vec_id] @ u[b.vec_id] >= 0.97:
                assert b._cell in a._near


@pytest.mark.parametrize("among_new", [True, False])
def test_a_first_drop_may_be_larger_than_fits_a_task(spark, folder, among_new):
    x = np.eye(6)[np.arange(80) % 6] + np.random.default_rng(3).normal(size=(80, 6)) * 0.05
    schema = "vec_id long, hash string, v array<double>"
    for first, end in ((0, 70), (70, 80)):
        rows = [(i, f"h{i}", x[i].tolist()) for i in range(first, end)]
        writers.append_lines(spark.createDataFrame(rows, schema), f"{folder}/drops")
        drops = ingest.read_drops(spark, f"{folder}/drops", spark.createDataFrame([], schema).schema, 100)
        ingest.run_unique_vectors(drops, f"{folder}/out", f"{folder}/m", key="hash", position="vec_id", vector="v",
                                  threshold=0.9, among_new=among_new, small_values=120)  # 20 rows fit a task
    got = ingest.read_accepted(spark, f"{folder}/out", drops.schema)
    assert sorted(r.vec_id for r in got.collect()) == list(range(6 if among_new else 70))


def test_streamed_keys_are_unique_across_drops(spark, folder):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, hash string")
    for _ in range(2):
        writers.append_lines(rows, f"{folder}/drops")
        ingest.run_unique(ingest.read_drops(spark, f"{folder}/drops", rows.schema), "hash", f"{folder}/out", f"{folder}/m")
    assert spark.read.json(f"{folder}/out").count() == 2


def test_many_drops_make_few_batches(spark, folder):
    rows = spark.range(40).selectExpr("id", "string(id % 15) as hash")
    writers.append_batches(rows.repartition(2, "id"), f"{folder}/drops", rows=2)
    drops = [f for f in os.listdir(f"{folder}/drops") if f.endswith(".json")]
    ingest.run_unique(ingest.read_drops(spark, f"{folder}/drops", rows.schema), "hash", f"{folder}/out", f"{folder}/m")
    assert sorted(int(r.hash) for r in spark.read.schema(rows.schema).json(f"{folder}/out").collect()) == list(range(15))
    batches = [f for f in os.listdir(f"{folder}/m/commits") if f.isdigit()]
    assert 1 < len(batches) <= ingest.MOST_BATCHES < len(drops)
