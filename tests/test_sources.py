"""Data sources and sinks on small files: whole records, places of errors, one commit."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import records
from parley.sources import json_array, metrics_object, npy, readers, split_lines, versions


def put(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def tricky(n, rng):
    texts = ["", "a", "[{", "}],{", '"', "\\", '\\"', "\\\\", "é日", "x\ny", ",", "{\"a\":[1,2]}"]
    out = []
    for i in range(n):
        out.append({"id": i, "t": "".join(rng.choices(texts, k=rng.randint(0, 8))),
                    "deep": [{"k": [rng.choice(texts)]}] * rng.randint(0, 2), rng.choice(texts): None})
    return out


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}])
def test_array_is_cut_anywhere(folder, chunk, layout):
    want = tricky(12, random.Random(len(str(layout))))
    path = put(f"{folder}/a.json", "﻿ " * (chunk == 7) + json.dumps(want, ensure_ascii=False, **layout) + "\n")
    size, state, got = os.path.getsize(path), (False, 0), []
    for at in range(0, size, chunk):
        end = min(at + chunk, size)
        got += [json.loads(text) for _, text in json_array.records_of(path, at, end, *state)]
        quotes, outside, inside = json_array.report(path, at, end)
        state = (state[0] ^ (quotes % 2 == 1), state[1] + (inside if state[0] else outside))
    assert got == want and state == (False, 0)


def test_array_is_read_by_many_tasks(spark, folder):
    want = tricky(200, random.Random(3))
    path = put(f"{folder}/a.json", json.dumps(want, indent=1))
    df = json_array.read(spark, path, chunk=1000)
    assert df.rdd.getNumPartitions() > 20
    rows = sorted(df.collect(), key=lambda r: r.place)
    assert [json.loads(r.value) for r in rows] == want
    assert all(open(path, "rb").read()[r.place:].startswith(r.value.encode()) for r in rows)


@pytest.mark.parametrize("text, says", [
    ('{"a": 1}', "does not hold a list"), ("5", "does not hold a list"), ("", "does not hold a list"),
    ('[{"a": 1}, {"a": 2', "breaks off"), ('[{"a": 1}', "breaks off"), ("[", "breaks off"), ('[{"a": "x', "breaks off"),
    ('[{"a": 1} {"a": 2}]', "byte 10"), ('[{"a": 1},]', "byte 10"), ('[{"a": 1}, 7]', "byte 11"), ('[{"a": 1}] x', "byte 11"),
    ('[{"a": 1}, "b"]', "byte 11"), ('[[{"a": 1}]]', "byte 1"), ('[,{"a": 1}]', "byte 1"), ('[{"a": }]', "no JSON"),
])
def test_broken_arrays_fail_with_the_place(spark, folder, text, says):
    path = put(f"{folder}/a.json", text)
    with pytest.raises(Exception, match=says):
        readers.read_array(spark, path).collect()


def test_array_fields_of_other_types_are_null(spark, folder):
    path = put(f"{folder}/a.json", '[{"num_lines": "6"}, {"num_lines": 7, "dialogue_id": "b"}, {}]')
    rows = readers.read_array(spark, path).select("num_lines", "dialogue_id").collect()
    assert [tuple(r) for r in rows] == [(None, None), (7, "b"), (None, None)]
    assert readers.read_array(spark, put(f"{folder}/none.json", " [ ] ")).count() == 0


@pytest.mark.parametrize("line", ['{"a":1} x', '{"a":1}{"b":2}', "[1,2]", "5", '"x"', "null", '{"a":', "{'a':1}"])
def test_strict_lines_hold_one_object_each(spark, folder, line):
    with pytest.raises(Exception, match="no JSON"):
        readers.read_strict(spark, put(f"{folder}/a.json", f'{{"dialogue_id":"ok"}}\n{line}\n')).collect()


def test_strict_lines_read_as_python_does(spark, folder):
    path = put(f"{folder}/a.json", '{"dialogue_id":"a","dialogue_id":"b","x":NaN,"y":[1.0,2]}\n\n {"num_lines":3}\n')
    rows = readers.read_strict(spark, path, others="more", record="whole").orderBy("num_lines").collect()
    assert [r.dialogue_id for r in rows] == ["b", None]
    assert rows[0].whole == '{"dialogue_id":"b","x":NaN,"y":[1.0,2]}' and rows[1].more is None


def test_other_fields_survive(spark):
    schema = T.StructType.fromDDL("a long, b string")
    df = spark.createDataFrame([('{"b":"x","z":{"k":[1,null,"é"]},"a":2,"y":1.50}',), ('{"a":1}',), ("{}",)], "line string")
    split = df.select(records.canonical(F.col("line")).alias("whole"), records.other_fields(F.col("line"), schema).alias("more"),
                      F.from_json("line", schema).alias("r"))
    joined = split.select("whole", records.with_fields(records.as_record(F.col("r.a").alias("a"), F.col("r.b").alias("b")),
                                                       F.col("more")).alias("again"))
    rows = joined.collect()
    assert rows[0].whole == rows[0].again == '{"a":2,"b":"x","y":1.5,"z":{"k":[1,null,"é"]}}'
    assert [r.again for r in rows[1:]] == ['{"a":1,"b":null}', '{"a":null,"b":null}']


def test_matrix_files(spark, folder):
    x = np.arange(70, dtype=np.float64).reshape(10, 7) / 3
    np.save(f"{folder}/one.npy", x)
    df = npy.read(spark, f"{folder}/one.npy", range_bytes=7 * 8 * 3)
    assert df.rdd.getNumPartitions() == 4
    rows = sorted(df.collect())
    assert [r.id for r in rows] == list(range(10)) and np.allclose([r.embedding for r in rows], x)
    npy.write(df.repartition(5), f"{folder}/many")
    assert np.allclose([r.embedding for r in sorted(npy.read(spark, f"{folder}/many").collect())], x)
    assert npy.read(spark, f"{folder}/absent").count() == 0
    np.save(f"{folder}/flat.npy", np.arange(4))
    with pytest.raises(Exception, match="no matrix"):
        npy.read(spark, f"{folder}/flat.npy").collect()
    uneven = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        npy.write(uneven, f"{folder}/uneven")
    assert not os.path.exists(f"{folder}/uneven") or os.listdir(f"{folder}/uneven") == []


def test_a_failed_task_leaves_neither_side(spark, folder):
    df = spark.range(100).repartition(4)
    kept, removed, report = (f"{folder}/{n}" for n in ("kept", "removed", "report"))
    line = F.format_string('{"id":%d}', "id")
    with pytest.raises(Exception, match="stop"):
        split_lines.write(df, F.col("id") % 3 == 0, F.when(F.col("id") == 77, F.raise_error(F.lit("stop")).cast("string"))
                          .otherwise(line), kept, removed, report)
    assert not any(n[0] not in "._" for d in (kept, removed) if os.path.exists(d) for n in os.listdir(d))
    keep = F.when(F.col("id") > 5, F.col("id") % 3 == 0)  # null where not: removed
    assert split_lines.write(df, keep, line, kept, removed, report) == (32, 68)
    assert sorted(r.id for r in spark.read.json(kept).collect()) == [i for i in range(6, 100) if i % 3 == 0]
    assert spark.read.json(removed).count() == 68


def test_versions_are_seen_whole(spark, folder):
    path = f"{folder}/table"
    assert versions.read_lines(spark, path).count() == 0
    one = spark.createDataFrame([('{"a":1,"odd":[9,17,"x"]}',)], "record string")
    versions.append_records(path, one)
    before = versions.read_lines(spark, path)
    versions.append_records(path, spark.createDataFrame([('{"a":2}',)], "record string"))
    assert [r.value for r in before.collect()] == ['{"a":1,"odd":[9,17,"x"]}']  # a reader keeps its version
    assert sorted(r.value for r in versions.read_lines(spark, path).collect()) == ['{"a":1,"odd":[9,17,"x"]}', '{"a":2}']
    now = versions.current(spark, path)
    with pytest.raises(Exception, match="stop"):
        versions.append_records(path, one.select(F.raise_error(F.lit("stop")).cast("string").alias("record")))
    assert versions.current(spark, path) == now and versions.read_lines(spark, path).count() == 2


@pytest.mark.parametrize("rows", [0, 1, 500])
def test_metrics_object(spark, folder, rows):
    data = [(i, float(i) / 3 if i < rows * 0.6 else None, None if i % 7 == 3 and i < rows - 1 else i) for i in range(rows)]
    series = spark.createDataFrame(data, "pos long, request_latencies double, tokens_used_per_request long").repartition(6)
    summary = spark.createDataFrame([(4, {"taxi": 2})], "total_dialogues_attempted long, dialogue_service_distribution map<string,long>")
    metrics_object.write(summary, series, f"{folder}/run/metrics.json")
    with open(f"{folder}/run/metrics.json") as f:
        got = json.load(f)
    assert got["total_dialogues_attempted"] == 4 and got["dialogue_service_distribution"] == {"taxi": 2}
    assert got["request_latencies"] == [v for _, v, _ in data if v is not None]
    assert got["tokens_used_per_request"] == [v for *_, v in data]
    assert os.listdir(f"{folder}/run") == ["metrics.json"]
    if rows == 500:
        broken = series.withColumn("request_latencies", F.when(
            F.col("pos") == 123, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("request_latencies")))
        with pytest.raises(Exception, match="stop"):
            metrics_object.write(summary, broken, f"{folder}/other/metrics.json")
        assert not os.path.exists(f"{folder}/other") or os.listdir(f"{folder}/other") == []
