"""Empty inputs and plan shapes."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parley.catalog import fixture
from parley.operators import sentiment
from parley.operators.similarity import nearest_neighbours
from parley.operators.survivors import greedy_survivors
from parley.plans import corpus_report as report
from parley.plans import run_metrics as metrics
from tests import support
from tests.explain_all import plan_of

SF = f"{support.TESTDATA}/sf0.001"


def test_reports_on_nothing(spark):
    none = fixture.dialogues(spark, SF).where("conv_id < 0")
    assert report.metadata(none).first().total_dialogues == 0
    assert report.single_vs_multi(none).first().single_pct is None
    assert report.combination_counts(none).count() == 0
    assert report.top_region_by_category(none).count() == 0


def test_metrics_on_nothing(spark):
    none = spark.createDataFrame([], "pos long, request_latencies double, tokens_used_per_request double, "
                                     "dialogue_turns double, retries_per_dialogue double")
    assert metrics.latency_stability(none).first().latency_cv is None
    assert metrics.insights(none).first().mean_latency is None
    assert metrics.retry_gap_summary(none).first().mean_gap is None
    assert metrics.rolling_latency(none).count() == 0
    assert metrics.histogram(none, metrics.LATENCY).agg(F.sum("n")).first()[0] == 0


def test_vectors_on_nothing(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    assert greedy_survivors(none, 0.9).count() == 0
    assert nearest_neighbours(none, 3).count() == 0


def test_findings_on_nothing(spark):
    none = spark.createDataFrame([], "role string, score double")
    assert sentiment.findings(none, "role").first().neutral_pct is None


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "request_latencies double")
    rows = {r.bin: r.n for r in metrics.histogram(df, metrics.LATENCY).collect()}
    assert rows[1] == 5 and sum(rows.values()) == 5


@pytest.mark.parametrize("name", ["filter_dashboard", "latency_outliers", "line_overlap_anti", "service_categories",
                                  "exact_dedup", "top_intents", "insights", "sentiment_findings"])
def test_no_pairwise_joins(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(entry.queries()["latency_cv"](spark, SF))
    assert re.search(r"ReadSchema: struct<value:double>", plan)
    plan = plan_of(entry.queries()["pending_inputs"](spark, SF))
    assert "text" not in plan
    plan = plan_of(entry.queries()["word_frequency"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(role,assistant\)", plan)


def test_window_longer_than_a_block(spark):
    from pyspark.sql import functions as F

    from parley.operators.ordering import over_recent_rows

    rows = spark.range(20).withColumnRenamed("id", "pos")
    got = over_recent_rows(rows, "pos", 7, lambda w: {
        "n": F.count("*").over(w.rowsBetween(-7, 0))}, block_rows=3)
    assert {r.pos: r.n for r in got.collect()} == {i: min(i + 1, 8) for i in range(20)}


def test_broken_files_fail_and_other_types_do_not(spark, tmp_path):
    import pytest

    from parley.sources.readers import read_array, read_strict

    (tmp_path / "cut.json").write_text('[{"dialogue_id": "a", "num_lines": 3}, {"dialogue_id": "b"')
    with pytest.raises(Exception, match="breaks off"):
        read_array(spark, str(tmp_path / "cut.json")).collect()
    (tmp_path / "lines.json").write_text('{"dialogue_id": "a", "num_lines": "6"}\n\n{"dialogue_id": "b", "num_lines": 6}\n')
    got = read_strict(spark, str(tmp_path / "lines.json")).select("dialogue_id", "num_lines").collect()
    assert [tuple(r) for r in got] == [("a", None), ("b", 6)]
    (tmp_path / "bad.json").write_text('{"dialogue_id": "a"}\n{"dialogue_id"\n')
    with pytest.raises(Exception, match="no JSON"):
        read_strict(spark, str(tmp_path / "bad.json")).collect()


def test_metrics_of_several_files(spark):
    from parley.operators.joins import zip_arrays

    rows = spark.createDataFrame([([1, 2], [3]), ([4], None)], "a array<int>, b array<int>")
    assert sorted(map(tuple, zip_arrays(rows, ["a", "b"]).collect()), key=str) == [
        (0, 1, 3), (0, 4, None), (1, 2, None)]
