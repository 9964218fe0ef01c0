"""Latency, token and retry statistics over the metrics of a generation run.

A metrics table has one row per request, in the columns ``retries_per_dialogue``,
``request_latencies``, ``tokens_used_per_request`` and ``dialogue_turns``; functions about order
also need its 0-based ``pos``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.filters import above_two_sigma
from parley.operators.joins import zip_positions
from parley.operators.ordering import (
    approximate_quantiles, beside, over_recent_rows, quantiles, quantiles_of, with_position,
)

LATENCY, TOKENS = "request_latencies", "tokens_used_per_request"
TURNS, RETRIES = "dialogue_turns", "retries_per_dialogue"


def clean_metrics(raw: DataFrame) -> DataFrame:
    """Every column as a number; rows with a value that is not one are dropped."""
    return raw.select(*[F.col(c).try_cast("double").alias(c) for c in raw.columns]).na.drop("any")


def tokens_per_turn() -> Column:
    """Tokens over turns; no value for a dialogue without turns."""
    return F.try_divide(F.col(TOKENS), F.col(TURNS))


def latency_outliers(metrics: DataFrame) -> DataFrame:
    """Requests slower than mean + 2 standard deviations, and their tokens against the rest."""
    marked = above_two_sigma(metrics, LATENCY)
    high = F.avg(F.when(F.col("is_outlier"), F.col(TOKENS)))
    normal = F.avg(F.when(~F.col("is_outlier"), F.col(TOKENS)))
    return marked.agg(
        F.max("threshold").alias("threshold"),
        F.count_if("is_outlier").alias("high_requests"),
        (F.try_divide(F.count_if("is_outlier"), F.count("*")) * 100).alias("high_pct"),
        high.alias("high_tokens"), normal.alias("normal_tokens"),
        F.try_divide(high, normal).alias("token_ratio"),
    )


def token_efficiency(metrics: DataFrame) -> DataFrame:
    per_turn = metrics.withColumn("per_turn", tokens_per_turn())
    middle = quantiles(per_turn, "per_turn", [0.5]).withColumnRenamed("q0", "median_per_turn")
    return beside(per_turn.agg(
        F.avg("per_turn").alias("mean_per_turn"), F.min("per_turn").alias("min_per_turn"),
        F.max("per_turn").alias("max_per_turn"), F.corr(TURNS, TOKENS).alias("turns_tokens_corr"),
    ), middle)


def correlations(metrics: DataFrame, columns: Sequence[str] = (LATENCY, TOKENS, TURNS)) -> DataFrame:
    """Correlation matrix, one row per variable, from one pass."""
    pairs = metrics.agg(*[
        F.corr(a, b).alias(f"{i}_{j}")
        for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j
    ])

    def cell(i: int, j: int) -> Column:
        return F.lit(1.0) if i == j else F.col(f"{min(i, j)}_{max(i, j)}")

    rows = F.array(*[
        F.struct(F.lit(a).alias("variable"), *[cell(i, j).alias(b) for j, b in enumerate(columns)])
        for i, a in enumerate(columns)
    ])
    return pairs.select(F.inline(rows))


def value_distribution(metrics: DataFrame, column: str) -> DataFrame:
    """(value, n, pct) in value order."""
    counts = metrics.groupBy(F.col(column).cast("bigint").alias("value")).agg(
        F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.col("n") / total * 100).orderBy("value")


def retry_gaps(metrics: DataFrame, block_rows: int = 50_000) -> DataFrame:
    """(pos, gap) of every retried request after the first: requests since the one before."""
    events = with_position(metrics.where(F.col(RETRIES) > 0).select("pos"), "pos", name="_nth")
    gaps = over_recent_rows(
        events, "_nth", 1, lambda w: {"gap": F.col("pos") - F.lag("pos").over(w)}, block_rows)
    return gaps.where("gap is not null").select("pos", "gap")


def retry_gap_summary(metrics: DataFrame, block_rows: int = 50_000) -> DataFrame:
    return retry_gaps(metrics, block_rows).agg(
        F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))


def rolling_latency(metrics: DataFrame, window: int = 50, block_rows: int = 50_000) -> DataFrame:
    """(pos, rolling_mean): mean of the last ``window`` latencies, null until there are enough."""
    def frame(w):
        last = w.rowsBetween(-(window - 1), 0)
        return {"rolling_mean": F.when(
            F.count(LATENCY).over(last) >= window, F.avg(LATENCY).over(last))}

    rolled = over_recent_rows(metrics.select("pos", LATENCY), "pos", window - 1, frame, block_rows)
    return rolled.select("pos", "rolling_mean")


def latency_stability(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.stddev_samp(LATENCY).alias("latency_std"), F.avg(LATENCY).alias("latency_mean"),
        F.try_divide(F.stddev_samp(LATENCY), F.avg(LATENCY)).alias("latency_cv"),
    )


def latency_percentiles(
    metrics: DataFrame, percents: Sequence[int] = (50, 75, 90, 95, 99), exact: bool = True
) -> DataFrame:
    """(percent, latency), interpolated linearly; ``exact=False`` takes one pass."""
    find = quantiles if exact else approximate_quantiles
    found = find(metrics, LATENCY, [p / 100 for p in percents])
    return found.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("percent"), F.col(f"q{i}").alias("latency"))
        for i, p in enumerate(percents)
    ])))


def histogram(metrics: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, low, n): equal-width bins from the minimum to the maximum, empty ones included."""
    value = F.col(column)
    edges = metrics.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    width = F.col("_e.hi") - F.col("_e.lo")
    placed = metrics.select(value, edges.alias("_e")).where(value.isNotNull()).groupBy(
        F.when(width > 0, F.least(
            F.floor((value - F.col("_e.lo")) / width * bins) + 1, F.lit(bins))
        ).otherwise(1).cast("int").alias("bin")
    ).agg(F.count("*").alias("n"), F.first("_e").alias("_e"))
    frame = metrics.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return frame.join(placed.select("bin", "n"), "bin", "left").select(
        "bin", (edges["lo"] + (edges["hi"] - edges["lo"]) * (F.col("bin") - 1) / bins).alias("low"),
        F.coalesce("n", F.lit(0)).alias("n"))


def dialogue_length(metrics: DataFrame) -> DataFrame:
    """Median length and the most common one (the smallest on ties)."""
    counts = metrics.where(F.col(TURNS).isNotNull()).groupBy(TURNS).agg(F.count("*").alias("n"))
    usual = counts.agg(F.min_by(TURNS, F.struct(-F.col("n"), F.col(TURNS))).alias("mode_turns"))
    middle = quantiles(metrics, TURNS, [0.5]).withColumnRenamed("q0", "median_turns")
    return beside(usual, middle)


def throughput(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.try_divide(F.count("*"), F.sum(LATENCY) / 3600).alias("requests_per_hour"),
        F.try_divide(F.sum(TOKENS), F.sum(TURNS)).alias("tokens_per_turn"),
        F.avg(TOKENS).alias("mean_tokens"),
    )


def insights(metrics: DataFrame) -> DataFrame:
    """The insights table as one row of numbers."""
    found = quantiles_of(metrics, {LATENCY: [0.25, 0.75], TOKENS: [0.5]}).toDF(
        "latency_q25", "latency_q75", "median_tokens")
    plain = metrics.agg(
        F.avg(LATENCY).alias("mean_latency"), F.min(LATENCY).alias("min_latency"),
        F.max(LATENCY).alias("max_latency"), F.avg(TOKENS).alias("mean_tokens"),
        F.avg(TURNS).alias("mean_turns"),
        (F.try_divide(F.count_if(F.col(RETRIES) > 0), F.count("*")) * 100).alias("retry_rate_pct"),
        F.min(TOKENS).cast("bigint").alias("min_tokens"),
        F.max(TOKENS).cast("bigint").alias("max_tokens"),
        F.avg(F.when(F.col(TURNS) <= 5, F.col(TOKENS))).alias("short_mean_tokens"),
        F.avg(F.when(F.col(TURNS) > 5, F.col(TOKENS))).alias("long_mean_tokens"),
    )
    return beside(plain, found)


def run_summary(attempts: DataFrame) -> DataFrame:
    """Counters of a run from its attempts.

    ``attempts`` has one row per attempt: ``dialogue`` (request), ``ok``, ``latency_s``,
    ``tokens``, ``turns`` (of a success). Success is reported per attempt and per dialogue.
    """
    per_dialogue = attempts.groupBy("dialogue").agg(
        F.count("*").alias("attempts"), F.max("ok").alias("ok"), F.sum("latency_s").alias("latency"),
        F.sum("tokens").alias("tokens"), F.max(F.when(F.col("ok"), F.col("turns"))).alias("turns"),
    )
    return per_dialogue.agg(
        F.sum("attempts").alias("total_dialogues_attempted"),
        F.count_if("ok").alias("total_dialogues_generated"),
        F.count_if("ok").alias("total_successful_dialogues"),
        F.count_if(~F.col("ok")).alias("total_failed_dialogues"),
        F.sum(F.col("attempts") - F.col("ok").cast("int")).alias("total_retries"),
        F.avg(F.when(F.col("ok"), F.col("attempts") - 1)).alias("mean_retries"),
        F.try_divide(F.sum("latency"), F.sum("attempts")).alias("mean_latency"),
        F.sum("tokens").alias("total_tokens"),
        F.try_divide(F.sum("tokens"), F.sum("attempts")).alias("mean_tokens"),
        F.avg("turns").alias("mean_turns"),
        (F.try_divide(F.count_if("ok"), F.sum("attempts")) * 100).alias("success_pct_per_attempt"),
        (F.try_divide(F.count_if("ok"), F.count("*")) * 100).alias("success_pct_per_dialogue"),
    )


def success_rate(summary: DataFrame) -> DataFrame:
    """Totals and the share of attempts that succeeded, from a run summary."""
    return summary.select(
        "total_dialogues_attempted", "total_retries",
        (F.try_divide(F.col("total_successful_dialogues"), F.col("total_dialogues_attempted")) * 100)
        .alias("success_pct"))


COUNTERS = ["total_dialogues_attempted", "total_dialogues_generated", "total_successful_dialogues",
            "total_failed_dialogues", "total_retries", "total_time_taken"]


def merge_runs(runs: DataFrame) -> DataFrame:
    """One total row out of per-worker or per-batch summaries; absent counters count as 0."""
    return runs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS if c in runs.columns])


def merge_service_counts(runs: DataFrame, column: str = "dialogue_service_distribution") -> DataFrame:
    """(service, n) summed over the runs' maps."""
    return runs.select(F.explode(column).alias("service", "n")).groupBy("service").agg(
        F.sum("n").alias("n"))


def service_distribution(dialogues: DataFrame) -> DataFrame:
    """(service, n) by primary service."""
    return dialogues.where(F.size("services") > 0).groupBy(
        F.get("services", F.lit(0)).alias("service")).agg(F.count("*").alias("n"))


def padded_series(series: dict[str, DataFrame]) -> DataFrame:
    """Ragged (pos, value) series next to each other by position, null where one has ended."""
    return zip_positions(series)
