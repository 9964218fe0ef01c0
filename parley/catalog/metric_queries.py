"""Queries over run metrics; the ``events`` table stands for a run's requests.

value = latency, k of props = tokens, k % 10 + 1 = turns, and an error retried k % 3 + 1 times.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.catalog.fixture import dialogues, over_dialogues, table
from parley.catalog.registry import query
from parley.operators.ordering import with_position
from parley.plans import run_metrics as metrics

M = """
  WITH k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
  m AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, event_id, event_type,
          value AS latency, CAST(k AS DOUBLE) AS tokens, CAST(k % 10 + 1 AS DOUBLE) AS turns,
          CAST(CASE WHEN event_type = 'error' THEN k % 3 + 1 ELSE 0 END AS DOUBLE) AS retries
        FROM k)"""


def requests(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "ts", "event_id", "user_id", "event_type",
        F.col("value").alias(metrics.LATENCY), k.cast("double").alias(metrics.TOKENS),
        (k % 10 + 1).cast("double").alias(metrics.TURNS),
        F.when(F.col("event_type") == "error", k % 3 + 1).otherwise(0).cast("double")
        .alias(metrics.RETRIES),
    )


def placed(spark, sf_dir):
    rows = requests(spark, sf_dir).select(
        "ts", "event_id", metrics.LATENCY, metrics.TOKENS, metrics.TURNS, metrics.RETRIES)
    return with_position(rows, "ts", "event_id")


def rounded(df, digits=6):
    return df.select(*[
        F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


@query("clean_metrics", f"""{M}
  SELECT event_id, latency AS request_latencies, tokens AS tokens_used_per_request,
         turns AS dialogue_turns, retries AS retries_per_dialogue
  FROM m WHERE event_type <> 'signup'""")
def clean_metrics(spark, sf_dir):
    # as read from CSV: text everywhere, and signups carry a latency that is no number
    raw = requests(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_type") == "signup", "n/a")
        .otherwise(F.col(metrics.LATENCY).cast("string")).alias(metrics.LATENCY),
        *[F.col(c).cast("string").alias(c)
          for c in (metrics.TOKENS, metrics.TURNS, metrics.RETRIES)])
    return metrics.clean_metrics(raw).withColumn("event_id", F.col("event_id").cast("bigint"))


@query("latency_outliers", f"""{M},
  t AS (SELECT avg(latency) + 2 * stddev_samp(latency) AS threshold FROM m),
  a AS (SELECT max(threshold) AS threshold, count(*) FILTER (latency > threshold) AS high_requests,
          count(*) AS n, avg(tokens) FILTER (latency > threshold) AS high_tokens,
          avg(tokens) FILTER (latency <= threshold) AS normal_tokens FROM m, t)
  SELECT round(threshold, 6) AS threshold, high_requests,
         round(high_requests / n * 100, 6) AS high_pct, round(high_tokens, 6) AS high_tokens,
         round(normal_tokens, 6) AS normal_tokens,
         round(high_tokens / normal_tokens, 6) AS token_ratio FROM a""")
def latency_outliers(spark, sf_dir):
    return rounded(metrics.latency_outliers(requests(spark, sf_dir)))


@query("token_efficiency", f"""{M}
  SELECT round(avg(tokens / turns), 6) AS mean_per_turn, round(min(tokens / turns), 6)
         AS min_per_turn, round(max(tokens / turns), 6) AS max_per_turn,
         round(corr(turns, tokens), 6) AS turns_tokens_corr,
         round(quantile_cont(tokens / turns, 0.5), 6) AS median_per_turn FROM m""")
def token_efficiency(spark, sf_dir):
    return rounded(metrics.token_efficiency(requests(spark, sf_dir)))


@query("correlations", f"""{M},
  c AS (SELECT round(corr(latency, tokens), 6) AS lt, round(corr(latency, turns), 6) AS ln,
               round(corr(tokens, turns), 6) AS tn FROM m)
  SELECT 'request_latencies' AS variable, 1.0 AS request_latencies,
         lt AS tokens_used_per_request, ln AS dialogue_turns FROM c
  UNION ALL SELECT 'tokens_used_per_request', lt, 1.0, tn FROM c
  UNION ALL SELECT 'dialogue_turns', ln, tn, 1.0 FROM c""")
def correlations(spark, sf_dir):
    return rounded(metrics.correlations(requests(spark, sf_dir)))


@query("retry_histogram", f"""{M}
  SELECT CAST(retries AS BIGINT) AS value, count(*) AS n,
         round(count(*) / (SELECT count(*) FROM m) * 100, 6) AS pct FROM m GROUP BY 1""")
def retry_histogram(spark, sf_dir):
    return rounded(metrics.value_distribution(requests(spark, sf_dir), metrics.RETRIES))


@query("turn_distribution", f"""{M}
  SELECT CAST(turns AS BIGINT) AS value, count(*) AS n,
         round(count(*) / (SELECT count(*) FROM m) * 100, 6) AS pct FROM m GROUP BY 1""")
def turn_distribution(spark, sf_dir):
    return rounded(metrics.value_distribution(requests(spark, sf_dir), metrics.TURNS))


@query("retry_gaps", f"""{M},
  g AS (SELECT pos - lag(pos) OVER (ORDER BY pos) AS gap FROM m WHERE retries > 0)
  SELECT round(avg(gap), 6) AS mean_gap, max(gap) AS max_gap FROM g""")
def retry_gaps(spark, sf_dir):
    return rounded(metrics.retry_gap_summary(placed(spark, sf_dir)))


@query("rolling_latency", f"""{M}
  SELECT pos, CASE WHEN count(*) OVER w >= 50 THEN round(avg(latency) OVER w, 6) END AS rolling_mean
  FROM m WINDOW w AS (ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def rolling_latency(spark, sf_dir):
    return rounded(metrics.rolling_latency(placed(spark, sf_dir)))


@query("latency_cv", f"""{M}
  SELECT round(stddev_samp(latency), 6) AS latency_std, round(avg(latency), 6) AS latency_mean,
         round(stddev_samp(latency) / avg(latency), 6) AS latency_cv FROM m""")
def latency_cv(spark, sf_dir):
    return rounded(metrics.latency_stability(requests(spark, sf_dir)))


@query("latency_percentiles", f"""{M}, p AS (SELECT unnest([50, 75, 90, 95, 99]) AS percent)
  SELECT percent, round(CASE percent WHEN 50 THEN quantile_cont(latency, 0.5)
    WHEN 75 THEN quantile_cont(latency, 0.75) WHEN 90 THEN quantile_cont(latency, 0.9)
    WHEN 95 THEN quantile_cont(latency, 0.95) ELSE quantile_cont(latency, 0.99) END, 6) AS latency
  FROM m, p GROUP BY percent""")
def latency_percentiles(spark, sf_dir):
    return rounded(metrics.latency_percentiles(requests(spark, sf_dir)))


def _histogram_sql(column: str) -> str:
    return f"""{M},
  e AS (SELECT min({column}) AS lo, max({column}) AS hi FROM m),
  b AS (SELECT least(floor(({column} - lo) / (hi - lo) * 50) + 1, 50) AS bin, count(*) AS n
        FROM m, e GROUP BY 1)
  SELECT CAST(f.bin AS INTEGER) AS bin, round(lo + (hi - lo) * (f.bin - 1) / 50, 6) AS low,
         coalesce(b.n, 0) AS n
  FROM (SELECT unnest(range(1, 51)) AS bin) f CROSS JOIN e LEFT JOIN b ON b.bin = f.bin"""


@query("latency_histogram", _histogram_sql("latency"))
def latency_histogram(spark, sf_dir):
    return rounded(metrics.histogram(requests(spark, sf_dir), metrics.LATENCY))


@query("token_histogram", _histogram_sql("tokens"))
def token_histogram(spark, sf_dir):
    return rounded(metrics.histogram(requests(spark, sf_dir), metrics.TOKENS))


@query("dialogue_length", f"""{M}
  SELECT (SELECT turns FROM m GROUP BY turns ORDER BY count(*) DESC, turns LIMIT 1) AS mode_turns,
         quantile_cont(turns, 0.5) AS median_turns FROM m""")
def dialogue_length(spark, sf_dir):
    return metrics.dialogue_length(requests(spark, sf_dir))


@query("throughput", f"""{M}
  SELECT round(count(*) / (sum(latency) / 3600), 6) AS requests_per_hour,
         round(sum(tokens) / sum(turns), 6) AS tokens_per_turn, round(avg(tokens), 6) AS mean_tokens
  FROM m""")
def throughput(spark, sf_dir):
    return rounded(metrics.throughput(requests(spark, sf_dir)))


@query("insights", f"""{M}
  SELECT round(avg(latency), 6) AS mean_latency, min(latency) AS min_latency,
         max(latency) AS max_latency, round(quantile_cont(latency, 0.25), 6) AS latency_q25,
         round(quantile_cont(latency, 0.75), 6) AS latency_q75, round(avg(tokens), 6) AS mean_tokens,
         quantile_cont(tokens, 0.5) AS median_tokens, round(avg(turns), 6) AS mean_turns,
         round(count(*) FILTER (retries > 0) / count(*) * 100, 6) AS retry_rate_pct,
         CAST(min(tokens) AS BIGINT) AS min_tokens, CAST(max(tokens) AS BIGINT) AS max_tokens,
         round(avg(tokens) FILTER (turns <= 5), 6) AS short_mean_tokens,
         round(avg(tokens) FILTER (turns > 5), 6) AS long_mean_tokens FROM m""")
def insights(spark, sf_dir):
    return rounded(metrics.insights(requests(spark, sf_dir)))


ATTEMPTS_SQL = """
  a AS (SELECT user_id AS dialogue, event_type = 'purchase' AS ok, value AS latency_s, k AS tokens,
               k % 10 + 1 AS turns FROM k),
  d AS (SELECT dialogue, count(*) AS attempts, bool_or(ok) AS ok, sum(latency_s) AS latency,
               sum(tokens) AS tokens, max(turns) FILTER (ok) AS turns FROM a GROUP BY dialogue)"""


@query("run_summary", f"""{M}, {ATTEMPTS_SQL}
  SELECT CAST(sum(attempts) AS BIGINT) AS total_dialogues_attempted,
         count(*) FILTER (ok) AS total_dialogues_generated,
         count(*) FILTER (ok) AS total_successful_dialogues,
         count(*) FILTER (NOT ok) AS total_failed_dialogues,
         CAST(sum(attempts) - count(*) FILTER (ok) AS BIGINT) AS total_retries,
         round(avg(attempts - 1) FILTER (ok), 6) AS mean_retries,
         round(sum(latency) / sum(attempts), 6) AS mean_latency,
         CAST(sum(tokens) AS BIGINT) AS total_tokens,
         round(sum(tokens) / sum(attempts), 6) AS mean_tokens, round(avg(turns), 6) AS mean_turns,
         round(count(*) FILTER (ok) / sum(attempts) * 100, 6) AS success_pct_per_attempt,
         round(count(*) FILTER (ok) / count(*) * 100, 6) AS success_pct_per_dialogue FROM d""")
def run_summary(spark, sf_dir):
    # each user is a request; every event an attempt that a purchase ends well
    rows = requests(spark, sf_dir)
    attempts = rows.select(
        F.col("user_id").alias("dialogue"), (F.col("event_type") == "purchase").alias("ok"),
        F.col(metrics.LATENCY).alias("latency_s"),
        F.col(metrics.TOKENS).cast("bigint").alias("tokens"),
        F.col(metrics.TURNS).cast("int").alias("turns"))
    return rounded(metrics.run_summary(attempts))


WORKERS_SQL = """
  w AS (SELECT user_id, count(*) AS total_dialogues_attempted,
          count(*) FILTER (event_type = 'purchase') AS total_successful_dialogues,
          count(*) FILTER (event_type = 'error') AS total_retries FROM events GROUP BY user_id)"""


def _workers(spark, sf_dir):
    """A run's summary per user, with a map of all its event types."""
    kind, n = F.col("event_type"), F.col("n")
    per_type = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return per_type.groupBy("user_id").agg(
        F.sum("n").alias("total_dialogues_attempted"),
        F.sum(F.when(kind == "purchase", n).otherwise(0)).alias("total_successful_dialogues"),
        F.sum(F.when(kind == "error", n).otherwise(0)).alias("total_retries"),
        F.map_from_entries(F.collect_list(F.struct(kind, n))).alias("dialogue_service_distribution"))


@query("merge_runs", f"""{M}, {WORKERS_SQL}
  SELECT CAST(sum(total_dialogues_attempted) AS BIGINT) AS total_dialogues_attempted,
         CAST(sum(total_successful_dialogues) AS BIGINT) AS total_successful_dialogues,
         CAST(sum(total_retries) AS BIGINT) AS total_retries FROM w""")
def merge_runs(spark, sf_dir):
    return metrics.merge_runs(_workers(spark, sf_dir))


@query("merge_service_counts", """
  SELECT event_type AS service, count(*) AS n FROM events GROUP BY 1""")
def merge_service_counts(spark, sf_dir):
    return metrics.merge_service_counts(_workers(spark, sf_dir))


@query("success_rate", f"""{M}, {WORKERS_SQL}
  SELECT CAST(sum(total_dialogues_attempted) AS BIGINT) AS total_dialogues_attempted,
         CAST(sum(total_retries) AS BIGINT) AS total_retries,
         round(sum(total_successful_dialogues) / sum(total_dialogues_attempted) * 100, 6)
           AS success_pct FROM w""")
def success_rate(spark, sf_dir):
    return rounded(metrics.success_rate(metrics.merge_runs(_workers(spark, sf_dir))))


@query("service_distribution", over_dialogues(
    "SELECT services[1] AS service, count(*) AS n FROM dialogues GROUP BY 1"))
def service_distribution(spark, sf_dir):
    return metrics.service_distribution(dialogues(spark, sf_dir))


@query("ragged_zip", f"""{M},
  a AS (SELECT pos, latency FROM m),
  b AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, tokens FROM m WHERE event_type <> 'error'),
  c AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, turns FROM m WHERE event_type = 'purchase')
  SELECT pos, latency AS request_latencies, tokens AS tokens_used_per_request,
         turns AS dialogue_turns
  FROM a FULL JOIN b USING (pos) FULL JOIN c USING (pos)""")
def ragged_zip(spark, sf_dir):
    rows = requests(spark, sf_dir)
    order = ["ts", "event_id"]
    series = {
        metrics.LATENCY: rows,
        metrics.TOKENS: rows.where("event_type <> 'error'"),
        metrics.TURNS: rows.where("event_type = 'purchase'"),
    }
    return metrics.padded_series({
        name: with_position(part.select(*order, name), *order) for name, part in series.items()})
