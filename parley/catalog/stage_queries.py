"""Queries through files, model stages, streams and whole plans.

Models are stood in for by deterministic functions of the text, so that results can be checked.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.catalog.dedup_queries import STATE_SQL, THRESHOLD, documents_as_turns, greedy_sql
from parley.catalog.fixture import DIALOGUES_SQL, dialogues, over_dialogues, table
from parley.catalog.metric_queries import M, placed
from parley.catalog.registry import query
from parley.catalog.text_queries import WORDS_SQL
from parley.functions import records as record_functions
from parley.functions import text
from parley.functions.hashing import content_hash, fingerprint
from parley.operators import model_stage, moderation
from parley.operators.dedup import flag_exact_duplicates
from parley.operators.ordering import beside
from parley.operators.shape import for_export, with_dialogue_id
from parley.plans import cleanup, generation
from parley.plans import run_metrics as metrics
from parley.schemas import DIALOGUE_JSON
from parley.session import cut, scratch_path
from parley.sources import json_array, metrics_object, npy, readers, versions, writers
from parley.streaming import ingest


def records(spark, sf_dir):
    """Dialogues as the JSON files carry them."""
    return for_export(dialogues(spark, sf_dir)).select(
        "dialogue_id", "services", "turns", "num_lines", "user_emotions", "assistant_emotions",
        "scenario_category", "generated_scenario", "time_slot", "regions", "resolution_status")


#: Every record as its canonical text: names sorted, no blanks between.
RECORD_SQL = """
  SELECT d.dialogue_id, d.num_lines, to_json({
    'assistant_emotions': [assistant_emotion], 'dialogue_id': d.dialogue_id, 'generated_scenario': generated_scenario,
    'num_lines': num_lines, 'regions': [region], 'resolution_status': resolution_status,
    'scenario_category': scenario_category, 'services': services,
    'time_slot': [slot_start::VARCHAR, slot_end::VARCHAR, slot], 'turns': t.turns,
    'user_emotions': [user_emotion]})::VARCHAR AS record
  FROM dialogues d JOIN (
    SELECT conv_id, list({'assistant_response': assistant_response, 'intent': intent, 'turn_number': turn_number,
                          'utterance': utterance} ORDER BY turn_number) AS turns FROM turns GROUP BY conv_id) t
  USING (conv_id)"""


def whole_records(spark, sf_dir):
    """(dialogue_id, num_lines, record) with all fields of a record in its canonical text."""
    rows = records(spark, sf_dir)
    return rows.select("dialogue_id", "num_lines", record_functions.as_record(*rows.columns).alias("record"))


@query("lines_written_and_read", over_dialogues(f"SELECT dialogue_id, record FROM ({RECORD_SQL})"))
def lines_written_and_read(spark, sf_dir):
    path = scratch_path(spark, "lines")
    writers.append_lines(records(spark, sf_dir), path)
    return readers.read_strict(spark, path, record="record").select("dialogue_id", "record")


@query("array_written_and_read", over_dialogues(
    f"SELECT dialogue_id, num_lines > 2 AS long, record FROM ({RECORD_SQL})"))
def array_written_and_read(spark, sf_dir):
    """Arrays cut into chunks that end anywhere, with typed columns beside the whole records."""
    path = scratch_path(spark, "arrays")
    json_array.write(whole_records(spark, sf_dir), path)
    rows = readers.read_array(spark, path, record="record", chunk=20_000)
    return rows.select("dialogue_id", (F.col("num_lines") > 2).alias("long"), "record")


@query("other_fields_kept", over_dialogues(f"SELECT dialogue_id, record FROM ({RECORD_SQL})"))
def other_fields_kept(spark, sf_dir):
    """Records read with three typed fields; the others travel as VARIANT and are written back."""
    path = scratch_path(spark, "lines")
    writers.append_lines(records(spark, sf_dir), path)
    few = T.StructType([f for f in DIALOGUE_JSON.fields if f.name in ("dialogue_id", "num_lines", "resolution_status")])
    rows = readers.read_strict(spark, path, few, others="others")
    return rows.select("dialogue_id", record_functions.with_fields(
        record_functions.as_record(*few.names), F.col("others")).alias("record"))


@query("turns_from_file", over_dialogues("""
  SELECT dialogue_id, turn_number, utterance AS user_utterance, intent, assistant_response,
         array_to_string(services, '||') AS services_str FROM turns JOIN dialogues USING (dialogue_id)"""))
def turns_from_file(spark, sf_dir):
    path = scratch_path(spark, "lines")
    writers.append_lines(records(spark, sf_dir), path)
    return readers.read_turns(spark, path).select(
        "dialogue_id", F.col("turn_number").cast("bigint").alias("turn_number"), "user_utterance", "intent",
        "assistant_response", "services_str")


@query("seeds_from_file", """
  WITH c AS (SELECT conv_id, list({'turn_id': turn::VARCHAR, 'speaker': CASE role WHEN 'user' THEN 0
               WHEN 'assistant' THEN 1 ELSE 2 END, 'utterance': text} ORDER BY turn) AS t
             FROM conversations GROUP BY conv_id)
  SELECT 'seed_' || conv_id AS dialogue_id, x.turn_id AS turn_id, x.speaker AS speaker, x.utterance AS utterance
  FROM (SELECT conv_id, unnest(t) AS x FROM c)""")
def seeds_from_file(spark, sf_dir):
    path = scratch_path(spark, "seeds")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("seq"))
    speaker = F.transform("seq.role", lambda r: F.when(r == "user", 0).when(r == "assistant", 1).otherwise(2))
    rows.select(
        F.concat(F.lit("seed_"), F.col("conv_id").cast("string")).alias("dialogue_id"),
        F.array().cast("array<string>").alias("services"),
        F.struct(F.transform("seq.turn", lambda t: t.cast("string")).alias("turn_id"), speaker.alias("speaker"),
                 F.col("seq.text").alias("utterance")).alias("turns")).write.parquet(path)
    seeds = readers.read_seeds(spark, path)
    return seeds.select("dialogue_id", F.inline(F.arrays_zip("turns.turn_id", "turns.speaker", "turns.utterance")))


@query("personas_from_files", """
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, source AS cluster_label, lang AS summary_label,
         text AS persona FROM documents""")
def personas_from_files(spark, sf_dir):
    path = scratch_path(spark, "personas")
    docs = table(spark, sf_dir, "documents")
    parts = max(5, docs.count() // 50_000)  # so no task reads more when there are more rows
    (docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").select(
        F.col("source").alias("cluster_label"), F.col("lang").alias("summary_label"), F.col("text").alias("persona"))
     .write.parquet(path))
    return readers.read_personas(spark, path)


@query("vector_matrix_files", """
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, embedding FROM embeddings""")
def vector_matrix_files(spark, sf_dir):
    path = scratch_path(spark, "matrix")
    npy.write(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), path)
    return readers.read_vector_matrix(spark, path)


@query("bad_lines_skipped", over_dialogues("""
  SELECT count(*) AS good, (SELECT count(*) FROM benchmark) AS bad FROM dialogues"""))
def bad_lines_skipped(spark, sf_dir):
    # benchmark texts are no JSON objects: each is one bad line
    path = scratch_path(spark, "mixed")
    good = records(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    noise = table(spark, sf_dir, "benchmark").select(F.regexp_replace("text", r"\s+", " ").alias("value"))
    good.unionByName(noise).write.text(path)
    kept, bad = readers.read_tolerant(spark, path)
    counted = kept.select(F.lit(1).alias("good"), F.lit(0).alias("bad")).unionByName(
        bad.select(F.lit(0).alias("good"), F.lit(1).alias("bad")))
    return counted.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


@query("rewritten_corpus", over_dialogues(f"""
  , r AS ({RECORD_SQL}) SELECT record FROM r UNION ALL SELECT record FROM r WHERE num_lines > 2"""))
def rewritten_corpus(spark, sf_dir):
    """Two versions of one table: the corpus, then the corpus and some of it again."""
    path = scratch_path(spark, "corpus")
    corpus = cut(whole_records(spark, sf_dir))
    versions.append_records(path, corpus)
    versions.append_records(path, corpus.where("num_lines > 2"))
    return versions.read_lines(spark, path).withColumnRenamed("value", "record")


@query("split_files", over_dialogues(
    f"SELECT dialogue_id, record, num_lines > 2 AS kept FROM ({RECORD_SQL})"))
def split_files(spark, sf_dir):
    kept, removed = scratch_path(spark, "kept"), scratch_path(spark, "removed")
    writers.write_split(whole_records(spark, sf_dir), F.col("num_lines") > 2, kept, removed, record="record")

    def back(path, flag):
        return readers.read_strict(spark, path, record="record").select("dialogue_id", "record", F.lit(flag).alias("kept"))

    return back(kept, True).unionByName(back(removed, False))


@query("duplicates_split", """
  WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(text)), lang ORDER BY doc_id) > 1 AS copy
             FROM documents)
  SELECT doc_id, copy AS removed, count(*) OVER () AS total, count(*) FILTER (NOT copy) OVER () AS included,
         count(*) FILTER (copy) OVER () AS excluded FROM d""")
def duplicates_split(spark, sf_dir):
    """The split of a deduplication into its two files, with the counts that its commit reports."""
    docs = documents_as_turns(spark, sf_dir)
    flagged = flag_exact_duplicates(docs.select("doc_id", content_hash(F.col("turns")).alias("hash")), "hash", "doc_id")
    kept, removed = scratch_path(spark, "kept"), scratch_path(spark, "removed")
    n = writers.write_split(flagged.select("doc_id", "is_duplicate"), ~F.col("is_duplicate"), kept, removed)
    schema = T.StructType([T.StructField("doc_id", T.LongType())])

    def back(path, flag):
        return readers.read_strict(spark, path, schema).withColumn("removed", F.lit(flag))

    return back(kept, False).unionByName(back(removed, True)).select(
        "doc_id", "removed", F.lit(sum(n)).cast("bigint").alias("total"), F.lit(n[0]).cast("bigint").alias("included"),
        F.lit(n[1]).cast("bigint").alias("excluded"))


@query("record_fingerprints", over_dialogues(f"SELECT dialogue_id, sha256(record) AS hash FROM ({RECORD_SQL})"))
def record_fingerprints(spark, sf_dir):
    return whole_records(spark, sf_dir).select(
        "dialogue_id", record_functions.record_hash(F.col("record")).alias("hash"))


@query("known_state", over_dialogues("""
  SELECT dialogue_id AS known, 'id' AS kind FROM dialogues
  UNION ALL SELECT DISTINCT sha256(text), 'hash' FROM documents"""))
def known_state(spark, sf_dir):
    ids, hashes = scratch_path(spark, "ids"), scratch_path(spark, "hashes")
    writers.append_lines(records(spark, sf_dir), ids)
    writers.append_hashes(table(spark, sf_dir, "documents").select(
        fingerprint(F.col("text")).alias("hash")), hashes)
    return readers.read_known_ids(spark, ids).select(
        F.col("dialogue_id").alias("known"), F.lit("id").alias("kind")).unionByName(
        readers.read_known_hashes(spark, hashes).select(
            F.col("hash").alias("known"), F.lit("hash").alias("kind")))


@query("metrics_files", f"""{M}
  SELECT round(sum(latency), 3) AS latency, round(sum(tokens), 3) AS tokens, count(*) AS n,
         CAST(max(pos) + 1 AS BIGINT) AS attempted FROM m""")
def metrics_files(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    series = cut(placed(spark, sf_dir))
    totals = series.agg(
        F.count("*").alias("total_dialogues_attempted"),
        F.count("*").alias("total_dialogues_generated"),
        F.sum(metrics.LATENCY).alias("total_time_taken"))
    writers.write_metrics_csv(series, totals, path)
    clean = metrics.clean_metrics(readers.read_metrics_csv(spark, path))
    return clean.agg(
        F.round(F.sum(metrics.LATENCY), 3).alias("latency"),
        F.round(F.sum(metrics.TOKENS), 3).alias("tokens"), F.count("*").alias("n"),
        F.max("total_dialogues_attempted").cast("bigint").alias("attempted"))


@query("metrics_object_written_and_read", f"""{M}
  SELECT pos, latency AS request_latencies, tokens AS tokens_used_per_request,
         (SELECT count(*) FROM m) AS attempted FROM m""")
def metrics_object_written_and_read(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    series = cut(placed(spark, sf_dir))
    totals = series.agg(F.count("*").alias("total_dialogues_attempted"))
    metrics_object.write(totals, series.select("pos", metrics.LATENCY, metrics.TOKENS), f"{path}/metrics.json")
    summary, back = readers.read_run_metrics(spark, f"{path}/metrics.json")
    return beside(back, summary.select(F.col("total_dialogues_attempted").alias("attempted"))).select(
        F.col("pos").cast("bigint").alias("pos"), metrics.LATENCY, F.col(metrics.TOKENS).cast("double").alias(metrics.TOKENS), "attempted")


@query("generated_ids", over_dialogues(
    "SELECT dialogue_id || '_generated_' || md5(generated_scenario) AS dialogue_id FROM dialogues"))
def generated_ids(spark, sf_dir):
    seeds = dialogues(spark, sf_dir).withColumnRenamed("dialogue_id", "seed_id")
    return with_dialogue_id(seeds, "seed_id", "generated_scenario").select("dialogue_id")


def letter_shares(texts):
    """A stand-in embedding: how often each ASCII letter occurs."""
    import numpy as np

    return np.array([[t.lower().count(chr(97 + i)) for i in range(26)] for t in texts], "float64")


@query("embed_stage", """
  WITH l AS (SELECT conv_id, turn, lower(text) AS t FROM conversations),
  c AS (SELECT conv_id, turn, unnest(range(26)) AS i, t FROM l),
  n AS (SELECT conv_id, turn, i, length(t) - length(replace(t, chr(CAST(97 + i AS INTEGER)), '')) AS n FROM c)
  SELECT conv_id, turn, round(max(n) / sqrt(sum(n * n)), 6) AS peak,
         round(sum(n) / sqrt(sum(n * n)), 6) AS total
  FROM n GROUP BY 1, 2""")
def embed_stage(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn(
        "key", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    found = model_stage.embed(rows, "key", "text", letter_shares)
    v = F.col("embedding")
    parts = F.split("key", "/")
    return found.select(
        parts[0].cast("bigint").alias("conv_id"), parts[1].cast("bigint").alias("turn"),
        F.round(F.array_max(v), 6).alias("peak"),
        F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("hashed_embedding", f"""
  WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
  b AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 6))::BIGINT % 256 AS bucket, count(*) AS n
        FROM (SELECT doc_id, unnest(ws) AS word FROM w) GROUP BY ALL),
  s AS (SELECT doc_id, count(*) AS used, max(n) / sqrt(sum(n * n)) AS peak, sum(bucket * n) / sqrt(sum(n * n)) AS spread
        FROM b GROUP BY doc_id)
  SELECT doc_id, 256 AS dimension, coalesce(used, 0)::INTEGER AS used, round(coalesce(peak, 0.0), 6) AS peak,
         round(coalesce(spread, 0.0), 4) AS spread FROM documents LEFT JOIN s USING (doc_id)""")
def hashed_embedding(spark, sf_dir):
    found = model_stage.hashed_embedding(table(spark, sf_dir, "documents"), "doc_id", "text")
    v = F.col("embedding")
    weighted = F.transform(v, lambda x, i: x * i)
    return found.select(
        "doc_id", F.size(v).alias("dimension"), F.size(F.filter(v, lambda x: x != 0)).alias("used"),
        F.round(F.array_max(v), 6).alias("peak"),
        F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 4).alias("spread"))


@query("files_only_where_rows", """
  SELECT 'dead letters' AS name, count(*) AS n, true AS written FROM labels WHERE toxic = 1
  UNION ALL SELECT 'nothing', 0, false""")
def files_only_where_rows(spark, sf_dir):
    """Failed inputs go to a dead-letter file; an empty selection leaves no file at all."""
    labels = table(spark, sf_dir, "labels")
    schema = labels.schema
    out = None
    for name, rows in (("dead letters", labels.where("toxic = 1")), ("nothing", labels.where("toxic = 1 and toxic = 0"))):
        path = scratch_path(spark, "letters")
        written = writers.write_dead_letters(rows, path)
        back = readers._or_empty(spark, schema, lambda: spark.read.schema(schema).json(path))
        one = back.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(written).alias("written"))
        out = one if out is None else out.unionByName(one)
    return out


def shares(body: str) -> dict:
    """A stand-in moderation model: shares of two letters; it fails on texts without either."""
    low = body.lower()
    if "z" not in low and "q" not in low:
        raise ValueError("nothing to score")
    return {"z": low.count("z") / len(low), "q": low.count("q") / len(low)}


def share_of_x(body: str) -> dict:
    """A second stand-in, which is asked where the first failed, and fails in its turn on other texts."""
    low = body.lower()
    if "x" not in low:
        raise ValueError("nothing to score")
    return {"x": low.count("x") / len(low)}


SHARES_SQL = """s AS (SELECT doc_id, lower(text) AS t FROM documents),
  r AS (SELECT doc_id, (length(t) - length(replace(t, 'z', ''))) / length(t) AS z,
               (length(t) - length(replace(t, 'q', ''))) / length(t) AS q,
               (length(t) - length(replace(t, 'x', ''))) / length(t) AS x,
               contains(t, 'z') OR contains(t, 'q') AS first, contains(t, 'x') AS second FROM s)"""


@query("moderation_stage", f"""WITH {SHARES_SQL}
  SELECT doc_id, first OR second AS ok,
         CASE WHEN first THEN z >= 0.01 OR q >= 0.01 WHEN second THEN x >= 0.01 END AS flagged FROM r""")
def moderation_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tries = iter((shares, share_of_x))
    done, left = model_stage.with_one_retry(
        docs, "doc_id", lambda rows: model_stage.moderate(rows, "doc_id", "text", next(tries), 0.01))
    return done.select("doc_id", F.lit(True).alias("ok"), "flagged").unionByName(left.select(
        "doc_id", F.lit(False).alias("ok"), F.lit(None).cast("boolean").alias("flagged")))


@query("moderation_lexicon", f"""
  WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
  c AS (SELECT doc_id, len(list_filter(ws, lambda x: x IN ('und', 'der'))) / greatest(len(ws), 1) AS g,
               len(list_filter(ws, lambda x: x IN ('le', 'la'))) / greatest(len(ws), 1) AS f FROM w)
  SELECT CAST(doc_id AS VARCHAR) AS dialogue_id, g > 0.02 OR f > 0.02 AS flagged,
         round(g, 6) AS german, round(f, 6) AS french FROM c""")
def moderation_lexicon(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))
    found = moderation.by_lexicon(
        docs, "id", "text", {"german": ["und", "der"], "french": ["le", "la"]}, 0.02)
    score = F.col("category_scores")
    return found.select("dialogue_id", "flagged", F.round(score["german"], 6).alias("german"),
                        F.round(score["french"], 6).alias("french"))


def write_turns(values: dict, number: int) -> tuple[str, int]:
    """A stand-in generator: errs, answers without tags, or writes as many turns as it is told.

    The first hex digit of the prompt's md5 decides on which attempt it succeeds, if ever.
    """
    digit = int(hashlib.md5(values["user"].encode()).hexdigest()[0], 16)
    needed = 1 if digit < 8 else 2 if digit < 12 else 3 if digit < 14 else 4
    if number < needed:
        if digit % 2:
            raise RuntimeError("service unavailable")
        return "no tags here", 10
    words = values["user"].split()
    start = int(hashlib.md5(values["user"].encode()).hexdigest()[:8], 16)

    def some(i: int) -> str:
        return " ".join(words[(start + 7 * i + j) % len(words)] for j in range(6))

    return "\n".join(
        f"<User>{some(i)}</User> <Intent>intent_{digit}</Intent> <Assistant>{some(i + 50)}</Assistant>"
        for i in range(digit % 4 + 1)), 100


DIGIT_SQL = """p AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS user
                     FROM conversations GROUP BY conv_id),
  g AS (SELECT conv_id, CAST('0x' || substr(md5(user), 1, 1) AS INTEGER) AS digit FROM p),
  o AS (SELECT conv_id, digit, CASE WHEN digit < 8 THEN 1 WHEN digit < 12 THEN 2 WHEN digit < 14 THEN 3
          ELSE 4 END AS needed FROM g)"""


def generation_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("seq"))
    return rows.select("conv_id", F.array_join("seq.text", "\n").alias("user"))


@query("completion_retry", f"""WITH {DIGIT_SQL}
  SELECT conv_id, least(needed, 3) AS attempts, needed <= 3 AS ok,
         CASE WHEN needed <= 3 THEN digit % 4 + 1 ELSE 0 END AS n_turns FROM o""")
def completion_retry(spark, sf_dir):
    tried = model_stage.generate(generation_requests(spark, sf_dir), "conv_id", write_turns)
    done = model_stage.outcomes(tried, "conv_id")
    return done.select("conv_id", "attempts", "ok", F.when(
        F.col("ok"), F.size(text.parse_turns(F.col("text")))).otherwise(0).alias("n_turns"))


@query("attempt_summary", f"""WITH {DIGIT_SQL},
  s AS (SELECT least(needed, 3) AS attempts, needed <= 3 AS ok FROM o)
  SELECT CAST(sum(attempts) AS BIGINT) AS total_dialogues_attempted,
         count(*) FILTER (ok) AS total_successful_dialogues,
         count(*) FILTER (NOT ok) AS total_failed_dialogues,
         round(count(*) FILTER (ok) / sum(attempts) * 100, 6) AS success_pct_per_attempt FROM s""")
def attempt_summary(spark, sf_dir):
    tried = model_stage.generate(generation_requests(spark, sf_dir), "conv_id", write_turns)
    attempts = tried.select(F.col("conv_id").alias("dialogue"), "ok", "latency_s", "tokens",
                            F.size(text.parse_turns(F.col("text"))).alias("turns"))
    return metrics.run_summary(attempts).select(
        "total_dialogues_attempted", "total_successful_dialogues", "total_failed_dialogues",
        F.round("success_pct_per_attempt", 6).alias("success_pct_per_attempt"))


@query("stream_dedup", "SELECT DISTINCT sha256(text) AS hash FROM documents")
def stream_dedup(spark, sf_dir):
    drops, target, marks = (scratch_path(spark, n) for n in ("drops", "unique", "marks"))
    docs = table(spark, sf_dir, "documents").select("doc_id", fingerprint(F.col("text")).alias("hash"))
    writers.append_batches(docs.repartition(4, "doc_id"), drops)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("hash", T.StringType())])
    ingest.run_unique(ingest.read_drops(spark, drops, schema, files=2), "hash", target, marks)
    return spark.read.schema(schema).json(target).select("hash")


@query("stream_append", "SELECT conv_id, turn FROM conversations")
def stream_append(spark, sf_dir):
    drops, target, marks = (scratch_path(spark, n) for n in ("drops", "appended", "marks"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    writers.append_batches(rows.repartition(3, "conv_id"), drops)
    ingest.run_append(ingest.read_drops(spark, drops, rows.schema), target, marks)
    return spark.read.schema(rows.schema).json(target)


@query("stream_unique_vectors", greedy_sql(
    STATE_SQL, "SELECT id AS vec_id FROM numbered JOIN survivors USING (rn)", first="old"))
def stream_unique_vectors(spark, sf_dir):
    # two drops: the vectors of even labels, then those of odd ones
    drops, target, marks = (scratch_path(spark, n) for n in ("drops", "vectors", "marks"))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.sha2(F.col("vec_id").cast("string"), 256).alias("hash"), "embedding", "label")
    schema = rows.drop("label").schema
    for odd in (0, 1):
        writers.append_batches(rows.where(F.col("label") % 2 == odd).drop("label"), drops)
        ingest.run_unique_vectors(
            ingest.read_drops(spark, drops, schema, files=1000), target, marks, key="hash",
            position="vec_id", vector="embedding", threshold=THRESHOLD)
    return ingest.read_accepted(spark, target, schema).select("vec_id")


_STATE_SQL = f"""
    WITH {DIALOGUES_SQL},
    member AS (SELECT dialogue_id, row_number() OVER (ORDER BY md5(dialogue_id || ':42'), dialogue_id)
                 AS r, count(*) OVER () AS n
               FROM dialogues JOIN embeddings ON vec_id = conv_id
               WHERE list_sort(list_distinct(services)) = ['attraction', 'restaurant']),
    rogue AS (SELECT dialogue_id, bool_or(regexp_matches(utterance || ' x ' || assistant_response,
                '<([^A-Za-z]|$)|(^|[^A-Za-z])>')) AS rogue FROM turns GROUP BY 1)
    SELECT d.conv_id AS id, CAST(e.embedding AS DOUBLE[]) AS v, d.dialogue_id, d.num_lines,
           CASE WHEN r <= n // 2 THEN 'thinned' WHEN rogue THEN 'brackets' END AS out
    FROM dialogues d JOIN embeddings e ON e.vec_id = d.conv_id JOIN rogue USING (dialogue_id)
    LEFT JOIN member USING (dialogue_id)"""

CLEANUP_SQL = greedy_sql(
    f"SELECT * FROM ({_STATE_SQL}) WHERE out IS NULL",
    f"""SELECT dialogue_id, CASE WHEN rn NOT IN (SELECT rn FROM survivors) THEN 'semantic'
          WHEN num_lines <= 2 THEN 'short' ELSE 'kept' END AS outcome FROM numbered
        UNION ALL SELECT dialogue_id, out FROM ({_STATE_SQL}) WHERE out IS NOT NULL""")


@query("corpus_cleanup", CLEANUP_SQL)
def corpus_cleanup(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    corpus = dialogues(spark, sf_dir).join(vectors, "conv_id")
    return cleanup.outcomes(corpus, position="conv_id", vector="embedding", threshold=THRESHOLD,
                            min_lines=2)


def write_scenario(values: dict, number: int) -> tuple[str, int]:
    return "It is late. " + values["user"], 20


def embed_bodies(rows):
    return model_stage.embed(rows, "request", "body", letter_shares)


@query("generation_batch")
def generation_batch(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    rows = conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("seq"))
    speaker = F.transform("seq.role", lambda r: F.when(r == "user", 0).when(
        r == "assistant", 1).otherwise(2))
    seeds = rows.select(
        F.concat(F.lit("seed_"), F.col("conv_id").cast("string")).alias("dialogue_id"),
        F.struct(F.transform("seq.turn", lambda t: t.cast("string")).alias("turn_id"),
                 speaker.alias("speaker"), F.col("seq.text").alias("utterance")).alias("turns"))
    personas = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"), F.col("source").alias("cluster_label"),
        F.format_string("['%s']", "lang").alias("summary_label"),
        F.concat(F.lit("A "), "lang", F.lit(" speaker from "), "source").alias("persona"))
    empty = readers.read_known_hashes(spark, scratch_path(spark, "none"))
    requests = generation.plan_requests(
        seeds, personas, seeds.count(), "11", empty, balanced=True)
    new, _ = generation.run_batch(
        requests, write_scenario, write_turns, embed_bodies, empty,
        readers.read_known_vectors(spark, scratch_path(spark, "none")).select(
            "id", F.col("embedding").alias("vec")), threshold=0.999)
    return new.select("dialogue_id", "scenario_category", "num_lines", "resolution_status",
                      F.array_join("services", ",").alias("services"))
