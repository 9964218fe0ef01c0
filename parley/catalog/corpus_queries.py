"""Queries over conversations and the derived dialogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley import vocab
from parley.catalog.fixture import dialogues, over_dialogues, sql_list, table
from parley.catalog.registry import query
from parley.functions.draws import draw_hash
from parley.functions.hashing import fingerprint
from parley.operators import filters, shape
from parley.operators.ordering import with_position
from parley.operators.joins import categories_of, flag_members
from parley.plans import corpus_report as report

SPEAKER_SQL = "CASE role WHEN 'user' THEN 'USER' WHEN 'assistant' THEN 'ASSISTANT' ELSE 'UNKNOWN' END"

TURN_COLUMNS = ["dialogue_id", "turn_number", "user_utterance", "intent", "assistant_response"]

SELECTION = {
    "scenarios": [c for s in ("general", "hotel", "taxi", "flight") for c in vocab.CATEGORIES[s]],
    "statuses": ["Resolved", "Escalated"],
    "slots": ["Early Morning", "Afternoon", "Evening", "Overnight"],
    "regions": vocab.REGIONS[:40],
    "services": ["taxi", "hotel", "flight"],
    "user_emotions": vocab.USER_EMOTIONS[:14],
    "assistant_emotions": vocab.ASSISTANT_EMOTIONS[:15],
}

SELECTED_SQL = f"""
  scenario_category IN (SELECT unnest({sql_list(SELECTION['scenarios'])}))
  AND resolution_status IN ('Resolved', 'Escalated')
  AND slot IN ('Early Morning', 'Afternoon', 'Evening', 'Overnight')
  AND list_contains({sql_list(SELECTION['regions'])}, region)
  AND list_has_any(services, ['taxi', 'hotel', 'flight'])
  AND list_contains({sql_list(SELECTION['user_emotions'])}, user_emotion)
  AND list_contains({sql_list(SELECTION['assistant_emotions'])}, assistant_emotion)"""


@query("base_conversation_hash", f"""
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg({SPEAKER_SQL} || ': ' || text, chr(10) ORDER BY turn)) AS hash
  FROM conversations GROUP BY conv_id""")
def base_conversation_hash(spark, sf_dir):
    seeds = shape.seeds_from_rows(table(spark, sf_dir, "conversations"))
    return seeds.select(
        "conv_id", F.size("turns").alias("n_turns"),
        fingerprint(shape.base_conversation(F.col("turns"))).alias("hash"),
    )


@query("seed_turn_zip", f"""
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
  u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i
        FROM conversations WHERE role <> 'system')
  SELECT r.conv_id, r.turn AS turn_id, {SPEAKER_SQL} AS speaker, u.text AS utterance
  FROM r JOIN u USING (conv_id, i)""")
def seed_turn_zip(spark, sf_dir):
    # system rows have no utterance here, so the arrays differ in length
    speaker = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(
        F.collect_list(F.struct("turn", speaker.alias("speaker"), "role", "text"))).alias("seq"))
    seeds = rows.select("conv_id", F.struct(
        F.col("seq.turn").alias("turn_id"), F.col("seq.speaker").alias("speaker"),
        F.transform(F.filter("seq", lambda x: x["role"] != "system"), lambda x: x["text"])
        .alias("utterance"),
    ).alias("turns"))
    return seeds.select("conv_id", F.inline(shape.zip_seed_turns(F.col("turns"))))


@query("turn_pairs", over_dialogues(
    "SELECT dialogue_id, turn_number, utterance, intent, assistant_response FROM turns"))
def turn_pairs(spark, sf_dir):
    return dialogues(spark, sf_dir).select("dialogue_id", F.inline("turns"))


@query("dialogue_flatten", over_dialogues("""
  SELECT t.dialogue_id, t.turn_number, t.utterance AS user_utterance, t.intent,
         t.assistant_response, d.num_lines, d.slot_start AS time_slot_start,
         d.slot_end AS time_slot_end, d.slot AS time_slot_description,
         array_to_string(d.services, '||') AS services_str, d.region AS regions_str,
         d.user_emotion AS user_emotions_str, d.assistant_emotion AS assistant_emotions_str,
         d.scenario_category, d.generated_scenario, d.resolution_status
  FROM turns t JOIN dialogues d USING (conv_id)"""))
def dialogue_flatten(spark, sf_dir):
    # the slot goes through its text form, lists for even and objects for odd conversations
    slot = F.col("time_slot")
    as_text = F.when(
        F.col("conv_id") % 2 == 0,
        F.concat(F.lit("["), slot["start"].cast("string"), F.lit(","), slot["end"].cast("string"),
                 F.lit(',"'), slot["description"], F.lit('"]')),
    ).otherwise(F.to_json(slot))
    flat = shape.flatten_dialogues(dialogues(spark, sf_dir).withColumn("time_slot", as_text))
    return shape.with_joined_lists(flat).drop("conv_id", *[
        "services", "regions", "user_emotions", "assistant_emotions"])


@query("dialogue_validate", over_dialogues("""
  , flat AS (SELECT t.*, d.num_lines, CASE WHEN length(t.utterance) % 7 = 0 THEN NULL
               ELSE t.utterance END AS u2,
             CASE WHEN t.conv_id % 11 = 0 THEN NULL ELSE d.slot END AS slot2
             FROM turns t JOIN dialogues d USING (conv_id))
  SELECT rule, n AS rows FROM (
    SELECT 'null:user_utterance' AS rule, count(*) FILTER (u2 IS NULL) AS n FROM flat
    UNION ALL SELECT 'not_integer:num_lines', count(*) FILTER (conv_id % 13 = 0) FROM flat
    UNION ALL SELECT 'incomplete:time_slot', count(*) FILTER (slot2 IS NULL) FROM flat
    UNION ALL SELECT 'missing:generated_scenario', NULL)
  WHERE n IS NULL OR n > 0"""))
def dialogue_validate(spark, sf_dir):
    # damage is planted by arithmetic so that rules have something to report
    broken = dialogues(spark, sf_dir).drop("generated_scenario").withColumn(
        "num_lines", F.when(F.col("conv_id") % 13 != 0, F.col("num_lines").cast("string"))
        .otherwise("many"))
    flat = shape.flatten_dialogues(broken, strict=False).withColumns({
        "user_utterance": F.when(F.length("user_utterance") % 7 != 0, F.col("user_utterance")),
        "time_slot_description": F.when(F.col("conv_id") % 11 != 0, F.col("time_slot_description")),
    })
    return shape.violations(flat)


@query("filter_dashboard", over_dialogues(f"""
  SELECT t.dialogue_id, t.turn_number, d.scenario_category, d.resolution_status
  FROM turns t JOIN dialogues d USING (conv_id) WHERE {SELECTED_SQL}"""))
def filter_dashboard(spark, sf_dir):
    kept = filters.selected(dialogues(spark, sf_dir), **SELECTION)
    return kept.select("dialogue_id", F.explode("turns.turn_number").alias("turn_number"),
                       "scenario_category", "resolution_status")


@query("filter_num_lines", over_dialogues(
    "SELECT dialogue_id, num_lines FROM dialogues WHERE num_lines > 2"))
def filter_num_lines(spark, sf_dir):
    return filters.longer_than(dialogues(spark, sf_dir), 2).select("dialogue_id", "num_lines")


@query("num_lines_counts", over_dialogues("""
  SELECT count(*) AS total, count(*) FILTER (num_lines > 2) AS included,
         count(*) FILTER (num_lines <= 2) AS excluded FROM dialogues"""))
def num_lines_counts(spark, sf_dir):
    return filters.split_counts(
        dialogues(spark, sf_dir), filters.is_longer_than(F.col("num_lines"), 2))


@query("services_exact_set", over_dialogues("""
  SELECT dialogue_id FROM dialogues
  WHERE list_sort(list_distinct(services)) = ['attraction', 'restaurant']"""))
def services_exact_set(spark, sf_dir):
    return dialogues(spark, sf_dir).where(
        filters.is_exact_set(F.col("services"), ["restaurant", "attraction"])
    ).select("dialogue_id")


@query("filter_service_count", over_dialogues("""
  SELECT dialogue_id, len(services) AS n_services FROM dialogues WHERE len(services) > 1"""))
def filter_service_count(spark, sf_dir):
    return filters.with_service_count(dialogues(spark, sf_dir), more_than=1).select(
        "dialogue_id", F.size("services").alias("n_services"))


@query("service_categories", f"""
  WITH s AS (SELECT DISTINCT source AS service FROM documents
             UNION SELECT unnest({sql_list(vocab.SERVICES)})),
  c AS ({' UNION ALL '.join(
      f"SELECT '{s}' AS service, unnest({sql_list(c)}) AS category"
      for s, c in vocab.CATEGORIES.items())})
  SELECT s.service, c.category FROM s JOIN c ON c.service = s.service OR c.service = 'general'""")
def service_categories(spark, sf_dir):
    # document sources are services nobody knows: they get the general categories only
    known = spark.createDataFrame([(s,) for s in vocab.SERVICES], "service string")
    sources = table(spark, sf_dir, "documents").select(F.col("source").alias("service"))
    return categories_of(sources.union(known).distinct()).select("service", "category")


@query("dataset_metadata", over_dialogues("""
  SELECT count(DISTINCT dialogue_id) AS total_dialogues,
         CAST(sum(num_lines) AS BIGINT) AS total_turns,
         (SELECT count(DISTINCT s) FROM (SELECT unnest(services) AS s FROM dialogues))
           AS unique_services,
         count(DISTINCT scenario_category) AS unique_scenario_categories,
         count(DISTINCT user_emotion) AS unique_user_emotions,
         count(DISTINCT assistant_emotion) AS unique_assistant_emotions,
         count(DISTINCT region) AS unique_regions,
         count(DISTINCT resolution_status) AS resolution_statuses
  FROM dialogues"""))
def dataset_metadata(spark, sf_dir):
    return report.metadata(dialogues(spark, sf_dir))


@query("option_lists", over_dialogues("""
  SELECT 'scenario_category' AS field, scenario_category AS value FROM dialogues
  UNION SELECT 'resolution_status', resolution_status FROM dialogues
  UNION SELECT 'time_slot', slot FROM dialogues
  UNION SELECT 'regions', region FROM dialogues
  UNION SELECT 'services', unnest(services) FROM dialogues
  UNION SELECT 'user_emotions', user_emotion FROM dialogues
  UNION SELECT 'assistant_emotions', assistant_emotion FROM dialogues"""))
def option_lists(spark, sf_dir):
    return report.option_values(dialogues(spark, sf_dir))


@query("single_service", over_dialogues("""
  SELECT services[1] AS service, count(*) AS dialogues FROM dialogues
  WHERE len(services) = 1 GROUP BY 1"""))
def single_service(spark, sf_dir):
    return report.single_service_counts(dialogues(spark, sf_dir))


@query("single_vs_multi", over_dialogues("""
  SELECT count(*) AS total_dialogues, count(*) FILTER (len(services) = 1) AS single_service,
         count(*) FILTER (len(services) > 1) AS multi_service,
         round_even(count(*) FILTER (len(services) = 1) / count(*) * 100, 1) AS single_pct,
         round_even(count(*) FILTER (len(services) > 1) / count(*) * 100, 1) AS multi_pct
  FROM dialogues"""))
def single_vs_multi(spark, sf_dir):
    return report.single_vs_multi(dialogues(spark, sf_dir))


@query("services_per_dialogue", over_dialogues("""
  SELECT len(services) AS n_services, count(*) AS dialogues FROM dialogues GROUP BY 1"""))
def services_per_dialogue(spark, sf_dir):
    return report.dialogues_by_service_count(dialogues(spark, sf_dir))


@query("service_combos", over_dialogues("""
  SELECT len(services) AS n_services, array_to_string(list_sort(services), '+') AS combination,
         count(*) AS dialogues,
         round_even(count(*) / sum(count(*)) OVER (PARTITION BY len(services)) * 100, 1) AS pct
  FROM dialogues WHERE len(services) BETWEEN 2 AND 4 GROUP BY 1, 2"""))
def service_combos(spark, sf_dir):
    return report.combination_counts(dialogues(spark, sf_dir))


@query("emotion_counts", over_dialogues("""
  SELECT 'user' AS side, user_emotion AS emotion, CAST(sum(num_lines) AS BIGINT) AS n
  FROM dialogues GROUP BY 2
  UNION ALL SELECT 'assistant', assistant_emotion, CAST(sum(num_lines) AS BIGINT)
  FROM dialogues GROUP BY 2"""))
def emotion_counts(spark, sf_dir):
    return report.emotion_counts(dialogues(spark, sf_dir))


@query("emotion_pairs", over_dialogues("""
  SELECT user_emotion, assistant_emotion, CAST(sum(num_lines) AS BIGINT) AS n
  FROM dialogues GROUP BY 1, 2"""))
def emotion_pairs(spark, sf_dir):
    return report.emotion_pairs(dialogues(spark, sf_dir))


@query("emotion_matrix", over_dialogues("SELECT user_emotion, " + ", ".join(
    f"CAST(sum(CASE WHEN assistant_emotion = '{a}' THEN num_lines ELSE 0 END) AS BIGINT) AS \"{a}\""
    for a in vocab.ASSISTANT_EMOTIONS) + " FROM dialogues GROUP BY 1"))
def emotion_matrix(spark, sf_dir):
    return report.emotion_matrix(dialogues(spark, sf_dir))


@query("scenario_counts", over_dialogues("""
  SELECT scenario_category, CAST(sum(num_lines) AS BIGINT) AS n FROM dialogues GROUP BY 1"""))
def scenario_counts(spark, sf_dir):
    return report.scenario_counts(dialogues(spark, sf_dir))


@query("resolution_counts", over_dialogues("""
  SELECT resolution_status, CAST(sum(num_lines) AS BIGINT) AS n FROM dialogues GROUP BY 1"""))
def resolution_counts(spark, sf_dir):
    return report.resolution_counts(dialogues(spark, sf_dir))


@query("avg_turns_by_resolution", over_dialogues("""
  SELECT resolution_status, round_even(avg(num_lines), 2) AS avg_turns
  FROM turns JOIN dialogues USING (conv_id) GROUP BY 1"""))
def avg_turns_by_resolution(spark, sf_dir):
    return report.mean_lines_by_resolution(dialogues(spark, sf_dir))


@query("time_slot_counts", over_dialogues("""
  SELECT slot AS time_slot, CAST(sum(num_lines) AS BIGINT) AS n FROM dialogues GROUP BY 1"""))
def time_slot_counts(spark, sf_dir):
    return report.time_slot_counts(dialogues(spark, sf_dir))


@query("region_counts", over_dialogues(
    "SELECT region, count(*) AS dialogues FROM dialogues GROUP BY 1"))
def region_counts(spark, sf_dir):
    return report.region_counts(dialogues(spark, sf_dir))


@query("top_region_category", over_dialogues("""
  , r AS (SELECT region FROM dialogues GROUP BY 1 ORDER BY count(*) DESC, region LIMIT 10),
  c AS (SELECT scenario_category FROM dialogues GROUP BY 1
        ORDER BY sum(num_lines) DESC, scenario_category LIMIT 5)
  SELECT region, scenario_category, count(DISTINCT dialogue_id) AS dialogues FROM dialogues
  WHERE region IN (SELECT region FROM r)
    AND scenario_category IN (SELECT scenario_category FROM c) GROUP BY 1, 2"""))
def top_region_category(spark, sf_dir):
    return report.top_region_by_category(dialogues(spark, sf_dir))


@query("avg_turn_number", over_dialogues("""
  SELECT scenario_category, round_even(avg(turn_number), 1) AS avg_turn_number
  FROM turns JOIN dialogues USING (conv_id) GROUP BY 1"""))
def avg_turn_number(spark, sf_dir):
    return report.mean_turn_number_by_category(dialogues(spark, sf_dir))


@query("top_intents", over_dialogues("""
  SELECT intent, count(*) AS n, (SELECT count(DISTINCT intent) FROM turns) AS distinct_intents
  FROM turns GROUP BY 1 ORDER BY n DESC, intent LIMIT 10"""))
def top_intents(spark, sf_dir):
    return report.top_intents(dialogues(spark, sf_dir))


@query("dialogue_viewer", over_dialogues("""
  , firsts AS (SELECT dialogue_id, row_number() OVER (ORDER BY conv_id) AS n FROM dialogues)
  SELECT t.dialogue_id, turn_number, utterance AS user_utterance, intent, assistant_response
  FROM turns t JOIN firsts USING (dialogue_id) WHERE n = 7"""))
def dialogue_viewer(spark, sf_dir):
    flat = shape.flatten_dialogues(dialogues(spark, sf_dir))
    return filters.nth_dialogue(flat, 7, "conv_id").select(*TURN_COLUMNS)


@query("rebalance_split", over_dialogues("""
  , member AS (SELECT dialogue_id, row_number() OVER
                 (ORDER BY md5(dialogue_id || ':42'), dialogue_id) AS r, count(*) OVER () AS n
               FROM dialogues WHERE list_sort(list_distinct(services)) = ['attraction', 'restaurant'])
  SELECT d.dialogue_id, coalesce(r <= n // 2, false) AS removed
  FROM dialogues d LEFT JOIN member USING (dialogue_id)"""))
def rebalance_split(spark, sf_dir):
    from parley.operators.sampling import thin_class

    corpus = dialogues(spark, sf_dir)
    target = filters.is_exact_set(F.col("services"), ["attraction", "restaurant"])
    removed = thin_class(corpus.where(target), "dialogue_id", seed="42")
    return flag_members(corpus.select("dialogue_id"), removed, "dialogue_id", "removed")


@query("turn_sample", over_dialogues("""
  SELECT dialogue_id, turn_number FROM turns
  ORDER BY md5(dialogue_id || '/' || turn_number || ':42'), dialogue_id, turn_number LIMIT 50"""))
def turn_sample(spark, sf_dir):
    from parley.operators.sampling import capped_sample

    turns = dialogues(spark, sf_dir).select(
        "dialogue_id", F.explode("turns.turn_number").alias("turn_number"))
    key = F.concat_ws("/", "dialogue_id", F.col("turn_number").cast("string"))
    return capped_sample(turns, key, "42", 50, "dialogue_id", "turn_number")


@query("export_types", over_dialogues("""
  SELECT dialogue_id, CAST(num_lines AS INTEGER) AS num_lines,
         CAST(slot_start AS VARCHAR) AS slot_start, CAST(slot_end AS VARCHAR) AS slot_end,
         slot AS slot_label FROM dialogues"""))
def export_types(spark, sf_dir):
    out = shape.for_export(dialogues(spark, sf_dir))
    return out.select("dialogue_id", "num_lines", F.get("time_slot", F.lit(0)).alias("slot_start"),
                      F.get("time_slot", F.lit(1)).alias("slot_end"),
                      F.get("time_slot", F.lit(2)).alias("slot_label"))


@query("batch_numbers", """
  SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) // 20 AS batch
  FROM (SELECT DISTINCT conv_id FROM conversations)""")
def batch_numbers(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return with_position(ids, "conv_id").select(
        "conv_id", F.floor(F.col("pos") / 20).alias("batch"))


@query("first_per_group", """
  SELECT source, lang, doc_id, n_chars FROM documents
  QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1""")
def first_per_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return filters.keep_first(docs, ["source", "lang"], "doc_id")
