"""Queries over texts: brackets, tags, renderings, prompts, words, sentiment, entities, moderation."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley import vocab
from parley.catalog.fixture import dialogues, over_dialogues, sql_list, table
from parley.catalog.registry import query
from parley.functions import prompts, text
from parley.operators import entities, filters, moderation, sentiment
from parley.operators.shape import base_conversation, seeds_from_rows
from parley.plans import corpus_report as report

TOKENS_SQL = "tokens AS (SELECT page_id, unnest(string_split_regex(html, '\\s+')) AS token FROM pages)"
ROGUE_SQL = "regexp_matches(token, '<([^A-Za-z]|$)|(^|[^A-Za-z])>')"


def page_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.explode(F.split("html", r"\s+")).alias("token"))


@query("filter_rogue_brackets", f"""
  WITH {TOKENS_SQL} SELECT page_id, token, count(*) AS n FROM tokens
  WHERE NOT {ROGUE_SQL} GROUP BY 1, 2""")
def filter_rogue_brackets(spark, sf_dir):
    kept = page_tokens(spark, sf_dir).where(~text.has_rogue_brackets(F.col("token")))
    return kept.groupBy("page_id", "token").agg(F.count("*").alias("n"))


@query("clean_counts", f"""
  WITH {TOKENS_SQL} SELECT count(*) AS total, count(*) FILTER (NOT {ROGUE_SQL}) AS included,
  count(*) FILTER ({ROGUE_SQL}) AS excluded FROM tokens""")
def clean_counts(spark, sf_dir):
    return filters.split_counts(
        page_tokens(spark, sf_dir), ~text.has_rogue_brackets(F.col("token")))


@query("clean_dialogues", over_dialogues("""
  , p AS (SELECT page_id, html AS token FROM pages),
  bad AS (SELECT page_id, regexp_matches(token, '<([^A-Za-z]|$)|(^|[^A-Za-z])>') AS b FROM p),
  j AS (SELECT t.dialogue_id, coalesce(bool_or(bad.b AND t.turn_number = 2), false) AS rogue
        FROM turns t LEFT JOIN bad ON bad.page_id = t.conv_id GROUP BY 1)
  SELECT dialogue_id FROM j WHERE NOT rogue"""))
def clean_dialogues(spark, sf_dir):
    # a page of the same number, where there is one, takes the place of the second answer
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("conv_id"), "html")
    mixed = dialogues(spark, sf_dir).join(pages, "conv_id", "left").withColumn(
        "turns", F.transform("turns", lambda t: t.withField("assistant_response", F.when(
            t["turn_number"] == 2, F.coalesce("html", t["assistant_response"])
        ).otherwise(t["assistant_response"]))))
    return filters.clean(mixed).select("dialogue_id")


@query("tag_parse", over_dialogues(r"""
  SELECT dialogue_id, turn_number, trim(utterance, E' \n\t') AS utterance, intent,
         trim(assistant_response, E' \n\t') AS assistant_response FROM turns"""))
def tag_parse(spark, sf_dir):
    tagged = dialogues(spark, sf_dir).select(
        "dialogue_id", text.render_tags(F.col("turns")).alias("body"))
    valid = tagged.where(text.is_valid_generation(F.col("body")))
    return valid.select("dialogue_id", F.inline(text.parse_turns(F.col("body"))))


# Tagged texts with planted damage, by utterance length: a blank intent, a nested tag, a lost end.
TAGGED_SQL = """
  , damaged AS (SELECT conv_id, turn_number, '<User>' || CASE WHEN length(utterance) % 5 = 1
      THEN '<User>' ELSE '' END || utterance || CASE WHEN length(utterance) % 5 = 2 THEN ''
      ELSE '</User>' END || ' <Intent>' || CASE WHEN length(utterance) % 5 = 3 THEN '' ELSE intent END
      || '</Intent> <Assistant>' || assistant_response || '</Assistant>' AS part FROM turns),
  body AS (SELECT conv_id, string_agg(part, chr(10) ORDER BY turn_number) AS body
           FROM damaged GROUP BY conv_id)"""

# the same markup; SQL takes the flag as an argument of its own
FULL_TURN = text.TURN_PATTERN.removeprefix("(?s)")
FULL_FORMAT = text.FORMAT_PATTERN.removeprefix("(?s)")


def damaged_texts(spark, sf_dir):
    def part(t):
        rest = F.length(t["utterance"]) % 5
        return F.concat(
            F.lit("<User>"), F.when(rest == 1, "<User>").otherwise(""), t["utterance"],
            F.when(rest == 2, "").otherwise("</User>"), F.lit(" <Intent>"),
            F.when(rest == 3, "").otherwise(t["intent"]), F.lit("</Intent> <Assistant>"),
            t["assistant_response"], F.lit("</Assistant>"))

    return dialogues(spark, sf_dir).select(
        "conv_id", F.array_join(F.transform("turns", part), "\n").alias("body"))


@query("tag_validity", over_dialogues(rf"""{TAGGED_SQL}
  SELECT conv_id, len(regexp_extract_all(body, '{FULL_TURN}', 1, 's')) AS n_turns,
         regexp_matches(body, '{FULL_FORMAT}', 's')
           AS has_format,
         contains(array_to_string(regexp_extract_all(body, '<User>(.*?)</User>', 1, 's'), ' '), '<User>')
           AS nested,
         len(regexp_extract_all(body, '{FULL_TURN}', 1, 's')) > 0 AND NOT contains(array_to_string(
           regexp_extract_all(body, '<User>(.*?)</User>', 1, 's'), ' '), '<User>') AS valid
  FROM body"""))
def tag_validity(spark, sf_dir):
    body = F.col("body")
    return damaged_texts(spark, sf_dir).select(
        "conv_id", F.size(text.parse_turns(body)).alias("n_turns"),
        text.has_turn_format(body).alias("has_format"), text.has_nested_tags(body).alias("nested"),
        text.is_valid_generation(body).alias("valid"))


def _filled(field: str) -> str:
    trimmed = rf"trim({field}, E' \n\t\r')"
    return f"CASE WHEN {trimmed} = '' THEN 'N/A' ELSE {trimmed} END AS {field}"


@query("tag_parse_filling", over_dialogues(rf"""{TAGGED_SQL},
  i AS (SELECT conv_id, unnest(regexp_extract_all(body, '{FULL_TURN}', 1, 's')) AS utterance,
        unnest(regexp_extract_all(body, '{FULL_TURN}', 2, 's')) AS intent,
        unnest(regexp_extract_all(body, '{FULL_TURN}', 3, 's')) AS assistant_response,
        generate_subscripts(regexp_extract_all(body, '{FULL_TURN}', 2, 's'), 1) AS turn_number FROM body)
  SELECT conv_id, turn_number, {_filled("utterance")}, {_filled("intent")}, {_filled("assistant_response")}
  FROM i"""))
def tag_parse_filling(spark, sf_dir):
    return damaged_texts(spark, sf_dir).select(
        "conv_id", F.inline(text.parse_turns_filling(F.col("body")))
    ).select("conv_id", "turn_number", "utterance", "intent", "assistant_response")


RENDER_SQL = r"""
  , trimmed AS (SELECT *, trim(utterance, E' \n\t') AS u, trim(assistant_response, E' \n\t') AS a
                FROM turns)
  SELECT d.dialogue_id,
    md5(string_agg('User: ' || utterance || chr(10) || 'Intent: ' || intent || chr(10)
      || 'Assistant: ' || assistant_response, chr(10) ORDER BY turn_number)) AS hash_text,
    md5(string_agg('User: ' || utterance || chr(10) || 'Intent: ' || intent || chr(10)
      || 'Emotion: N/A' || chr(10) || 'Assistant: ' || assistant_response, chr(10)
      ORDER BY turn_number)) AS hash_text_emotion,
    md5(string_agg('User: ' || utterance || chr(10) || 'Intent: ' || intent || chr(10)
      || 'Assistant: ' || assistant_response || chr(10) || chr(10), '' ORDER BY turn_number))
      AS moderation_text,
    md5(string_agg('User: ' || u || ' Assistant: ' || a, ' ' ORDER BY turn_number)) AS pair_text,
    md5(max(generated_scenario) || ' ' || string_agg('Intent: ' || intent || '. User: ' || u
      || '. Assistant: ' || a, ' ' ORDER BY turn_number)) AS embedding_text
  FROM trimmed JOIN dialogues d USING (conv_id) GROUP BY d.dialogue_id"""


@query("render_texts", over_dialogues(RENDER_SQL))
def render_texts(spark, sf_dir):
    turns = F.col("turns")
    return dialogues(spark, sf_dir).select(
        "dialogue_id", F.md5(text.render_hash_text(turns)).alias("hash_text"),
        F.md5(text.render_hash_text(turns, with_emotion=True)).alias("hash_text_emotion"),
        F.md5(text.render_moderation_text(turns)).alias("moderation_text"),
        F.md5(text.render_pair_text(turns)).alias("pair_text"),
        F.md5(text.render_embedding_text(F.col("generated_scenario"), turns)).alias("embedding_text"))


def template_sql(template: str, **slots: str) -> str:
    return " || ".join(
        slots[part] if is_slot else "'" + part.replace("'", "''") + "'"
        for is_slot, part in prompts.pieces(template))


_SCENARIO_SLOTS = {
    "persona": "'persona ' || conv_id", "time": "slot_start || ':00'", "slot": "slot",
    "region": "region", "category": "scenario_category",
    "services": "array_to_string(services, ', ')",
}
_DIALOGUE_SLOTS = {
    "services": "array_to_string(services, ', ')", "scenario": "generated_scenario",
    "region": "region", "user_emotions": "user_emotion", "assistant_emotions": "assistant_emotion",
    "min_turns": "'5'", "max_turns": "'10'", "base_conversation": "base",
    "ending": "CASE WHEN resolution_status = 'Escalated' THEN "
              + template_sql(prompts.ENDING_ESCALATED) + " ELSE "
              + template_sql(prompts.ENDING_OTHER, status="lower(resolution_status)") + " END",
}


@query("prompt_text", over_dialogues(f"""
  , b AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'USER' WHEN 'assistant' THEN
            'ASSISTANT' ELSE 'UNKNOWN' END || ': ' || text, chr(10) ORDER BY turn) AS base
          FROM conversations GROUP BY conv_id)
  SELECT dialogue_id, md5({template_sql(prompts.SCENARIO_SYSTEM, **_SCENARIO_SLOTS)}) AS scenario_system,
         {template_sql(prompts.SCENARIO_USER, **_SCENARIO_SLOTS)} AS scenario_user,
         md5({template_sql(prompts.DIALOGUE_SYSTEM, **_DIALOGUE_SLOTS)}) AS dialogue_system,
         md5({template_sql(prompts.DIALOGUE_USER, **_DIALOGUE_SLOTS)}) AS dialogue_user
  FROM dialogues JOIN b USING (conv_id)"""))
def prompt_text(spark, sf_dir):
    base = seeds_from_rows(table(spark, sf_dir, "conversations")).select(
        "conv_id", base_conversation(F.col("turns")).alias("base"))
    rows = dialogues(spark, sf_dir).join(base, "conv_id")
    scenario = prompts.scenario_prompts(
        F.concat(F.lit("persona "), F.col("conv_id").cast("string")),
        F.concat(F.col("time_slot.start").cast("string"), F.lit(":00")),
        F.col("time_slot.description"), F.get("regions", F.lit(0)), F.col("scenario_category"),
        F.col("services"))
    dialogue = prompts.dialogue_prompts(
        F.col("base"), F.col("services"), F.col("generated_scenario"), F.col("regions"),
        F.col("user_emotions"), F.col("assistant_emotions"), F.col("resolution_status"), 5, 10)
    return rows.select(
        "dialogue_id", F.md5(scenario[0]).alias("scenario_system"), scenario[1].alias("scenario_user"),
        F.md5(dialogue[0]).alias("dialogue_system"), F.md5(dialogue[1]).alias("dialogue_user"))


WORDS_SQL = r"""list_filter(string_split_regex(regexp_replace(lower(text), '[^a-zA-Z\s]', '', 'g'),
  '\s+'), lambda w: w <> '')"""
COUNTED_SQL = f"""w AS (SELECT unnest({WORDS_SQL}) AS word FROM conversations WHERE role = 'assistant'),
  counts AS (SELECT word, count(*) AS n FROM w GROUP BY word)"""


def assistant_words(spark, sf_dir):
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return report.word_counts(answers, "text")


@query("word_frequency", f"WITH {COUNTED_SQL} SELECT word, n FROM counts")
def word_frequency(spark, sf_dir):
    return assistant_words(spark, sf_dir)


@query("word_summary", f"""WITH {COUNTED_SQL}
  SELECT count(*) AS distinct_words, CAST(sum(n) AS BIGINT) AS total_words,
         (SELECT word FROM counts ORDER BY n DESC, word LIMIT 1) AS top_word,
         max(n) AS top_count FROM counts""")
def word_summary(spark, sf_dir):
    return report.word_summary(assistant_words(spark, sf_dir))


@query("top_words", f"""WITH {COUNTED_SQL}
  SELECT word, n FROM counts WHERE NOT list_contains({sql_list(vocab.STOP_WORDS)}, word)
  ORDER BY n DESC, word LIMIT 150""")
def top_words(spark, sf_dir):
    return report.top_words(assistant_words(spark, sf_dir), 150, vocab.stop_word_table(spark))


# The corpus is invented prose, so its own frequent words stand in for a sentiment lexicon.
WORD_VALENCE = {"tion": 2.1, "elle": -1.9, "und": 1.5, "that": -0.8, "for": 2.3, "an": -1.2,
                "at": 0.9, "der": -2.4, "es": 1.1, "st": -0.6, "ed": 1.7, "ha": -2.0}
WORD_NEGATORS = ["the", "le", "of"]

SCORED_SQL = f"""
  tok AS (SELECT conv_id, turn, role, {WORDS_SQL} AS ws FROM conversations),
  pos AS (SELECT conv_id, turn, role, ws, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM tok),
  lex AS (SELECT * FROM (VALUES {', '.join(f"('{w}', {v}::DOUBLE)" for w, v in WORD_VALENCE.items())})
          AS l(word, valence)),
  s AS (SELECT conv_id, turn, sum(valence * CASE WHEN list_has_any(ws[greatest(i - 3, 1):i - 1],
          {sql_list(WORD_NEGATORS)}) THEN -0.74::DOUBLE ELSE 1.0::DOUBLE END) AS s
        FROM pos JOIN lex USING (word) GROUP BY 1, 2),
  scored AS (SELECT c.conv_id, c.turn, c.role, round(coalesce(s, 0) / sqrt(coalesce(s, 0)
               * coalesce(s, 0) + 15), 4) + 0.0::DOUBLE AS score
             FROM conversations c LEFT JOIN s USING (conv_id, turn)),
  kinds AS (SELECT *, CASE WHEN score > 0.1 THEN 'Positive' WHEN score < -0.1 THEN 'Negative'
              ELSE 'Neutral' END AS category FROM scored)"""


def scored(spark, sf_dir):
    return sentiment.score(table(spark, sf_dir, "conversations"), ["conv_id", "turn", "role"],
                           "text", WORD_VALENCE, WORD_NEGATORS)


@query("sentiment_scores", f"WITH {SCORED_SQL} SELECT conv_id, turn, role, score FROM scored")
def sentiment_scores(spark, sf_dir):
    return scored(spark, sf_dir)


@query("sentiment_categories",
       f"WITH {SCORED_SQL} SELECT role, category, count(*) AS n FROM kinds GROUP BY 1, 2")
def sentiment_categories(spark, sf_dir):
    return sentiment.category_counts(scored(spark, sf_dir), "role")


@query("sentiment_extremes", f"""WITH {SCORED_SQL}, u AS (SELECT * FROM scored WHERE role = 'user')
  SELECT * FROM (SELECT 'positive' AS kind, conv_id, turn, score FROM u
                 ORDER BY score DESC, conv_id, turn LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'neutral', conv_id, turn, score FROM u
                           ORDER BY abs(score), conv_id, turn LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'negative', conv_id, turn, score FROM u
                           ORDER BY score, conv_id, turn LIMIT 1)""")
def sentiment_extremes(spark, sf_dir):
    return sentiment.extremes(scored(spark, sf_dir).where("role = 'user'"), ["conv_id", "turn"])


@query("sentiment_findings", f"""WITH {SCORED_SQL},
  a AS (SELECT avg(score) FILTER (role = 'user') AS u, avg(score) FILTER (role = 'assistant') AS a,
          count(*) FILTER (role = 'user' AND category = 'Neutral') * 100.0
            / count(*) FILTER (role = 'user') AS pct FROM kinds)
  SELECT round(u, 6) AS avg_user, round(a, 6) AS avg_assistant,
         CASE WHEN u > a THEN 'user' ELSE 'assistant' END AS more_positive,
         (SELECT category FROM kinds WHERE role = 'user' GROUP BY 1 ORDER BY count(*) DESC,
            list_position(['Positive', 'Neutral', 'Negative'], category) LIMIT 1) AS usual_category,
         round(pct, 6) AS neutral_pct FROM a""")
def sentiment_findings(spark, sf_dir):
    found = sentiment.findings(scored(spark, sf_dir), "role")
    return found.withColumns({
        c: F.round(c, 6) for c in ("avg_user", "avg_assistant", "neutral_pct")})


ENTITY_TEXTS_SQL = """texts AS (
  SELECT 'doc_' || doc_id AS text_id, text FROM documents
  UNION ALL SELECT dialogue_id, generated_scenario FROM dialogues)"""


def entity_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("text_id"), "text")
    return docs.unionByName(dialogues(spark, sf_dir).select(
        F.col("dialogue_id").alias("text_id"), F.col("generated_scenario").alias("text")))


CARDINAL = {"CARDINAL": r"[0-9]+"}
PATTERNS = entities.PATTERNS | CARDINAL


@query("entity_mentions", over_dialogues(f""", {ENTITY_TEXTS_SQL}, hits AS ({' UNION ALL '.join(
    f"SELECT text_id, '{label}' AS label, unnest(regexp_extract_all(text, '{p}')) AS entity FROM texts"
    for label, p in PATTERNS.items())})
  SELECT text_id, label, entity, count(*) AS n FROM hits GROUP BY 1, 2, 3"""))
def entity_mentions(spark, sf_dir):
    hits = entities.extract(entity_texts(spark, sf_dir), ["text_id"], "text", CARDINAL)
    return hits.groupBy("text_id", "label", "entity").agg(F.count("*").alias("n"))


@query("anonymise", over_dialogues(f""", {ENTITY_TEXTS_SQL}
  SELECT text_id, md5(regexp_replace(regexp_replace(regexp_replace(text,
    '{entities.PATTERNS['GPE']}', '[LOCATION]', 'g'), '{entities.PATTERNS['TIME']}', '[TIME]', 'g'),
    '{entities.NUMBER}', '[NUMBER]', 'g')) AS masked FROM texts"""))
def anonymise(spark, sf_dir):
    return entity_texts(spark, sf_dir).select(
        "text_id", F.md5(entities.anonymise(F.col("text"))).alias("masked"))


def moderated(spark, sf_dir):
    """Labels as moderation results; a document's length gives its scores some spread."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id")
    toxic, low = F.col("toxic") == 1, F.col("quality") == 0
    spread = (F.col("n_chars") % 100) / 1000
    return labels.select(
        F.col("doc_id").cast("string").alias("dialogue_id"), (toxic | low).alias("flagged"),
        F.create_map(F.lit("toxic"), toxic, F.lit("low_quality"), low).alias("categories"),
        F.create_map(
            F.lit("toxic"), F.when(toxic, 0.8).otherwise(0.1) + spread,
            F.lit("low_quality"), F.when(low, 0.7).otherwise(0.2) + spread).alias("category_scores"))


MODERATED_SQL = """
  m AS (SELECT doc_id, toxic = 1 AS t, quality = 0 AS q, (n_chars % 100) / 1000 AS x
        FROM labels JOIN documents USING (doc_id)),
  f AS (SELECT doc_id, 'toxic' AS category, t AS hit,
          CASE WHEN t THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END + x AS score FROM m
        UNION ALL SELECT doc_id, 'low_quality', q,
          CASE WHEN q THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END + x FROM m)"""


@query("moderation_summary", f"""WITH {MODERATED_SQL}
  SELECT category, count(*) FILTER (hit) AS flagged, round(avg(score), 6) AS mean_score,
         round(max(score), 6) AS max_score FROM f GROUP BY 1""")
def moderation_summary(spark, sf_dir):
    found = moderation.category_summary(moderated(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_score", "max_score")})


@query("moderation_flagged", f"""WITH {MODERATED_SQL}
  SELECT CAST(doc_id AS VARCHAR) AS dialogue_id, string_agg(category, ',' ORDER BY category)
    AS categories FROM f WHERE hit GROUP BY doc_id""")
def moderation_flagged(spark, sf_dir):
    found = filters.flagged_only(moderated(spark, sf_dir))
    return found.withColumn("categories", F.array_join(F.array_sort("categories"), ","))


@query("label_keys", """
  SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN array_to_string(list_sort([source, lang]), '|')
    WHEN n_chars % 3 = 1 THEN '''' || lang || '''' ELSE '' END AS key FROM documents""")
def label_keys(spark, sf_dir):
    # list literals, plain string literals and text that is neither, by length
    docs = table(spark, sf_dir, "documents")
    rest = F.col("n_chars") % 3
    label = F.when(rest == 0, F.format_string("['%s', '%s']", "source", "lang")).when(
        rest == 1, F.format_string("'%s'", "lang")).otherwise(F.col("source"))
    return docs.select("doc_id", F.array_join(text.label_key(label), "|").alias("key"))
