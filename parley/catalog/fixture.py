"""The ``dialogues`` table derived from ``conversations``, in Spark and in SQL.

Every user row becomes a turn answered by the next row if that is the assistant's; the
dialogue's attributes follow from the conversation number by integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import vocab

INTENTS = ["find_place", "make_booking", "ask_price", "change_plan", "report_problem", "say_thanks"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns() -> Column:
    """``seq``: the conversation's (turn, role, text) in order."""
    seq = F.col("seq")
    paired = F.transform(seq, lambda x, i: F.struct(
        x["role"].alias("role"), x["text"].alias("text"), F.get(seq, i + 1).alias("next"),
    ))
    return F.transform(
        F.filter(paired, lambda p: p["role"] == "user"),
        lambda p, i: F.struct(
            (i + 1).cast("int").alias("turn_number"),
            p["text"].alias("utterance"),
            F.get(vocab.strings(INTENTS), F.length(p["text"]) % 6).alias("intent"),
            F.when(p["next"]["role"] == "assistant", p["next"]["text"]).otherwise("N/A")
            .alias("assistant_response"),
        ),
    )


def with_attributes(df: DataFrame, number: str) -> DataFrame:
    """Services, emotions, region, slot, status and scenario from an integer column."""
    n = F.col(number)
    share = (n * 37 + 11) % 100

    def pick(items: Column, index: Column) -> Column:
        return F.get(items, index.cast("int"))

    services = (
        F.when(share < 30, pick(vocab.combinations_of("single"), n % 8))
        .when(share < 70, pick(vocab.combinations_of("double"), n % 17))
        .when(share < 90, pick(vocab.combinations_of("triple"), n % 15))
        .otherwise(pick(vocab.combinations_of("quadruple"), n % 9))
    )
    tenth = (n * 53 + 29) % 10
    df = df.withColumns({
        "services": services,
        "user_emotions": F.array(pick(vocab.strings(vocab.USER_EMOTIONS), (n * 7) % 20)),
        "assistant_emotions": F.array(
            pick(vocab.strings(vocab.ASSISTANT_EMOTIONS), (F.floor(n / 5) * 13) % 20)),
        "regions": F.array(pick(vocab.strings(vocab.REGIONS), (n * 17) % 54)),
        "time_slot": pick(vocab.slot_structs(), (n * 5) % 6),
        "resolution_status": F.when(tenth < 4, "Resolved").when(tenth < 7, "Failed")
        .otherwise("Escalated"),
    })
    options = vocab.categories_for(F.get("services", F.lit(0)))
    df = df.withColumn("scenario_category", pick(options, (n * 11) % F.size(options)))
    return df.withColumn("generated_scenario", F.concat_ws(
        " ", F.lit("A"), "scenario_category", F.lit("request from"), F.get("regions", F.lit(0))))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("seq")
    )
    shaped = grouped.select("conv_id", _turns().alias("turns")).where(F.size("turns") > 0)
    return with_attributes(shaped, "conv_id").withColumns({
        "dialogue_id": F.concat(F.lit("conv_"), F.col("conv_id").cast("string")),
        "num_lines": F.size("turns"),
    })


def sql_list(values: list) -> str:
    def one(v):
        if isinstance(v, list):
            return sql_list(v)
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "[" + ", ".join(one(v) for v in values) + "]"


def _categories_case() -> str:
    general = vocab.CATEGORIES["general"]
    arms = " ".join(
        f"WHEN '{s}' THEN {sql_list(general + vocab.CATEGORIES[s])}" for s in vocab.SERVICES
    )
    return f"CASE services[1] {arms} ELSE {sql_list(general)} END"


TURNS_SQL = f"""
seq AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
turns AS (
  SELECT conv_id, 'conv_' || conv_id AS dialogue_id,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_number,
         text AS utterance,
         {sql_list(INTENTS)}[length(text) % 6 + 1] AS intent,
         CASE WHEN next_role = 'assistant' THEN next_text ELSE 'N/A' END AS assistant_response
  FROM seq WHERE role = 'user'
)"""

DIALOGUES_SQL = f"""{TURNS_SQL},
sized AS (
  SELECT conv_id, dialogue_id, count(*) AS num_lines, (conv_id * 37 + 11) % 100 AS share,
         (conv_id * 53 + 29) % 10 AS tenth
  FROM turns GROUP BY conv_id, dialogue_id
),
attributed AS (
  SELECT conv_id, dialogue_id, num_lines,
         CASE WHEN share < 30 THEN {sql_list(vocab.COMBINATIONS['single'])}[conv_id % 8 + 1]
              WHEN share < 70 THEN {sql_list(vocab.PAIRS)}[conv_id % 17 + 1]
              WHEN share < 90 THEN {sql_list(vocab.TRIPLES)}[conv_id % 15 + 1]
              ELSE {sql_list(vocab.QUADRUPLES)}[conv_id % 9 + 1] END AS services,
         {sql_list(vocab.USER_EMOTIONS)}[(conv_id * 7) % 20 + 1] AS user_emotion,
         {sql_list(vocab.ASSISTANT_EMOTIONS)}[((conv_id // 5) * 13) % 20 + 1] AS assistant_emotion,
         {sql_list(vocab.REGIONS)}[(conv_id * 17) % 54 + 1] AS region,
         {sql_list([a for a, _, _ in vocab.TIME_SLOTS])}[(conv_id * 5) % 6 + 1] AS slot_start,
         {sql_list([b for _, b, _ in vocab.TIME_SLOTS])}[(conv_id * 5) % 6 + 1] AS slot_end,
         {sql_list([d for _, _, d in vocab.TIME_SLOTS])}[(conv_id * 5) % 6 + 1] AS slot,
         CASE WHEN tenth < 4 THEN 'Resolved' WHEN tenth < 7 THEN 'Failed' ELSE 'Escalated' END
           AS resolution_status
  FROM sized
),
optioned AS (SELECT *, {_categories_case()} AS options FROM attributed),
dialogues AS (
  SELECT *, options[(conv_id * 11) % len(options) + 1] AS scenario_category,
         'A ' || options[(conv_id * 11) % len(options) + 1] || ' request from ' || region
           AS generated_scenario
  FROM optioned
)"""


def over_dialogues(select: str) -> str:
    """SQL over the derived ``dialogues`` and ``turns`` tables."""
    return f"WITH {DIALOGUES_SQL} {select}"
