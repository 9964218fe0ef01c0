"""Record schemas."""

from pyspark.sql import types as T

TURN = T.StructType([
    T.StructField("turn_number", T.IntegerType()),
    T.StructField("utterance", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("assistant_response", T.StringType()),
])

# ``time_slot`` is read as text: records carry either [start, end, label] or an object.
DIALOGUE_JSON = T.StructType([
    T.StructField("dialogue_id", T.StringType()),
    T.StructField("services", T.ArrayType(T.StringType())),
    T.StructField("turns", T.ArrayType(TURN)),
    T.StructField("num_lines", T.IntegerType()),
    T.StructField("user_emotions", T.ArrayType(T.StringType())),
    T.StructField("assistant_emotions", T.ArrayType(T.StringType())),
    T.StructField("scenario_category", T.StringType()),
    T.StructField("generated_scenario", T.StringType()),
    T.StructField("time_slot", T.StringType()),
    T.StructField("regions", T.ArrayType(T.StringType())),
    T.StructField("resolution_status", T.StringType()),
])

SEED = T.StructType([
    T.StructField("dialogue_id", T.StringType()),
    T.StructField("services", T.ArrayType(T.StringType())),
    T.StructField("turns", T.StructType([
        T.StructField("turn_id", T.ArrayType(T.StringType())),
        T.StructField("speaker", T.ArrayType(T.IntegerType())),
        T.StructField("utterance", T.ArrayType(T.StringType())),
    ])),
])

PERSONA = T.StructType([
    T.StructField("cluster_label", T.StringType()),
    T.StructField("summary_label", T.StringType()),
    T.StructField("persona", T.StringType()),
])

HASH_STATE = T.StructType([T.StructField("hash", T.StringType())])

VECTOR_STATE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

METRIC_COLUMNS = [
    "retries_per_dialogue", "request_latencies", "tokens_used_per_request", "dialogue_turns",
    "total_dialogues_attempted", "total_dialogues_generated", "total_time_taken",
]

RUN_METRICS_JSON = T.StructType([
    T.StructField("total_dialogues_attempted", T.LongType()),
    T.StructField("total_dialogues_generated", T.LongType()),
    T.StructField("total_successful_dialogues", T.LongType()),
    T.StructField("total_failed_dialogues", T.LongType()),
    T.StructField("total_retries", T.LongType()),
    T.StructField("retries_per_dialogue", T.ArrayType(T.DoubleType())),
    T.StructField("request_latencies", T.ArrayType(T.DoubleType())),
    T.StructField("total_time_taken", T.DoubleType()),
    T.StructField("tokens_used_per_request", T.ArrayType(T.DoubleType())),
    T.StructField("dialogue_service_distribution", T.MapType(T.StringType(), T.LongType())),
    T.StructField("dialogue_turns", T.ArrayType(T.DoubleType())),
])

FLAT_COLUMNS = [
    "dialogue_id", "services", "num_lines", "user_emotions", "assistant_emotions",
    "scenario_category", "generated_scenario", "time_slot_start", "time_slot_end",
    "time_slot_description", "regions", "resolution_status", "user_utterance", "intent",
    "assistant_response", "turn_number",
]

KEY_COLUMNS = [
    "dialogue_id", "scenario_category", "generated_scenario", "resolution_status",
    "user_utterance", "intent", "assistant_response", "turn_number",
]

INT_COLUMNS = ["turn_number", "num_lines", "time_slot_start", "time_slot_end"]
LIST_COLUMNS = ["services", "user_emotions", "assistant_emotions", "regions"]
