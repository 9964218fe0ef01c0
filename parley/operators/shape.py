"""From seed turns to flat, validated turn rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.schemas import FLAT_COLUMNS, INT_COLUMNS, KEY_COLUMNS, LIST_COLUMNS


def zip_seed_turns(turns: Column) -> Column:
    """Parallel arrays -> turn structs, cut to the shortest array; speaker 0 / 1 are named."""
    n = F.least(F.size(turns["turn_id"]), F.size(turns["speaker"]), F.size(turns["utterance"]))
    n = F.greatest(F.coalesce(n, F.lit(0)), F.lit(0))
    zipped = F.arrays_zip(
        F.slice(turns["turn_id"], 1, n).alias("turn_id"),
        F.slice(turns["speaker"], 1, n).alias("speaker"),
        F.slice(turns["utterance"], 1, n).alias("utterance"),
    )
    return F.transform(zipped, lambda t: F.struct(
        t["turn_id"].alias("turn_id"),
        F.when(t["speaker"] == 0, "USER").when(t["speaker"] == 1, "ASSISTANT")
        .otherwise("UNKNOWN").alias("speaker"),
        t["utterance"].alias("utterance"),
    ))


def base_conversation(turns: Column) -> Column:
    """``SPEAKER: utterance`` lines of zipped seed turns."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(t["speaker"], F.lit(": "), t["utterance"])), "\n"
    )


def speaker_of(role: Column) -> Column:
    return (
        F.when(role == "user", "USER").when(role == "assistant", "ASSISTANT").otherwise("UNKNOWN")
    )


def seeds_from_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> one seed record per conversation, turns in order.

    A conversation becomes one record because that is what the rest of the library reads; a
    record has to fit in a row, like any dialogue.
    """
    turn = F.struct("turn", speaker_of(F.col("role")).alias("speaker"),
                    F.col("text").alias("utterance"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def split_time_slot(slot: Column) -> list[Column]:
    """Time slot as text, list or object form -> start, end and description columns."""
    is_list = F.ltrim(slot).startswith("[")
    items = F.from_json(slot, "array<string>")
    fields = F.from_json(slot, "struct<start:string,end:string,description:string>")

    def part(name: str, i: int) -> Column:
        return F.when(is_list, F.get(items, F.lit(i))).otherwise(fields[name]).alias(f"time_slot_{name}")

    return [part("start", 0), part("end", 1), part("description", 2)]


def flatten_dialogues(dialogues: DataFrame, strict: bool = True) -> DataFrame:
    """One row per turn with the dialogue's columns; a dialogue without turns has no row.

    ``strict`` casts raise on text that is not a number; otherwise such values become null and
    ``violations`` reports them.
    """
    names = dialogues.columns
    schema = dict(dialogues.dtypes)
    if "time_slot" in names and schema["time_slot"] == "string":
        slot = split_time_slot(F.col("time_slot"))
    elif "time_slot" in names:
        slot = [
            F.col("time_slot.start").alias("time_slot_start"),
            F.col("time_slot.end").alias("time_slot_end"),
            F.col("time_slot.description").alias("time_slot_description"),
        ]
    else:
        slot = []
    carried = [c for c in names if c not in ("turns", "time_slot")]
    flat = dialogues.select(*carried, *slot, F.explode("turns").alias("_t"))
    fields = {"utterance": "user_utterance"}
    flat = flat.select(
        *[c for c in flat.columns if c != "_t"],
        *[
            F.col(f"_t.{f.name}").alias(fields.get(f.name, f.name))
            for f in flat.schema["_t"].dataType
        ],
    )
    for name in LIST_COLUMNS:
        if name in flat.columns:
            empty = F.array().cast("array<string>")
            flat = flat.withColumn(name, F.coalesce(F.col(name), empty))
    for name in INT_COLUMNS:
        if name in flat.columns:
            cast = F.col(name).cast("int") if strict else F.col(name).try_cast("int")
            flat = flat.withColumn(name, cast)
    return flat


def with_joined_lists(flat: DataFrame) -> DataFrame:
    """Add ``<list>_str`` columns: the list's items joined by ``||``."""
    return flat.withColumns({f"{c}_str": F.array_join(c, "||") for c in LIST_COLUMNS})


def missing_columns(flat: DataFrame) -> list[str]:
    return [c for c in FLAT_COLUMNS if c not in flat.columns]


def violations(flat: DataFrame) -> DataFrame:
    """(rule, rows) for every broken rule, in one pass; empty when the table is valid.

    Rules: a required column is absent; an integer column does not cast; a key column is null;
    a list column is null; the slot has no three parts; a turn's text is blank.
    """
    present = set(flat.columns)
    checks: dict[str, Column] = {}
    for c in INT_COLUMNS:
        if c in present:
            checks[f"not_integer:{c}"] = F.col(c).try_cast("int").isNull()
    for c in KEY_COLUMNS:
        if c in present:
            checks[f"null:{c}"] = F.col(c).isNull()
    for c in LIST_COLUMNS:
        if c in present:
            checks[f"not_list:{c}"] = F.col(c).isNull()
    slot = [c for c in FLAT_COLUMNS if c.startswith("time_slot") and c in present]
    if slot:
        gap = F.lit(False)
        for c in slot:
            gap = gap | F.col(c).isNull()
        checks["incomplete:time_slot"] = gap
    for c in ("user_utterance", "intent", "assistant_response"):
        if c in present:
            checks[f"blank:{c}"] = F.coalesce(F.trim(c) == "", F.lit(False))
    rules = list(checks)
    counts = flat.agg(*[F.count_if(checks[r]).alias(f"r{i}") for i, r in enumerate(rules)])
    absent = [F.struct(F.lit(f"missing:{c}").alias("rule"), F.lit(None).cast("bigint").alias("rows"))
              for c in missing_columns(flat)]
    counted = [F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("rows"))
               for i, r in enumerate(rules)]
    return counts.select(F.explode(F.array(*absent, *counted)).alias("v")).select("v.*").where(
        "rows is null or rows > 0"
    )


def require_valid(flat: DataFrame) -> DataFrame:
    """``flat`` itself, or an error naming every broken rule."""
    broken = [r.rule for r in violations(flat).collect()]  # at most one row per rule
    if broken:
        raise ValueError("invalid turn table: " + ", ".join(sorted(broken)))
    return flat


def with_dialogue_id(df: DataFrame, seed_id: str, content: str | None = None) -> DataFrame:
    """``<seed>_generated_<id>``: a random id, or one derived from ``content`` for reruns."""
    unique = F.uuid() if content is None else F.md5(F.col(content))
    return df.withColumn(
        "dialogue_id", F.concat(F.col(seed_id).cast("string"), F.lit("_generated_"), unique)
    )


def for_export(dialogues: DataFrame) -> DataFrame:
    """Types of the published file: slot items as text (null -> ''), counts as integers."""
    kind = dict(dialogues.dtypes)["time_slot"]
    if kind == "string":
        items = F.array(*split_time_slot(F.col("time_slot")))
    elif kind.startswith("array"):
        items = F.col("time_slot")
    else:
        items = F.array(*[
            F.col(f"time_slot.{f}").cast("string") for f in ("start", "end", "description")
        ])
    return dialogues.withColumns({
        "time_slot": F.transform(items, lambda x: F.coalesce(x.cast("string"), F.lit(""))),
        "num_lines": F.col("num_lines").cast("int"),
        "turns": F.transform("turns", lambda t: t.withField(
            "turn_number", t["turn_number"].cast("int"))),
    })
