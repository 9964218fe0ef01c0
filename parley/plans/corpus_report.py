"""Corpus statistics.

Input is the nested ``dialogues`` table, one row per dialogue. Turn-grain figures weigh each
dialogue by its number of turns instead of exploding it, so the turn texts are never read for
them; ``grain="dialogue"`` counts every dialogue once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley import vocab
from parley.functions.text import words
from parley.operators.ordering import beside, first_per_key

SLOT = "time_slot.description"


def _with_turns(dialogues: DataFrame) -> DataFrame:
    """Dialogues that have a turn; the others do not exist in any figure."""
    return dialogues.where(F.size("turns") > 0)


def _weight(grain: str) -> Column:
    return F.size("turns") if grain == "turn" else F.lit(1)


def one_per_dialogue(dialogues: DataFrame, position: str = "dialogue_id") -> DataFrame:
    """Distinct dialogue ids with their services, scenario and regions, first row wins."""
    slim = _with_turns(dialogues).select(
        "dialogue_id", "services", "scenario_category", "regions",
        F.col(position).alias("_order"),
    )
    return first_per_key(slim, ["dialogue_id"], "_order").drop("_order")


def option_values(dialogues: DataFrame) -> DataFrame:
    """(field, value): every distinct choice each filter field offers."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("field"), F.array(F.col(path)).alias("values"))
        for name, path in (("scenario_category", "scenario_category"),
                           ("resolution_status", "resolution_status"), ("time_slot", SLOT))
    ], *[
        F.struct(F.lit(name).alias("field"), F.col(name).alias("values"))
        for name in ("regions", "services", "user_emotions", "assistant_emotions")
    ])
    fields = _with_turns(dialogues).select(F.explode(pairs).alias("p"))
    return fields.select(
        F.col("p.field").alias("field"), F.explode("p.values").alias("value")
    ).distinct()


def metadata(dialogues: DataFrame) -> DataFrame:
    """One row: dialogues, turns and the number of distinct values per field."""
    kinds = option_values(dialogues).groupBy().pivot(
        "field", ["services", "scenario_category", "user_emotions", "assistant_emotions",
                  "regions", "resolution_status"]
    ).agg(F.count("value")).select(
        F.col("services").alias("unique_services"),
        F.col("scenario_category").alias("unique_scenario_categories"),
        F.col("user_emotions").alias("unique_user_emotions"),
        F.col("assistant_emotions").alias("unique_assistant_emotions"),
        F.col("regions").alias("unique_regions"),
        F.col("resolution_status").alias("resolution_statuses"),
    )
    totals = _with_turns(dialogues).agg(
        F.countDistinct("dialogue_id").alias("total_dialogues"),
        F.sum(F.size("turns")).alias("total_turns"),
    )
    return beside(totals, kinds)


def single_service_counts(dialogues: DataFrame) -> DataFrame:
    only = one_per_dialogue(dialogues).where(F.size("services") == 1)
    return only.groupBy(F.get("services", F.lit(0)).alias("service")).agg(
        F.count("*").alias("dialogues")
    )


def single_vs_multi(dialogues: DataFrame) -> DataFrame:
    size = F.size("services")
    counted = one_per_dialogue(dialogues).agg(
        F.count("*").alias("total_dialogues"),
        F.count_if(size == 1).alias("single_service"),
        F.count_if(size > 1).alias("multi_service"),
    )
    share = lambda c: F.bround(F.try_divide(F.col(c), F.col("total_dialogues")) * 100, 1)
    return counted.withColumns({
        "single_pct": share("single_service"), "multi_pct": share("multi_service"),
    })


def dialogues_by_service_count(dialogues: DataFrame) -> DataFrame:
    return one_per_dialogue(dialogues).groupBy(F.size("services").alias("n_services")).agg(
        F.count("*").alias("dialogues")
    ).orderBy("n_services")


def combination_counts(dialogues: DataFrame, sizes: Iterable[int] = (2, 3, 4)) -> DataFrame:
    """Dialogues per service combination and its share inside its size, order ignored."""
    counted = one_per_dialogue(dialogues).where(F.size("services").isin(list(sizes))).groupBy(
        F.size("services").alias("n_services"),
        F.array_join(F.array_sort("services"), "+").alias("combination"),
    ).agg(F.count("*").alias("dialogues"))
    # a window over counts, one row per combination of a size
    same_size = F.sum("dialogues").over(Window.partitionBy("n_services"))
    return counted.withColumn(
        "pct", F.bround(F.col("dialogues") / same_size * 100, 1)
    ).orderBy("n_services", "dialogues", "combination")


def emotion_counts(dialogues: DataFrame, grain: str = "turn") -> DataFrame:
    """(side, emotion, n) for users and assistants."""
    sides = F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(f"{side}_emotions").alias("emotions"))
        for side in ("user", "assistant")
    ])
    return (
        _with_turns(dialogues).select(_weight(grain).alias("w"), F.explode(sides).alias("s"))
        .select("w", F.col("s.side").alias("side"), F.explode("s.emotions").alias("emotion"))
        .groupBy("side", "emotion").agg(F.sum("w").alias("n"))
    )


def emotion_pairs(dialogues: DataFrame, grain: str = "turn") -> DataFrame:
    """(user_emotion, assistant_emotion, n), every pair of a dialogue's two lists."""
    return (
        _with_turns(dialogues)
        .select(_weight(grain).alias("w"), F.explode("user_emotions").alias("user_emotion"),
                "assistant_emotions")
        .select("w", "user_emotion", F.explode("assistant_emotions").alias("assistant_emotion"))
        .groupBy("user_emotion", "assistant_emotion").agg(F.sum("w").alias("n"))
    )


def emotion_matrix(dialogues: DataFrame, grain: str = "turn") -> DataFrame:
    """``emotion_pairs`` as a matrix: one column per assistant emotion, 0 where none."""
    return (
        emotion_pairs(dialogues, grain).groupBy("user_emotion")
        .pivot("assistant_emotion", vocab.ASSISTANT_EMOTIONS).agg(F.sum("n")).na.fill(0)
    )


def value_counts(dialogues: DataFrame, path: str, name: str, grain: str = "turn") -> DataFrame:
    """(name, n) of a scalar field: scenario category, resolution status, time slot."""
    return _with_turns(dialogues).groupBy(F.col(path).alias(name)).agg(
        F.sum(_weight(grain)).alias("n")
    )


def scenario_counts(dialogues: DataFrame, grain: str = "turn") -> DataFrame:
    return value_counts(dialogues, "scenario_category", "scenario_category", grain)


def resolution_counts(dialogues: DataFrame, grain: str = "turn") -> DataFrame:
    return value_counts(dialogues, "resolution_status", "resolution_status", grain)


def time_slot_counts(dialogues: DataFrame, grain: str = "turn") -> DataFrame:
    return value_counts(dialogues, SLOT, "time_slot", grain)


def mean_lines_by_resolution(dialogues: DataFrame, grain: str = "turn") -> DataFrame:
    w = _weight(grain)
    return _with_turns(dialogues).groupBy("resolution_status").agg(
        F.bround(F.sum(F.col("num_lines") * w) / F.sum(w), 2).alias("avg_turns")
    )


def region_counts(dialogues: DataFrame) -> DataFrame:
    """(region, dialogues): each dialogue counts once per region."""
    return one_per_dialogue(dialogues).select(
        F.explode(F.array_distinct("regions")).alias("region")
    ).groupBy("region").agg(F.count("*").alias("dialogues"))


def top(counts: DataFrame, key: str, count: str, k: int) -> DataFrame:
    """The k largest, ties by key."""
    return counts.orderBy(F.desc(count), key).limit(k)


def top_region_by_category(dialogues: DataFrame, regions: int = 10, categories: int = 5) -> DataFrame:
    """Dialogues per (region, category) among the top regions and the top categories."""
    best_regions = top(region_counts(dialogues), "region", "dialogues", regions)
    best_categories = top(scenario_counts(dialogues), "scenario_category", "n", categories)
    return (
        one_per_dialogue(dialogues)
        .join(F.broadcast(best_categories), "scenario_category", "left_semi")
        .select(F.explode(F.array_distinct("regions")).alias("region"), "scenario_category")
        .join(F.broadcast(best_regions), "region", "left_semi")
        .groupBy("region", "scenario_category").agg(F.count("*").alias("dialogues"))
    )


def mean_turn_number_by_category(dialogues: DataFrame) -> DataFrame:
    """Mean turn *number* per scenario category (what the length chart has always shown)."""
    total = F.aggregate("turns.turn_number", F.lit(0).cast("bigint"),
                        lambda a, x: a + F.coalesce(x, F.lit(0)))
    present = F.size(F.filter("turns.turn_number", lambda x: x.isNotNull()))
    return _with_turns(dialogues).groupBy("scenario_category").agg(
        F.bround(F.try_divide(F.sum(total), F.sum(present)), 1).alias("avg_turn_number")
    )


def intent_counts(dialogues: DataFrame) -> DataFrame:
    return dialogues.select(F.explode("turns.intent").alias("intent")).where(
        "intent is not null"
    ).groupBy("intent").agg(F.count("*").alias("n"))


def top_intents(dialogues: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent intents, with the number of distinct intents beside them."""
    counts = intent_counts(dialogues)
    return top(counts, "intent", "n", k).withColumn(
        "distinct_intents", counts.agg(F.count("*")).scalar())


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n) over a text column."""
    return texts.select(F.explode(words(F.col(column))).alias("word")).groupBy("word").agg(
        F.count("*").alias("n")
    )


def word_summary(counts: DataFrame) -> DataFrame:
    """Distinct words, all words, and the most common word with its count (ties by word)."""
    best = F.min_by(F.struct("word", "n"), F.struct(-F.col("n"), F.col("word")))
    return counts.agg(
        F.count("*").alias("distinct_words"), F.sum("n").alias("total_words"), best.alias("_b"),
    ).select("distinct_words", "total_words", F.col("_b.word").alias("top_word"),
             F.col("_b.n").alias("top_count"))


def top_words(counts: DataFrame, k: int = 150, stop_words: DataFrame | None = None) -> DataFrame:
    """The k most frequent words, stop words (a fixed short list) left out."""
    if stop_words is not None:
        counts = counts.join(F.broadcast(stop_words), "word", "left_anti")
    return top(counts, "word", "n", k)
