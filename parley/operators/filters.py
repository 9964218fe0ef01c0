"""Row predicates and filters over dialogues and turns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import vocab
from parley.functions.text import has_rogue_brackets
from parley.operators.ordering import first_per_key, with_position


def is_exact_set(items: Column, wanted: Iterable[str]) -> Column:
    """The array holds exactly these items, order and repeats ignored."""
    target = vocab.strings(sorted(set(wanted)))
    return F.coalesce(F.array_sort(F.array_distinct(items)) == target, F.lit(False))


def has_rogue_turn(turns: Column) -> Column:
    """Any text of any turn holds a stray bracket."""
    return F.coalesce(F.exists(turns, lambda t: (
        has_rogue_brackets(t["utterance"]) | has_rogue_brackets(t["intent"])
        | has_rogue_brackets(t["assistant_response"])
    )), F.lit(False))


def clean(dialogues: DataFrame) -> DataFrame:
    """Dialogues free of stray brackets."""
    return dialogues.where(~has_rogue_turn(F.col("turns")))


def split_counts(df: DataFrame, keep: Column) -> DataFrame:
    """One row: total, included, excluded."""
    kept = F.coalesce(keep, F.lit(False))
    return df.agg(
        F.count("*").alias("total"), F.count_if(kept).alias("included"),
        F.count_if(~kept).alias("excluded"),
    )


def is_longer_than(num_lines: Column, threshold: int = 5) -> Column:
    """More lines than the threshold; a missing or non-integer count does not qualify."""
    return F.coalesce(num_lines > threshold, F.lit(False))


def longer_than(dialogues: DataFrame, threshold: int = 5) -> DataFrame:
    return dialogues.where(is_longer_than(F.col("num_lines"), threshold))


def selected(
    df: DataFrame, *, scenarios: Iterable[str] = (), statuses: Iterable[str] = (),
    slots: Iterable[str] = (), regions: Iterable[str] = (), services: Iterable[str] = (),
    user_emotions: Iterable[str] = (), assistant_emotions: Iterable[str] = (),
) -> DataFrame:
    """Seven-way corpus filter: membership for the scalars, overlap for the lists, all AND-ed.

    An empty selection does not restrict, whichever kind it is; names are compared whole.
    """
    slot = "time_slot_description" if "time_slot_description" in df.columns else "time_slot.description"
    for column, names in (("scenario_category", scenarios), ("resolution_status", statuses),
                          (slot, slots)):
        names = list(names)
        if names:
            df = df.where(F.col(column).isin(names))
    for column, names in (("regions", regions), ("services", services),
                          ("user_emotions", user_emotions),
                          ("assistant_emotions", assistant_emotions)):
        names = list(names)
        if names:
            df = df.where(F.arrays_overlap(F.col(column), vocab.strings(names)))
    return df


def with_service_count(df: DataFrame, n: int | None = None, more_than: int | None = None) -> DataFrame:
    """Dialogues with exactly ``n`` services, or with more than a number of them."""
    size = F.size("services")
    return df.where(size == n if n is not None else size > more_than)


def above_two_sigma(df: DataFrame, column: str) -> DataFrame:
    """Add ``threshold`` (mean + 2 sample standard deviations) and ``is_outlier``."""
    limit = df.agg((F.avg(column) + 2 * F.stddev_samp(column)).alias("threshold"))
    return df.withColumn("threshold", limit.scalar()).withColumn(
        "is_outlier", F.col(column) > F.col("threshold"))


def flagged_only(moderated: DataFrame) -> DataFrame:
    """Flagged records with the categories whose flag is set."""
    return moderated.where("flagged").select("dialogue_id", F.map_keys(
        F.map_filter("categories", lambda k, v: v)
    ).alias("categories"))


def nth_dialogue(turns: DataFrame, n: int, position: str) -> DataFrame:
    """All turns, in order, of the n-th distinct dialogue (from 1) by first appearance."""
    firsts = turns.groupBy("dialogue_id").agg(F.min(position).alias("_first"))
    ordered = with_position(firsts, "_first", "dialogue_id", name="_n")
    wanted = F.broadcast(ordered.where(F.col("_n") == n - 1).select("dialogue_id"))  # one row
    return turns.join(wanted, "dialogue_id", "left_semi").orderBy("turn_number")


def keep_first(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    return first_per_key(df, keys, position)
