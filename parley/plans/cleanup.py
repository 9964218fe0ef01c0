"""From generated dialogues to the published corpus: thin, clean, deduplicate, drop short ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.hashing import content_hash
from parley.operators import dedup, filters
from parley.operators.joins import flag_members
from parley.operators.sampling import thin_class
from parley.session import cut


def outcomes(
    dialogues: DataFrame, *, position: str, vector: str, threshold: float = 0.9,
    thin: tuple[str, ...] = ("attraction", "restaurant"), seed: str = "42", min_lines: int = 5,
    **search,
) -> DataFrame:
    """(dialogue_id, outcome): the step that removed each dialogue, or ``kept``.

    Steps in order: ``thinned`` (half of the over-represented service pair), ``brackets``,
    ``exact`` and ``semantic`` duplicates by ``position``, ``short``.
    """
    slim = dialogues.select(
        "dialogue_id", position, vector, "num_lines",
        filters.is_exact_set(F.col("services"), thin).alias("in_class"),
        filters.has_rogue_turn(F.col("turns")).alias("rogue"),
        content_hash(F.col("turns")).alias("hash"))
    slim = cut(slim)
    removed = thin_class(slim.where("in_class"), "dialogue_id", seed)
    state = cut(flag_members(slim, removed, "dialogue_id", "thinned"))
    clean = state.where("not thinned and not rogue")
    stages = dedup.two_stage_duplicates(clean, "hash", position, vector, threshold, **search)
    judged = state.join(stages, position, "left")
    return judged.select("dialogue_id", F.when(F.col("thinned"), "thinned").when(
        F.col("rogue"), "brackets").when(F.col("stage").isNotNull(), F.col("stage")).when(
        ~filters.is_longer_than(F.col("num_lines"), min_lines), "short").otherwise("kept")
        .alias("outcome"))


def published(dialogues: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept dialogues, removed dialogues with their outcome)."""
    joined = dialogues.join(cut(decided), "dialogue_id")
    return (joined.where("outcome = 'kept'").drop("outcome"), joined.where("outcome <> 'kept'"))
