"""Lexicon sentiment of short texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import vocab
from parley.functions.text import words

# A small general lexicon; pass a larger one where it matters.
LEXICON = {
    "love": 3.2, "great": 3.1, "excellent": 2.7, "amazing": 2.8, "wonderful": 2.7, "perfect": 2.7,
    "best": 3.2, "happy": 2.7, "glad": 2.0, "good": 1.9, "nice": 1.8, "thanks": 1.9, "thank": 1.5,
    "appreciate": 1.7, "pleased": 1.9, "enjoy": 2.2, "helpful": 1.8, "satisfied": 1.8,
    "fantastic": 2.6, "awesome": 3.1, "delighted": 2.3, "welcome": 2.0, "fine": 0.8, "hope": 1.9,
    "like": 1.5, "comfortable": 1.5, "easy": 1.9, "fun": 2.3, "safe": 1.9, "friendly": 2.2,
    "recommend": 1.5, "beautiful": 2.9, "excited": 1.4, "grateful": 2.0, "win": 2.8, "free": 2.3,
    "worst": -3.1, "terrible": -2.1, "awful": -2.0, "horrible": -2.5, "bad": -2.5, "hate": -2.7,
    "angry": -2.3, "annoyed": -1.6, "disappointed": -2.1, "disappointing": -2.2,
    "frustrated": -2.4, "frustrating": -1.9, "upset": -1.6, "sad": -2.1, "sorry": -0.3,
    "problem": -1.7, "problems": -1.7, "issue": -0.9, "lost": -1.3, "broken": -2.1, "wrong": -2.1,
    "delay": -1.3, "delayed": -0.9, "fail": -2.5, "failed": -2.3, "rude": -2.0, "dirty": -1.9,
    "unacceptable": -2.0, "complaint": -1.2, "worried": -1.2, "confused": -1.3, "poor": -2.1,
    "useless": -1.8, "refuse": -1.2, "cancel": -1.0, "emergency": -1.6, "pain": -2.3, "stress": -1.8,
}

NEGATORS = ["not", "no", "never", "none", "nothing", "neither", "nor", "cannot", "without", "cant",
            "dont", "doesnt", "didnt", "isnt", "wasnt", "wont", "wouldnt", "couldnt", "shouldnt"]

NEGATION = -0.74  # a negator among the three words before turns the valence and weakens it
SPREAD = 15.0
MAX_LEXICON = 100_000


def lexicon_table(spark: SparkSession, lexicon: dict[str, float] | None = None) -> DataFrame:
    entries = LEXICON if lexicon is None else lexicon
    if len(entries) > MAX_LEXICON:
        raise ValueError("a lexicon goes to every task and has to stay small")
    return spark.createDataFrame(list(entries.items()), "word string, valence double")


def score(texts: DataFrame, keys: list[str], column: str, lexicon: dict[str, float] | None = None,
          negators: list[str] | None = None) -> DataFrame:
    """(keys, score): valence sum s scaled to s / sqrt(s * s + 15); ``keys`` identify a text.

    Words carry the three before them, so no order is needed after the explode and sums combine
    before the shuffle.
    """
    negating = vocab.strings(NEGATORS if negators is None else negators)
    tokens = F.col("_tokens")
    with_context = F.transform(tokens, lambda w, i: F.struct(
        w.alias("word"),
        F.slice(tokens, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))).alias("before"),
    ))
    exploded = texts.select(*keys, words(F.col(column)).alias("_tokens")).select(
        *keys, F.explode_outer(with_context).alias("t")).select(*keys, "t.*")
    valued = exploded.join(F.broadcast(lexicon_table(texts.sparkSession, lexicon)), "word", "left")
    signed = F.col("valence") * F.when(F.arrays_overlap("before", negating), NEGATION).otherwise(1.0)
    total = valued.groupBy(*keys).agg(F.coalesce(F.sum(signed), F.lit(0.0)).alias("_s"))
    scaled = F.round(F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + SPREAD), 4)
    return total.select(*keys, (scaled + F.lit(0.0)).alias("score"))  # no negative zero


def category(value: Column) -> Column:
    return F.when(value > 0.1, "Positive").when(value < -0.1, "Negative").otherwise("Neutral")


def category_counts(scored: DataFrame, side: str) -> DataFrame:
    """(side, category, n)."""
    return scored.groupBy(F.col(side), category(F.col("score")).alias("category")).agg(
        F.count("*").alias("n"))


def extremes(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The most positive, most neutral and most negative text, first key on ties."""
    key = F.struct(*keys)

    def best(measure: Column) -> Column:
        return F.min_by(F.struct(*keys, "score"), F.struct(measure.alias("m"), key.alias("k")))

    found = scored.agg(best(-F.col("score")).alias("positive"),
                       best(F.abs("score")).alias("neutral"), best(F.col("score")).alias("negative"))
    return found.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("kind"), F.col(n).alias("x"))
        for n in ("positive", "neutral", "negative")
    ])).alias("e")).select("e.kind", "e.x.*")


def findings(scored: DataFrame, side: str, user: str = "user", assistant: str = "assistant") -> DataFrame:
    """One row: mean scores, the more positive side, the users' usual category, their neutral share."""
    is_user, is_assistant = F.col(side) == user, F.col(side) == assistant
    kind = category(F.col("score"))
    names = ["Positive", "Neutral", "Negative"]
    counts = [F.count_if(is_user & (kind == n)).alias(n) for n in names]
    row = scored.agg(
        F.avg(F.when(is_user, F.col("score"))).alias("avg_user"),
        F.avg(F.when(is_assistant, F.col("score"))).alias("avg_assistant"), *counts)
    usual = F.array_max(F.array(*[
        F.struct(F.col(n).alias("n"), F.lit(-i).alias("first"), F.lit(n).alias("name"))
        for i, n in enumerate(names)]))["name"]
    return row.select(
        "avg_user", "avg_assistant",
        F.when(F.col("avg_user") > F.col("avg_assistant"), user).otherwise(assistant)
        .alias("more_positive"),
        usual.alias("usual_category"),
        (F.try_divide(F.col("Neutral"), F.col("Positive") + F.col("Neutral") + F.col("Negative")) * 100)
        .alias("neutral_pct"))
