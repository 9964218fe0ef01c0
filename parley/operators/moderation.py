"""Moderation results: flagged records and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import words


def category_summary(moderated: DataFrame) -> DataFrame:
    """(category, flagged, mean_score, max_score) over all records' category maps."""
    flat = moderated.select("categories", F.explode("category_scores").alias("category", "score"))
    hit = F.coalesce(F.element_at("categories", F.col("category")), F.lit(False))
    return flat.select("category", "score", hit.alias("hit")).groupBy("category").agg(
        F.count_if("hit").alias("flagged"), F.avg("score").alias("mean_score"),
        F.max("score").alias("max_score"))


def totals(moderated: DataFrame) -> DataFrame:
    return moderated.agg(F.count("*").alias("records"), F.count_if("flagged").alias("flagged"))


def by_lexicon(texts: DataFrame, key: str, column: str, terms: dict[str, list[str]],
               least: float = 0.0) -> DataFrame:
    """Moderation without a model: a category's score is the share of words among its terms.

    ``terms`` is a short caller-supplied list per category; a score above ``least`` flags.
    """
    # a column of its own, so that a text is cut into words once and not for each use
    texts = texts.select(F.col(key).alias("dialogue_id"), words(F.col(column)).alias("_words"))
    tokens = F.col("_words")

    def hits(listed: list[str]):
        return F.size(F.filter(tokens, lambda w: w.isin(listed)))

    share = {name: hits(listed) / F.greatest(F.size(tokens), F.lit(1))
             for name, listed in terms.items()}
    scored = texts.select("dialogue_id", F.create_map(*[
        x for name, value in share.items() for x in (F.lit(name), value)]).alias("category_scores"))
    scored = scored.withColumn(
        "categories", F.transform_values("category_scores", lambda k, v: v > least))
    return scored.withColumn("flagged", F.exists(F.map_values("categories"), lambda v: v))
