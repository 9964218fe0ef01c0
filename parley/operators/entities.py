"""Pattern and gazetteer entities, and masking built on them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import vocab



def any_of(names: list[str]) -> str:
    """Pattern for whole names, grouped by first letter so that most words fail on one test."""
    groups: dict[str, list[str]] = {}
    for name in sorted(names, key=len, reverse=True):
        groups.setdefault(name[0], []).append(re.escape(name[1:]).replace(r"\ ", " "))
    return r"\b(?:" + "|".join(
        f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in groups.items()) + r")\b"


PATTERNS = {
    "MONEY": r"\$[0-9][0-9,.]*(?: (?:thousand|million|billion))?",
    "TIME": r"\b[0-9]{1,2}:[0-9]{2}\b|\b[0-9]{1,2} ?(?:AM|PM|am|pm)\b",
    "GPE": any_of(vocab.REGIONS),
}

# Characters a mention can start with: tested first, since a word-boundary test is the slow part.
STARTS = {"MONEY": "$", "TIME": "0-9", "GPE": "".join(sorted({r[0] for r in vocab.REGIONS}))}

NUMBER = r"[0-9]+(?:[.,][0-9]+)*"


def guarded(label: str, pattern: str) -> str:
    return f"(?=[{STARTS[label]}])(?:{pattern})" if label in STARTS else pattern


def extract(texts: DataFrame, keys: list[str], column: str,
            patterns: dict[str, str] | None = None) -> DataFrame:
    """(keys, label, entity): one row per mention; ``patterns`` adds to or replaces the usual ones."""
    found = F.array(*[
        F.struct(F.lit(label).alias("label"),
                 F.regexp_extract_all(F.col(column), F.lit(guarded(label, pattern)), F.lit(0)).alias("hits"))
        for label, pattern in {**PATTERNS, **(patterns or {})}.items()
    ])
    return texts.select(*keys, F.explode(found).alias("f")).select(
        *keys, F.col("f.label").alias("label"), F.explode("f.hits").alias("entity"))


def anonymise(text: Column) -> Column:
    """Replace places, times and numbers by their kind."""
    masked = F.regexp_replace(text, guarded("GPE", PATTERNS["GPE"]), "[LOCATION]")
    masked = F.regexp_replace(masked, guarded("TIME", PATTERNS["TIME"]), "[TIME]")
    return F.regexp_replace(masked, NUMBER, "[NUMBER]")
