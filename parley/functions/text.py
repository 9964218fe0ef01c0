"""Text expressions: trimming, tag parsing, rendering, brackets, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markup a generated dialogue is written in.
TURN_PATTERN = (
    r"(?s)<User>(.*?)</User>\s*<Intent>(.*?)</Intent>\s*<Assistant>(.*?)</Assistant>"
)
FORMAT_PATTERN = r"(?s)<User>.*?</User>.*?<Intent>.*?</Intent>.*?<Assistant>.*?</Assistant>"
TAG_NAMES = ["User", "Intent", "Assistant"]
# End of fixed values.

MISSING = "N/A"

WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def _captures(text: Column, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(TURN_PATTERN), F.lit(group))


def parse_turns(text: Column) -> Column:
    """Tagged text -> array of turn structs numbered from 1."""
    zipped = F.arrays_zip(
        _captures(text, 1).alias("u"), _captures(text, 2).alias("i"), _captures(text, 3).alias("a")
    )
    return F.transform(
        zipped,
        lambda t, n: F.struct(
            (n + 1).cast("int").alias("turn_number"),
            strip(t["u"]).alias("utterance"),
            strip(t["i"]).alias("intent"),
            strip(t["a"]).alias("assistant_response"),
        ),
    )


def parse_turns_filling(text: Column) -> Column:
    """As ``parse_turns`` with every blank part replaced by ``N/A``."""
    return F.transform(parse_turns(text), lambda t: F.struct(
        t["turn_number"].alias("turn_number"),
        *[_or_missing(t[f]).alias(f) for f in ("utterance", "intent", "assistant_response")],
    ))


def _or_missing(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(MISSING))


def has_nested_tags(text: Column, literal: bool = False) -> Column:
    """True when what one tag encloses holds its own opening tag again.

    ``literal=True`` asks instead for a capture that *is* the bare opening tag, the narrower
    reading found in older corpora.
    """
    found = F.lit(False)
    for name in TAG_NAMES:
        tag = f"<{name}>"
        inner = F.regexp_extract_all(text, F.lit(f"(?s)<{name}>(.*?)</{name}>"), F.lit(1))
        hit = F.array_contains(inner, tag) if literal else F.array_join(inner, "\n").contains(tag)
        found = found | hit
    return F.coalesce(found, F.lit(False))


def has_turn_format(text: Column) -> Column:
    """At least one full tagged turn is present."""
    return text.rlike(FORMAT_PATTERN)


def is_valid_generation(text: Column) -> Column:
    """Parses to at least one turn and holds no nested tag."""
    return F.coalesce(~has_nested_tags(text) & (F.size(parse_turns(text)) > 0), F.lit(False))


def render_hash_text(turns: Column, with_emotion: bool = False) -> Column:
    """Text whose fingerprint identifies a generated dialogue."""
    emotion = [F.lit("\nEmotion: N/A")] if with_emotion else []
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit("User: "), t["utterance"], F.lit("\nIntent: "), t["intent"], *emotion,
        F.lit("\nAssistant: "), t["assistant_response"],
    )), "\n")


def render_moderation_text(turns: Column) -> Column:
    """Text a moderation model reads: a blank line closes each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit("User: "), F.coalesce(t["utterance"], F.lit("")),
        F.lit("\nIntent: "), F.coalesce(t["intent"], F.lit("")),
        F.lit("\nAssistant: "), F.coalesce(t["assistant_response"], F.lit("")), F.lit("\n\n"),
    )), "")


def _labelled(label: str, text: Column) -> Column:
    bare = strip(text)
    return F.when(bare != "", F.concat(F.lit(label), bare))


def render_pair_text(turns: Column) -> Column:
    """``User: u Assistant: a`` on one line, blank sides dropped."""
    sides = F.flatten(F.transform(turns, lambda t: F.array(
        _labelled("User: ", t["utterance"]), _labelled("Assistant: ", t["assistant_response"]),
    )))
    return F.array_join(sides, " ")


def render_embedding_text(scenario: Column, turns: Column) -> Column:
    """Scenario followed by the turns that have all three parts."""
    parts = F.transform(turns, lambda t: F.concat(
        _labelled("Intent: ", t["intent"]), F.lit(". "), _labelled("User: ", t["utterance"]),
        F.lit(". "), _labelled("Assistant: ", t["assistant_response"]),
    ))
    # concat_ws would keep an empty body as a trailing blank
    return F.array_join(F.concat(F.array(scenario), F.coalesce(parts, F.array())), " ")


def render_tags(turns: Column) -> Column:
    """Inverse of ``parse_turns``: turns back to tagged text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit("<User>"), t["utterance"], F.lit("</User> <Intent>"), t["intent"],
        F.lit("</Intent> <Assistant>"), t["assistant_response"], F.lit("</Assistant>"),
    )), "\n")


def has_rogue_brackets(text: Column) -> Column:
    """``<`` not followed by a letter, or ``>`` not preceded by one."""
    return F.coalesce(text.rlike(r"<(?![A-Za-z])|(?<![A-Za-z])>"), F.lit(False))


def words(text: Column) -> Column:
    """Lower-case ASCII words; every other character but white space is dropped first."""
    bare = F.regexp_replace(F.lower(text), r"[^a-zA-Z\s]", "")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def label_key(label: Column) -> Column:
    """Sorted array of the labels a list literal names.

    A quoted string gives a one-label key holding the literal as written; anything else gives
    the empty key.
    """
    bare = strip(label)
    is_list = bare.rlike(r"(?s)^\[.*\]$")
    is_text = bare.rlike(r"""(?s)^('[^']*'|"[^"]*")$""")
    parsed = F.from_json(F.translate(bare, "'", '"'), "array<string>")
    return F.coalesce(
        F.when(is_list, F.array_sort(parsed)).when(is_text, F.array(label)),
        F.array().cast("array<string>"),
    )
