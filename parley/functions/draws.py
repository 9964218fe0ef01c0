"""Deterministic draws: every choice is a function of a key and a seed, so a rerun repeats it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 2 ** 32


def draw_hash(key: Column, seed: str) -> Column:
    """md5 of ``key:seed``; also the order of every seeded shuffle."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def draw_int(key: Column, seed: str) -> Column:
    """32-bit draw as BIGINT."""
    return F.conv(F.substring(draw_hash(key, seed), 1, 8), 16, 10).cast("bigint")


def draw_unit(key: Column, seed: str) -> Column:
    """Draw in [0, 1)."""
    return draw_int(key, seed) / F.lit(float(_SPAN))


def draw_below(key: Column, seed: str, bound: Column) -> Column:
    """Draw in 0..bound-1; null where there is nothing to draw from."""
    return F.pmod(draw_int(key, seed), F.nullif(bound.cast("bigint"), F.lit(0)))


def draw_from(key: Column, seed: str, items: Column) -> Column:
    """Uniform item of an array."""
    return F.get(items, draw_below(key, seed, F.size(items)).cast("int"))


def weight_edges(weights: Sequence[tuple[str, float]]) -> list[tuple[str, int]]:
    """Upper edge of each label's share of the 32-bit draws."""
    total = sum(w for _, w in weights)
    edges, reached = [], 0.0
    for label, weight in weights:
        reached += weight
        edges.append((label, round(reached / total * _SPAN)))
    return edges


def draw_weighted(key: Column, seed: str, weights: Sequence[tuple[str, float]]) -> Column:
    """Label drawn with the given weights, first label first on the unit interval.

    Edges are compared as integers, so they do not depend on float addition.
    """
    drawn = draw_int(key, seed)
    choice = F
    for label, edge in weight_edges(weights)[:-1]:
        choice = choice.when(drawn < edge, label)
    last = weights[-1][0]
    return F.lit(last) if choice is F else choice.otherwise(last)


def draw_range(key: Column, seed: str, low: float, high: float) -> Column:
    """Uniform draw in [low, high)."""
    return F.lit(low) + (F.lit(high) - F.lit(low)) * draw_unit(key, seed)


def shuffled(items: Column, key: Column, seed: str) -> Column:
    """Array in seeded random order."""
    tagged = F.transform(items, lambda x, i: F.struct(
        F.md5(F.concat(key.cast("string"), F.lit(f":{seed}:"), i.cast("string"))).alias("h"),
        x.alias("x"),
    ))
    return F.transform(F.array_sort(tagged), lambda t: t["x"])


def slot_time(key: Column, seed: str, start: Column, end: Column) -> Column:
    """``HH:MM`` on a five-minute step inside a slot.

    A slot that passes midnight draws its evening part or its morning part with equal chance.
    Hours outside 0..23 give ``00:00``.
    """
    wraps = end < start
    evening = draw_unit(key, f"{seed}:half") < 0.5
    first = F.when(wraps & ~evening, F.lit(0)).otherwise(start * 60)
    last = F.when(wraps & evening, F.lit(24 * 60)).otherwise(end * 60)
    steps = F.floor((last - first) / 5)
    minutes = first + 5 * draw_below(key, f"{seed}:step", F.greatest(steps, F.lit(1)))
    text = F.concat(
        F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad(F.pmod(minutes, F.lit(60)).cast("string"), 2, "0"),
    )
    legal = start.between(0, 23) & end.between(0, 23)
    return F.when(legal, text).otherwise(F.lit("00:00"))
