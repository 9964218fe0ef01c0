"""Seeded samples and assignments, all functions of a key so that a rerun repeats them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import vocab
from parley.functions.draws import (
    draw_below, draw_from, draw_hash, draw_unit, draw_weighted, shuffled, slot_time,
)
from parley.operators.joins import lookup
from parley.operators.ordering import with_group_position, with_position


def draws(df: DataFrame, key: str, seed: str, bound: int, name: str = "pick") -> DataFrame:
    """Each row of ``df`` draws a position below ``bound`` (sampling with replacement)."""
    return df.withColumn(name, draw_below(F.col(key), seed, F.lit(bound)))


def request_table(df: DataFrame, n: int) -> DataFrame:
    """``n`` requests numbered from 0."""
    return df.sparkSession.range(n).withColumnRenamed("id", "request")


def sample_with_replacement(
    population: DataFrame, requests: DataFrame, key: str, seed: str, *order: str
) -> DataFrame:
    """One row of ``population`` for every request; a row may be drawn many times.

    Only the order columns, which identify a row, are put in order; the rest joins at the end.
    """
    placed = with_position(population.select(*order), *order, name="_pos")
    picked = draws(requests, key, seed, max(placed.count(), 1), "_pos")
    picked = lookup(picked, placed, ["_pos"]).drop("_pos")
    return lookup(picked, population, list(order))


def equal_quotas(groups: DataFrame, n: int, *order: str) -> DataFrame:
    """Split ``n`` over the groups: ``n // g`` each, one more for the first ``n % g``."""
    placed = with_position(groups, *order, name="_rank")
    g = placed.count()
    return placed.withColumn(
        "quota", F.lit(n // max(g, 1)) + (F.col("_rank") < n % max(g, 1)).cast("int")
    ).drop("_rank")


def stratified_sample(
    population: DataFrame, group: str, n: int, seed: str, *order: str
) -> DataFrame:
    """``n`` draws with replacement spread equally over the groups, in seeded order.

    Draw i belongs to the group its number falls to, so no group is expanded from one row.
    Rows carry ``request`` (0..n-1) and ``rank``, their place after the shuffle.
    """
    placed = with_group_position(
        population.where(F.col(group).isNotNull()).select(group, *order), group, *order, name="_p")
    groups = with_position(placed.select(group, "_p_size").distinct(), group, name="_g")
    groups = groups.persist()
    g = max(groups.count(), 1)
    quota, extra = divmod(n, g)
    i = F.col("request")
    big = extra * (quota + 1)
    which = F.when(i < big, F.floor(i / (quota + 1))).otherwise(
        F.lit(extra) + F.floor((i - big) / max(quota, 1)))
    wanted = lookup(request_table(population, n).withColumn("_g", which), groups, ["_g"])
    wanted = wanted.withColumn("_p", draw_below(F.col("request"), seed, F.col("_p_size"))).drop(
        "_g", "_p_size")
    drawn = lookup(wanted, placed.drop("_p_size"), [group, "_p"]).drop("_p")
    shuffle = draw_hash(F.col("request"), f"{seed}:order")
    ranked = with_position(drawn.withColumn("_h", shuffle), "_h", "request", name="rank").drop("_h")
    return lookup(ranked, population.drop(group), list(order))


def thin_class(members: DataFrame, key: str, seed: str) -> DataFrame:
    """Keys of the half (rounded down) of a class to remove, by seeded order."""
    ids = members.where(F.col(key).isNotNull()).select(key).withColumn(
        "_h", draw_hash(F.col(key), seed))
    placed = with_position(ids, "_h", key, name="_r")
    return placed.where(F.col("_r") < placed.count() // 2).select(key)


def capped_sample(df: DataFrame, key: Column, seed: str, n: int, *ties: str) -> DataFrame:
    """``n`` rows in seeded order, or all of them when there are fewer."""
    return df.withColumn("_h", draw_hash(key, seed)).orderBy("_h", *ties).limit(n).drop("_h")


def assign_size_class(
    df: DataFrame, key: str, seed: str, weights: Sequence[tuple[str, float]] = tuple(vocab.SIZE_WEIGHTS)
) -> DataFrame:
    return df.withColumn("size_class", draw_weighted(F.col(key), f"{seed}:size", weights))


def _combination_at(index: Column) -> Column:
    """Combination number ``index`` of the row's size class."""
    picked = None
    for name in vocab.COMBINATIONS:
        item = F.get(vocab.combinations_of(name), index.cast("int"))
        is_class = F.col("size_class") == name
        picked = F.when(is_class, item) if picked is None else picked.when(is_class, item)
    return picked


def _class_width() -> Column:
    width = None
    for name, items in vocab.COMBINATIONS.items():
        is_class = F.col("size_class") == name
        width = F.when(is_class, len(items)) if width is None else width.when(is_class, len(items))
    return width


def random_services(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Uniform combination of the row's size class, shuffled."""
    index = draw_below(F.col(key), f"{seed}:combination", _class_width())
    return df.withColumn("services", shuffled(
        _combination_at(index), F.col(key), f"{seed}:shuffle"))


def balanced_services(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Least-used combination first: usage inside a size class never differs by more than one.

    Rows of a class take the combinations in turn, in seeded order.
    """
    turn = df.select(key, "size_class", draw_hash(F.col(key), f"{seed}:turn").alias("_h"))
    placed = with_group_position(turn, "size_class", "_h", key, name="_p").select(key, "_p")
    chosen = _combination_at(F.pmod(F.col("_p"), _class_width()))
    return df.join(placed, key).withColumns({
        "combination": F.array_join(F.array_sort(chosen), "+"),
        "services": shuffled(chosen, F.col(key), f"{seed}:shuffle"),
    }).drop("_p")


def combination_usage(assigned: DataFrame) -> DataFrame:
    """Uses per (size class, combination), unused ones with 0."""
    rows = [(s, "+".join(sorted(c))) for s, items in vocab.COMBINATIONS.items() for c in items]
    known = assigned.sparkSession.createDataFrame(rows, "size_class string, combination string")
    used = assigned.groupBy("size_class", "combination").agg(F.count("*").alias("uses"))
    # at most one row per combination on either side
    return known.join(F.broadcast(used), ["size_class", "combination"], "left").na.fill(0, ["uses"])


def usage_spread(usage: DataFrame) -> DataFrame:
    """Least and most used combination count per size class."""
    return usage.groupBy("size_class").agg(
        F.min("uses").alias("min_uses"), F.max("uses").alias("max_uses"))


def with_scenario_choices(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Region, category, slot, time, emotions and resolution status for each request."""
    k = F.col(key)
    primary = F.get("services", F.lit(0))
    df = df.withColumns({
        "regions": F.array(draw_from(k, f"{seed}:region", vocab.strings(vocab.REGIONS))),
        "scenario_category": draw_from(k, f"{seed}:category", vocab.categories_for(primary)),
        "time_slot": draw_from(k, f"{seed}:slot", vocab.slot_structs()),
        "user_emotions": F.array(
            draw_from(k, f"{seed}:user", vocab.strings(vocab.USER_EMOTIONS))),
        "assistant_emotions": F.array(
            draw_from(k, f"{seed}:assistant", vocab.strings(vocab.ASSISTANT_EMOTIONS))),
        "resolution_status": draw_weighted(k, f"{seed}:status", vocab.RESOLUTION_WEIGHTS),
    })
    return df.withColumn("time", slot_time(
        k, f"{seed}:time", F.col("time_slot.start"), F.col("time_slot.end")))


def pick_personas(
    requests: DataFrame, key: str, personas: DataFrame, cluster: str, summary: str, idx: str,
    seed: str,
) -> DataFrame:
    """Two-stage choice: a coin picks the grouping, then a group, then a member, all uniform.

    Groups, not personas, are equally likely. ``cluster`` and ``summary`` are the two grouping
    columns, ``idx`` numbers the personas uniquely.
    """
    kinds = F.array(
        F.struct(F.lit("cluster").alias("by"), F.col(cluster).cast("string").alias("group")),
        F.struct(F.lit("summary").alias("by"), F.col(summary).cast("string").alias("group")),
    )
    members = personas.select(F.col(idx).alias("_idx"), F.explode(kinds).alias("_k")).select(
        "_idx", F.to_json("_k").alias("_group"), F.col("_k.by").alias("by"),
        F.col("_k.group").alias("group"))
    members = with_group_position(members, "_group", "_idx", name="_m")
    groups = with_group_position(
        members.select("by", "group", "_group", "_m_size").distinct(), "by", "group", name="_g")
    counts = {r["by"]: r["n"] for r in groups.groupBy("by").agg(F.count("*").alias("n")).collect()}
    k = F.col(key)
    coin = F.when(draw_unit(k, f"{seed}:coin") < 0.5, "cluster").otherwise("summary")
    chosen = requests.withColumn("by", coin).withColumn("_g", F.when(
        F.col("by") == "cluster", draw_below(k, f"{seed}:group", F.lit(counts.get("cluster", 1)))
    ).otherwise(draw_below(k, f"{seed}:group", F.lit(counts.get("summary", 1)))))
    chosen = lookup(chosen, groups.drop("_g_size"), ["by", "_g"])
    chosen = chosen.withColumn("_m", draw_below(k, f"{seed}:member", F.col("_m_size")))
    found = lookup(chosen.drop("_m_size", "_g"), members.select("_group", "_m", "_idx"),
                   ["_group", "_m"])
    return found.withColumnRenamed("_idx", idx).drop("_group", "_m")


def members_by_group(personas: DataFrame, group: str, idx: str) -> DataFrame:
    """Inverted index as rows: (group, position, idx), in index order."""
    return with_group_position(personas.select(group, idx), group, idx, name="position").drop(
        "position_size")
