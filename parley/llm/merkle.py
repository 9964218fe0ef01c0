"""Merkle manifest of a dataset: one digest for all rows, and a proof of every row against it.

A row is a leaf: the sha256 of its fields, each with its length in front. The leaves of a group, in
order, are hashed two by two, level upon level, to the group's root; the groups' roots likewise to
the root of all. Digests are hashed as hex text.

Levels are concatenated strings. An aligned block of ``BLOCK`` nodes keeps a level as one string of
64 letters a node: substrings of 128 letters hash to the level above, and the substrings that flank
a node's own are the siblings of its proof. A block's root is a node of the next tier, which is
treated in the same way, until a group is one block. Proofs are then put together from the top
tier down, block by block: no step holds more than a block of a group, whatever the group's size.
All of it is SQL functions.

A proof is ``path``, the siblings' digests one after another from the leaf up, and ``sides``, a letter
for each level: ``l`` or ``r`` for the side the sibling stands on, ``-`` for a level without one.

Defined cases: a null field is ``-``, unlike an empty one; null order values come first, rows of equal
order are ordered by their leaves, and repeated rows are leaves of their own with proofs of their
own; null is a group of its own, before all others; a group of one row has its leaf as root; an
empty table gives no rows. Columns that are not asked for are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.ordering import with_position
from parley.session import cut

#: Nodes of a block, as a power of two.
BITS = 8
BLOCK = 1 << BITS
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field as it enters a leaf: its length in bytes and its text, or ``-`` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _upto(n: Column) -> Column:
    """0 to n - 1; nothing for zero."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _node(level: Column, place: Column, nodes: int = 1) -> Column:
    return F.substring(level, place * (DIGEST * nodes) + 1, F.lit(DIGEST * nodes))


def _nodes(level: Column) -> Column:
    return (F.length(level) / DIGEST).cast("int")


def _parents(level: Column) -> Column:
    pairs = F.ceil(_nodes(level) / 2).cast("int")
    return F.array_join(F.transform(_upto(pairs), lambda i: F.sha2(_node(level, i, 2), 256)), "")


def _in_groups(leaves: DataFrame) -> DataFrame:
    """``grp, ord, leaf, ...`` with the place ``pos`` in the group and the group's ``size``.

    Rows are range partitioned, so a group of any size spreads over tasks; counts meet per
    (partition, group).
    """
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("ord"), F.asc("leaf")]
    placed = cut(leaves.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("mark", F.monotonically_increasing_id())
                 .withColumn("part", F.shiftright("mark", 33)))
    all_parts = Window.partitionBy("g").orderBy("p")
    runs = (placed.groupBy(F.col("part").alias("p"), F.col("grp").alias("g"))
            .agg(F.min("mark").alias("first"), F.count("*").alias("n"))
            .withColumn("before", F.coalesce(F.sum("n").over(
                all_parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("size", F.sum("n").over(all_parts.rowsBetween(
                Window.unboundedPreceding, Window.unboundedFollowing))))
    return (placed.join(runs, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
            .withColumn("pos", F.col("mark") - F.col("first") + F.col("before"))
            .drop("p", "g", "first", "n", "before", "part", "mark"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """``grp, pos, size, node, ...`` -> one row per aligned block with its ``levels`` and ``items``."""
    items = F.array_sort(F.collect_list(F.struct("pos", "node", *[
        c for c in nodes.columns if c not in ("grp", "pos", "size", "node")])))  # a block at most
    size = F.col("size")
    depth = F.when(size <= 1, 0).otherwise(F.least(F.lit(BITS), F.length(F.bin(size - 1))))
    bottom = F.array_join(F.col("items.node"), "")
    levels = F.aggregate(_upto(F.col("depth")), F.array(bottom),
                         lambda made, _: F.concat(made, F.array(_parents(F.element_at(made, -1)))))
    return (nodes.groupBy("grp", F.shiftright("pos", BITS).alias("block"), "size").agg(items.alias("items"))
            .withColumn("depth", depth).withColumn("levels", levels)
            .withColumn("top", F.element_at("levels", -1)))


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of the nodes, blocks of those blocks' roots, and so on to one block a group."""
    tiers = []
    while True:
        tier = cut(_blocks(nodes))
        tiers.append(tier)
        if tier.where(F.col("size") > BLOCK).isEmpty():
            return tiers
        nodes = tier.select("grp", F.col("block").alias("pos"),
                            F.ceil(F.col("size") / BLOCK).alias("size"), F.col("top").alias("node"))


def _proofs(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """``grp, pos, node, ..., sides, path`` of every node of the lowest tier.

    ``above`` is ``grp, sides, path`` over each group's root, and other columns to carry down.
    """
    carried = [c for c in above.columns if c not in ("grp", "sides", "path")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(tiers):
        above = above.select(*[F.col(c).alias(f"{c}_above") for c in above.columns])
        rows = tier.join(above, F.col("grp").eqNullSafe(F.col("grp_above"))
                         & (F.col("block") == F.col("block_above")))
        levels = F.col("levels")

        def at_level(i: Column, k: Column) -> tuple[Column, Column, Column]:
            own = F.call_function("shiftright", i, k)
            other = own.bitwiseXOR(F.lit(1))
            return F.get(levels, k), own, other

        def side(i: Column, k: Column) -> Column:
            level, own, other = at_level(i, k)
            return F.when(other >= _nodes(level), "-").when(other < own, "l").otherwise("r")

        def sibling(i: Column, k: Column) -> Column:
            level, _, other = at_level(i, k)
            return _node(level, other)  # empty beyond the end

        def proof(part, i: Column, rest: str) -> Column:
            return F.concat(F.array_join(F.transform(_upto(F.col("depth")), lambda k: part(i, k)), ""), F.col(rest))

        found = F.transform("items", lambda x, i: F.struct(
            x.alias("item"), proof(side, i, "sides_above").alias("sides"), proof(sibling, i, "path_above").alias("path")))
        rows = rows.select("grp", *[F.col(f"{c}_above").alias(c) for c in carried], F.inline(found))
        above = rows.select("grp", F.col("item.pos").alias("block"), "sides", "path", *carried)
    return rows.select("grp", "item.*", "sides", "path", *carried)


@dataclass
class Manifest:
    leaves: list[DataFrame]  # tiers of blocks over the rows of each group
    groups: list[DataFrame]  # tiers of blocks over the groups' roots

    def root(self) -> DataFrame:
        """One row with the ``root`` of all; none for an empty table."""
        return self.groups[-1].select(F.col("top").alias("root"))

    def subroots(self) -> DataFrame:
        """``grp, subroot``."""
        return self.leaves[-1].select("grp", F.col("top").alias("subroot"))

    def proofs(self) -> DataFrame:
        """The rows with ``leaf, subroot, root, sides, path``."""
        top = self.root().select(F.lit(0).alias("grp"), F.lit("").alias("sides"), F.lit("").alias("path"), "root")
        groups = _proofs(self.groups, top).select(
            F.col("name").alias("grp"), "sides", "path", F.col("node").alias("subroot"), "root")
        return _proofs(self.leaves, groups).drop("pos").withColumnRenamed("node", "leaf")


def build(leaves: DataFrame) -> Manifest:
    """Manifest of ``grp, ord, leaf`` and other columns to keep beside each leaf.

    Other columns may not be called like those of this module; :func:`verified` shows the use.
    """
    rows = _tiers(_in_groups(leaves).withColumnRenamed("leaf", "node"))
    roots = with_position(rows[-1].select(F.col("grp").alias("name"), F.col("top").alias("node")),
                          F.asc_nulls_first("name"))
    # one row, but counted by Spark: the number of groups
    size = roots.agg(F.count("*").alias("size")).scalar()
    groups = _tiers(roots.select(F.lit(0).alias("grp"), F.col("pos").cast("long").alias("pos"),
                                 size.alias("size"), "node", "name"))
    return Manifest(rows, groups)


def folded(leaf_digest: Column, sides: Column, path: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    def up(made: Column, k: Column) -> Column:
        side = F.substring(sides, k + 1, F.lit(1))
        sibling = F.substring(path, made["at"], F.lit(DIGEST))
        joined = F.concat(F.when(side == "l", sibling).otherwise(""), made["digest"],
                          F.when(side == "r", sibling).otherwise(""))
        return F.struct(F.sha2(joined, 256).alias("digest"),
                        (made["at"] + F.when(side == "-", 0).otherwise(DIGEST)).alias("at"))

    start = F.struct(leaf_digest.alias("digest"), F.lit(1).alias("at"))
    return F.aggregate(_upto(F.length(sides)), start, up)["digest"]


def tampered(doc_id: Column) -> Column:
    """Rows to be altered: a seventh of the ids; none without id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 0, F.lit(False))


def verified(docs: DataFrame) -> DataFrame:
    """Every row of documents against the manifest per language, some of them altered after it."""
    fields = {name: F.col(name) for name in FIELDS}
    more = fields | {"n_chars": (F.col("n_chars").cast("decimal(20,0)") + 1)}
    leaves = cut(docs.select(
        F.col("lang").alias("grp"), F.col("doc_id").alias("ord"), leaf(*fields.values()).alias("leaf"),
        F.when(tampered(F.col("doc_id")), leaf(*more.values())).alias("altered")))
    proofs = build(leaves).proofs()
    again = folded(F.coalesce("altered", "leaf"), F.col("sides"), F.col("path"))
    return proofs.select(
        F.col("ord").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2("path", 256).alias("proof_sha256"), again.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
