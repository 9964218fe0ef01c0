"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A text's set is its distinct five-word shingles. The sketch has ``COORDS`` coordinates. In round i
each shingle falls into one bin with a hash of its own for that round, and a bin keeps the smallest
(round, hash) it gets; the first ``COORDS`` rounds choose the bin by hash, round COORDS + j sends
every shingle to bin j. So every coordinate fills, two sets agree in a coordinate with the
probability of their Jaccard similarity, and the share of agreeing coordinates is concentrated.
Most sets are done after one or two rounds.

Bands of four coordinates give candidates: at similarity 0.75 no band agrees with probability 5e-6,
and every candidate counts only after its full sets have been compared.

Texts with the same set are one node from the start. In each bucket of a band the nodes are compared
with the one of the smallest id. In buckets that then hold several components, shingles that no
other node there has bound what a node can share with any: most outsiders are out by that bound
alone. The rest are compared with pivots chosen by hash. What is still apart in a bucket is joined on
its rarest shingles: with each set ordered from its rarest shingle on, the first shingle two similar
sets share stands so early in both that enough of either follows it. Copies of one text differ in
their rare shingles, so few pairs pass, and none that could be linked is lost. Sets of which all
shingles are frequent are still looked at in pairs there, in blocks, by their sizes and places alone.

Defined cases: null texts and texts without words have no shingle and are linked with nothing; with
fewer than five words the whole sequence is the one shingle; rows without id are linked with nothing
and kept, without component; rows of one id are one document, whose texts all count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.arrays import byte_slices, mix, signed, words
from parley.session import cut

WORDS = 5
COORDS = 128
BAND = 4
PERCENT = 75
PIVOT_ROUNDS = 2
#: Nodes of one shingle in a block of the last join.
CROWD = 1000

_PLACE = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_LOW56 = np.uint64(8)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    hashes, at = words(data, offsets)
    count = np.diff(at)
    windows = np.maximum(count - WORDS + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(count)), windows)
    first = at[text] + np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    total = np.zeros(len(text), np.uint64)
    short = count[text] < WORDS
    for j in range(WORDS):
        use = ~short | (j < count[text])
        total[use] += hashes[first[use] + j] * _PLACE[j]
    total = mix(total + count[text].astype(np.uint64) * short)
    order = np.lexsort((total, text))
    total, text = total[order], text[order]
    new = np.r_[True, (total[1:] != total[:-1]) | (text[1:] != text[:-1])][:len(total)]
    total, text = total[new], text[new]
    return total, np.searchsorted(text, np.arange(len(offsets)))


def sketches(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``COORDS`` values for each set; rows of empty sets are unfilled."""
    n = len(at) - 1
    empty = np.uint64(2**64 - 1)
    out = np.full(n * COORDS, empty, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(at))
    elements = sets
    for round_no in range(2 * COORDS):
        if not len(elements):
            break
        salt = mix(np.array([round_no + 1], np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        value = mix(elements ^ salt)
        bins = (value % np.uint64(COORDS)).astype(np.int64) if round_no < COORDS else round_no - COORDS
        rank = np.uint64(round_no) << np.uint64(56) | mix(value) >> _LOW56
        np.minimum.at(out, owner * COORDS + bins, rank)
        open_sets = (out.reshape(n, COORDS) == empty).any(axis=1)
        stay = open_sets[owner]
        elements, owner = elements[stay], owner[stay]
    return out.reshape(n, COORDS)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """One number for each band of each sketch."""
    bands = COORDS // BAND
    grouped = rows.reshape(len(rows), bands, BAND)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(rows), bands)).copy()
    for j in range(BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, j])
    return key


def _names(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each set: equal sets have equal sums, and the rows of an empty set no bucket."""
    sums = np.zeros((2, len(sets) + 1), np.uint64)
    np.cumsum(sets, out=sums[0, 1:])
    np.cumsum(mix(sets * np.uint64(0xE7037ED1A0B428DB)), out=sums[1, 1:])
    one, two = (mix(s[at[1:]] - s[at[:-1]]) for s in sums)
    return one, two


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in byte_slices(batch.column(1)):
            sets, at = shingles(data, offsets)
            size = np.diff(at)
            keys = band_keys(sketches(sets, at))
            one, two = _names(sets, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first).cast(pa.int64()), pa.array(size),
                 pa.array(signed(one)), pa.array(signed(two)),
                 pa.FixedSizeListArray.from_arrays(pa.array(signed(keys.ravel())), keys.shape[1])
                 .cast(pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in byte_slices(batch.column(1)):
            sets, at = shingles(data, offsets)
            raw = memoryview(sets.tobytes())
            one, two = _names(sets, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), pa.array(np.diff(at)), pa.array(signed(one)),
                 pa.array(signed(two)),
                 pa.array([bytes(raw[8 * a:8 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())],
                          pa.binary())], names=["node", "n_shingles", "set_a", "set_b", "shingles"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = batch.column(2), batch.column(3)
        good = []
        for i in range(batch.num_rows):
            a = np.frombuffer(one[i].as_buffer(), np.uint64)
            b = np.frombuffer(two[i].as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
            both = int((b[at] == a).sum()) if len(b) else 0
            good.append(both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both))
        keep = batch.filter(pa.array(good, pa.bool_()))
        yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1)], names=["a", "b"])


def sets_of(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``node, shingles`` of the nodes in ``asked``, a row each; only their texts are read again.

    An id may stand in several rows: a text that gives another set is not the node's, and of texts
    that give its set one is kept.
    """
    wanted = nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "doc_id")
    found = cut(docs.select("doc_id", "text").join(wanted, "doc_id").select("node", "text")
                .mapInArrow(_sets, "node long, n_shingles long, set_a long, set_b long, shingles binary")
                .where(F.col("node") == F.xxhash64("set_a", "set_b", "n_shingles")).select("node", "shingles"))
    again = cut(found.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"))
    if not again.limit(1).count():
        return found
    return cut(found.join(again, "node", "left_anti")
               .union(found.join(again, "node", "left_semi").dropDuplicates(["node"])))


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of nodes ``a, b`` whose full sets are similar enough.

    A node that stands in very many pairs is a hot key of the joins only, whose partitions the
    engine may split, as each pair is judged alone.
    """
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
            .mapInArrow(_links, "a long, b long"))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, raw in zip(batch.column(0), batch.column(1)):
            found = np.frombuffer(raw.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node.as_py())), pa.array(found)],
                                             names=["node", "shingle"])


def own_counts(sets: DataFrame) -> DataFrame:
    """``node, own``: how many shingles of a node no other node of ``sets`` has."""
    return (sets.mapInArrow(_exploded, "node long, shingle long")
            .groupBy("shingle").agg(F.count("*").alias("n"), F.first("node").alias("node"))
            .where("n = 1").groupBy("node").agg(F.count("*").alias("own")))


def rare_pairs(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``nodes`` (``node, n_shingles, label``) that may be linked, of different labels.

    ``at`` counts the rarer shingles of a set before one. Two sets share at most what is left of
    either from their first common shingle on, which must be enough for their sizes.

    The pairs of nodes that share an early shingle are looked at where neither size rules them out;
    the nodes of a frequent one are dealt to blocks of ``CROWD``, so no task has all its pairs.
    """
    rows = cut(sets.join(nodes.select("node"), "node", "left_semi").select("node", "shingles")
               .mapInArrow(_exploded, "node long, shingle long"))
    counts = rows.groupBy("shingle").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("node").orderBy("n", "shingle")
    early = (rows.join(counts, "shingle").withColumn("at", F.row_number().over(rarest) - 1).where("n > 1")
             .join(nodes, "node").withColumn("rest", F.col("n_shingles") - F.col("at"))
             .where(100 * F.col("rest") >= PERCENT * F.col("n_shingles"))
             .select("shingle", "node", "n_shingles", "rest", "label"))
    early = cut(early)
    mixed = (early.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                          F.count("*").alias("n"))
             .where("low < high").select("shingle", F.ceil(F.col("n") / CROWD).cast("int").alias("blocks")))
    # similar sizes are in one step or in neighbouring ones, as a step is a little wider than they may differ
    early = early.join(mixed, "shingle").withColumn(
        "step", F.floor(F.log("n_shingles") / float(np.log(100 / PERCENT * 1.001))))
    left = early.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    mates = (early.select("shingle", F.col("node").alias("pivot"), F.col("n_shingles").alias("size"),
                          F.col("rest").alias("rest_too"), F.col("label").alias("other"), "blocks",
                          F.explode(F.array(F.col("step") - 1, "step")).alias("step"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))
    enough = (PERCENT + 100) * F.least("rest", "rest_too") >= PERCENT * (F.col("n_shingles") + F.col("size"))
    smaller = F.struct("n_shingles", "node") < F.struct("size", "pivot")
    return _pairs(left.join(mates, ["shingle", "step", "block"]).where(
        smaller & (F.col("label") != F.col("other")) & _sizes("n_shingles", "size") & enough))


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, label``: the smallest node reachable over the links, for nodes that have one.

    Each round takes the smallest label around a node, then the label of that label.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        step = cut(labels.join(near, "node").select("node", F.col("label").alias("old"),
                                                    F.least("label", "near").alias("label")))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = cut(step.join(jump, "label", "left")
                     .select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        if not labels.where("label < old").limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
    raise ValueError("components did not settle")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    sketched = cut(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, set_a long, set_b long, "
                                            "bands array<long>"))
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    # a node is a set; it is named by the smallest id that has it
    nodes = cut(full.groupBy("set_a", "set_b", "n_shingles")
                .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
                .withColumn("node", F.xxhash64("set_a", "set_b", "n_shingles")))
    members = nodes.select("node", "n_shingles", "doc_id", F.explode("bands").alias("band"))
    crowded = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = cut(members.join(crowded, "band"))
    links = _same_id(full)
    # first every member of a bucket against the one with the smallest id, likely the original
    pivots = members.groupBy("band").agg(F.min(F.struct("doc_id", "node", "n_shingles")).alias("pivot")).select(
        "band", F.col("pivot.node").alias("pivot"), F.col("pivot.n_shingles").alias("size"))
    pairs = cut(_pairs(members.join(pivots, "band").where(_sizes("n_shingles", "size"))))
    links = cut(links.union(verified(sets_of(docs, nodes, _ends(pairs)), pairs)))
    labels = components(nodes, links)
    rest = cut(_apart(members, labels))
    if rest.limit(1).count():
        # a set of which more than a quarter is its own can be linked with nothing
        sets = sets_of(docs, nodes, rest)
        reach = F.col("n_shingles") - F.coalesce("own", F.lit(0))
        rest = cut(rest.join(own_counts(sets), "node", "left").withColumn("reach", reach)
                   .where(100 * F.col("reach") >= PERCENT * F.col("n_shingles"))
                   .select("band", "node", "n_shingles", "reach"))
        done = pairs
        for turn in range(PIVOT_ROUNDS):
            left = cut(_apart(rest, labels))
            if not left.limit(1).count():
                break
            able = (PERCENT + 100) * F.least("reach", "reach_too") >= PERCENT * (F.col("n_shingles") + F.col("size"))
            mates = left.select(F.col("band").alias("at"), F.col("node").alias("pivot"), F.col("n_shingles").alias("size"),
                                F.col("reach").alias("reach_too"), F.col("label").alias("other"))
            order = F.struct(F.xxhash64("pivot", F.lit(turn)), *[c for c in mates.columns if c != "at"])
            mates = mates.groupBy("at").agg(F.min(order).alias("m")).select("at", "m.*")
            pairs = cut(_pairs(left.join(mates, (F.col("band") == F.col("at")) & (F.col("label") != F.col("other"))
                                         & able & _sizes("n_shingles", "size")))
                        .join(done, ["a", "b"], "left_anti"))
            done = done.union(pairs)
            links = cut(links.union(verified(sets, pairs)))
            labels = components(nodes, links)
        left = cut(_apart(rest, labels).select("node", "n_shingles", "label").distinct())
        if left.limit(1).count():
            pairs = cut(rare_pairs(sets, left).join(done, ["a", "b"], "left_anti"))
            links = cut(links.union(verified(sets, pairs)))
            labels = components(nodes, links)
    named = (nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
             .select("set_a", "set_b", "n_shingles", "label", "doc_id"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = cut(named.join(smallest, "label").select("set_a", "set_b", "n_shingles", "component_id"))
    rows = (sketched.select("doc_id", "n_shingles", "set_a", "set_b")
            .join(named, ["set_a", "set_b", "n_shingles"], "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (rows.withColumn("component_id", component)
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs of ``node`` and ``pivot``, the smaller first."""
    return (rows.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
            .distinct())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their labels, of the buckets that hold more than one component."""
    known = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = (known.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"))
             .where("low < high").select("band"))
    return known.join(apart, "band")


def _sizes(one: str, two: str):
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(one, two) >= PERCENT * F.greatest(one, two)


def _same_id(full: DataFrame) -> DataFrame:
    """Links between the different texts of one id."""
    node = F.xxhash64("set_a", "set_b", "n_shingles")
    several = full.groupBy("doc_id").agg(F.min(node).alias("a"), F.max(node).alias("high")).where("a < high")
    return (full.select("doc_id", node.alias("b")).join(several, "doc_id").where("a < b")
            .select("a", "b").distinct())
