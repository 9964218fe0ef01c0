"""Packing: shortest-pack-first over the histogram of piece lengths.

Texts become ids and are cut into pieces of at most one sequence. Only the histogram of lengths, of
at most ``size`` bins, decides which lengths share a sequence, so packing costs the driver the same
for any corpus. A piece then finds its place by its rank among the pieces of its length.

Defined cases: a null or empty text is its end mark alone; rows without id and repeated rows are
packed like any other row; an empty table gives no piece; columns other than the id and the text are
not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import word_tokens
from parley.llm.arrays import byte_slices
from parley.session import cut

SIZE = 2048
END_ID = 1

_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, nth long"
_PLACED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long")
_RANK_BITS = np.uint64(48)


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID,
           id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every text, numbered by length within the task that made them.

    Written to the shared folder: the numbers hold only for the rows as they were written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with word_tokens.released(tokenizer) as encoder:
            yield from cut_up(batches, encoder)

    def cut_up(batches: Iterator[pa.RecordBatch], encoder: word_tokens.WordTokens) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            names = batch.column(0)
            for first, end, data, offsets in byte_slices(batch.column(1)):
                ids, at = encoder.encode(data, offsets)
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                total = np.diff(at)
                count = -(-total // size)
                doc = np.repeat(np.arange(end - first), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * size
                length = np.minimum(total[doc] - start, size)
                begin = at[doc] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * b:4 * (b + n)])
                       for b, n in zip(begin.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                of_length = np.bincount(length, minlength=size + 1)
                nth = np.empty(len(doc), np.int64)
                nth[order] = (np.arange(len(doc)) - np.repeat(np.cumsum(of_length) - of_length, of_length)
                              + np.repeat(seen, of_length))
                seen += of_length
                yield pa.RecordBatch.from_arrays(
                    [names.slice(first, end - first).take(pa.array(doc)).cast(pa.int64()),
                     pa.array(start.astype(np.int64)), pa.array(length.astype(np.int32)),
                     pa.array(crc, pa.int64()), pa.array(total[doc].astype(np.int64)),
                     pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return cut(docs.select(id_column, text).mapInArrow(run, _PIECES))


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """``(lengths, how many sequences hold just these)`` for pieces given by their length counts.

    Lengths are placed longest first, each into the open packs with the most room. A pack opened
    for a length takes as many of that length as fit, as placing them one by one would.
    """
    out: list[tuple[list[int], int]] = []
    heap: list[tuple[int, int, tuple, int]] = []  # room (negated), tie-break, (rest, length, copies), packs
    made = 0

    def keep(room: int, node: tuple, packs: int) -> None:
        nonlocal made
        if room:
            heapq.heappush(heap, (-room, made, node, packs))
            made += 1
        else:
            out.append((_lengths(node), packs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and heap and -heap[0][0] >= length:
            room, _, node, packs = heapq.heappop(heap)
            used = min(left, packs)
            if used < packs:
                keep(-room, node, packs - used)
            keep(-room - length, (node, length, 1), used)
            left -= used
        fits = size // length
        if left >= fits:
            keep(size - fits * length, ((), length, fits), left // fits)
        if left % fits:
            keep(size - left % fits * length, ((), length, left % fits), 1)
    return out + [(_lengths(node), packs) for _, _, node, packs in heap]


def _lengths(node: tuple) -> list[int]:
    found: list[int] = []
    while node:
        node, length, copies = node
        found += [length] * copies
    return found[::-1]


def slots(packed: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Sorted places: (length, first rank) as one number, its sequence, its offset there."""
    next_rank: dict[int, int] = {}
    keys, sequences, offsets, base = [], [], [], 0
    for lengths, packs in packed:
        offset = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            next_rank[length] = rank + packs
            keys.append(length << int(_RANK_BITS) | rank)
            sequences.append(base)
            offsets.append(offset)
            offset += length
        base += packs
    order = np.argsort(np.array(keys, np.uint64))
    return (np.array(keys, np.uint64)[order], np.array(sequences, np.int64)[order],
            np.array(offsets, np.int64)[order])


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID,
         id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its sequence and its offset there."""
    cut_pieces = pieces(docs, tokenizer, size, end_id, id_column, text)
    counts = cut(cut_pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in
                 counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    keys, sequences, offsets = slots(patterns(histogram, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length = rows["length"].to_numpy().astype(np.uint64)
            rank = (rows["nth"].to_numpy() + rows["base"].to_numpy()).astype(np.uint64)
            slot = np.searchsorted(keys, length << _RANK_BITS | rank, "right") - 1
            first = keys[slot] & np.uint64((1 << int(_RANK_BITS)) - 1) if len(slot) else rank
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"], rows["start"], pa.array(length.astype(np.int64)), rows["ids_crc32"],
                 rows["doc_tokens"], pa.array(sequences[slot] + (rank - first).astype(np.int64)),
                 pa.array(offsets[slot])],
                names=[f.split()[0] for f in _PLACED.split(", ")])

    return cut_pieces.join(bases, ["part", "length"]).mapInArrow(place, _PLACED)
