"""Whole texts of an Arrow column as byte arrays, cut into slices of bounded size, and their words.

Words are runs of bytes that are no ASCII white space, with A-Z in lower case. A word is known by a
64-bit hash, computed for all words of a slice at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93 | 1
_codes: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_codes() -> np.ndarray:
    if not _codes:
        _codes.append(mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD) | np.uint64(1))
    return _codes[0]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_power_cache: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; kept up to the slice size."""
    if len(_power_cache.get("up", ())) >= n:
        return _power_cache["up"][:n], _power_cache["down"][:n]
    size = max(n, SLICE_BYTES + 1)
    up, down = _powers(_STEP, size), _powers(pow(_STEP, -1, 1 << 64), size)
    if size <= 2 * SLICE_BYTES:
        _power_cache.update(up=up, down=down)
    return up[:n], down[:n]


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, end, bytes, offsets)`` of runs of rows of about ``limit`` bytes; null is empty.

    A text longer than the limit is a slice of its own, and whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data if data is not None else b"", np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums from which a hash of any stretch follows; good for places to cut, not for identity."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_codes()[data] * _power_tables(len(data))[0], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches; equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[begin]) * _power_tables(len(sums))[1][begin])


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes, eight bytes at a time.

    Each eight are mixed with their place before they are summed, so no shift, sum or product of
    bytes makes two stretches meet, as there are for sums of powers modulo 2**64.
    """
    size = end - begin
    blocks = (size + 7) >> 3
    ends = np.cumsum(blocks)
    of = np.repeat(np.arange(len(size)), blocks)
    place = np.arange(len(of)) - (ends - blocks)[of]
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eight = np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))[begin[of] + 8 * place]
    rest = np.minimum(size[of] - 8 * place, 8).astype(np.uint64)
    eight &= np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * rest)
    keys = mix(np.arange(1, int(blocks.max(initial=0)) + 1, dtype=np.uint64) * _ODD)
    sums = np.zeros(len(of) + 1, np.uint64)
    np.cumsum(mix(eight ^ keys[place]), out=sums[1:])
    return mix(sums[ends] - sums[ends - blocks] + size.astype(np.uint64) * _ODD)


def words(data: np.ndarray, offsets: np.ndarray, places: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all words in order, and where each text's words begin (one entry more than texts).

    With ``places`` also each word's first byte and its length.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)) + (none, none) * places
    solid = ~SPACE[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    starts[edge] = solid[edge]
    ends[edge - 1] = solid[edge - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hashes = span_hashes(LOWER[data], begin, end)
    at = np.searchsorted(begin, offsets)
    return (hashes, at, begin, end - begin) if places else (hashes, at)


def word_hash(word: bytes) -> int:
    """Hash of one word, as :func:`words` gives it."""
    return int(words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def fold(doc_id: Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def in_fold(doc_id: Column, folds: int, held: int) -> Column:
    """Whether a row is held out; a row without id is not."""
    return F.coalesce(fold(doc_id, folds) == held, F.lit(False))


def learnt_from(doc_id: Column, folds: int, held: int) -> Column:
    """Whether a row may be learnt from; a row without id may not."""
    return F.coalesce(fold(doc_id, folds) != held, F.lit(False))


def scored(df: DataFrame, keep: list[str], text: str, fields: str,
           scorer: Callable[[np.ndarray, np.ndarray], list], limit: int = SLICE_BYTES) -> DataFrame:
    """``keep`` columns beside what ``scorer`` finds from the bytes of each slice of texts."""
    schema = StructType([df.schema[c] for c in keep] + list(StructType.fromDDL(fields)))
    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(fields)]
    at = keep.index(text) if text in keep else len(keep)  # a text that is kept is not sent twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in byte_slices(batch.column(at), limit):
                found = scorer(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(first, end - first) for i in range(len(keep))]
                    + [pa.array(x, kind) for x, kind in zip(found, kinds)], names=schema.names)

    sent = [F.col(f"`{c}`") for c in keep] + ([F.col(text).alias("scored text")] if at == len(keep) else [])
    return df.select(*sent).mapInArrow(run, schema)


class KeyIndex:
    """Places of many whole numbers (below 2**63) in a fixed list, found by hashing."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, np.uint64)
        bits = max(10, int(4 * len(self.keys)).bit_length())
        self.tables, rest = [], np.arange(len(self.keys), dtype=np.int32)
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            table = np.full(1 << bits, -1, np.int32)
            slot = (self.keys[rest] * np.uint64(salt)) >> np.uint64(64 - bits)
            table[slot[::-1]] = rest[::-1]
            rest = rest[table[slot] != rest]
            self.tables.append((np.uint64(salt), np.uint64(64 - bits), table))
        order = np.argsort(self.keys[rest])
        self.rest, self.rest_keys = rest[order], self.keys[rest][order]

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Place of each number, -1 where it is not in the list."""
        asked = asked.astype(np.uint64)
        out = np.full(len(asked), -1, np.int32)
        if not len(self.keys):
            return out
        todo = None
        for salt, shift, table in self.tables:
            sought = asked if todo is None else asked[todo]
            found = table[(sought * salt) >> shift]
            good = (found >= 0) & (self.keys[found] == sought)
            if todo is None:
                out[good] = found[good]
                todo = np.flatnonzero(~good & (found >= 0))
            else:
                out[todo[good]] = found[good]
                todo = todo[~good & (found >= 0)]
        if len(self.rest) and len(todo):
            place = np.minimum(np.searchsorted(self.rest_keys, asked[todo]), len(self.rest) - 1)
            good = self.rest_keys[place] == asked[todo]
            out[todo[good]] = self.rest[place[good]]
        return out


def text_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of rows of ``values`` between consecutive offsets; zero for an empty stretch."""
    out = np.zeros((len(offsets) - 1,) + values.shape[1:], np.float64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=np.float64)
    return out
