"""Removal of long passages that an earlier document holds, by a run-length compressed index.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller
id. Strings are judged on the input, and may overlap.

Texts travel in slices of a few megabytes, one compressed row each. In every string of ``LENGTH``
bytes at least one place is an anchor: the place whose ``GRAM`` bytes have the smallest hash of all
in the string. So equal strings have equal anchors, and

1. every slice sends the hashes of its distinct anchors to buckets, which answer by one bit each
   whether another document has them, too;
2. around anchors that several documents have, slices send the distinct contexts, all bytes that a
   string with this anchor may take, with the smallest document of each; a bucket builds its index
   of them, streams every context's matching statistics through it, and answers by one bit for each
   string whether it matches a smaller document;
3. slices mark what the answers say and give what is left.

A passage that stands in a third of all documents is one entry of a slice in either step, and whole
copies share their contexts. Buckets are cut by counted sizes, so that their number grows with the
input and not their size.

:class:`RunIndex` is the index of a bucket: the Burrows-Wheeler transform of its contexts as runs,
with the text places of the first and last suffix of each run. Matching statistics need no more: as
long as the next byte to the left is that of the run the search stands in, the match grows; otherwise
the search goes on from the sampled end of the nearest run of that byte, above or below, whichever
shares more with the match. Contexts that repeat each other make long runs, not long indexes.

Defined cases: null and empty texts hold nothing; a row without id is no earlier document and keeps
its whole text; rows of one id are one document, they take nothing from each other; texts of any
length are whole, searched in stretches that overlap; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.arrays import byte_slices, mix
from parley.session import cut

LENGTH = 50
GRAM = 24
REACH = LENGTH - GRAM  # bytes of a context on either side of its anchor
WIDTH = LENGTH + REACH  # of a context
CLOSE = (REACH + 1) // 2
SLICE = 2 << 20
#: Bytes that a bucket of hashes, and one of contexts, should hold.
BUCKET = 2 << 20
INDEXED = 1 << 19
STRETCH = 1 << 18

_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = 0xD6E8FEB86659FD93
_STEP_ON = np.uint64(0x9E3779B97F4A7C15)
_SHORT = np.uint64((1 << 40) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on."""
    size, whole, spans = 1, _CODE[data], {}
    spans[1] = whole
    while size * 2 <= GRAM:
        whole = whole[:-size] * np.uint64(pow(_STEP, size, 1 << 64)) + whole[size:]
        size *= 2
        spans[size] = whole
    while size < GRAM:
        more = max(s for s in spans if s <= GRAM - size)
        n = len(data) - size - more + 1
        whole = whole[:n] * np.uint64(pow(_STEP, more, 1 << 64)) + spans[more][size:size + n]
        size += more
    return np.maximum(mix(whole), np.uint64(1))


def _over_windows(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` neighbouring values."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[:len(values) - (width - size)], values[width - size:]) if size < width else values


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors, ascending, and the hashes there; no string reaches over two texts.

    Every string has one, of the smallest hash in it.
    """
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for begin in range(0, len(data), STRETCH):
        low, high = max(0, begin - REACH), min(len(data), begin + STRETCH + LENGTH)
        if high - low < LENGTH:
            continue
        h = _gram_hashes(data[low:high])
        least = _over_windows(h, REACH + 1, np.minimum)
        ends = offsets[(offsets > low) & (offsets < high)] - low
        for back in range(1, LENGTH):
            at = ends - back
            least[at[(at >= 0) & (at < len(least))]] = 0
        edge = np.zeros(REACH, np.uint64)
        chosen = np.flatnonzero(_over_windows(np.concatenate([edge, least, edge]), REACH + 1, np.maximum) == h)
        chosen = chosen[(chosen + low >= begin) & (chosen + low < begin + STRETCH)]
        places.append(chosen + low)
        hashes.append(h[chosen])
    return _thinned(np.concatenate(places), np.concatenate(hashes), offsets)


def _thinned(places: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer of the equal anchors that stand close, as in a run of one letter.

    Of those at most ``CLOSE`` apart the first in each ``CLOSE`` bytes and the last stay. So the ones
    that stay are less than a string's ``REACH`` + 1 places apart, and no string loses all of its own.
    """
    if not len(places):
        return places, hashes
    text = np.searchsorted(offsets, places, "right")
    tie = np.r_[False, (hashes[1:] == hashes[:-1]) & (np.diff(places) <= CLOSE) & (text[1:] == text[:-1])]
    first = places[np.flatnonzero(~tie)][np.cumsum(~tie) - 1]
    part = (places - first) // CLOSE
    keep = ~tie | np.r_[True, part[1:] != part[:-1]] | np.r_[~tie[1:], True]
    return places[keep], hashes[keep]


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of distinct rows of symbols.

    ``rows`` have a fixed width, ``begin`` and ``end`` tell what of a row is text; ``owner`` is the
    number kept for each row. Symbols are bytes; rows end in a sentinel below all of them.
    """

    def __init__(self, rows: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray):
        sizes = end - begin
        inside = (np.arange(rows.shape[1]) >= begin[:, None]) & (np.arange(rows.shape[1]) < end[:, None])
        n = int(sizes.sum()) + len(rows)
        self.text = np.zeros(n, np.int16)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        of = np.repeat(np.arange(len(rows)), sizes + 1)
        body = np.ones(n, bool)
        body[starts + sizes] = False
        self.text[body] = rows[inside].astype(np.int16) + 1
        order = self._sort(n)
        before = self.text[order - 1]  # of the first suffix: the last sentinel
        new = np.r_[True, before[1:] != before[:-1]]
        self.start = np.flatnonzero(new)
        self.head = before[self.start].astype(np.int64)
        ends = np.r_[self.start[1:], n]
        size = ends - self.start
        self.first, self.last = order[self.start], order[ends - 1]  # sampled suffixes
        self.end = ends - 1
        by_head = np.argsort(self.head, kind="stable")
        self.base = np.empty(len(self.head), np.int64)  # row to which a run's first row leads
        self.base[by_head] = np.cumsum(size[by_head]) - size[by_head]
        self.keys = self.head[by_head] * len(self.head) + by_head
        self.runs = by_head
        # rows that share LENGTH symbols, and the least owner of each such group
        half = self.ranks[28]
        tail = np.minimum(order + (LENGTH - 28), n - 1)
        same = (half[order[1:]] == half[order[:-1]]) & (half[tail[1:]] == half[tail[:-1]])
        self.groups = np.flatnonzero(np.r_[True, ~same])
        self.least = np.minimum.reduceat(owner[of[order]], self.groups)

    def _sort(self, n: int) -> np.ndarray:
        """Suffix order by doubling; keeps the first eight symbols and the ranks of longer prefixes."""
        padded = np.zeros(n + 8, np.uint64)
        padded[:n] = self.text
        # a byte may take 257 values with the sentinel, so seven of them go into 64 bits
        self.packed = np.zeros(n, np.uint64)
        for k in range(7):
            self.packed |= padded[k:k + n] << np.uint64(9 * (6 - k))
        order = np.argsort(self.packed)
        key, size, self.ranks = self.packed[order], 7, {}
        while True:
            new = np.r_[0, np.cumsum(key[1:] != key[:-1])]
            rank = np.empty(n, np.int64)
            rank[order] = new
            if size <= 56:
                self.ranks[size] = rank.astype(np.int32)
            elif new[-1] == n - 1:
                return order
            after = np.zeros(n, np.int64)
            after[:max(n - size, 0)] = rank[size:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key)
            key = key[order]
            size *= 2

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at two text places share, counted to 111."""
        out, last = np.zeros(len(a), np.int64), len(self.text) - 1
        for size in (56, 28, 14, 7):
            i, j = a + out, b + out
            good = (i <= last) & (j <= last)
            rank = self.ranks[size]
            good &= rank[np.minimum(i, last)] == rank[np.minimum(j, last)]
            out += size * good
        i, j = a + out, b + out
        good = (i <= last) & (j <= last)
        differ = self.packed[np.minimum(i, last)] ^ self.packed[np.minimum(j, last)]
        for k in range(6, 0, -1):
            out += good & (differ >> np.uint64(9 * k) == 0)
        return out

    def stream(self, rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(column, lengths, owners)`` from the last column of ``rows`` to the first.

        The matching statistics of all rows at once: how long a match in the index begins at this
        column, and the least owner among all that match ``LENGTH`` symbols, where so many match.
        """
        n, count = len(self.text), len(rows)
        row, place, length = np.zeros(count, np.int64), np.full(count, self.first[0]), np.zeros(count, np.int64)
        none = np.iinfo(np.int64).max
        for column in range(rows.shape[1] - 1, -1, -1):
            live = np.flatnonzero((column >= begin) & (column < end))
            owners = np.full(count, none)
            if len(live):
                symbol = rows[live, column].astype(np.int64) + 1
                run = np.searchsorted(self.start, row[live], "right") - 1
                away = np.flatnonzero(self.head[run] != symbol)
                if len(away):
                    self._jump(live[away], symbol[away], run, away, row, place, length)
                r, at = run, row[live]
                row[live] = self.base[r] + at - self.start[r]
                place[live] -= 1
                length[live] += 1
                lost = length[live] <= 0
                length[live[lost]] = 0
                long = live[length[live] >= LENGTH]
                owners[long] = self.least[np.searchsorted(self.groups, row[long], "right") - 1]
            yield column, length, owners

    def _jump(self, which, symbol, run, away, row, place, length) -> None:
        """Move searches to the nearest run of their symbol that shares most with their match."""
        runs = len(self.head)
        at = np.searchsorted(self.keys, symbol * runs + run[away])
        below = np.minimum(at, runs - 1)
        above = np.maximum(at - 1, 0)
        down, up = self.runs[below], self.runs[above]
        has_down = self.head[down] == symbol
        has_up = self.head[up] == symbol
        shared_down = np.where(has_down, np.minimum(self._shared(place[which], self.first[down]), length[which]), -1)
        shared_up = np.where(has_up, np.minimum(self._shared(place[which], self.last[up]), length[which]), -1)
        use_down = shared_down >= shared_up
        best = np.where(use_down, down, up)
        run[away] = best
        row[which] = np.where(use_down, self.start[best], self.end[best])
        place[which] = np.where(use_down, self.first[best], self.last[best])
        length[which] = np.maximum(shared_down, shared_up)  # -1, then 0, for a symbol that is nowhere


def _packed(column: bytes, size: int) -> bytes:
    return pa.decompress(column, decompressed_size=size, codec="zstd", asbytes=True)


def slices_of(docs: DataFrame, limit: int = SLICE) -> DataFrame:
    """``slice, ids, known, sizes, bytes, data``: texts of a few documents, compressed, in one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else (
                batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for first, end, data, offsets in byte_slices(batch.column(1), limit):
                yield pa.RecordBatch.from_pydict({
                    "slice": [number], "ids": [ids[first:end].tolist()], "known": [known[first:end].tolist()],
                    "sizes": [np.diff(offsets).tolist()], "bytes": [len(data)],
                    "data": [pa.compress(data.tobytes(), codec="zstd", asbytes=True)]},
                    pa.schema([("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("known", pa.list_(pa.bool_())),
                               ("sizes", pa.list_(pa.int64())), ("bytes", pa.int64()), ("data", pa.binary())]))
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(
        run, "slice long, ids array<long>, known array<boolean>, sizes array<long>, bytes long, data binary")


class _Slice:
    """One slice unpacked: texts of rows with an id, their anchors sorted by hash."""

    def __init__(self, row: dict):
        self.number = row["slice"]
        self.ids = np.array(row["ids"], np.int64)
        self.known = np.array(row["known"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.offsets = np.r_[0, np.cumsum(self.sizes)]
        self.data = np.frombuffer(_packed(row["data"], row["bytes"]), np.uint8)
        self.places, hashes = anchors(self.data, self.offsets)
        text = np.searchsorted(self.offsets, self.places, "right") - 1
        use = self.known[text]
        order = np.argsort(hashes[use], kind="stable")
        self.places, self.text = self.places[use][order], text[use][order]
        self.hashes = hashes[use][order]
        new = np.r_[True, self.hashes[1:] != self.hashes[:-1]][:len(self.hashes)]
        self.first = np.flatnonzero(new)
        self.key = np.cumsum(new) - 1  # of each anchor: which distinct hash
        self.distinct = self.hashes[self.first]

    def in_buckets(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """Distinct hashes of each bucket, as places among all distinct ones."""
        of = _bucket(self.distinct, buckets)
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]][:len(of)])
        for begin, end in zip(edges, np.r_[edges[1:], len(of)]):
            yield int(of[order[begin]]), order[begin:end]

    def several(self) -> np.ndarray:
        """Which distinct hashes several documents of this slice have."""
        if not len(self.first):
            return np.zeros(0, bool)
        ids = self.ids[self.text]
        return np.minimum.reduceat(ids, self.first) != np.maximum.reduceat(ids, self.first)

    def shared(self, flags: list[dict], buckets: int) -> np.ndarray:
        """Which distinct hashes other documents have, from the answers of the buckets."""
        out = np.zeros(len(self.distinct), bool)
        bits = {f["bucket"]: np.frombuffer(f["bits"], np.uint8) for f in flags or []}
        for bucket, which in self.in_buckets(buckets):
            if bucket in bits:
                out[which] = np.unpackbits(bits[bucket], count=len(which)).astype(bool)
        return out

    def contexts(self, shared: np.ndarray) -> _Contexts:
        return _Contexts(self, np.flatnonzero(shared[self.key]))


class _Contexts:
    """Distinct contexts of a slice around shared anchors, in a fixed order."""

    def __init__(self, part: _Slice, at: np.ndarray):
        self.places, self.text = part.places[at], part.text[at]
        found, which, n = [np.zeros((0, WIDTH + 2), np.uint8)], [np.zeros(0, np.int64)], 0
        for begin in range(0, len(at), 1 << 15):  # a context takes many times the bytes of its place
            rows, mine = _distinct(self._rows(part, slice(begin, begin + (1 << 15))))
            found.append(rows)
            which.append(mine + n)
            n += len(rows)
        self.rows, again = _distinct(np.concatenate(found))
        self.which = again[np.concatenate(which)]
        self.hashes = np.zeros(len(self.rows), np.uint64)
        self.hashes[self.which] = part.hashes[at]
        self.owner = np.full(len(self.rows), np.iinfo(np.int64).max)
        np.minimum.at(self.owner, self.which, part.ids[self.text])

    def _rows(self, part: _Slice, some: slice) -> np.ndarray:
        places, text = self.places[some], self.text[some]
        low, high = part.offsets[text], part.offsets[text + 1]
        begin = np.maximum(low - (places - REACH), 0)
        end = np.minimum(high - (places - REACH), WIDTH)
        columns = np.arange(WIDTH)
        inside = (columns >= begin[:, None]) & (columns < end[:, None])
        index = np.clip(places[:, None] - REACH + columns, 0, max(len(part.data) - 1, 0))
        rows = np.zeros((len(places), WIDTH + 2), np.uint8)
        rows[:, :WIDTH] = part.data[index] * inside
        rows[:, WIDTH], rows[:, WIDTH + 1] = begin, end
        return rows

    def in_buckets(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        of = _bucket(self.hashes, buckets)
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]][:len(of)])
        for begin, end in zip(edges, np.r_[edges[1:], len(of)]):
            yield int(of[order[begin]]), order[begin:end]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of bytes, and which of them each row is."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    _, first, which = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(),
                                return_index=True, return_inverse=True)
    return rows[first], which


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    # anchors are the smallest hashes of all, so these are spread anew
    return ((mix(hashes + _STEP_ON) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _send_anchors(slices: DataFrame, buckets: int) -> DataFrame:
    """``bucket, slice, n, keys, several``; keys are 40 bits, enough among those of a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            part = _Slice(row)
            several, keys = part.several(), mix(part.distinct) & _SHORT
            packed = keys.view(np.uint8).reshape(-1, 8)[:, :5]
            out = [(b, part.number, len(w), packed[w].tobytes(), np.packbits(several[w]).tobytes())
                   for b, w in part.in_buckets(buckets)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)],
                                                 names=["bucket", "slice", "n", "keys", "several"])

    return slices.mapInArrow(run, "bucket long, slice long, n long, keys binary, several binary")


def _answer_anchors(table: pa.Table) -> pa.Table:
    """Of a bucket: one bit for each key of each slice, whether several documents have it."""
    counts = table["n"].to_numpy()
    raw = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint8).reshape(-1, 5)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, :5] = raw
    several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n)
                              for b, n in zip(table["several"].to_pylist(), counts)]).astype(bool)
    _, which, times = np.unique(keys.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    shared = times > 1
    shared[which[several]] = True
    bits, found, at = [], [], 0
    for n in counts:
        mine = shared[which[at:at + n]]
        bits.append(np.packbits(mine).tobytes())
        found.append(int(mine.sum()))
        at += n
    return pa.table({"slice": table["slice"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary()),
                     "found": pa.array(found, pa.int64())})


def _send_contexts(slices: DataFrame, buckets: int, finer: int) -> DataFrame:
    """``bucket, slice, n, contexts, owners``; slices come with the answers for their anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            part = _Slice(row)
            found = part.contexts(part.shared(row["flags"], buckets))
            out = [(b, part.number, len(w), pa.compress(found.rows[w].tobytes(), codec="zstd", asbytes=True),
                    found.owner[w].tobytes()) for b, w in found.in_buckets(finer)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)],
                                                 names=["bucket", "slice", "n", "contexts", "owners"])

    return slices.mapInArrow(run, "bucket long, slice long, n long, contexts binary, owners binary")


def smaller_matches(rows: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of each context and each string in it: the least owner of all contexts with this string.

    A context whose anchor no other one has holds its strings alone, so it stays out of the index.
    """
    begin, end = rows[:, WIDTH].astype(np.int64), rows[:, WIDTH + 1].astype(np.int64)
    column = np.arange(REACH + 1)
    whole = (column >= begin[:, None]) & (column + LENGTH <= end[:, None])
    out = np.where(whole, owner[:, None], np.iinfo(np.int64).max)
    grams = np.ascontiguousarray(rows[:, REACH:REACH + GRAM]).view(f"V{GRAM}").ravel()
    _, which, times = np.unique(grams, return_inverse=True, return_counts=True)
    met = np.flatnonzero(times[which] > 1)
    if len(met):
        body, begin, end = rows[met, :WIDTH], begin[met], end[met]
        for at, _, owners in RunIndex(body, begin, end, owner[met]).stream(body, begin, end):
            if at <= REACH:
                out[met, at] = owners
    return out


def _answer_contexts(table: pa.Table) -> pa.Table:
    """Of a bucket: for each context of each slice one bit a string, whether a smaller document has it."""
    counts = table["n"].to_numpy()
    packed = [_packed(c, n * (WIDTH + 2)) for c, n in zip(table["contexts"].to_pylist(), counts)]
    rows = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, WIDTH + 2)
    owner = np.frombuffer(b"".join(table["owners"].to_pylist()), np.int64)
    distinct, which = _distinct(rows)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, which, owner)
    found = smaller_matches(distinct, least)
    bits, at = [], 0
    for n in counts:
        mine = found[which[at:at + n]] < owner[at:at + n, None]
        bits.append(pa.compress(np.packbits(mine).tobytes(), codec="zstd", asbytes=True))
        at += n
    return pa.table({"slice": table["slice"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})


def _covered(part: _Slice, found: _Contexts, masks: list[dict], finer: int) -> np.ndarray:
    """Which bytes of a slice go."""
    strings = np.zeros((len(found.rows), REACH + 1), bool)
    bits = {m["bucket"]: m["bits"] for m in masks or []}
    for bucket, which in found.in_buckets(finer):
        n = len(which) * (REACH + 1)
        raw = np.frombuffer(_packed(bits[bucket], (n + 7) // 8), np.uint8)
        strings[which] = np.unpackbits(raw, count=n).reshape(-1, REACH + 1)
    begin, end = found.rows[:, WIDTH].astype(np.int64), found.rows[:, WIDTH + 1].astype(np.int64)
    at = np.arange(REACH + 1)
    whole = (at >= begin[:, None]) & (at + LENGTH <= end[:, None])
    edges = np.zeros(len(part.data) + 1, np.int32)
    for first in range(0, len(found.places), 1 << 16):
        w = found.which[first:first + (1 << 16)]
        later = part.ids[found.text[first:first + (1 << 16)]] > found.owner[w]
        which, j = np.nonzero(np.where(later[:, None], whole[w], strings[w]))
        start = found.places[first + which] - REACH + j
        np.add.at(edges, start, 1)
        np.add.at(edges, start + LENGTH, -1)
    return np.cumsum(edges[:-1]) > 0


def _finish(slices: DataFrame, buckets: int, finer: int, texts: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            part = _Slice(row)
            found = part.contexts(part.shared(row["flags"], buckets))
            gone = _covered(part, found, row["masks"], finer)
            out = []
            for i, known in enumerate(part.known):
                begin, end = part.offsets[i], part.offsets[i + 1]
                mine = gone[begin:end]
                spans = int(np.count_nonzero(mine[1:] & ~mine[:-1]) + (len(mine) > 0 and mine[0]))
                kept = part.data[begin:end][~mine].tobytes()
                out.append((int(part.ids[i]) if known else None, end - begin, int(mine.sum()), spans,
                            kept if texts else hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.binary() if texts else pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return slices.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept "
                                  + ("binary" if texts else "string"))


def without_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every row of ``docs`` = (doc_id, text, ...).

    ``kept`` is what is left of the text, as bytes since a cut may split a letter; without
    ``texts``, the sha256 of these bytes in hex.
    """
    slices = cut(slices_of(docs))
    total = slices.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, 5 * 2 * total // (REACH + 2) // BUCKET + 1)
    flags = cut(_send_anchors(slices, buckets).groupBy("bucket").applyInArrow(
        _answer_anchors, "slice long, bucket long, bits binary, found long"))
    met = flags.agg(F.sum("found")).first()[0] or 0
    finer = max(1, met * WIDTH // INDEXED + 1)
    per_slice = flags.groupBy("slice").agg(F.collect_list(F.struct("bucket", "bits")).alias("flags"))
    marked = slices.join(per_slice, "slice", "left")
    masks = cut(_send_contexts(marked, buckets, finer).groupBy("bucket").applyInArrow(
        _answer_contexts, "slice long, bucket long, bits binary"))
    answers = masks.groupBy("slice").agg(F.collect_list(F.struct("bucket", "bits")).alias("masks"))
    return _finish(marked.join(answers, "slice", "left"), buckets, finer, texts)
