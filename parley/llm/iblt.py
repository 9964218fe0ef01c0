"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines; lines over ``LONG`` bytes are cut at sentence ends) become 64-bit
digests, a repeated paragraph a new one each time. A digest is added to one cell in each of three
tables: its count, its sum and the sum of its check. Cells of two texts subtract; what both have
vanishes, and cells left with one digest give it away, whose removal lays others open, until the
differing digests are all known. If cells stay closed, the two are sketched again four times larger.
The likeness is shared digests over all digests.

Which document comes next is found without ordering the table in one place: ids are dealt to ranges
of about ``ROWS_PER_RANGE`` rows, and each range also gets the document that follows its last one.

Defined cases: a null text is an empty one; two empty texts are alike with 1; a single document is
its own next; rows without id come last in descending order, rows of one id are ordered by a hash
of their text; an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.arrays import byte_slices, mix, span_hashes

CELLS = 8  # in each of three tables of a fingerprint; a power of two
TABLES = 3
LONG = 400
ROWS_PER_RANGE = 8192
COMPARED_BYTES = 256 << 10  # texts compared at once; a longer text is compared alone, and whole
_NO_ID = -(2**63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = [mix(np.array([s], np.uint64)) for s in (3, 5, 7, 11)]


def digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of each text, and where each text's begin."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    newline = data == 10
    edges = np.r_[np.flatnonzero(newline) + 1, offsets]  # paragraphs begin here
    stop = np.isin(data[:-1], (33, 46, 63)) & (data[1:] == 32)
    sentence = np.flatnonzero(stop) + 2
    edge_line = np.unique(np.r_[0, edges])
    size = np.diff(np.r_[edge_line, n])
    if len(sentence):
        line = np.searchsorted(edge_line, sentence, "right") - 1
        sentence = sentence[size[line] > LONG]
    begin = np.unique(np.r_[edges, sentence])
    begin = begin[begin < n]
    end = np.r_[begin[1:], n]
    end = end - (data[end - 1] == 10)
    full = end > begin
    begin, end = begin[full], end[full]
    keys = span_hashes(data, begin, end)
    text = np.searchsorted(offsets, begin, "right") - 1
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])][:len(keys)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    keys = mix(keys + (np.arange(len(keys)) - first).astype(np.uint64) * _ODD)
    return keys, np.searchsorted(text, np.arange(len(offsets)))


def add(cells: np.ndarray, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray, size: int) -> None:
    """Adds digests to ``cells[field, owner * 3 * size + ...]``: counts, sums, sums of checks."""
    signed = sign.astype(np.int64).view(np.uint64)
    check = mix(keys ^ _SALTS[3])
    for table in range(TABLES):
        at = owner * (TABLES * size) + table * size + (
            mix(keys ^ _SALTS[table]) & np.uint64(size - 1)).astype(np.int64)
        np.add.at(cells[0], at, signed)
        np.add.at(cells[1], at, keys * signed)
        np.add.at(cells[2], at, check * signed)


def sketch(keys: np.ndarray, at: np.ndarray, size: int = CELLS) -> np.ndarray:
    """Cells of every text: fields by texts by cells."""
    n = len(at) - 1
    cells = np.zeros((3, n * TABLES * size), np.uint64)
    add(cells, np.repeat(np.arange(n), np.diff(at)), keys, np.ones(len(keys), np.int64), size)
    return cells.reshape(3, n, TABLES * size)


def spell(cells: np.ndarray) -> list[str]:
    """Fingerprints as text: counts, sums and the upper halves of the checks of all cells."""
    rows = np.concatenate([cells[0].astype("<u4").view(np.uint8).reshape(cells.shape[1], -1),
                           cells[1].astype("<u8").view(np.uint8).reshape(cells.shape[1], -1),
                           (cells[2] >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(cells.shape[1], -1)],
                          axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in rows]


def peel(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, digest, sign)`` of all that subtracted sketches give away, and which are not empty."""
    n = cells.shape[1]
    flat = cells.reshape(3, -1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.flatnonzero(flat[0] != 0)
    while len(look):
        count = flat[0, look].view(np.int64)
        single = look[np.abs(count) == 1]
        sign = flat[0, single]
        keys = flat[1, single] * sign
        good = mix(keys ^ _SALTS[3]) == flat[2, single] * sign
        single, keys, sign = single[good], keys[good], sign[good].view(np.int64)
        if not len(single):
            break
        owner = single // (TABLES * size)
        _, first = np.unique(mix(owner.astype(np.uint64) * _ODD) ^ keys, return_index=True)
        owner, keys, sign = owner[first], keys[first], sign[first]
        add(flat, owner, keys, -sign, size)
        found.append((owner, keys, sign))
        look = look[flat[0, look] != 0]
    closed = flat.reshape(3, n, -1).any(axis=(0, 2))
    empty = [np.zeros(0, t) for t in (np.int64, np.uint64, np.int64)]
    return (*(np.concatenate(x) for x in (zip(*found) if found else [[e] for e in empty])), closed)


def _gather(keys: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = at[which + 1] - at[which]
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[which] - (ends - size), size)
    return keys[place], np.repeat(np.arange(len(which)), size)


def differences(keys: np.ndarray, at: np.ndarray, one: np.ndarray, two: np.ndarray,
                size: int = CELLS) -> np.ndarray:
    """How many digests differ between texts ``one[i]`` and ``two[i]``."""
    out = np.zeros(len(one), np.int64)
    todo = np.arange(len(one))
    while len(todo):
        cells = np.zeros((3, len(todo) * TABLES * size), np.uint64)
        for side, sign in ((one, 1), (two, -1)):
            k, owner = _gather(keys, at, side[todo])
            add(cells, owner, k, np.full(len(k), sign, np.int64), size)
        owner, _, _, closed = peel(cells.reshape(3, len(todo), -1), size)
        out[todo] = np.bincount(owner, minlength=len(todo))
        total = (at[one + 1] - at[one] + at[two + 1] - at[two])[todo]
        hopeless = closed & (size > 64 * (total + 16))  # digests that share all their cells
        for i in todo[hopeless].tolist():
            out[i] = len(np.setxor1d(keys[at[one[i]]:at[one[i] + 1]], keys[at[two[i]]:at[two[i] + 1]]))
        todo, size = todo[closed & ~hopeless], size * 4
    return out


def likeness(keys: np.ndarray, at: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Shared digests over all digests of each pair; 1 for two empty texts."""
    apart = differences(keys, at, one, two)
    total = at[one + 1] - at[one] + at[two + 1] - at[two]
    return np.where(total > 0, (total - apart) / np.maximum(total + apart, 1), 1.0)


def with_next(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``range, copy, key, doc_id, text`` dealt out and ordered so that the next row is the next document.

    Rows with ``copy`` only lend their text to the last row of the range.
    """
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), "text")
    ranges = max(1, -(-keyed.count() // rows_per_range))
    bounds = np.unique(np.array(keyed.approxQuantile(
        "key", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges)) if ranges > 1 else [], np.float64))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(0).to_numpy().astype(np.float64), "left")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32())], names=["key", "range"])

    tops = {r.range: r.top for r in keyed.select("key").mapInArrow(ranged, "key long, range int")
            .groupBy("range").agg(F.max("key").alias("top")).collect()}  # a row for each range
    filled = sorted(tops)
    lends = {tops[low]: high for low, high in zip(filled, filled[1:] + filled[:1])}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy()
            at = np.searchsorted(bounds, keys.astype(np.float64), "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at), pa.array(np.zeros(len(at), bool))],
                names=["doc_id", "key", "text", "range", "copy"])
            lent = [i for i, k in enumerate(keys.tolist()) if k in lends]
            if lent:
                some = batch.take(pa.array(lent))
                to = [lends[k] for k in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(to, pa.int32()), pa.array(np.ones(len(to), bool))],
                    names=["doc_id", "key", "text", "range", "copy"])

    dealt = keyed.mapInArrow(deal, "doc_id long, key long, text string, range int, copy boolean")
    return (dealt.repartitionById(ranges, F.col("range"))
            .sortWithinPartitions("range", "copy", F.desc("key"), F.xxhash64("text")))


def fingerprints(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike they are.

    The edited text has the first ``floor(n / 2)`` characters of the next document, in descending
    order of the id, in place of as many at its end.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose next is not known yet
        for batch in batches:
            copies = batch.column(2).to_numpy(zero_copy_only=False)
            for first, end, _, _ in byte_slices(batch.column(1), COMPARED_BYTES):
                rows = [] if held is None else [held]
                lent = False
                for i in range(first, end):
                    if copies[i]:
                        if held is None and not rows:
                            break
                        rows.append((None, batch.column(1)[i].as_py()))
                        lent = True
                        break
                    rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
                if len(rows) > 1:
                    yield _compare(rows)
                held = None if lent else rows[-1] if rows else None
                if lent:
                    return

    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    return with_next(docs, rows_per_range).select("doc_id", "text", "copy").mapInArrow(run, schema)


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    """All rows but the last against their edited texts and the rows after them."""
    texts = [t for _, t in rows]
    n = len(texts) - 1
    edited = []
    for text, after in zip(texts, texts[1:]):
        half = len(text) // 2
        edited.append(text[:len(text) - half] + after[:half])
    raw = [t.encode() for t in texts + edited]
    offsets = np.r_[0, np.cumsum([len(r) for r in raw])]
    keys, at = digests(np.frombuffer(b"".join(raw), np.uint8), offsets)
    names = spell(sketch(keys, at))
    own = np.arange(n)
    return pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in rows[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
         pa.array([hashlib.sha256(r).hexdigest() for r in raw[n + 1:]]),
         pa.array(names[:n]), pa.array(names[n + 1:]),
         pa.array(likeness(keys, at, own, n + 1 + own)), pa.array(likeness(keys, at, own, own + 1))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
               "near_edited", "near_next"])
