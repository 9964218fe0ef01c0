"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes, frozen after counting. A byte costs
the bits of its probability in the longest context that has been followed by it, plus the bits of
the escapes from the longer ones (escape method C: a context seen T times before D different bytes
escapes with D / (T + D)); at the end stands one of 256 bytes. A text is of the language that codes
it in the fewest bits; its score is that language's share when all are weighed by 2**-bits.

Counting reads every text that may be learnt from, and scoring every text, whole. Tasks add up the
windows of four bytes that they read, so a tree grows with the different windows of its language. ASCII letters are read in lower case.

A share tells languages apart, not whether the text is in one at all. For that, ``limits`` codes texts
with trees that have not counted them, and their first 4, 16, 64, ... bytes, and takes the spread of the bits a
byte for each language and length; ``predict_fitting`` says whether a text stays within it.

Defined cases: null, empty or letterless text is ``und`` with score 0; null languages teach nothing;
languages with equal bits give the first by name; without any learnt language all is ``und``; a null
id is predicted and teaches nothing; repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.arrays import LOWER, KeyIndex, byte_slices, scored, text_sums
from parley.session import cut

MAX_ROWS = 2_000
SAMPLE_PARTS = 64
#: Lengths are told apart by powers of four; the limit lies above nine tenths of the texts by ``SPREADS``
#: times the distance from the median to the third quartile. A language and length with fewer than ``LEAST_HELD``
#: texts has no limit of its own and takes the nearest shorter one's, or none.
LENGTHS = 10
SPREADS = 16
LEAST_SPREAD = 0.03  # of the median
LEAST_HELD = 8
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Four bytes ending at each byte of each text, as one number; zeros stand before a text."""
    low = LOWER[data].astype(np.uint32)
    out = low.copy()
    for back in (1, 2, 3):
        out[back:] |= low[:-back] << np.uint32(8 * back) if len(low) > back else np.uint32(0)
    starts = offsets[:-1][np.diff(offsets) > 0]
    ends = offsets[1:][np.diff(offsets) > 0]
    for i, mask in enumerate((0xFF, 0xFFFF, 0xFFFFFF)):
        at = starts + i
        at = at[at < ends]
        out[at] &= np.uint32(mask)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, key, n, kept``, summed over what the task has read since it last gave some out."""
    place: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        of = (keys >> np.uint64(33)).astype(np.int64)
        aside = (keys >> np.uint64(32)) & np.uint64(1) == 1
        return pa.RecordBatch.from_arrays(
            [pa.array(list(place), pa.string()).take(pa.array(of)),
             pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n), pa.array(np.where(aside, 0, n))],
            names=["lang", "key", "n", "kept"])

    for batch in batches:
        of = np.array([place.setdefault(name, len(place)) for name in batch.column(0).to_pylist()], np.uint64)
        group = of << np.uint64(33) | batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(32)
        for first, end, data, offsets in byte_slices(batch.column(1)):
            found = np.unique(_windows(data, offsets) | np.repeat(group[first:end], np.diff(offsets)),
                              return_counts=True)
            held.append(found)
            size += len(found[0])
            if size > 2_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield out(*held[0])
                    held, size = [], 0
    if held:
        yield out(*merged())


@dataclass
class Model:
    langs: list[str]
    four: KeyIndex
    four_bits: np.ndarray  # of the last of four bytes after the three
    three: KeyIndex
    three_bits: np.ndarray  # of the last of three bytes after the two
    three_escape: np.ndarray  # of leaving the three bytes as a context
    two_bits: np.ndarray
    two_escape: np.ndarray

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of every text in every language."""
        windows = _windows(data, offsets)
        at = self.four.find(windows)
        cost = self.four_bits[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            rest = windows[new]
            context, tail = self.three.find(rest >> np.uint32(8)), self.three.find(rest & np.uint32(0xFFFFFF))
            two = rest & np.uint32(0xFFFF)
            lower = np.where((tail >= 0)[:, None], self.three_bits[tail],
                             self.two_escape[(rest >> np.uint32(8)) & np.uint32(0xFFFF)] + self.two_bits[two])
            cost[new] = lower + np.where((context >= 0)[:, None], self.three_escape[context], 0)
        return text_sums(cost, offsets)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> list:
        return self.judge(data, offsets, {})[:2]

    def judge(self, data: np.ndarray, offsets: np.ndarray, most: dict[str, np.ndarray]) -> list:
        """Language and score of each text, and whether its bits a byte are within ``most``."""
        n = len(offsets) - 1
        out, score, fits = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
        good = has_letter(data, offsets)
        if self.langs and good.any():
            bits = self.bits(data, offsets)
            best = bits.argmin(axis=1)
            gap = np.minimum((bits - bits[np.arange(n), best][:, None]), 1000)
            share = 1 / (2.0 ** -gap).sum(axis=1)
            out[good] = np.array(self.langs, object)[best][good]
            score[good] = share[good]
            sizes = np.diff(offsets)
            bound = np.array([most.get(name, np.full(LENGTHS, np.inf)) for name in self.langs])
            rate = bits[np.arange(n), best] / np.maximum(sizes, 1)
            fits[good] = (rate <= bound[best, length_class(sizes)])[good]
        return [out, score, fits]


def length_class(sizes: np.ndarray) -> np.ndarray:
    """The largest power of four that each size reaches, at most ``LENGTHS - 1``."""
    powers = 4 ** np.arange(LENGTHS)
    return np.maximum(np.searchsorted(powers, sizes, "right") - 1, 0)


def limits(docs: DataFrame, learn: Column, model: Model) -> dict[str, np.ndarray]:
    """Most bits a byte that a text of each language may take, by length class.

    ``model`` has counted no text that stands aside; those are coded with it, equal ones count once.
    """
    held = _known(docs, learn).where("aside").withColumn("text_hash", F.xxhash64("text"))
    place = {name: i for i, name in enumerate(model.langs)}

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, end, data, offsets in byte_slices(batch.column(1)):
                good = has_letter(data, offsets)
                for i in range(end - first):
                    lang, text = langs[first + i], data[offsets[i]:offsets[i + 1]]
                    if lang not in place or not good[i]:
                        continue
                    ends = 4 ** np.arange(length_class(np.array([len(text)]))[0] + 1)
                    starts = np.r_[0, np.cumsum(ends)]
                    bits = model.bits(np.concatenate([text[:e] for e in ends]), starts)[:, place[lang]] / ends
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(ends), pa.string()), pa.array(np.arange(len(ends))),
                         pa.array(bits.astype(np.float64)), pa.array([hashes[first + i]] * len(ends), pa.int64())],
                        names=["lang", "length", "rate", "text_hash"])

    # rates are told apart to a ten-thousandth of a bit, so no group holds a rate for each text
    quarters = F.array(*map(F.lit, (0.5, 0.75, 0.9)))
    spread = (held.select("lang", "text", "text_hash")
              .mapInArrow(rates, "lang string, length long, rate double, text_hash long")
              .groupBy("lang", "length", "text_hash").agg(F.round(F.min("rate"), 4).alias("rate"))
              .groupBy("lang", "length", "rate").agg(F.count("*").alias("n"))
              .groupBy("lang", "length").agg(F.sum("n").alias("n"), F.percentile("rate", quarters, F.col("n")).alias("q"))
              .collect())  # LENGTHS rows a language
    out: dict[str, np.ndarray] = {}
    for r in sorted(spread, key=lambda r: (r.lang, r.length)):
        if r.n >= LEAST_HELD:
            bound = r.q[2] + SPREADS * max(r.q[1] - r.q[0], LEAST_SPREAD * r.q[0])
            out.setdefault(r.lang, np.full(LENGTHS, np.inf))[r.length:] = bound
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = text_sums(_LETTER[data].astype(np.float32), offsets) > 0
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        raw = data[offsets[i]:offsets[i + 1]]
        if (raw >= 0x80).any():
            out[i] = any(c.isalpha() for c in raw.tobytes().decode("utf-8", "ignore"))
    return out


def sample(docs: DataFrame, learn: Column, max_rows: int = MAX_ROWS, more: list[str] = []) -> DataFrame:
    """``lang, text`` (and the columns ``more``) of at most ``max_rows`` rows of each language."""
    def first(rows: DataFrame, *group: str) -> DataFrame:
        by_hash = Window.partitionBy(*group).orderBy(F.xxhash64("doc_id"), "doc_id")
        return rows.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= max_rows)

    # what is first among all of a language is first in its part of them, so parts are cut down alone
    known = (docs.where("lang is not null and text is not null").where(learn)
             .select("doc_id", "lang", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(SAMPLE_PARTS)).alias("part")))
    drawn = first(first(known, "lang", "part"), "lang").select("doc_id", "lang").distinct()
    return (docs.select("doc_id", "lang", "text").where("text is not null")
            .join(F.broadcast(drawn), ["doc_id", "lang"]).select("lang", "text", *more))


def _known(docs: DataFrame, learn: Column) -> DataFrame:
    """``lang, text, aside`` of all rows to learn from; a quarter of the texts, by hash, stands aside for limits."""
    return docs.where("lang is not null and text is not null").where(learn).select(
        "lang", "text", (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("aside"))


def _windows_of(docs: DataFrame, learn: Column) -> DataFrame:
    """``lang, key, n, kept``: how often each window occurs in all texts, and in those not standing aside."""
    return (_known(docs, learn).mapInArrow(_count, "lang string, key long, n long, kept long")
            .groupBy("lang", "key").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept")))


def fit(docs: DataFrame, learn: Column) -> Model:
    """``learn`` tells from ``doc_id`` whether a row may be learnt from."""
    return _model(_windows_of(docs, learn).select("lang", "key", "n").toArrow())


def fit_with_limits(docs: DataFrame, learn: Column) -> tuple[Model, dict[str, np.ndarray]]:
    """The model of all texts to learn from, and the limits that those standing aside show."""
    counted = cut(_windows_of(docs, learn))
    part = _model(counted.where("kept > 0").select("lang", "key", F.col("kept").alias("n")).toArrow())
    most = limits(docs, learn, part)
    return _model(counted.select("lang", "key", "n").toArrow()), most


def _model(table: pa.Table) -> Model:
    coded = pa.chunked_array(table.column("lang"), pa.string()).dictionary_encode().combine_chunks()
    if isinstance(coded, pa.ChunkedArray):
        coded = pa.array([], pa.string()).dictionary_encode()
    listed, langs = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    keys = table.column("key").to_numpy().astype(np.uint64)
    n = table.column("n").to_numpy().astype(np.float64)
    names = sorted(listed)
    four = np.unique(keys)
    three = np.unique(np.concatenate([four >> np.uint64(8), four & np.uint64(0xFFFFFF)]))
    sizes = len(names)
    four_bits = np.zeros((len(four), sizes), np.float32)
    three_bits, three_escape = np.zeros((2, len(three), sizes), np.float32)
    two_bits, two_escape = np.zeros((2, 1 << 16, sizes), np.float32)
    for i, name in enumerate(names):
        own = langs == listed.index(name)
        below = np.full(1, 8.0)  # bits of a byte in no context at all
        for order in range(4):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            grams, total = _totals(keys[own] & mask, n[own])
            contexts, seen = _totals(grams >> np.uint64(8), total)
            different = np.unique(grams >> np.uint64(8), return_counts=True)[1]
            escape = np.log2(seen + different) - np.log2(different)
            bits = (np.log2(seen + different)[np.searchsorted(contexts, grams >> np.uint64(8))]
                    - np.log2(total))
            every = (np.arange(1 << 8 * (order + 1), dtype=np.uint64) if order < 2
                     else three if order == 2 else four)
            cost = _values(contexts, escape, every >> np.uint64(8)) + (
                below[0] if order == 0 else
                below[(every & np.uint64((1 << 8 * order) - 1)).astype(np.int64)] if order <= 2 else
                below[np.searchsorted(three, every & np.uint64(0xFFFFFF))])
            at = np.searchsorted(every, grams)
            cost[at] = bits
            below = cost
            if order == 1:
                two_bits[:, i] = cost
            elif order == 2:
                three_bits[:, i] = cost
                two_escape[:, i] = _values(contexts, escape, np.arange(1 << 16, dtype=np.uint64))
            elif order == 3:
                four_bits[:, i] = cost
                three_escape[:, i] = _values(contexts, escape, three)
    return Model(names, KeyIndex(four), four_bits, KeyIndex(three), three_bits, three_escape,
                 two_bits, two_escape)


def _totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, n, len(found))


def _values(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Value of each asked key, 0 where it is not there."""
    out = np.zeros(len(asked))
    if len(keys):
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = keys[at] == asked
        out[hit] = values[at[hit]]
    return out


def predict(docs: DataFrame, model: Model, keep: list[str], lang: str = "lang_pred",
            score: str = "score", text: str = "text") -> DataFrame:
    """``keep`` columns, the predicted language of every row and its score."""
    return scored(docs, keep, text, f"`{lang}` string, `{score}` double", model.predict)


def predict_fitting(docs: DataFrame, model: Model, most: dict[str, np.ndarray], keep: list[str], lang: str,
                    score: str, fits: str, text: str = "text") -> DataFrame:
    """As ``predict``, with whether each text is within the limits of its language."""
    return scored(docs, keep, text, f"`{lang}` string, `{score}` double, `{fits}` boolean",
                  lambda data, offsets: model.judge(data, offsets, most))
