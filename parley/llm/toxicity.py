"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its n-grams of bytes (lower case, everything but letters and digits read as a
space). Each n-gram's share among toxic and other labelled texts gives a log ratio; a logistic
classifier is fitted to texts whose features are those ratios. N-grams whose shares differ by less
than ``LEAST_Z`` standard errors, as chance would make them, are left out, which keeps long texts
from adding up noise; all others count, however many they are.

Fitting uses at most ``max_rows`` labelled texts, half of them toxic, taken in the order of a hash
of the id. Their features stay in a table; each step of the fit is a job whose tasks sum the gradient
over it, and the driver holds weights only. Scoring reads every text whole.

Defined cases: a null or empty text has no n-gram and gets the score of the bias alone; several
labels of one id count as toxic if one is; null labels and labels without a text teach nothing;
without texts of both classes the score is the share of toxic ones, or 0; a null id is scored, and
teaches nothing; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.arrays import LOWER, byte_slices, scored, text_sums
from parley.session import cut

SIZES = (4, 5, 6)
BITS = 20
MAX_ROWS = 20_000
LEAST_Z = 4.0  # standard errors between an n-gram's two shares
DECAY = 1e-4
STOP = 1e-3  # of the gradient's first size
GRADIENT_TASKS = 8
GRADIENT_TEXTS = 256
THRESHOLD = 0.7
SCORE_BYTES = 1 << 16
COUNT_BYTES = 1 << 17  # bytes of a slice: n-grams take over a hundred times their bytes while they are sorted

_AS_SPACE = LOWER.copy()
_AS_SPACE[[b for b in range(128) if not chr(b).isalnum()]] = 32
_CODE = (np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = np.uint64(0xD1342543DE82EF95)


def ngrams(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None
           ) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` of every distinct n-gram of each text, sorted; only ``wanted`` features."""
    padded = np.insert(_AS_SPACE[data], offsets, 32)
    begin = offsets + np.arange(len(offsets))  # the space before each text, and one at the end
    codes = _CODE[padded]
    found = []
    for n in SIZES:
        count = len(padded) - n + 1
        if count <= 0:
            continue
        total = codes[:count].copy()
        for j in range(1, n):
            total *= _STEP
            total += codes[j:j + count]
        feature = (((total ^ (total >> np.uint64(31))) * (_STEP + np.uint64(2 * n)))
                   >> np.uint64(64 - BITS)).astype(np.int64)
        good = np.ones(count, bool)
        for back in range(1, n - 1):  # no n-gram reaches over the space between two texts
            at = begin[1:-1] - back
            good[at[(at >= 0) & (at < count)]] = False
        at = np.flatnonzero(good if wanted is None else good & wanted[feature])
        found.append((np.searchsorted(begin, at, "right") - 1) << BITS | feature[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.unique(np.concatenate(found))
    return keys >> BITS, keys & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray  # by feature: fitted weight times log-count ratio
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, feature = ngrams(data, offsets, self.weights != 0)
        ends = np.searchsorted(text, np.arange(len(offsets)))
        total = text_sums(self.weights[feature], ends) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for first, end, data, offsets in byte_slices(batch.column(0), COUNT_BYTES):
            text, feature = ngrams(data, offsets)
            for y in (0, 1):
                counts[y] += np.bincount(feature[toxic[first:end][text] == y], minlength=1 << BITS)
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(counts[1, used]), pa.array(counts[0, used])],
        names=["feature", "pos", "neg"])


def sample(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """``text, toxic`` of at most ``max_rows`` labelled rows, as many of either class if it has them."""
    known = (labels.where("doc_id is not null and toxic is not null")
             .groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
             .where(learn))
    drawn = None
    for y in (0, 1):
        side = (known.where(F.col("toxic") == y)
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2))
        drawn = side if drawn is None else drawn.union(side)
    return (docs.where("text is not null").select("doc_id", "text")
            .join(F.broadcast(drawn), "doc_id").select("text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS) -> Model:
    """``learn`` tells from ``doc_id`` whether a row may be learnt from."""
    train = cut(sample(docs, labels, learn, max_rows))
    sizes = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Model(np.zeros(1 << BITS, np.float32), 60.0 if pos else -60.0)
    share = (F.col("pos") + F.col("neg")) / (pos + neg)
    counts = (train.mapInArrow(_class_counts, "feature long, pos long, neg long")
              .groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
              .withColumn("z", F.abs(F.col("pos") / pos - F.col("neg") / neg)
                          / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-12))
              .withColumn("ratio", F.log((F.col("pos") + 1) / (pos + 2)) - F.log((F.col("neg") + 1) / (neg + 2)))
              .where(F.col("z") >= LEAST_Z).select("feature", "ratio").toArrow())
    chosen = counts.column("feature").to_numpy()
    order = np.argsort(chosen)
    chosen, ratio = chosen[order], counts.column("ratio").to_numpy()[order]
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in byte_slices(batch.column(0), COUNT_BYTES):
                text, feature = ngrams(data, offsets, place >= 0)
                ends = np.searchsorted(text, np.arange(len(offsets)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, end - first),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[feature]))],
                    names=["toxic", "features"])

    found = cut(train.mapInArrow(rows, "toxic int, features array<int>")).coalesce(GRADIENT_TASKS)
    fitted = _minimum(lambda w: _loss(found, ratio, w, pos + neg), np.zeros(len(chosen) + 1))
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = fitted[:-1] * ratio
    return Model(weights, float(fitted[-1]))


def _loss(found: DataFrame, ratio: np.ndarray, w: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """Mean loss over all texts with the penalty on large weights, and its gradient, summed in the tasks."""
    scaled = w[:-1] * ratio

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope = 0.0, np.zeros(len(w))
        for batch in batches:
            for first in range(0, batch.num_rows, GRADIENT_TEXTS):
                some = batch.slice(first, GRADIENT_TEXTS)
                y = some.column(0).to_numpy().astype(np.float64)
                feature = some.column(1).flatten().to_numpy()
                text = np.repeat(np.arange(len(y)), some.column(1).value_lengths().to_numpy())
                z = np.bincount(text, scaled[feature], len(y)) + w[-1]
                miss = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
                loss += float((np.logaddexp(0, z) - y * z).sum())
                slope[:-1] += np.bincount(feature, miss[text], len(scaled)) * ratio
                slope[-1] += miss.sum()
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())],
                                         names=["loss", "slope"])

    parts = found.mapInArrow(part, "loss double, slope binary").collect()  # at most GRADIENT_TASKS rows
    slope = sum((np.frombuffer(r.slope) for r in parts), np.zeros(len(w))) / n
    slope[:-1] += DECAY * w[:-1]
    return sum(r.loss for r in parts) / n + DECAY / 2 * float(w[:-1] @ w[:-1]), slope


def _minimum(loss_at: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray,
             rounds: int = 60, memory: int = 6) -> np.ndarray:
    """Where a smooth convex function is least, by limited-memory quasi-Newton steps."""
    loss, slope = loss_at(w)
    done = STOP * np.linalg.norm(slope)
    moves: list[tuple[np.ndarray, np.ndarray]] = []  # steps and what they changed in the gradient
    for _ in range(rounds):
        if np.linalg.norm(slope) <= done:
            break
        way, shares = slope.copy(), []
        for step, change in reversed(moves):
            shares.append((step @ way) / (step @ change))
            way -= shares[-1] * change
        way *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / np.linalg.norm(slope)
        for (step, change), share in zip(moves, reversed(shares)):
            way += (share - (change @ way) / (step @ change)) * step
        length = 1.0
        while True:  # shorter until the loss falls as the gradient promises
            there, slope_there = loss_at(w - length * way)
            if there <= loss - 1e-4 * length * (slope @ way):
                break
            length /= 4
            if length < 1e-6:
                return w
        step, change = -length * way, slope_there - slope
        if step @ change > 1e-14:
            moves = (moves + [(step, change)])[-memory:]
        w, loss, slope = w + step, there, slope_there
    return w


def scores(docs: DataFrame, model: Model, keep: list[str], name: str = "score",
           text: str = "text") -> DataFrame:
    """``keep`` columns and the score of every row."""
    return scored(docs, keep, text, f"`{name}` double",
                  lambda data, offsets: [model.scores(data, offsets)], SCORE_BYTES)
