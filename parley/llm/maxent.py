"""LM scoring with a hashed maximum-entropy model.

A token falls into one of 256 buckets by its hash, 16 classes of 16. The features of a place are the
word before, the word before that (a skip) and both together, each hashed to a row of weights. One
softmax gives the class, a second the bucket inside it; inside a bucket a token has its smoothed
share of the bucket's count, so that all tokens' probabilities sum to one. Biases are the counts'
logarithms. Weights are trained by gradient steps in the tasks that hold the texts; after each round
over a share of the training texts the tasks' changes are averaged, weighted by tokens. Every
training text is used once. Tasks score in numpy batches.

Counts are kept for all tokens. Those with at least one ``2**21``-th of all training tokens are at
most that many and go to the tasks; the rest are joined as (text, token, times) rows, so no frequent
token meets in one task.

Tokens are known by 64-bit hashes of their bytes.

Defined cases: a null text is an empty one, of its end token alone; rows without id teach nothing and
are scored; repeated rows are scored alike and each counts; without training texts every token's
base probability is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.arrays import KeyIndex, byte_slices, mix, signed, text_sums, words
from parley.session import cut

END = np.uint64(0x5BF0A8B1D3C4E697)  # the token that ends a text
BEFORE = (np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179))  # stand before its first
CLASSES = 16
PER_CLASS = 16
CLASS_ROWS = 1 << 12
WORD_ROWS = 1 << 13
FEATURES = 3
ROUNDS = 2
RATE = 0.15
STEP_TOKENS = 8192
LISTED = 1 << 21
BLOCK = 1 << 14
_SALT = mix(np.arange(1, FEATURES + 1, dtype=np.uint64))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, and where each text's begin."""
    hashes, at = words(data, offsets)
    return np.insert(hashes, at[1:], END), at + np.arange(len(at))


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CLASSES * PER_CLASS - 1)).astype(np.int64)


def contexts(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the features of every place: one row for each feature."""
    one = np.empty_like(hashes)
    two = np.empty_like(hashes)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    starts = at[:-1]
    one[starts] = BEFORE[0]
    two[starts] = BEFORE[1]
    second = starts + 1
    second = second[second < at[1:]]
    two[second] = BEFORE[0]
    return np.stack([mix(one ^ _SALT[0]), mix(two ^ _SALT[1]), mix(one * np.uint64(3) + two ^ _SALT[2])])


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(token, n)``, summed over what the task has read since it last gave some out."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n)], names=["token", "n"])

    for batch in batches:
        for _, _, data, offsets in byte_slices(batch.column(0)):
            found = np.unique(tokens(data, offsets)[0], return_counts=True)
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
    class_bias: np.ndarray
    word_bias: np.ndarray  # by class
    class_weights: np.ndarray  # feature rows by class
    word_weights: np.ndarray  # feature and class rows by bucket of the class

    def flat(self) -> np.ndarray:
        return np.concatenate([self.class_weights.ravel(), self.word_weights.ravel()])

    def load(self, flat: np.ndarray) -> None:
        n = self.class_weights.size
        self.class_weights = flat[:n].reshape(self.class_weights.shape).copy()
        self.word_weights = flat[n:].reshape(self.word_weights.shape).copy()

    def rows(self, context: np.ndarray, cls: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        first = [(c & np.uint64(CLASS_ROWS - 1)).astype(np.int64) + i * CLASS_ROWS for i, c in enumerate(context)]
        second = [((c >> np.uint64(16)) + cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                   & np.uint64(WORD_ROWS - 1)).astype(np.int64) + i * WORD_ROWS for i, c in enumerate(context)]
        return first, second

    @staticmethod
    def _likely(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Softmax by place before its division, and what to divide by.

        The largest is found over columns and sums are products with ones: a row is too short to reduce alone.
        """
        z = weights.take(rows[0], axis=0)
        z += bias
        for r in rows[1:]:
            z += weights.take(r, axis=0)
        z -= np.ascontiguousarray(z.T).max(axis=0)[:, None]
        np.exp(z, out=z)
        return z, z @ np.ones(z.shape[1], z.dtype)

    def probabilities(self, context: np.ndarray, aim: np.ndarray) -> np.ndarray:
        """Probability of each place's bucket."""
        out = np.empty(len(aim), np.float64)
        for a in range(0, len(aim), STEP_TOKENS):
            b = min(len(aim), a + STEP_TOKENS)
            cls, word = aim[a:b] // PER_CLASS, aim[a:b] % PER_CLASS
            first, second = self.rows(context[:, a:b], cls)
            at = np.arange(b - a)
            z, whole = self._likely(self.class_weights, first, self.class_bias)
            out[a:b] = z[at, cls].astype(np.float64) / whole
            z, whole = self._likely(self.word_weights, second, self.word_bias.take(cls, axis=0))
            out[a:b] *= z[at, word].astype(np.float64) / whole
        return out

    def learn(self, context: np.ndarray, aim: np.ndarray, sizes: list[np.ndarray]) -> None:
        """Gradient steps over the places in order; ``sizes`` has each row's squared gradients so far."""
        for a in range(0, len(aim), STEP_TOKENS):
            b = min(len(aim), a + STEP_TOKENS)
            cls, word = aim[a:b] // PER_CLASS, aim[a:b] % PER_CLASS
            first, second = self.rows(context[:, a:b], cls)
            at = np.arange(b - a)
            for weights, rows, bias, hit, size in (
                    (self.class_weights, first, self.class_bias, cls, sizes[0]),
                    (self.word_weights, second, self.word_bias.take(cls, axis=0), word, sizes[1])):
                miss, whole = self._likely(weights, rows, bias)
                miss /= whole[:, None]
                miss[at, hit] -= 1
                for r in rows:
                    order = np.argsort(r.astype(np.uint16) if len(weights) <= 1 << 16 else r, kind="stable")
                    ordered = r[order]
                    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                    used, g = ordered[starts], np.add.reduceat(miss.take(order, axis=0), starts, axis=0)
                    size[used] += np.einsum("ij,ij->i", g, g) / g.shape[1]
                    weights[used] -= RATE * g / np.sqrt(size[used] + 1)[:, None]


def start(totals: np.ndarray) -> Model:
    """A model without features from the buckets' counts."""
    share = (totals + 1.0).reshape(CLASSES, PER_CLASS)
    return Model(np.log(share.sum(axis=1)).astype(np.float32), np.log(share).astype(np.float32),
                 np.zeros((FEATURES * CLASS_ROWS, CLASSES), np.float32),
                 np.zeros((FEATURES * WORD_ROWS, PER_CLASS), np.float32))


def train(texts: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """``texts`` has ``text`` and ``turn``, the round that a text is used in."""
    for turn in range(rounds):
        before = model.flat()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Model(model.class_bias, model.word_bias, model.class_weights.copy(), model.word_weights.copy())
            sizes = [np.zeros(len(own.class_weights), np.float32), np.zeros(len(own.word_weights), np.float32)]
            seen = 0
            for batch in batches:
                for _, _, data, offsets in byte_slices(batch.column(0)):
                    hashes, at = tokens(data, offsets)
                    own.learn(contexts(hashes, at), bucket(hashes), sizes)
                    seen += len(hashes)
            if seen:
                change = (own.flat() - before).astype(np.float16)
                for at in range(0, len(change), BLOCK):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([at // BLOCK], pa.int32()), pa.array([seen], pa.int64()),
                         pa.array([change[at:at + BLOCK].tobytes()], pa.binary())],
                        names=["block", "seen", "change"])

        moved = (texts.where(F.col("turn") == turn).select("text")
                 .mapInArrow(run, "block int, seen long, change binary")
                 .repartition("block").mapInArrow(_average, "block int, change binary").collect())
        after = before.copy()
        for r in moved:  # as many rows as the model has blocks
            part = np.frombuffer(r.change, np.float32)
            after[r.block * BLOCK:r.block * BLOCK + len(part)] += part
        model.load(after)
    return model


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted mean of the changes of each block, added up as they come in."""
    sums: dict[int, np.ndarray] = {}
    seen: dict[int, int] = {}
    for batch in batches:
        for block, n, change in zip(*(batch.column(i) for i in range(3))):
            key, n = block.as_py(), n.as_py()
            part = np.frombuffer(change.as_buffer(), np.float16).astype(np.float64) * n
            sums[key] = sums[key] + part if key in sums else part
            seen[key] = seen.get(key, 0) + n
    for key, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([key], pa.int32()), pa.array([(total / seen[key]).astype(np.float32).tobytes()], pa.binary())],
            names=["block", "change"])


def scores(docs: DataFrame, learn: Column, turn: Column, id_column: str = "doc_id",
           text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``learn`` tells which rows to learn from and ``turn`` deals them to the rounds.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    learnt = docs.where(learn).select("text", F.pmod(turn, F.lit(rounds)).alias("turn"))
    counts = cut(learnt.select("text").mapInArrow(count, "token long, n long")
                 .groupBy("token").agg(F.sum("n").alias("n")))
    of_bucket = F.col("token").bitwiseAND(CLASSES * PER_CLASS - 1)
    by_bucket = counts.groupBy(of_bucket.cast("int").alias("bucket")).agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    totals, kinds = np.zeros((2, CLASSES * PER_CLASS))
    for r in by_bucket:
        totals[r.bucket], kinds[r.bucket] = r.n, r.kinds
    n, v = int(totals.sum()), int(kinds.sum())
    model = train(learnt, start(totals), rounds)
    listed = counts.where(F.col("n") * LISTED >= n).toArrow()  # at most LISTED rows
    keys = listed.column("token").to_numpy().view(np.uint64)
    times = listed.column("n").to_numpy().astype(np.float64)
    index = docs.sparkSession.sparkContext.broadcast((keys, times))
    room = totals + kinds + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, c = index.value
        find = KeyIndex(known >> np.uint64(1))
        for batch in batches:
            for first, end, data, offsets in byte_slices(batch.column(1)):
                hashes, at = tokens(data, offsets)
                aim = bucket(hashes)
                place = find.find(hashes >> np.uint64(1))
                hit = place >= 0
                hit[hit] = known[place[hit]] == hashes[hit]
                seen = np.where(hit, c[place] if len(c) else 0, 0)
                inner = np.where(hit, np.log10((seen + 1) / room[aim]), 0.0)
                base = np.where(hit, np.log10((seen + 1) / (n + v + 1)), 0.0)
                model_part = np.log10(model.probabilities(contexts(hashes, at), aim))
                rest = np.flatnonzero(~hit)
                doc = np.searchsorted(at, rest, "right") - 1
                order = np.lexsort((hashes[rest], doc))
                doc, token = doc[order], hashes[rest][order]
                new = np.r_[True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])][:len(doc)]
                starts = np.flatnonzero(new)
                again = np.diff(np.r_[starts, len(doc)])
                ends = pa.array(np.searchsorted(doc[starts], np.arange(end - first + 1)), pa.int32())
                sums = text_sums(np.stack([hit, base, inner + model_part], axis=1), at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.diff(at)),
                     pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1]), pa.array(sums[:, 2]),
                     pa.ListArray.from_arrays(ends, pa.array(signed(token[starts]))),
                     pa.ListArray.from_arrays(ends, pa.array(again, pa.int64()))],
                    names=["doc_id", "n_tokens", "known", "base", "own", "rare", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = cut(docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, known long, base double, own double, "
                                     "rare array<long>, times array<long>")
                .withColumn("row", F.monotonically_increasing_id()))
    room_of = F.element_at(F.array(*map(F.lit, room.tolist())), (of_bucket + 1).cast("int"))
    seen = F.coalesce("n", F.lit(0))
    rest = (found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
            .select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
            .join(counts, "token", "left")
            .groupBy("row").agg(
                F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("known_more"),
                F.sum(F.col("times") * F.log10((seen + 1) / F.lit(float(n + v + 1)))).alias("base_more"),
                F.sum(F.col("times") * F.log10((seen + 1) / room_of)).alias("own_more")))
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return found.join(rest, "row", "left").select(
        "doc_id", "n_tokens", add("known", "known_more").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        add("base", "base_more").alias("base_score"), add("own", "own_more").alias("score"))
