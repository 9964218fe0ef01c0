"""BPE encoding and decoding with content-defined chunks.

A rolling hash over the bytes decides where a text is cut, so texts that share a passage share its
chunks wherever they stand. A worker encodes the inside of each distinct chunk once and keeps a
bounded memo of chunks. At each join the words around it are encoded again as one stretch; the
stretch is taken once it begins and ends with exactly the ids that the two chunks have there, and
grows by whole words until it does.

Chunks are shared within a worker, not across the cluster: carrying every shared chunk's ids to
every text would shuffle more bytes than encoding it again costs.

Defined cases: a null text is an empty one and has no ids; a text without white space is one
stretch; repeated rows and rows without id give a row each; an empty table gives no row; only the id
and the text are read.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parley.llm import word_tokens
from parley.llm.arrays import SPACE, byte_slices, prefix_hashes, span_hashes, stretch_hashes

WINDOW = 48
MEAN_BYTES = 2048
MEMO_IDS = 8_000_000

_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def chunk_starts(data: np.ndarray, offsets: np.ndarray, mean: int = MEAN_BYTES,
                 window: int = WINDOW) -> np.ndarray:
    """First bytes of all chunks: of each text, and after each window whose hash says so."""
    n = len(data)
    starts = offsets[:-1][np.diff(offsets) > 0]
    if n > window:
        sums = prefix_hashes(data)
        hashes = stretch_hashes(sums, np.arange(n - window), np.arange(window, n))
        ends = np.flatnonzero((hashes >> np.uint64(20)) % np.uint64(mean) == 0) + window
        ends = ends[(data[ends] & 0xC0) != 0x80]  # never inside a character
        starts = np.concatenate([starts, ends])
    return np.unique(starts)


class ChunkEncoder:
    """Encodes slices of texts; ``encode_all`` encodes stretches given by their places."""

    def __init__(self, tokens: word_tokens.WordTokens, mean: int = MEAN_BYTES, memo_ids: int = MEMO_IDS):
        self.tokens, self.mean, self.memo_ids = tokens, mean, memo_ids
        self.memo: OrderedDict[int, np.ndarray] = OrderedDict()
        self.held = 0
        self.encoded = self.reused = 0

    def encode_all(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        size = end - begin
        ids, at = self.tokens.encode(data[word_tokens.ranges(begin, size)], np.r_[0, np.cumsum(size)])
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def _remember(self, key: int, ids: np.ndarray) -> None:
        self.memo[key] = ids
        self.held += len(ids) + 16
        while self.held > self.memo_ids:
            _, old = self.memo.popitem(last=False)
            self.held -= len(old) + 16

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of every text of a slice."""
        starts = chunk_starts(data, offsets, self.mean)
        if not len(starts):
            return [np.zeros(0, np.int32)] * (len(offsets) - 1)
        ends = np.r_[starts[1:], len(data)]
        # the inside of a chunk: whole words with white space on either side
        space = SPACE[data]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        gaps = np.flatnonzero(space)
        left = np.searchsorted(gaps, starts)
        right = np.searchsorted(gaps, ends) - 1
        inner = right > left
        body_from = np.where(inner, gaps[np.minimum(left, len(gaps) - 1)], ends) if len(gaps) else ends
        body_to = np.where(inner, gaps[np.maximum(right, 0)], ends) if len(gaps) else ends
        text_start = np.isin(starts, offsets)
        text_end = np.isin(ends, offsets)
        body_from = np.where(text_start & (inner | text_end), starts, body_from)
        body_to = np.where(text_end & (inner | text_start), ends, body_to)
        inner |= text_start & text_end
        keys = span_hashes(data, body_from, body_to)
        bodies: list[np.ndarray | None] = []
        missing: dict[int, int] = {}
        for i, key in enumerate(keys.tolist()):
            ids = self.memo.get(key)
            if ids is None:
                missing.setdefault(key, i)
            else:
                self.memo.move_to_end(key)
            bodies.append(ids)
        if missing:
            which = np.fromiter(missing.values(), np.int64)
            fresh = dict(zip(missing, self.encode_all(data, body_from[which], body_to[which])))
            for i, key in enumerate(keys.tolist()):
                if bodies[i] is None:
                    bodies[i] = fresh[key]
            for key, ids in fresh.items():
                self._remember(key, ids)
        self.encoded += len(missing)
        self.reused += len(bodies) - len(missing)
        return self._join(data, offsets, starts, body_from, body_to, inner, bodies, gaps)

    def _join(self, data, offsets, starts, body_from, body_to, inner, bodies, gaps) -> list[np.ndarray]:
        """Put the chunks of each text together, encoding the words around each join again."""
        first_chunk = np.searchsorted(starts, offsets[:-1])
        last_chunk = np.searchsorted(starts, offsets[1:])
        open_joins: list[tuple[int, int, int]] = []  # text, chunk before, chunk after (with an inside)
        for t, (a, b) in enumerate(zip(first_chunk.tolist(), last_chunk.tolist())):
            solid = [c for c in range(a, b) if inner[c]]
            open_joins += [(t, x, y) for x, y in zip([-1, *solid], [*solid, -1])]
        repaired: dict[tuple[int, int, int], tuple[np.ndarray, int, int]] = {}
        reach = 1
        while open_joins:
            spans = []
            for t, x, y in open_joins:
                low = int(offsets[t]) if x < 0 else int(body_from[x])
                mid = int(offsets[t]) if x < 0 else int(body_to[x])
                mid_to = int(offsets[t + 1]) if y < 0 else int(body_from[y])
                high = int(offsets[t + 1]) if y < 0 else int(body_to[y])
                spans.append((self._back(gaps, data, low, mid, reach), mid, mid_to,
                              self._on(gaps, data, mid_to, high, reach)))
            places = np.array(spans, np.int64)
            lefts = self.encode_all(data, places[:, 0], places[:, 1])
            wholes = self.encode_all(data, places[:, 0], places[:, 3])
            rights = self.encode_all(data, places[:, 2], places[:, 3])
            again = []
            for join, l, w, r in zip(open_joins, lefts, wholes, rights):
                _, x, y = join
                before = bodies[x] if x >= 0 else l
                after = bodies[y] if y >= 0 else r
                agrees = (len(w) >= len(l) + len(r) and np.array_equal(w[:len(l)], l)
                          and np.array_equal(w[len(w) - len(r):], r)
                          and np.array_equal(before[len(before) - len(l):], l)
                          and np.array_equal(after[:len(r)], r))
                if agrees:
                    repaired[join] = (w[len(l):len(w) - len(r)], 0, 0)
                else:
                    again.append(join)
            if again and reach > len(data):
                raise ValueError("a join never agrees: the tokenizer joins across white space")
            open_joins, reach = again, reach * 4
        out = []
        for t, (a, b) in enumerate(zip(first_chunk.tolist(), last_chunk.tolist())):
            solid = [c for c in range(a, b) if inner[c]]
            parts = []
            for x, y in zip([-1, *solid], [*solid, -1]):
                parts.append(repaired[t, x, y][0])
                if y >= 0:
                    parts.append(bodies[y])
            out.append(np.concatenate(parts))
        return out

    @staticmethod
    def _back(gaps: np.ndarray, data: np.ndarray, low: int, at: int, words: int) -> int:
        """A place some white spaces before ``at``, not before ``low``."""
        i = int(np.searchsorted(gaps, at)) - words
        return max(low, int(gaps[i])) if i >= 0 else low

    @staticmethod
    def _on(gaps: np.ndarray, data: np.ndarray, at: int, high: int, words: int) -> int:
        i = int(np.searchsorted(gaps, at, "right")) - 1 + words
        return min(high, int(gaps[i])) if i < len(gaps) else high


def decode(ids: np.ndarray, names: list[str]) -> str:
    """The file names no decoder, for which the library joins the ids' names by spaces."""
    if len(ids) < 2:
        return names[int(ids[0])] if len(ids) else ""
    return " ".join(itemgetter(*ids.tolist())(names))


def digests(docs: DataFrame, tokenizer: str, mean: int = MEAN_BYTES, id_column: str = "doc_id",
            text: str = "text") -> DataFrame:
    """Number of ids, hash of the ids and hash of the decoded text, of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with word_tokens.released(tokenizer) as tokens:
            yield from hashed(batches, ChunkEncoder(tokens, mean))

    def hashed(batches: Iterator[pa.RecordBatch], encoder: ChunkEncoder) -> Iterator[pa.RecordBatch]:
        names = encoder.tokens.names
        decimals = [str(i) for i in range(len(names))]
        for batch in batches:
            for first, end, data, offsets in byte_slices(batch.column(1)):
                found = encoder.texts(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first).cast(pa.int64()),
                     pa.array([len(x) for x in found], pa.int64()),
                     pa.array([hashlib.sha256(decode(x, decimals).encode()).hexdigest() for x in found]),
                     pa.array([hashlib.sha256(decode(x, names).encode()).hexdigest() for x in found])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_column, text).mapInArrow(run, _DIGESTS)


def encode(docs: DataFrame, tokenizer: str, mean: int = MEAN_BYTES, id_column: str = "doc_id",
           text: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with word_tokens.released(tokenizer) as tokens:
            yield from encoded(batches, ChunkEncoder(tokens, mean))

    def encoded(batches: Iterator[pa.RecordBatch], encoder: ChunkEncoder) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in byte_slices(batch.column(1)):
                found = [x.tolist() for x in encoder.texts(data, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first).cast(pa.int64()),
                     pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(id_column, text).mapInArrow(run, "doc_id long, ids array<int>")
