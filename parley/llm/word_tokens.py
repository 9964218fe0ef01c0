"""Ids of whole texts under a word-wise byte-pair tokenizer, many texts at a time.

The tokenizer splits at white space and never joins across it, so the ids of a text are those of
its white-space words in order. A slice of texts is split into words at once, each distinct word is
encoded once, and a worker keeps a bounded memo of words. Words of plain Latin letters, digits and
punctuation are merged for all new words together by the file's own merge ranks; every other word
goes through the ``tokenizers`` library itself. Tests hold both against the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

from parley.llm.arrays import LOWER, SPACE, words

MEMO_WORDS = 1_000_000
LONGEST_PLAIN = 48
_NONE = np.int32(2**31 - 1)

# classes of bytes: 0 anything else, 1 letter, 2 digit, 3 punctuation, 4 first byte of é and the like
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[[b for b in b'!"#$%&()*+,-./:;=>?@[\\]^_`{}~']] = 3  # no quote, and neither < nor |
_CLASS[0xC3] = 4
_ACCENT = np.ones(256, bool)  # bytes after 0xC3 that make a letter
_ACCENT[:0x80] = _ACCENT[0xC0:] = False
_ACCENT[[0x97, 0xB7]] = False
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[0x80:0x9F] += 0x20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the given stretches, one stretch after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class WordTokens:
    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.names = [""] * self.library.get_vocab_size()
        for name, i in self.library.get_vocab().items():
            self.names[i] = name
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {0xC3: level.pre_tokenize_str("é")[0][0][0]}
        shown |= {b: chr(b) for b in range(33, 127)}
        shown |= {("é".encode()[:1] + bytes([b]))[1]: level.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][1]
                  for b in range(0x80, 0xC0)}
        self.first = np.zeros((2, 256), np.int32)  # id of a byte inside, and at the end, of a part
        for b, c in shown.items():
            self.first[0, b], self.first[1, b] = vocab.get(c, 0), vocab.get(c + end, 0)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        keys = left << np.uint64(16) | right
        self.keys = keys  # by rank
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # two tables from a pair's hash to its rank: what finds its place taken goes to the second
        self.tables = []
        rest = np.arange(len(keys), dtype=np.int32)
        for shift in (44, 40):
            table = np.full(1 << 20, -1, np.int32)
            slot = self._slot(keys[rest], shift)
            table[slot[::-1]] = rest[::-1]
            rest = rest[table[slot] != rest]
            self.tables.append((shift, table))
        self.rest = {int(keys[i]): int(i) for i in rest}
        self.memo_words = memo_words
        self._forget()

    @staticmethod
    def _slot(keys: np.ndarray, shift: int) -> np.ndarray:
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(shift - 20)) & np.uint64(0xFFFFF)

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64)
        out = np.full(len(keys), _NONE, np.int32)
        for shift, table in self.tables:
            found = table[self._slot(keys, shift)]
            hit = (self.keys[found] == keys) & (found >= 0)
            out[hit] = found[hit]
        for key, rank in self.rest.items():
            out[keys == key] = rank
        return out

    def _merge(self, ids: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the best pair of every unit, leftmost first, until no pair of it merges."""
        done_ids, done_unit = [], []
        rank = np.full(len(ids), _NONE, np.int32)  # of the pair that begins here
        inner = np.flatnonzero(unit[1:] == unit[:-1])
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            best = np.minimum.reduceat(rank, starts)
            over = np.repeat(best == _NONE, sizes)
            if over.any():
                done_ids.append(ids[over])
                done_unit.append(unit[over])
            at = np.flatnonzero((rank == np.repeat(best, sizes)) & ~over)
            at = at[np.r_[True, unit[at[1:]] != unit[at[:-1]]]] if len(at) else at
            ids[at] = self.made[rank[at]]
            rank[at] = -1  # to be found anew, and so has the pair that ends here
            before = at[at > 0] - 1
            rank[before[unit[before] == unit[before + 1]]] = -1
            stay = ~over
            stay[at + 1] = False
            ids, unit, rank = ids[stay], unit[stay], rank[stay]
            ask = np.flatnonzero(rank == -1)
            rank[ask] = _NONE
            ask = ask[ask < len(ids) - 1]
            ask = ask[unit[ask] == unit[ask + 1]]
            rank[ask] = self._ranks(ids[ask], ids[ask + 1])
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ids, unit = np.concatenate(done_ids), np.concatenate(done_unit)
        order = np.argsort(unit, kind="stable")
        return ids[order], unit[order]

    def _new_words(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given by their places in ``data``, and how many each has."""
        text = data[ranges(begin, size)]
        word = np.repeat(np.arange(len(size)), size)
        kind = _CLASS[text]
        lead = kind == 4
        after = np.r_[False, lead[:-1] & (word[1:] == word[:-1])]
        kind[after & _ACCENT[text] & (kind == 0)] = 1
        broken = lead & ~np.r_[kind[1:] == 1, False]
        broken[:-1] |= lead[:-1] & ~after[1:]
        broken[:-1] |= lead[:-1] & (text[1:] < 0x80)
        odd = np.zeros(len(size), bool)
        odd[word[(kind == 0) | broken]] = True
        odd |= size > LONGEST_PLAIN
        kind[lead] = 1
        plain = ~odd[word]
        text, word, kind = text[plain], word[plain], kind[plain]
        after = after[plain]
        text = np.where(after, _SMALL[text], LOWER[text])
        cut = np.r_[True, (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)][:len(text)]
        unit = np.cumsum(cut) - 1
        last = np.r_[cut[1:], True][:len(text)]
        ids, of_unit = self._merge(self.first[last.astype(np.int8), text], unit)
        of_word = word[np.flatnonzero(cut)][of_unit] if len(ids) else np.zeros(0, np.int64)
        counts = np.bincount(of_word, minlength=len(size))
        strange = np.flatnonzero(odd)
        if not len(strange):
            return ids, counts
        texts = [data[b:b + n].tobytes().decode("utf-8", "replace")
                 for b, n in zip(begin[strange].tolist(), size[strange].tolist())]
        more = [np.array(x.ids, np.int32) for x in
                self.library.encode_batch_fast(texts, add_special_tokens=False)]
        counts[strange] = [len(x) for x in more]
        ends = np.cumsum(counts)
        out = np.zeros(ends[-1], np.int32)
        out[ranges((ends - counts)[~odd], counts[~odd])] = ids
        for i, x in zip(strange.tolist(), more):
            out[ends[i] - len(x):ends[i]] = x
        return out, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one entry more)."""
        hashes, texts, begin, size = words(data, offsets, places=True)
        if not len(hashes):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == distinct[inside]
        if not known.all():
            if len(self.hashes) > self.memo_words:
                self._forget()
                known[:] = False
            new = first[~known]
            ids, counts = self._new_words(data, begin[new], size[new])
            at = len(self.pool) + np.cumsum(counts) - counts
            self.pool = np.concatenate([self.pool, ids])
            into = np.searchsorted(self.hashes, distinct[~known])
            self.hashes = np.insert(self.hashes, into, distinct[~known])
            self.at = np.insert(self.at, into, at)
            self.size = np.insert(self.size, into, counts)
            place = np.searchsorted(self.hashes, distinct)
        at, count = self.at[place][which], self.size[place][which]
        ends = np.r_[0, np.cumsum(count)]
        return self.pool[ranges(at, count)], ends[texts]


_kept: dict[str, WordTokens] = {}


def for_worker(path: str) -> WordTokens:
    """The worker's encoder, without words in its memo; see :func:`released`."""
    if path not in _kept:
        _kept[path] = WordTokens(path)
    return _kept[path]


@contextmanager
def released(path: str) -> Iterator[WordTokens]:
    """The worker's encoder for one task. Its memo goes with the task, as workers stay for others."""
    tokens = for_worker(path)
    try:
        yield tokens
    finally:
        tokens._forget()
