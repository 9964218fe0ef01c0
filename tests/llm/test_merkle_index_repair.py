"""Merkle manifest, run-length index and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from parley.llm import conversation_repair, merkle, run_index

WHITE = " \t\n\x0b\x0c\r"


# --- Merkle manifest ---------------------------------------------------------------------------

FIELDS = "doc_id long, source string, lang string, n_chars long, text string, grp int, node string, pos long, size int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else ""))
        i >>= 1
    return out


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(top, k)
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            made = leaf((*r[:3], r[3] + 1, r[4]) if altered else r)
            for right, sibling in path:
                made = h(sibling, made) if right else h(made, sibling)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[g][-1][0], root, h(*[s for _, s in path]), made, made == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("counts", [[1], [1, 1, 1], [2, 3, 256, 257], [700, 5]])
def test_manifest(spark, counts):
    rng = random.Random(len(counts))
    rows = []
    for g, n in enumerate(counts):
        lang = [None, "de", "Zz", "é"][g]
        for i in range(n):
            doc_id = None if n > 4 and i < 2 else i * 3 + g
            rows.append((doc_id, rng.choice([None, "", "web"]), lang, rng.choice([None, 0, 2**63 - 1 if i == 3 else 7]),
                         rng.choice([None, "", "tëxt", "x" * 3000])))
    rows += rows[:2]  # repeated rows are leaves of their own
    df = spark.createDataFrame([(*r, 1, "n", 2, 3) for r in rows], FIELDS).repartition(3)
    got = sorted([tuple(r) for r in merkle.verified(df).collect()], key=repr)
    assert got == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.verified(spark.createDataFrame([], FIELDS)).collect() == []


# --- run-length index --------------------------------------------------------------------------

def brute_repeats(rows):
    owner = {}
    for doc_id, text in rows:
        for i in range(len(text) - 49) if doc_id is not None else ():
            owner[text[i:i + 50]] = min(owner.get(text[i:i + 50], doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 49) if doc_id is not None else ():
            if owner[text[i:i + 50]] < doc_id:
                gone[i:i + 50] = True
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((doc_id, len(text), int(gone.sum()), int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1)), kept))
    return sorted(out, key=repr)


def repetitive(n, rng):
    parts = ["".join(rng.choices("ab ", k=rng.randint(40, 400))) for _ in range(10)]
    parts += ["".join(rng.choices("abcdefghij é", k=rng.randint(40, 400))) for _ in range(30)]
    out = []
    for i in range(n):
        pieces = [rng.choice([rng.choice(parts), rng.choice(parts)[rng.randint(0, 60):rng.randint(60, 300)],
                              "".join(rng.choices("xyz", k=rng.randint(0, 80))), "a" * rng.randint(0, 120)])
                  for _ in range(rng.randint(0, 6))]
        out.append((rng.choice([i, i, i, i // 2, None, -i]), "".join(pieces) or None))
    out += [(1002, "-" * 30_000), (1003, "é" + "-" * 20_000), (1004, "-+" * 9000), (1005, "+" + "-+" * 8000 + "."),
            (1000, "long " * 20_000), (1001, "x" + "long " * 30_000), out[3], out[3], (-7, None), (8, "")]
    return out


@pytest.mark.parametrize("limit", [run_index.INDEXED, 2000])
def test_repeats(spark, monkeypatch, limit):
    monkeypatch.setattr(run_index, "INDEXED", limit)  # many small buckets give the same
    monkeypatch.setattr(run_index, "BUCKET", 4 * limit)
    rows = repetitive(120, random.Random(7))
    df = spark.createDataFrame([(d, t, 1, "b") for d, t in rows], "doc_id long, text string, slice int, bucket string")
    got = sorted([tuple(r) for r in run_index.without_repeats(df.repartition(5)).collect()], key=repr)
    want = brute_repeats([(d, (t or "").encode()) for d, t in rows])
    assert [(*g[:4], bytes(g[4])) for g in got] == want and any(w[2] for w in want)


def test_no_repeats_in_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert run_index.without_repeats(df).collect() == []


def test_matching_statistics_of_other_texts():
    rng = random.Random(2)
    rows = np.array([rng.choices(b"abc", k=60) for _ in range(40)], np.uint8)
    begin, end = np.zeros(40, np.int64), np.array([rng.randint(1, 60) for _ in range(40)])
    index = run_index.RunIndex(rows, begin, end, np.arange(40))
    texts = [bytes(r[:e]) for r, e in zip(rows, end)]
    asked = np.array([rng.choices(b"abcd", k=30) for _ in range(20)], np.uint8)
    asked[:5, 3:25] = rows[:5, :22]
    for column, lengths, _ in index.stream(asked, np.zeros(20, np.int64), np.full(20, 30)):
        for row, length in zip(asked, lengths):
            best = max(k for k in range(31 - column) if any(bytes(row[column:column + k]) in t for t in texts))
            assert length == best


def test_anchors_do_not_depend_on_stretches(monkeypatch):
    data = np.frombuffer(bytes(random.Random(3).choices(b"abcd", k=5000)), np.uint8)
    offsets = np.array([0, 700, 700, 731, 4000, 5000])
    whole = run_index.anchors(data, offsets)
    monkeypatch.setattr(run_index, "STRETCH", 97)
    for a, b in zip(whole, run_index.anchors(data, offsets)):
        assert (a == b).all()
    for begin, end in zip(offsets[:-1], offsets[1:]):  # every string has an anchor
        for i in range(begin, end - 49):
            assert ((whole[0] >= i) & (whole[0] <= i + 26)).any()


def test_runs_of_a_letter_have_few_anchors():
    for data in (b"a" * 9000, b"ab" * 4500, b"abc" * 3000):
        offsets = np.array([0, 4000, len(data)])
        places, _ = run_index.anchors(np.frombuffer(data, np.uint8), offsets)
        assert len(places) < len(data) / 10
        for begin, end in ((0, 4000), (4000, len(data))):
            mine = places[(places >= begin) & (places < end)]
            for i in range(begin, end - 49):
                assert ((mine >= i) & (mine <= i + 26)).any()


# --- conversation repair -----------------------------------------------------------------------

def brute_conversation(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    following, full = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        to = following[state]
        heapq.heappush(queue, (cost + 3, audit + "I", i, to, lines + (full[to] + ":",)))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state, lines))
        if faults[i] not in ("b", "d"):
            more = 3 * (faults[i] == "t")
            heapq.heappush(queue, (cost + 3 + more, audit + "R", i + 1, to, lines + (f"{full[to]}:{text}",)))
            if role[:1] == to or state == "" and role[:1] == "s":
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[:1], lines + (f"{role}:{text}",)))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *map(faults.count, "bdt"), illegal, cost, audit, h("\n".join(lines))


def brute_repair(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        mine = conversations.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(((c, *brute_conversation(sorted(m, key=lambda r: (r[0] is not None, r[0] or 0, r[1], h(r[2])))))
                   for c, m in conversations.items()), key=repr)


def conversations(n, rng):
    out = []
    for c in range(n):
        for t in range(rng.randint(1, rng.choice([3, 6, 40]))):
            out.append((rng.choice([c, c, c, c, c, None]), rng.choice([t, t, t, t + 1, None]),
                        rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]),
                        rng.choice(["Hi.", "What?", "so on", "Yes!", "x. ", "ok \n", " ", None, "", f"{t}.", f"é{t}!",
                                    "end. "])))
    out += [(99, i, "system", "again") for i in range(60)]  # deleted rows carry costs unchanged over lanes
    out += [(98, i, ["user", "assistant"][i % 2], "word " * 5000 + f"{i}.") for i in range(6)]
    return out + out[:3]


@pytest.mark.parametrize("bits", [10, 1])
def test_repair(spark, bits):
    rows = conversations(50, random.Random(5))
    schema = "conv_id long, turn long, role string, text string, kind int, mark long, lane string"
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema).repartition(4)
    got = sorted([tuple(r) for r in conversation_repair.repaired(df, bits).collect()], key=repr)
    assert got == brute_repair(rows)


def test_repair_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_repair.repaired(spark.createDataFrame([], schema)).collect() == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = conversation_repair.repaired(spark.createDataFrame([(dropped, 0, "user", "Hi.")], schema)).collect()
    assert [tuple(r) for r in rows] == [(dropped, 0, 0, 0, 0, 0, 0, "", h(""))]


def test_fix_up_stops_where_vectors_differ_by_a_constant():
    lanes = conversation_repair.Lanes(["E" * 3 + "EI" * 50])  # user rows, then pairs
    lanes.backward(np.array([[0, 0, 0, 9]]), np.array([0]))
    guessed = lanes.costs.copy()
    lanes.backward(np.array([conversation_repair.END]), np.array([0]))
    fresh = conversation_repair.Lanes(["E" * 3 + "EI" * 50])
    fresh.backward(np.array([conversation_repair.END]), np.array([0]))
    assert (lanes.costs == fresh.costs).all() and (lanes.shifts == fresh.shifts).all()
    assert (guessed != fresh.costs).any(axis=1).sum() < 10
