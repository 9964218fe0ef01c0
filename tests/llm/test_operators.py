"""Every operator on small tables with nulls, empty and repeated rows, against brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import (
    chunk_reuse, fast_sketch, host_suffix, iblt, learned_parts, maxent, packing, ppm, toxicity, warc, word_tokens,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, part int, label int"
PATH = word_tokens.default_path()


def make_texts(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        kind = i % 9
        if kind == 0 and out:
            out.append(rng.choice(out))
        elif kind == 1 and out:
            words = (rng.choice(out) or "").split(" ")
            words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
        elif kind == 2:
            out.append(rng.choice([None, "", "  \n\t ", "one", "two Words", "İ don't <|endoftext|> 日本 ½\x1cz"]))
        else:
            out.append(" ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ",\n"]) for _ in range(rng.randint(1, 120))))
    out.append("x" * 5000 + " " + "word. " * 4000)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 1, 0.5, 3, 1) for i, t in enumerate(make_texts(120))]
    rows += [(None, "no id here at all", None, None, None, None, None, None), rows[5]]
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.mark.parametrize("mean", [32, 2048])
def test_chunks_give_the_ids_of_the_library(docs, rows, empty, mean):
    got, tok = by_id(chunk_reuse.digests(docs, PATH, mean)), library()
    for doc, text in rows:
        ids = tok.encode(text, add_special_tokens=False).ids
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert got[doc].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert chunk_reuse.digests(empty, PATH).count() == 0


def test_packing_places_every_id_once(docs, rows, empty):
    got = packing.pack(docs, PATH, size=64).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    places = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 64
    tok = library()
    for doc, text in rows:
        ids = tok.encode(text, add_special_tokens=False).ids + [1]
        want = sorted((a, len(ids[a:a + 64]), zlib.crc32(np.array(ids[a:a + 64], "<u4").tobytes()), len(ids))
                      for a in range(0, len(ids), 64))
        assert set(want) == {(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[doc]}
    assert sum(r.length for r in got) / 64 / len(places) > 0.97
    assert packing.pack(empty, PATH).count() == 0


def test_patterns_hold_the_histogram():
    histogram = {1: 5000, 2048: 100, 7: 33, 700: 41, 1300: 5}
    held = collections.Counter()
    for lengths, packs in packing.patterns(histogram):
        assert sum(lengths) <= 2048
        for length in lengths:
            held[length] += packs
    assert held == histogram


def shingle_sets(rows):
    out = collections.defaultdict(set)
    for doc, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
        out[doc] |= {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def test_near_duplicates_are_those_of_brute_force(docs, rows, empty):
    sets = shingle_sets([r for r in rows if r[0] is not None])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = fast_sketch.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (
                len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert fast_sketch.near_duplicates(empty).count() == 0


def test_star_of_near_copies_and_outsiders(spark):
    """A crowd around one text, some of it too far to be linked: outsiders stay alone."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        words = list(base)
        for at in rng.sample(range(100), rng.choice([1, 2, 3, 4, 5, 6])):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = shingle_sets(rows)
    linked = {i for i in sets if 100 * len(sets[0] & sets[i]) >= 75 * len(sets[0] | sets[i])}
    assert 1 < len(linked) < 120
    got = by_id(fast_sketch.near_duplicates(docs))
    assert all(got[i].component_id == 0 for i in linked)


def test_rare_pairs_lose_no_link(spark):
    """Random near copies of one text, all still apart: every linked pair is among the candidates."""
    rng = random.Random(8)
    sets = {}
    for node in range(80):
        words = [f"w{i}" for i in range(rng.choice([100, 100, 90, 120]))]
        for at in rng.sample(range(90), rng.randint(0, 7)):
            words[at] = f"x{at}y{rng.randint(0, 2)}"
        sets[node] = {hash(tuple(words[k:k + 5])) % 2**62 for k in range(len(words) - 4)}
    packed = spark.createDataFrame(
        [(n, bytearray(np.array(sorted(s), np.uint64).tobytes())) for n, s in sets.items()], "node long, shingles binary")
    nodes = spark.createDataFrame([(n, len(s), n) for n, s in sets.items()], "node long, n_shingles long, label long")
    got = {(r.a, r.b) for r in fast_sketch.rare_pairs(packed, nodes).collect()}
    linked = {(a, b) for a in sets for b in sets
              if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked and linked <= got and len(got) < 80 * 79 / 2
    merged = nodes.withColumn("label", F.lit(0))  # one component has nothing left to link
    assert fast_sketch.rare_pairs(packed, merged).count() == 0


def test_rare_pairs_of_repeated_ids(spark, monkeypatch):
    """An id in several rows, of equal and of other texts, is as good a partner as any."""
    monkeypatch.setattr(fast_sketch, "CROWD", 2)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(6):
        # about an eighth of each set is its own, at one end
        rows += [(i, " ".join(base[:360] + [f"own{i}x{j}" for j in range(44)]))] * (1 + 2 * (i % 2))
    rows += [(1, " ".join(f"else{j}" for j in range(300))), (3, " ".join(base[:100])), (5, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    names = (docs.mapInArrow(fast_sketch._sketch, "doc_id long, n_shingles long, set_a long, set_b long, "
                                                  "bands array<long>").where("n_shingles > 0")
             .groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("node", F.xxhash64("set_a", "set_b", "n_shingles")))
    nodes = fast_sketch.cut(names)
    sets = fast_sketch.sets_of(docs, nodes, nodes)
    held = {r.node: set(np.frombuffer(r.shingles, np.uint64).tolist()) for r in sets.collect()}
    known = {r.node: r.n_shingles for r in nodes.collect()}
    assert sets.count() == len(held) == 8 and {n: len(s) for n, s in held.items()} == known
    got = [(r.a, r.b) for r in fast_sketch.rare_pairs(
        sets, nodes.select("node", "n_shingles", F.col("node").alias("label"))).collect()]
    linked = {(a, b) for a in held for b in held
              if a < b and 100 * len(held[a] & held[b]) >= 75 * len(held[a] | held[b])}
    assert len(linked) == 15 and linked <= set(got) and len(set(got)) == len(got)


def test_sketch_coordinates_agree_like_the_sets():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.sort(pool[:300]), np.sort(pool[60:360])
    rows = fast_sketch.sketches(np.concatenate([a, b, pool[:1]]), np.array([0, 300, 600, 601]))
    assert abs((rows[0] == rows[1]).mean() - 240 / 360) < 0.15
    assert (rows != np.uint64(2**64 - 1)).all()


def paragraphs(text):
    found = collections.Counter()
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if len(line.encode()) + (i < len(lines) - 1) > iblt.LONG:
            found.update(x for x in re.split(r"(?<=[.!?] )", line) if x)
        elif line:
            found[line] += 1
    return found


def test_fingerprints(docs, rows, empty):
    got = [r for r in iblt.fingerprints(docs, rows_per_range=10).collect()]
    assert len(got) == len(rows)
    order = sorted({r for r in rows if r[0] is not None}, key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    found = by_id(iblt.fingerprints(docs.dropDuplicates(["doc_id"]), rows_per_range=10))
    prints = {}
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = found[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = paragraphs(text), paragraphs(other)
            either = sum((a | b).values())
            assert near == pytest.approx(sum((a & b).values()) / either if either else 1.0)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert iblt.fingerprints(empty).count() == 0


def test_peeling_gives_the_digests_back():
    keys = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cells = iblt.sketch(keys, np.array([0, len(keys)]), 1024)
    _, found, sign, closed = iblt.peel(cells, 1024)
    assert not closed[0] and set(found.tolist()) == set(keys.tolist()) and (sign == 1).all()


def test_lm_counts_and_base(docs, rows, empty):
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    count = collections.Counter()
    for doc, text in rows:
        if doc is not None and doc % 3:
            count.update(re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower()) + [None])
    n, v = sum(count.values()), len(count)
    listed = maxent.LISTED
    for bound in (listed, 20):
        maxent.LISTED = bound
        try:
            got = maxent.scores(docs, learn, F.col("doc_id")).collect()
        finally:
            maxent.LISTED = listed
        found = {r.doc_id: r for r in got}
        assert len(got) == len(rows)
        for doc, text in rows:
            own = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower()) + [None]
            r = found[doc]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
            assert r.base_score == pytest.approx(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in own))
            assert r.score < 0
    assert maxent.scores(empty, learn, F.col("doc_id")).count() == 0


def test_lm_probabilities_sum_to_one():
    model = maxent.start(np.arange(256.0))
    rng = np.random.default_rng(2)
    model.class_weights += rng.normal(size=model.class_weights.shape).astype(np.float32)
    model.word_weights += rng.normal(size=model.word_weights.shape).astype(np.float32)
    context = np.repeat(rng.integers(0, 2**63, (3, 1)).astype(np.uint64), 256, axis=1)
    assert model.probabilities(context, np.arange(256)).sum() == pytest.approx(1, abs=1e-4)


def test_lm_steps_are_those_of_plain_softmax():
    rng = np.random.default_rng(3)
    hashes = maxent.mix(rng.integers(0, 400, 5000).astype(np.uint64))
    at = np.array([0, 1200, 1201, 5000])
    aim, context = maxent.bucket(hashes), maxent.contexts(hashes, at)
    model = maxent.start(np.bincount(aim, minlength=256).astype(float))
    plain = maxent.start(np.bincount(aim, minlength=256).astype(float))
    sizes = [np.zeros(len(w), np.float32) for w in (model.class_weights, model.word_weights)]
    model.learn(context, aim, sizes)
    cls, word = aim // 16, aim % 16
    first, second = plain.rows(context, cls)
    chance = np.ones(len(aim))
    for weights, learnt, rows, bias, hit in ((plain.class_weights, model.class_weights, first, plain.class_bias[None], cls),
                                             (plain.word_weights, model.word_weights, second, plain.word_bias[cls], word)):
        share = np.exp(np.broadcast_to(bias, (len(aim), 16)).astype(np.float64))
        share /= share.sum(axis=1, keepdims=True)
        miss = share.copy()
        miss[np.arange(len(aim)), hit] -= 1
        for r in rows:
            g = np.zeros(weights.shape)
            np.add.at(g, r, miss)
            weights -= maxent.RATE * g / np.sqrt((g * g).mean(axis=1) + 1)[:, None]
        assert np.allclose(learnt, weights, atol=1e-4)
        z = sum(weights[r].astype(np.float64) for r in rows) + bias
        chance *= (np.exp(z) / np.exp(z).sum(axis=1, keepdims=True))[np.arange(len(aim)), hit]
    assert np.allclose(model.probabilities(context, aim), chance, rtol=1e-3)


def test_language(spark, empty):
    rng = random.Random(4)
    words = {"aa": ["the", "and", "thing"], "bb": ["der", "über", "nicht"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=12)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(900, None, "aa"), (901, "", None), (902, "12 + 3", "bb"), (None, "der über", None), (903, "日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ppm.fit(docs, F.col("doc_id") % 4 != 2)
    got = by_id(ppm.predict(docs, model, ["doc_id"]))
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:80])
    assert [got[i].lang_pred for i in (900, 901, 902, None)] == ["und", "und", "und", "bb"]
    assert got[903].lang_pred in words and all(0 <= r.score <= 1 for r in got.values())
    none = ppm.fit(empty.select("doc_id", "text", "lang"), F.lit(True))
    assert ppm.predict(docs, none, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_language_stage_rejects_foreign_text_and_noise(spark):
    import corpus_pipeline

    rng = random.Random(9)
    words = {"aa": "the and thing some where house water under light paper".split(),
             "bb": "der über nicht haus wasser unter licht papier wenn doch".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(30, 90))), lang)
            for i, lang in enumerate(["aa", "bb"] * 100)]
    foreign = " ".join(rng.choices("gdzie książka żółty przyszłość czyżby właśnie".split(), k=50))
    noise = "".join(rng.choices("qxzjkvwypfbghm0123456789#%&*", k=400))
    rows += [(900, foreign, None), (901, noise, None), (902, "12 + 3", None), (903, "water under paper", None),
             (904, " ".join(rng.choices(words["bb"], k=40)), "aa"), (None, "der haus unter wasser", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = [r.doc_id for r in corpus_pipeline.keep_languages(spark, docs, "").select("doc_id").collect()]
    assert set(kept) == {r[0] for r in rows} - {900, 901, 902} and len(kept) == len(rows) - 3


def test_language_is_learnt_from_all_texts(spark):
    """One text among thousands of its language is counted, too."""
    rows = [(i, "water under paper", "aa") for i in range(6000)] + [(i, f"word number {i}", "bb") for i in range(6000, 12000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, most = ppm.fit_with_limits(docs, F.lit(True))
    table = ppm._windows_of(docs, F.lit(True)).groupBy("lang").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept")).collect()
    assert {r.lang: r.n for r in table} == {"aa": 6000 * 17, "bb": sum(len(t) for _, t, lang in rows if lang == "bb")}
    assert all(r.kept <= r.n for r in table)
    for number in (6000, 9876, 11999):  # whose last window no other text has
        assert model.four.find(np.array([int.from_bytes(str(number)[-4:].encode(), "big")], np.uint64))[0] >= 0
    assert model.langs == ["aa", "bb"] and np.isfinite(most["bb"]).any()


def test_code_lengths_are_those_of_the_trees(spark):
    """Bits of one text by walking the contexts byte by byte."""
    train, text = "abracadabra abra", "abrab zz"
    docs = spark.createDataFrame([(0, train, "x")], "doc_id long, text string, lang string")
    model = ppm.fit(docs, F.lit(True))
    seen = [collections.defaultdict(collections.Counter) for _ in range(4)]
    padded = b"\0\0\0" + train.encode()
    for i in range(3, len(padded)):
        for order in range(4):
            seen[order][padded[i - order:i]][padded[i]] += 1
    bits, padded = 0.0, b"\0\0\0" + text.encode()
    for i in range(3, len(padded)):
        for order in (3, 2, 1, 0, -1):
            if order < 0:
                bits += 8
                break
            at = seen[order].get(padded[i - order:i])
            if at is None:
                continue
            total = sum(at.values()) + len(at)
            if padded[i] in at:
                bits -= np.log2(at[padded[i]] / total)
                break
            bits -= np.log2(len(at) / total)
    data = np.frombuffer(text.encode(), np.uint8)
    assert model.bits(data, np.array([0, len(data)]))[0, 0] == pytest.approx(bits, rel=1e-5)


def test_toxicity(spark, empty):
    rng = random.Random(6)
    plain = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(300):
        words = rng.choices(plain, k=40)
        if i % 5 == 0:
            words[rng.randrange(40)] = rng.choice(["scoundrel", "blackguard"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(900, None), (901, ""), (None, "a scoundrel")]
    labels += [(902, 1), (None, 1), (903, None), (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 1)
    got = by_id(toxicity.scores(docs, model, ["doc_id"]))
    assert all((got[i].score >= 0.7) == (i % 5 == 0) for i in range(300))
    assert got[None].score >= 0.7 and got[900].score == got[901].score < 0.5
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.scores(docs, none, ["doc_id"]).collect()}.pop() < 1e-9


def test_toxicity_fit_is_that_of_plain_descent(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["vile", "scum", "day"] if i % 3 == 0 else ["sun", "vile", "tree", "day"], k=6)))
            for i in range(90)] + [(90, None), (91, ""), (None, "vile scum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(92)] + [(1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    known = [(t, i % 3 == 0) for i, t in rows if i is not None and t is not None]
    grams = [{f" {t} "[i:i + n] for n in toxicity.SIZES for i in range(len(t) + 3 - n)} if t else set() for t, _ in known]
    y = np.array([float(toxic) for _, toxic in known])
    pos, neg = y.sum(), (1 - y).sum()
    columns = []
    for gram in sorted(set().union(*grams)):
        has = np.array([gram in g for g in grams], float)
        p, n, share = has @ y / pos, has @ (1 - y) / neg, has.mean()
        if abs(p - n) / np.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-12) >= toxicity.LEAST_Z:
            columns.append(has * (np.log((has @ y + 1) / (pos + 2)) - np.log((has @ (1 - y) + 1) / (neg + 2))))
    x = np.c_[np.array(columns).T, np.ones(len(y))]
    assert x.shape[1] - 1 == np.count_nonzero(model.weights)
    decay = np.r_[np.full(x.shape[1] - 1, toxicity.DECAY), 0]
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton's steps
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (p - y) / len(y) + decay * w
        bend = (x.T * (p * (1 - p))) @ x / len(y) + np.diag(decay + 1e-12)
        w = w - np.linalg.solve(bend, slope)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model, ["doc_id"]).collect()}
    for (i, _), best in zip([(i, t) for i, t in rows if i is not None and t is not None], 1 / (1 + np.exp(-x @ w))):
        assert got[i] == pytest.approx(best, abs=0.02)


def test_toxicity_with_repeated_rows_long_text_and_other_columns(spark):
    rows = [(i, "vile scum" if i % 2 else "fine day", 1.0, 7) for i in range(40)]
    rows += [rows[0], rows[1], (50, "vile scum " * 120_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.scores(docs, model, docs.columns, "found").collect()
    assert len(got) == 43 and len({r.found for r in got if r.doc_id in (0, 1)}) == 2
    assert {r.found > 0.5 for r in got if r.doc_id == 50} == {True}


def test_language_sample_is_the_first_of_each_language_by_hash(spark):
    rows = [(i, "ab" if i % 4 else "cd", "text") for i in range(4000)] + [(7, "ab", "text"), (8000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = ppm.sample(docs, F.lit(True), 50, ["doc_id"]).collect()
    order = {r.doc_id: (r.h, r.doc_id) for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for lang in ("ab", "cd"):
        every = sorted((i for i, name, _ in rows if name == lang), key=order.get)[:50]
        assert {r.doc_id for r in got if r.lang == lang} == set(every)


@pytest.mark.parametrize("page, text", [
    ("<p><img src=" + "A" * 9000 + ">one</p>", "one"),
    ("<p><a title=it's>two</a> words</p>", "two words"),
    ("<p title='a>b' lang=\"c>d\">three</p>", "three"),
    ("<p>four</p><a href=\"never closed", "four"),
])
def test_tags_of_any_length_and_quoting(page, text):
    assert host_suffix.blocks(page)[0] == [text]


def test_page_text(spark):
    head = "<html><head><title>T</title><script>x('</p>')</script></head><body class='has-sidebar'>"
    chrome = "<nav><ul><li>Home</li></ul></nav><div class=\"ad\">Buy</div><form>f</form><!-- <p>no</p> -->"
    page = (head + chrome + "<article><h1>A &amp; B</h1><p><b>one\n two<br>three<p>four&nbsp;five</p>"
            "<div id='comments'><p>reader</p></div></article><footer>&copy; x</footer></body></html>")
    rows = [(1, "http://a.b/1", page), (2, "http://a.b/2", None), (3, None, ""), (4, "http://a.b/4", "plain < text")]
    # no article: what the host's pages share goes, what is their own stays
    shared = "<div><p>Welcome to our site where we list all our offers and also our shops</p></div>"
    rows += [(10 + i, f"http://c.d/{i}", shared + f"<p>own text {i} with some words that only page {i} has got</p>")
             for i in range(8)]
    got = {r.page_id: r for r in host_suffix.extract(spark.createDataFrame(
        rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A & B\n\none two three\n\nfour five"
    assert (got[2].text, got[3].text, got[2].n_chars) == ("", "", 0) and got[4].text == "plain < text"
    for i in range(8):
        assert got[10 + i].text == f"own text {i} with some words that only page {i} has got"
    assert host_suffix.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_groups_of_a_host_follow_from_its_own_pages(spark, monkeypatch):
    monkeypatch.setattr(host_suffix, "MOST_LISTED", 10, raising=False)
    passage = "<p>this long passage stands on very many of the pages that this host has</p>"
    mine = [(i, f"http://a.b/{i}", f"<p>only page {i}</p>" + passage) for i in range(7)]
    others = [(100 + i, f"http://h{i}.d/", f"<p>page of host {i}</p>") for i in range(300)]
    texts = []
    for given in (mine, mine + others):
        pages = spark.createDataFrame(given, "page_id long, url string, html string")
        texts.append({r.page_id: r.text for r in host_suffix.extract(pages, 8).collect() if r.page_id < 100})
    assert texts[0] == texts[1]


def test_texts_do_not_depend_on_the_groups_of_a_host(spark):
    rng = random.Random(5)

    def passage(n):
        return "<p>" + " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n)) + "</p>"

    def plain(block):
        return block[3:-4]

    often, seldom, quoted, everywhere = passage(12), passage(12), passage(12), passage(12)
    rows, want = [], {}
    for i in range(90):  # 90 pages: a fifth are 18, three fifths 54
        own, has = passage(rng.randint(3, 20)), []
        if i % 3:  # on no article: what 18 pages share goes
            has += [often] * (i % 9 in (1, 2, 4)) + [seldom] * (i % 9 == 5) + [everywhere]  # 30, 10
            want[i] = [own] + [b for b in has if b == seldom]
            body = own + "".join(has)
        else:  # in an article: what 54 pages share goes
            has += [quoted] * (i % 2) + [everywhere] + [often] * (i % 9 == 3)  # 15, all, and 40 with those outside
            want[i] = [own] + [b for b in has if b != everywhere]
            body = f"<article>{own}{''.join(has)}</article>"
        rows.append((i or None, f"http://Big.host/{i}", body))
    rows += rows[:7]  # repeated rows count as one page
    rows += [(100 + i, f"http://small{i // 3}.host/", often + passage(9)) for i in range(6)]  # 3 pages share it
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = [collections.Counter(map(tuple, host_suffix.extract(pages, g).collect())) for g in (4, 16, 1000)]
    assert found[0] == found[1] == found[2] and sum(found[0].values()) == len(rows)
    for page, url, text, n in found[0]:
        if url.startswith("http://Big"):
            assert text == "\n\n".join(map(plain, want[page or 0])) and n == len(text)
        else:
            assert plain(often) not in text and len(text.split()) == 9


def test_a_host_of_more_pages_than_a_group_is_counted_whole(spark):
    shared = "<p>these ten words stand on one in five of all</p>"
    pages = spark.range(300).selectExpr(
        "id as page_id", "concat('http://a.b/', id) as url",
        f"concat('<p>', sha(string(id)), ' alone</p>', if(id % 5 = 0, '{shared}', '')) as html")
    got = host_suffix.extract(pages).collect()
    assert len(got) == 300 and not any("one in five" in r.text for r in got)


def test_runs_of_a_group_against_plain_counting():
    rng = random.Random(6)
    pages = [[" ".join(rng.choices("ab", [9, 1], k=rng.randint(0, 14))) or "x" for _ in range(rng.randint(0, 3))] for _ in range(60)]
    pages += [["one two three four five six seven eight nine"]] * 3
    names = [i // 2 if i < 60 else i for i in range(63)]
    found = collections.defaultdict(set)
    for name, page in zip(names, pages):
        every = " ".join(page).split()
        for i in range(len(every) - host_suffix.RUN + 1):
            found[tuple(every[i:i + host_suffix.RUN])].add(name)
    laid = host_suffix.laid_out(pages)
    begin = host_suffix.run_begins(laid)
    hashes = host_suffix.run_hashes(laid.tokens, begin)
    words = [w for page in pages for w in " ".join(page).split()]
    runs = [tuple(words[b:b + host_suffix.RUN]) for b in begin]
    assert set(runs) == set(found) and len(set(hashes.tolist())) == len(found)
    page, total = host_suffix.numbered(names)
    assert host_suffix.run_pages(laid, begin, page).tolist() == [len(found[r]) for r in runs] and total == 33
    known, n = host_suffix.count_pages(pages, names, np.unique(hashes)[::2])
    of = dict(zip(hashes.tolist(), runs))
    assert dict(zip(known.tolist(), n.tolist())) == {h: len(found[of[h]]) for h in np.unique(hashes)[::2].tolist()}
    assert set(host_suffix.frequent_runs(pages, names).tolist()) == {h for h, r in of.items() if len(found[r]) >= 0.2 * 33}


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>"), (5, "http://a/5", "<p>é</p>"), (3, None, None), (4, "u", ""), (7, "u\r\nX: y", "WARC/1.1\r\n\r\nx")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 5
    for page, _, text in rows:
        raw = (text or "").encode()
        assert got[page].payload_bytes == len(raw)
        assert got[page].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 5, 3, 4, 7)] == [
        ("revisit", 5), ("response", None), ("revisit", 4), ("response", None), ("response", None)]
    folder = str(tmp_path / "w")
    warc.write_pages(warc.with_revisits(pages), folder)
    some = warc.read(spark, folder).where("record_type = 'revisit' and headers['WARC-Target-URI'] = 'http://a/1'").collect()
    assert [r.refers_to for r in some] == [f"<{warc.ID_PREFIX}5>"]


def test_warc_cut_off_archives_fail_and_names_have_no_case(spark, tmp_path):
    good = (b"WARC/1.1\r\nwarc-type: response\r\nWARC-TARGET-URI: u\r\ncontent-length: 5\r\n\r\nabcde\r\n\r\n"
            b"WARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    bare = "record_type string, target_uri string, content_length long"

    def of(name, data, schema):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        return warc.read(spark, str(tmp_path / name), schema)

    assert [tuple(r) for r in of("good", good, bare).collect()] == [("response", "u", 5), ("revisit", None, 0)]
    assert [r.record_type for r in of("kept", good, bare).where("record_type = 'response'").collect()] == ["response"]
    head = good.index(b"abcde")
    for name, data in {"payload": good[:head + 3], "none": good[:head], "header": good[:head - 6],
                       "length": good.replace(b"content-length: 5", b"other: 5")}.items():
        for schema in (bare, bare + ", payload binary"):
            with pytest.raises(Exception, match="cut off|Content-Length"):
                of(f"{name}{len(schema)}", data, schema).collect()
        with pytest.raises(Exception, match="cut off|Content-Length"):
            of(f"{name} filtered", data, bare).where("record_type = 'metadata'").collect()


def test_warc_pages_without_rows_and_with_other_columns(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 300_000, "a", 1), (2, "u", None, "b", 2)],
                                  "page_id long, url string, html string, payload string, refers_to int")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert got[1].payload_bytes == 300_000 and got[2].payload_bytes == 0
    assert {r.record_type for r in got.values()} == {"response"}
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_joins_keep_repeated_rows(spark):
    """Equal results by the join and by the broadcast, where rows and ids are repeated."""
    rows = [(1, "a", "same"), (1, "a", "same"), (1, "a", "same"), (9, "b", "same"), (9, "b", "same"),
            (1, "a", "other"), (4, "c", "other"), (9, "b", "alone"), (2, "d", "own"), (2, "d", "own"), (None, "e", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    largest = {}
    for page, _, text in rows:
        largest[text] = max(largest.get(text, 0), page or 0)
    want = collections.Counter((page, url, text.encode(), largest[text] if page and page != largest[text] else None)
                               for page, url, text in rows)
    for share in (1, 1000):
        got = warc.with_revisits(pages, heavy_share=share).collect()
        assert collections.Counter((r.page_id, r.url, bytes(r.payload), r.refers_to) for r in got) == want


def test_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[40:80] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [1.0, None] + [1.0] * 6), (904, [1.0]),
             (None, [1.0] * 8), rows[3]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in learned_parts.search(table, F.col("vec_id") % 20 == 0, block=50).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 300, 20))
    hits = total = 0
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1)
        want = [i for i in sorted(range(300), key=lambda i: (-round(s[i], 9), i)) if i != q][:20]
        assert len(found) == 20 and [v for v, _ in found] == [v for v, _ in sorted(found, key=lambda t: (-t[1], t[0]))]
        assert all(score == pytest.approx(s[v]) for v, score in found)
        hits += len({v for v, _ in found} & set(want))
        total += 20
    assert hits / total >= 0.9
    copies = [v for v, _ in got[40] if 40 <= v < 80]
    assert copies == list(range(41, 41 + len(copies))) and len(copies) > 5
    few = spark.createDataFrame(rows[:3], table.schema)
    assert learned_parts.search(few, F.col("vec_id") == 0).count() == 2
    assert learned_parts.search(table.limit(0), F.lit(True)).count() == 0


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "MinHash near-dedup", "packing"]
    table = docs
    for name, stage in corpus_pipeline.STAGES:
        before, table = table, stage(spark, table, str(tmp_path))
        if name != "packing":
            assert table.columns == before.columns
    assert table.count() > 0


def thue_morse(n: int) -> tuple[str, str]:
    """Two texts that every sum of powers modulo 2**64 takes for one."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_and_paragraphs_do_not_meet_in_their_hashes(spark):
    one, other = thue_morse(2048)
    texts = [one, other, *(" ".join([w] * 8) for w in (one, other))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    found = {r.doc_id: r.ids for r in chunk_reuse.encode(df, PATH).collect()}
    assert [found[i] for i in range(4)] == ids
    packed = {}
    for r in packing.pack(df, PATH).collect():
        packed.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i in range(4):
        for start, length, crc in packed[i]:
            assert zlib.crc32(np.array([*ids[i], 1][start:start + length], "<u4").tobytes()) == crc
    assert all(r.kept for r in fast_sketch.near_duplicates(df).collect())
    prints = {r.doc_id: r.fingerprint for r in iblt.fingerprints(df).collect()}
    assert len(set(prints.values())) == 4
    known = maxent.scores(df, F.col("doc_id") == 0, F.lit(0)).orderBy("doc_id").collect()
    assert [r.n_known for r in known][:2] == [2, 1]
