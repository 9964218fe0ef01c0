"""The queries of this folder, under the names and with the columns they are asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (
    chunk_reuse, conversation_repair, fast_sketch, host_suffix, iblt, learned_parts, maxent, merkle, packing, ppm,
    run_index, toxicity, warc, word_tokens,
)
from parley.llm.arrays import in_fold, learnt_from

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_nb_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learnt_from(F.col("doc_id"), 3, 1))
    return (toxicity.scores(docs, model, ["doc_id"])
            .select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                    (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")))


@query
def op8_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_reuse.digests(table(spark, sf_dir, "documents"), word_tokens.default_path())


@query
def op9_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokens.default_path())


@query
def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = ppm.fit(docs, learnt_from(F.col("doc_id"), 4, 2))
    return (ppm.predict(docs, model, ["doc_id"])
            .select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score"))


@query
def op6_fast_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast_sketch.near_duplicates(table(spark, sf_dir, "documents"))


def _sql_base32(digest: str) -> str:
    """Upper-case base 32 of a SHA-1 given in hex."""
    letters = []
    for group in range(8):
        bits = f"('0x' || substr({digest}, {5 * group + 1}, 5))::BIGINT"
        letters += [f"substr('{warc.BASE32}', (({bits} >> {shift}) % 32 + 1)::BIGINT, 1)"
                    for shift in (15, 10, 5, 0)]
    return " || ".join(letters)


ORACLES["op1_warc_archive"] = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, url, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hexed FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY hexed) AS original FROM d)
SELECT page_id, payload_bytes, {_sql_base32('hexed')} AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to, url
FROM m
"""


@query
def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op3_learned_parts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_parts.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op2_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


@query
def op5_host_suffix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_suffix.extract(table(spark, sf_dir, "pages"))


@query
def op7_hashed_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id = F.col("doc_id")
    turn = F.floor(F.crc32(doc_id.cast("string")) / 7)
    return (maxent.scores(table(spark, sf_dir, "documents"), learnt_from(doc_id, 7, 2), turn)
            .withColumn("held_out", in_fold(doc_id, 7, 2)))


def _crc_table() -> str:
    """The table of crc32, from its polynomial, as ``crc(t)``."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(str(x))
    return f"crc AS (SELECT [{', '.join(out)}]::BIGINT[] AS t)"


def _sql_crc32(text: str) -> str:
    """crc32 of a text of one-byte letters; needs ``crc`` among the tables."""
    letters = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {letters}), "
            f"lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8)))")


def _sql_field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}, '-')"


def _sql_levels(name: str, bottom: str, key: str) -> str:
    return f"""{name} AS (
  SELECT {key}0 AS k, {bottom}
  UNION ALL
  SELECT {key}k + 1, list_transform(range(0, (len(nodes) + 1) // 2),
    lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM {name} WHERE len(nodes) > 1)"""


_LEAF = " || ".join(_sql_field(c) for c in merkle.FIELDS)
ORACLES["op11_block_string_merkle"] = f"""
WITH RECURSIVE {_crc_table()},
hashed AS (SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
  sha256(CASE WHEN {_sql_crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_LEAF.replace('n_chars', '(n_chars + 1)')}
         ELSE {_LEAF} END) AS now FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
{_sql_levels('up', 'list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY lang', 'lang, ')},
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos
             FROM up WHERE len(nodes) = 1),
{_sql_levels('top', 'list(subroot ORDER BY pos) AS nodes FROM subroots', '')},
steps AS (
  SELECT l.lang, l.pos, 0 AS tier, k, l.pos >> k AS own, nodes
  FROM leaves l JOIN up ON l.lang IS NOT DISTINCT FROM up.lang AND len(nodes) > 1
  UNION ALL
  SELECT l.lang, l.pos, 1, k, s.pos >> k, nodes
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN top ON len(nodes) > 1),
paths AS (SELECT lang, pos, list({{'odd': own & 1, 'h': coalesce(nodes[xor(own, 1) + 1], '')}} ORDER BY tier, k) AS path
          FROM steps GROUP BY lang, pos),
proved AS (
  SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, coalesce(path, []) AS path, now
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN paths p ON l.lang IS NOT DISTINCT FROM p.lang AND l.pos = p.pos)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(path, lambda x: x.h)), 'string_agg', ''))
         AS proof_sha256,
       list_reduce(list_prepend({{'odd': 0::BIGINT, 'h': now}}, path), lambda made, x: {{'odd': 0::BIGINT,
         'h': sha256(CASE WHEN x.odd = 1 THEN x.h || made.h ELSE made.h || x.h END)}}).h AS folded_root,
       folded_root = root AS verified
FROM proved
"""


@query
def op11_block_string_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


ORACLES["op12_run_index_dedup"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, doc_id, n, base, substr(h, 2 * base + 1, 2 * (256 + {run_index.LENGTH})) AS piece
           FROM (SELECT *, len(h) // 2 AS n, unnest(range(0, len(h) // 2, 256)) AS base FROM docs)),
places AS (SELECT r, doc_id, n, base + k AS i, substr(piece, 2 * k + 1, 2) AS b,
             substr(piece, 2 * k + 1, {2 * run_index.LENGTH}) AS s
           FROM (SELECT *, unnest(range(least(256, n - base))) AS k FROM pieces)),
strings AS (SELECT r, doc_id, i, s FROM places WHERE i + {run_index.LENGTH} <= n),
least AS (SELECT s, min(doc_id) AS owner FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT r, i FROM strings JOIN least USING (s) WHERE owner < doc_id),
marked AS (SELECT p.r, p.i, p.b, coalesce(p.i - max(hits.i) OVER (
             PARTITION BY p.r ORDER BY p.i) < {run_index.LENGTH}, false) AS gone
           FROM places p LEFT JOIN hits ON p.r = hits.r AND p.i = hits.i),
turned AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS starts FROM marked),
summed AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans,
             string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM turned GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN summed USING (r)
"""


@query
def op12_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_index.without_repeats(table(spark, sf_dir, "documents"), texts=False)
    return found.withColumnRenamed("kept", "kept_sha256")


def _sql_repair() -> str:
    """Forward search over the rows of a conversation: the best (cost, audit, text) of each state."""
    never = "{'c': 1000000000, 'a': '', 'b': ''}"

    def step(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'b': {state}.b || {line}}}"

    def best(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def inserted(table: str) -> str:
        user = best("s2", *[step(s, "3", "I", "chr(10) || 'user:'") for s in ("s0", "s1", "s3")])
        return (f"SELECT * REPLACE ({best('s3', step('s2', '3', 'I', "chr(10) || 'assistant:'"))} AS s3) "
                f"FROM (SELECT * REPLACE ({user} AS s2) FROM {table})")

    more = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN fresh AND initial = '{initial}' THEN {step(state, more, 'K', 'chr(10) || line')} ELSE {never} END"

    def given(state: str, role: str) -> str:
        return f"CASE WHEN fresh THEN {step(state, '3 + ' + more, 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} ELSE {never} END"

    users = [f(s, x) for s in ("s0", "s1", "s3") for f, x in ((kept, "u"), (given, "user"))]
    moved = f"""{step('s0', '4', 'D')} AS s0, {best(step('s1', '4', 'D'), kept('s0', 's'))} AS s1,
      {best(step('s2', '4', 'D'), *users)} AS s2,
      {best(step('s3', '4', 'D'), kept('s2', 'a'), given('s2', 'assistant'))} AS s3"""
    plain = "coalesce({0}::VARCHAR, ' ')"
    space = r"[\t-\r ]"
    return f"""
WITH RECURSIVE {_crc_table()},
hurt AS (SELECT conv_id, turn, {plain.format('role')} AS role, {plain.format('text')} AS text,
           {_sql_crc32(plain.format('conv_id') + " || ':' || " + plain.format('turn'))} % 20 AS k FROM conversations, crc),
left_over AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
           CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM hurt WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
             left(role, 1) AS initial, role || ':' || text AS line,
             regexp_replace(text, '{space}+$', '') AS body FROM left_over),
judged AS (SELECT *, CASE WHEN regexp_full_match(text, '{space}*') THEN 'blank'
             WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
             WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             fault NOT IN ('blank', 'duplicate') AS fresh,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
              count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
              count(*) FILTER (fault = 'truncated') AS truncated,
              count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0 AS i, {{'c': 0, 'a': '', 'b': ''}} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM counted
  UNION ALL
  SELECT conv_id, i + 1, {moved}
  FROM (SELECT w.*, j.text, j.line, j.initial, j.fault, j.fresh FROM ({inserted('walk')}) w
        JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = w.i + 1)),
ends AS (SELECT w.conv_id, {best('s0', 's3')} AS s FROM ({inserted('walk')}) w
         JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.c, 0)::BIGINT AS cost,
  coalesce(s.a, '') AS audit, sha256(coalesce(s.b[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLES["op13_rank_convergence_repair"] = _sql_repair()


@query
def op13_rank_convergence_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))
