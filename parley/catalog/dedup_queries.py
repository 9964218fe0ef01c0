"""Queries for hashing, membership, similarity and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.catalog.fixture import dialogues, over_dialogues, table
from parley.catalog.registry import query
from parley.functions.hashing import content_hash, fingerprint
from parley.functions.vectors import norm
from parley.operators import dedup, similarity, survivors, vector_index
from parley.operators.joins import seen, split_by_ids, unseen
from parley.operators.shape import base_conversation, seeds_from_rows
from parley.session import scratch_path

THRESHOLD = 0.4  # high enough to have few pairs, low enough to have some in the given vectors

LINES_SQL = """
  doc_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
  known AS (SELECT DISTINCT sha256(line) AS hash FROM
            (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark))"""


def lines(df, id_column):
    return df.select(id_column, F.explode(F.split("text", "\n")).alias("line")).withColumn(
        "hash", fingerprint(F.col("line")))


def documents_as_turns(spark, sf_dir):
    """Each document as a one-turn dialogue."""
    turn = F.struct(F.lit(1).alias("turn_number"), F.col("text").alias("utterance"),
                    F.col("lang").alias("intent"), F.lit("").alias("assistant_response"))
    return table(spark, sf_dir, "documents").withColumn("turns", F.array(turn))


def greedy_sql(rows: str, final: str, fixed: str = "false", first: str | None = None) -> str:
    """SQL for greedy survivors of ``rows`` = (id, v).

    ``fixed`` tells which rows always survive, ``first`` which are visited before the others.
    """
    first = first or fixed
    return f"""
  WITH RECURSIVE src AS ({rows}),
  numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {first} DESC, id) AS rn FROM src),
  earlier AS MATERIALIZED (
    SELECT b.rn, list(a.rn) AS near FROM numbered a JOIN numbered b
      ON a.rn < b.rn AND list_cosine_similarity(a.v, b.v) >= {THRESHOLD} GROUP BY b.rn),
  walk AS (
    SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept
    UNION ALL
    SELECT n.rn, CASE WHEN NOT ({fixed}) AND list_has_any(coalesce(e.near, []), w.kept) THEN w.kept
                      ELSE list_append(w.kept, n.rn) END
    FROM walk w JOIN numbered n ON n.rn = w.rn + 1 LEFT JOIN earlier e ON e.rn = n.rn),
  survivors AS (SELECT unnest(kept) AS rn FROM (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1))
  {final}"""


@query("exact_dedup", """
  SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(text)), lang ORDER BY doc_id) > 1
    AS is_duplicate FROM documents""")
def exact_dedup(spark, sf_dir):
    docs = documents_as_turns(spark, sf_dir).select(
        "doc_id", content_hash(F.col("turns")).alias("hash"))
    return dedup.flag_exact_duplicates(docs, "hash", "doc_id").select("doc_id", "is_duplicate")


@query("dedup_counts", """
  SELECT count(*) AS total, count(DISTINCT lower(trim(text)) || lang) AS included,
         count(*) - count(DISTINCT lower(trim(text)) || lang) AS excluded FROM documents""")
def dedup_counts(spark, sf_dir):
    hashed = documents_as_turns(spark, sf_dir).select(content_hash(F.col("turns")).alias("hash"))
    per_hash = hashed.groupBy("hash").agg(F.count("*").alias("n"))
    return per_hash.agg(F.sum("n").alias("total"), F.count("*").alias("included"),
                        (F.sum("n") - F.count("*")).alias("excluded"))


@query("line_overlap_anti", f"""
  WITH {LINES_SQL}
  SELECT doc_id, count(*) AS new_lines FROM doc_lines
  WHERE sha256(line) NOT IN (SELECT hash FROM known) GROUP BY doc_id""")
def line_overlap_anti(spark, sf_dir):
    fresh = unseen(lines(table(spark, sf_dir, "documents"), "doc_id"),
                   lines(table(spark, sf_dir, "benchmark"), "item_id"), ["hash"])
    return fresh.groupBy("doc_id").agg(F.count("*").alias("new_lines"))


@query("line_overlap_semi", f"""
  WITH {LINES_SQL}
  SELECT doc_id, count(*) AS known_lines FROM doc_lines
  WHERE sha256(line) IN (SELECT hash FROM known) GROUP BY doc_id""")
def line_overlap_semi(spark, sf_dir):
    old = seen(lines(table(spark, sf_dir, "documents"), "doc_id"),
               lines(table(spark, sf_dir, "benchmark"), "item_id"), ["hash"])
    return old.groupBy("doc_id").agg(F.count("*").alias("known_lines"))


@query("unused_seeds", """
  WITH c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body
             FROM conversations GROUP BY conv_id)
  SELECT conv_id FROM c WHERE NOT EXISTS
    (SELECT 1 FROM conversations x JOIN labels l ON l.doc_id = x.conv_id AND l.quality = 1
     WHERE x.conv_id = c.conv_id)""")
def unused_seeds(spark, sf_dir):
    # the state holds the conversations whose document is labelled good
    seeds = seeds_from_rows(table(spark, sf_dir, "conversations")).select(
        "conv_id", fingerprint(base_conversation(F.col("turns"))).alias("hash"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("conv_id"))
    used = seeds.join(good, "conv_id", "left_semi")
    return unseen(seeds, used, ["hash"]).select("conv_id")


@query("pending_inputs", """
  SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending_inputs(spark, sf_dir):
    return unseen(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                  ["doc_id"]).select("doc_id")


@query("split_by_ids", """
  SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS removed FROM documents""")
def split_documents(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    kept, removed = split_by_ids(table(spark, sf_dir, "documents").select("doc_id"), toxic, "doc_id")
    return kept.withColumn("removed", F.lit(False)).unionByName(
        removed.withColumn("removed", F.lit(True)))


@query("vector_norms", """
  WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM e""")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


def vectors(spark, sf_dir):
    return similarity.numbered_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("knn_topk", """
  WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  p AS (SELECT a.vec_id, b.vec_id AS nbr, list_cosine_similarity(a.v, b.v) AS s
        FROM e a JOIN e b ON a.vec_id <> b.vec_id)
  SELECT vec_id, nbr, round(s, 6) AS sim,
         row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, nbr) AS rank
  FROM p QUALIFY rank <= 10""")
def knn_topk(spark, sf_dir):
    found = similarity.nearest_neighbours(vectors(spark, sf_dir), 10)
    return found.select(F.col("id").alias("vec_id"), "nbr", F.round("sim", 6).alias("sim"), "rank")


@query("max_similarity", """
  WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  SELECT a.vec_id, round(max(list_cosine_similarity(a.v, b.v)), 6) AS max_sim
  FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY a.vec_id""")
def max_similarity(spark, sf_dir):
    found = similarity.nearest_neighbours(vectors(spark, sf_dir), 1)
    return found.select(F.col("id").alias("vec_id"), F.round("sim", 6).alias("max_sim"))


def _stored_index(spark, sf_dir):
    """An index of small cells, and nine tenths of them as the number to visit."""
    index = vector_index.build(vectors(spark, sf_dir), scratch_path(spark, "index"), leaf_rows=256, shard_rows=128)
    return index, max(1, index.cells().count() * 9 // 10)


@query("approx_neighbours")
def approx_neighbours(spark, sf_dir):
    index, probes = _stored_index(spark, sf_dir)
    found = index.search(vectors(spark, sf_dir), 50, probes)
    return found.select(F.col("id").alias("vec_id"), "nbr", F.round("sim", 6).alias("sim"), "rank")


@query("approx_recall", """
  SELECT count(*) AS vectors, true AS recall_reached, true AS cells_left_out, true AS no_false_likeness
  FROM embeddings""")
def approx_recall(spark, sf_dir):
    """Whether the stored index finds nine tenths of the ten nearest without visiting all cells."""
    index, probes = _stored_index(spark, sf_dir)
    rows = vectors(spark, sf_dir)
    found = index.search(rows, 10, probes)
    exact = similarity.nearest_neighbours(rows, 10)
    both = exact.select("id", "nbr", F.col("sim").alias("likeness")).join(
        found.select("id", "nbr", "sim"), ["id", "nbr"], "left")
    return both.agg(
        F.count_distinct("id").alias("vectors"), (F.count("sim") >= 0.9 * F.count("*")).alias("recall_reached"),
        (F.lit(probes) < index.cells().count()).alias("cells_left_out"),
        F.coalesce(F.every(F.abs(F.col("sim") - F.col("likeness")) < 1e-9), F.lit(True)).alias("no_false_likeness"))


@query("semantic_dedup", greedy_sql(
    "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    """SELECT id AS vec_id, rn NOT IN (SELECT rn FROM survivors) AS is_duplicate FROM numbered"""))
def semantic_dedup(spark, sf_dir):
    return dedup.flag_semantic_duplicates(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", THRESHOLD)


@query("semantic_dedup_in_cells", greedy_sql(
    "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    """SELECT id AS vec_id, rn NOT IN (SELECT rn FROM survivors) AS is_duplicate FROM numbered"""))
def semantic_dedup_in_cells(spark, sf_dir):
    """The same on the path that larger tables take."""
    return dedup.flag_semantic_duplicates(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", THRESHOLD, small_values=0, cells=8)


@query("negative_id_dedup", greedy_sql(
    "SELECT vec_id - 1000 AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "SELECT id, rn IN (SELECT rn FROM survivors) AS kept FROM numbered"))
def negative_id_dedup(spark, sf_dir):
    """Ids on either side of zero stand for the order like any others."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1000).alias("id"), "embedding")
    return survivors.greedy_survivors(similarity.numbered_vectors(rows, "id", "embedding"), THRESHOLD)


@query("two_stage_dedup", greedy_sql(
    """SELECT doc_id AS id, v FROM (
         SELECT d.doc_id, CAST(e.embedding AS DOUBLE[]) AS v,
                row_number() OVER (PARTITION BY lower(trim(d.text)), d.lang ORDER BY d.doc_id) AS copy
         FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)
       WHERE copy = 1 AND v IS NOT NULL""",
    """SELECT d.doc_id, CASE WHEN d.doc_id IN (SELECT id FROM src) THEN 'semantic' ELSE 'exact' END
         AS stage
       FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(text)), lang ORDER BY doc_id) AS copy
             FROM documents) d
       WHERE copy > 1 OR d.doc_id IN (SELECT id FROM src)
         AND d.doc_id NOT IN (SELECT id FROM numbered JOIN survivors USING (rn))"""))
def two_stage_dedup(spark, sf_dir):
    docs = documents_as_turns(spark, sf_dir).join(
        table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    rows = docs.select("doc_id", content_hash(F.col("turns")).alias("hash"), "embedding")
    return dedup.two_stage_duplicates(rows, "hash", "doc_id", "embedding", THRESHOLD)


# Vectors of the even labels are the state, those of the odd labels arrive.
STATE_SQL = """SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label % 2 = 0 AS old
               FROM embeddings"""


def _state_and_new(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "hash", F.sha2(F.col("vec_id").cast("string"), 256))
    old = F.col("label") % 2 == 0
    return rows.where(old), rows.where(~old)


@query("incremental_unique", greedy_sql(STATE_SQL, """
  SELECT id AS vec_id FROM numbered JOIN survivors USING (rn) WHERE NOT old""", "old"))
def incremental_unique(spark, sf_dir):
    old, new = _state_and_new(spark, sf_dir)
    kept = dedup.append_unique(
        new, old, similarity.numbered_vectors(old, "vec_id", "embedding"),
        key="hash", position="vec_id", vector="embedding", threshold=THRESHOLD)
    return kept.select("vec_id")


@query("snapshot_unique", f"""
  WITH s AS ({STATE_SQL})
  SELECT id AS vec_id FROM s n WHERE NOT old AND NOT EXISTS (
    SELECT 1 FROM s o WHERE o.old AND list_cosine_similarity(o.v, n.v) >= {THRESHOLD})""")
def snapshot_unique(spark, sf_dir):
    old, new = _state_and_new(spark, sf_dir)
    kept = dedup.append_unique(
        new, old, similarity.numbered_vectors(old, "vec_id", "embedding"),
        key="hash", position="vec_id", vector="embedding", threshold=THRESHOLD, among_new=False)
    return kept.select("vec_id")
