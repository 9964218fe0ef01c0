"""Queries for seeded samples, quotas and assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley import vocab
from parley.catalog.fixture import _categories_case, dialogues, over_dialogues, sql_list, table
from parley.catalog.registry import query
from parley.functions import draws
from parley.operators import sampling


def d(key: str, seed: str) -> str:
    """The 32-bit draw in SQL."""
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT)"


def below(key: str, seed: str, bound: str) -> str:
    return f"({d(key, seed)} % ({bound}))"


def item(key: str, seed: str, values: list) -> str:
    return f"{sql_list(values)}[{below(key, seed, str(len(values)))} + 1]"


def weighted(key: str, seed: str, weights) -> str:
    arms = " ".join(f"WHEN {d(key, seed)} < {edge} THEN '{label}'"
                    for label, edge in draws.weight_edges(weights)[:-1])
    return f"CASE {arms} ELSE '{weights[-1][0]}' END"


@query("random_sample", f"""
  WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
  r AS (SELECT item_id, {below('item_id', 'seed', '(SELECT count(*) FROM documents)')} AS pos
        FROM benchmark)
  SELECT item_id, doc_id FROM r JOIN p USING (pos)""")
def random_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    asked = table(spark, sf_dir, "benchmark").select("item_id")
    return sampling.sample_with_replacement(docs, asked, "item_id", "seed", "doc_id").select(
        "item_id", "doc_id")


QUOTA = 1003  # leaves a remainder over the services


@query("stratified_quota", over_dialogues(f"""
  , g AS (SELECT DISTINCT services[1] AS service FROM dialogues),
  r AS (SELECT service, row_number() OVER (ORDER BY service) - 1 AS rank, count(*) OVER () AS n FROM g)
  SELECT service, {QUOTA} // n + CASE WHEN rank < {QUOTA} % n THEN 1 ELSE 0 END AS quota FROM r"""))
def stratified_quota(spark, sf_dir):
    services = dialogues(spark, sf_dir).select(
        F.get("services", F.lit(0)).alias("service")).distinct()
    return sampling.equal_quotas(services, QUOTA, "service")


@query("stratified_sample", over_dialogues(f"""
  , p AS (SELECT dialogue_id, services[1] AS service, row_number() OVER
            (PARTITION BY services[1] ORDER BY dialogue_id) - 1 AS pos,
            count(*) OVER (PARTITION BY services[1]) AS size FROM dialogues),
  g AS (SELECT service, size, row_number() OVER (ORDER BY service) - 1 AS rank,
          count(*) OVER () AS n FROM (SELECT DISTINCT service, size FROM p)),
  t AS (SELECT count(*) AS total FROM conversations),
  q AS (SELECT service, size, total // n + CASE WHEN rank < total % n THEN 1 ELSE 0 END AS quota,
          rank FROM g, t),
  asked AS (SELECT service, size, unnest(range(quota)) + sum_before AS request FROM (
    SELECT *, coalesce(sum(quota) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS sum_before FROM q)),
  a AS (SELECT service, size, CAST(request AS BIGINT) AS request FROM asked),
  drawn AS (SELECT request, service, {below('request', '7', 'size')} AS pos FROM a)
  SELECT request, service, dialogue_id, row_number() OVER
    (ORDER BY md5(CAST(request AS VARCHAR) || ':7:order'), request) - 1 AS rank
  FROM drawn JOIN p USING (service, pos)"""))
def stratified_sample(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").count()
    seeds = dialogues(spark, sf_dir).select("dialogue_id", F.get("services", F.lit(0)).alias("service"))
    return sampling.stratified_sample(seeds, "service", n, "7", "dialogue_id").select(
        "request", "service", "dialogue_id", "rank")


@query("weighted_choice", f"""
  SELECT doc_id, {weighted('doc_id', 's:size', vocab.SIZE_WEIGHTS)} AS size_class,
         {weighted('doc_id', 's:status', vocab.RESOLUTION_WEIGHTS)} AS resolution_status FROM documents""")
def weighted_choice(spark, sf_dir):
    docs = sampling.assign_size_class(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "s")
    return docs.withColumn("resolution_status", draws.draw_weighted(
        F.col("doc_id"), "s:status", vocab.RESOLUTION_WEIGHTS))


def _combination_sql(index: str) -> str:
    arms = " ".join(
        f"WHEN '{name}' THEN {sql_list(['+'.join(sorted(c)) for c in items])}[({index}) % {len(items)} + 1]"
        for name, items in vocab.COMBINATIONS.items())
    return f"CASE size_class {arms} END"


BALANCED_SQL = f"""
  WITH s AS (SELECT doc_id, {weighted('doc_id', 'b:size', vocab.SIZE_WEIGHTS_SERIAL)} AS size_class
             FROM documents),
  p AS (SELECT *, row_number() OVER (PARTITION BY size_class ORDER BY
          md5(CAST(doc_id AS VARCHAR) || ':b:turn'), doc_id) - 1 AS pos FROM s),
  assigned AS (SELECT doc_id, size_class, {_combination_sql('pos')} AS combination FROM p)"""


def balanced(spark, sf_dir):
    docs = sampling.assign_size_class(
        table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "b", vocab.SIZE_WEIGHTS_SERIAL)
    return sampling.balanced_services(docs, "doc_id", "b")


@query("balanced_assignment", f"{BALANCED_SQL} SELECT doc_id, size_class, combination FROM assigned")
def balanced_assignment(spark, sf_dir):
    return balanced(spark, sf_dir).select("doc_id", "size_class", "combination")


@query("combination_usage", f"""{BALANCED_SQL},
  known AS ({' UNION ALL '.join(
      f"SELECT '{s}' AS size_class, unnest({sql_list(['+'.join(sorted(c)) for c in items])}) AS combination"
      for s, items in vocab.COMBINATIONS.items())}),
  used AS (SELECT size_class, combination, count(doc_id) AS uses
           FROM known LEFT JOIN assigned USING (size_class, combination) GROUP BY 1, 2)
  SELECT size_class, min(uses) AS min_uses, max(uses) AS max_uses FROM used GROUP BY 1""")
def combination_usage(spark, sf_dir):
    return sampling.usage_spread(sampling.combination_usage(balanced(spark, sf_dir)))


@query("random_services", f"""
  WITH s AS (SELECT doc_id, {weighted('doc_id', 'r:size', vocab.SIZE_WEIGHTS)} AS size_class FROM documents),
  c AS (SELECT doc_id, size_class, {d('doc_id', 'r:combination')} AS draw FROM s),
  l AS (SELECT doc_id, size_class, CASE size_class {' '.join(
      f"WHEN '{n}' THEN {sql_list(items)}[draw % {len(items)} + 1]"
      for n, items in vocab.COMBINATIONS.items())} END AS services FROM c),
  u AS (SELECT doc_id, size_class, unnest(services) AS service,
          generate_subscripts(services, 1) - 1 AS i FROM l)
  SELECT doc_id, size_class, string_agg(service, ',' ORDER BY
    md5(doc_id || ':r:shuffle:' || i)) AS services FROM u GROUP BY 1, 2""")
def random_services(spark, sf_dir):
    docs = sampling.assign_size_class(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "r")
    return sampling.random_services(docs, "doc_id", "r").withColumn(
        "services", F.array_join("services", ","))


_STARTS = [a for a, _, _ in vocab.TIME_SLOTS]
_ENDS = [b for _, b, _ in vocab.TIME_SLOTS]
_NAMES = [n for _, _, n in vocab.TIME_SLOTS]


@query("scenario_choices", over_dialogues(f"""
  , c AS (SELECT *, {_categories_case()} AS cats FROM dialogues)
  SELECT dialogue_id, {item('dialogue_id', 'q:region', vocab.REGIONS)} AS region,
         cats[{below('dialogue_id', 'q:category', 'len(cats)')} + 1] AS category,
         {item('dialogue_id', 'q:slot', _NAMES)} AS slot,
         {item('dialogue_id', 'q:user', vocab.USER_EMOTIONS)} AS user_emotion,
         {item('dialogue_id', 'q:assistant', vocab.ASSISTANT_EMOTIONS)} AS assistant_emotion,
         {weighted('dialogue_id', 'q:status', vocab.RESOLUTION_WEIGHTS)} AS status FROM c"""))
def scenario_choices(spark, sf_dir):
    asked = dialogues(spark, sf_dir).select("dialogue_id", "services")
    return sampling.with_scenario_choices(asked, "dialogue_id", "q").select(
        "dialogue_id", F.get("regions", F.lit(0)).alias("region"),
        F.col("scenario_category").alias("category"), F.col("time_slot.description").alias("slot"),
        F.get("user_emotions", F.lit(0)).alias("user_emotion"),
        F.get("assistant_emotions", F.lit(0)).alias("assistant_emotion"),
        F.col("resolution_status").alias("status"))


@query("slot_time", f"""
  WITH s AS (SELECT doc_id, {item('doc_id', 't:slot', _STARTS)} AS s, {item('doc_id', 't:slot', _ENDS)} AS e
             FROM documents),
  h AS (SELECT *, {d('doc_id', 't:half')} < 2147483648 AS evening FROM s),
  b AS (SELECT *, CASE WHEN e < s AND NOT evening THEN 0 ELSE s * 60 END AS first,
          CASE WHEN e < s AND evening THEN 1440 ELSE e * 60 END AS last FROM h),
  m AS (SELECT *, first + 5 * {below('doc_id', 't:step', '(last - first) // 5')} AS minutes FROM b)
  SELECT doc_id, lpad(CAST(minutes // 60 AS VARCHAR), 2, '0') || ':'
    || lpad(CAST(minutes % 60 AS VARCHAR), 2, '0') AS time FROM m""")
def slot_time(spark, sf_dir):
    slot = draws.draw_from(F.col("doc_id"), "t:slot", vocab.slot_structs())
    docs = table(spark, sf_dir, "documents").select("doc_id", slot.alias("slot"))
    return docs.select("doc_id", draws.slot_time(
        F.col("doc_id"), "t", F.col("slot.start"), F.col("slot.end")).alias("time"))


@query("parameter_draws", f"""
  SELECT doc_id, {item('doc_id', 'p:temperature', vocab.TEMPERATURES)}::DOUBLE AS temperature,
         {item('doc_id', 'p:penalty', vocab.PENALTIES)}::DOUBLE AS frequency_penalty,
         round(0.9::DOUBLE + 0.1::DOUBLE * ({d('doc_id', 'p:top')} / 4294967296::DOUBLE), 6) AS top_p
  FROM documents""")
def parameter_draws(spark, sf_dir):
    key = F.col("doc_id")

    def options(values):
        return F.array(*[F.lit(v) for v in values])

    return table(spark, sf_dir, "documents").select(
        "doc_id",
        draws.draw_from(key, "p:temperature", options(vocab.TEMPERATURES)).alias("temperature"),
        draws.draw_from(key, "p:penalty", options(vocab.PENALTIES)).alias("frequency_penalty"),
        F.round(draws.draw_range(key, "p:top", 0.9, 1.0), 6).alias("top_p"))


@query("persona_pick", f"""
  WITH r AS (SELECT DISTINCT conv_id FROM conversations),
  m AS (SELECT 'cluster' AS kind, source AS grp, doc_id FROM documents
        UNION ALL SELECT 'summary', lang, doc_id FROM documents),
  mm AS (SELECT *, row_number() OVER (PARTITION BY kind, grp ORDER BY doc_id) - 1 AS mpos,
           count(*) OVER (PARTITION BY kind, grp) AS size FROM m),
  g AS (SELECT kind, grp, size, row_number() OVER (PARTITION BY kind ORDER BY grp) - 1 AS gpos,
          count(*) OVER (PARTITION BY kind) AS n FROM (SELECT DISTINCT kind, grp, size FROM mm)),
  c AS (SELECT conv_id, CASE WHEN {d('conv_id', 'z:coin')} < 2147483648 THEN 'cluster'
          ELSE 'summary' END AS kind, {d('conv_id', 'z:group')} AS gd,
          {d('conv_id', 'z:member')} AS md FROM r),
  x AS (SELECT conv_id, g.kind, g.grp, md % g.size AS mpos
        FROM c JOIN g ON g.kind = c.kind AND g.gpos = gd % g.n)
  SELECT conv_id, kind AS grouping_kind, grp AS group_value, doc_id FROM x JOIN mm USING (kind, grp, mpos)""")
def persona_pick(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    docs = table(spark, sf_dir, "documents")
    return sampling.pick_personas(
        asked, "conv_id", docs, "source", "lang", "doc_id", "z"
    ).select("conv_id", F.col("by").alias("grouping_kind"), F.col("group").alias("group_value"), "doc_id")


@query("persona_index", """
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position
  FROM documents""")
def persona_index(spark, sf_dir):
    return sampling.members_by_group(table(spark, sf_dir, "documents"), "source", "doc_id").select(
        "source", "doc_id", "position")


@query("seeds_by_service", over_dialogues("""
  SELECT services[1] AS service, dialogue_id, row_number() OVER
    (PARTITION BY services[1] ORDER BY dialogue_id) - 1 AS position FROM dialogues"""))
def seeds_by_service(spark, sf_dir):
    seeds = dialogues(spark, sf_dir).where(F.size("services") > 0).select(
        "dialogue_id", F.get("services", F.lit(0)).alias("service"))
    return sampling.members_by_group(seeds, "service", "dialogue_id")
