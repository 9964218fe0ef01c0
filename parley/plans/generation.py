"""One generation batch: requests, choices, prompts, caller's model, parsing, unique append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley import vocab
from parley.functions import prompts, text
from parley.functions.hashing import fingerprint
from parley.operators import sampling
from parley.operators.dedup import append_unique
from parley.operators.joins import lookup, unseen
from parley.operators.model_stage import Generate, generate, outcomes
from parley.operators.shape import base_conversation, with_dialogue_id, zip_seed_turns
from parley.session import cut


def plan_requests(seeds: DataFrame, personas: DataFrame, n: int, seed: str, used: DataFrame,
                  *, balanced: bool = False) -> DataFrame:
    """``n`` requests with seed conversation, services, choices, persona and the scenario prompt.

    ``seeds`` is (dialogue_id, services, turns as parallel arrays), ``personas`` has ``idx``,
    ``cluster_label``, ``summary_label`` and ``persona``. ``used`` holds the hashes of base
    conversations that are spent; requests for those are dropped.
    """
    base = base_conversation(zip_seed_turns(F.col("turns")))
    ready = seeds.select(F.col("dialogue_id").alias("seed_id"), base.alias("base_conversation"))
    requests = sampling.sample_with_replacement(
        ready, sampling.request_table(seeds, n), "request", f"{seed}:seed", "seed_id")
    requests = unseen(requests.withColumn("hash", fingerprint(F.col("base_conversation"))),
                      used, ["hash"]).drop("hash")
    weights = vocab.SIZE_WEIGHTS_SERIAL if balanced else vocab.SIZE_WEIGHTS
    requests = sampling.assign_size_class(requests, "request", seed, weights)
    pick = sampling.balanced_services if balanced else sampling.random_services
    requests = sampling.with_scenario_choices(pick(requests, "request", seed), "request", seed)
    keyed = personas.withColumn("summary_key", F.to_json(text.label_key(F.col("summary_label"))))
    requests = sampling.pick_personas(
        requests, "request", keyed, "cluster_label", "summary_key", "idx", f"{seed}:persona")
    requests = lookup(requests, personas.select("idx", "persona"), ["idx"]).drop("idx", "by", "group")
    system, user = prompts.scenario_prompts(
        F.col("persona"), F.col("time"), F.col("time_slot.description"), F.get("regions", F.lit(0)),
        F.col("scenario_category"), F.col("services"))
    return requests.withColumns({"system": system, "user": user})


def run_batch(
    requests: DataFrame, write_scenario: Generate, write_dialogue: Generate,
    embed_texts, known_hashes: DataFrame, known_vectors: DataFrame, *, min_turns: int = 5,
    max_turns: int = 10, threshold: float = 0.9, attempts: int = 3, among_new: bool = True, **search,
) -> tuple[DataFrame, DataFrame]:
    """(new dialogues with ``hash`` and ``embedding``, all generation attempts).

    ``embed_texts`` maps (request, text) to (request, embedding).
    """
    requests = cut(requests)
    told = generate(requests.select("request", "system", "user"), "request", write_scenario, attempts,
                    valid=lambda body: text.strip(body) != "")
    scenarios = outcomes(told, "request").where("ok").select(
        "request", F.col("text").alias("generated_scenario"))
    staged = cut(requests.drop("system", "user").join(scenarios, "request"))
    system, user = prompts.dialogue_prompts(
        F.col("base_conversation"), F.col("services"), F.col("generated_scenario"), F.col("regions"),
        F.col("user_emotions"), F.col("assistant_emotions"), F.col("resolution_status"),
        min_turns, max_turns)
    tried = generate(staged.select("request", system.alias("system"), user.alias("user")),
                     "request", write_dialogue, attempts)
    texts = outcomes(tried, "request").where("ok").select("request", "text")
    parsed = staged.join(texts, "request").withColumn("turns", text.parse_turns(F.col("text")))
    body = text.render_hash_text(F.col("turns"))
    fresh = cut(parsed.withColumns({
        "body": body, "num_lines": F.size("turns"), "hash": fingerprint(body)}))
    fresh = cut(fresh.join(embed_texts(fresh.select("request", "body")), "request"))  # the model runs once
    kept = append_unique(fresh, known_hashes, known_vectors, key="hash", position="request",
                         vector="embedding", threshold=threshold, among_new=among_new, **search)
    named = with_dialogue_id(kept.withColumn("seed_request", F.concat_ws(":", "hash", F.col("request").cast("string"))),
                             "seed_id", "seed_request")
    return named.select(
        "dialogue_id", "services", "turns", "num_lines", "user_emotions", "assistant_emotions",
        "scenario_category", "generated_scenario", "time_slot", "regions", "resolution_status",
        "hash", "embedding"), tried
