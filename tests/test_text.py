"""Parsers, renderers, predicates and text statistics on hand-written cases."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from parley.functions import draws, text
from parley.functions.hashing import content_hash
from parley.operators import entities, filters, sentiment, shape
from parley.schemas import DIALOGUE_JSON, TURN

C = F.col


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(C("x")).alias("y")).first().y


GOOD = ("<User>Book a hotel room</User> <Intent>hotel_booking</Intent> "
        "<Assistant>I'll help you book a hotel room.</Assistant>")


def test_one_valid_turn(spark):
    turns = one(spark, text.parse_turns, GOOD)
    assert turns == [Row(turn_number=1, utterance="Book a hotel room", intent="hotel_booking",
                         assistant_response="I'll help you book a hotel room.")]
    assert one(spark, text.is_valid_generation, GOOD)
    assert one(spark, text.has_turn_format, GOOD)


def test_unclosed_tags_are_invalid(spark):
    bad = "<User>Incomplete dialogue <Intent>incomplete_intent"
    assert one(spark, text.parse_turns, bad) == []
    assert not one(spark, text.is_valid_generation, bad)


def test_newlines_and_blanks(spark):
    body = "<User>a\nb</User>\n<Intent></Intent>\n<Assistant> c </Assistant>"
    assert one(spark, text.parse_turns, body)[0].utterance == "a\nb"
    assert one(spark, text.parse_turns, body)[0].intent == ""
    filled = one(spark, text.parse_turns_filling, body)[0]
    assert (filled.intent, filled.assistant_response) == ("N/A", "c")


def test_nested_tags(spark):
    nested = "<User><User>x</User> <Intent>i</Intent> <Assistant>a</Assistant>"
    assert one(spark, text.has_nested_tags, nested)
    assert not one(spark, lambda x: text.has_nested_tags(x, literal=True), nested)
    assert not one(spark, text.is_valid_generation, nested)


def test_null_text_is_not_valid(spark):
    assert one(spark, text.is_valid_generation, None) is False


def test_strip_is_unicode(spark):
    assert one(spark, text.strip, "  \t a b 　\x1c") == "a b"


def test_rogue_brackets(spark):
    for value, rogue in [("a < b", True), ("</p>", True), ("5>", True), ("<b>", False),
                         ("plain", False), ("<", True), (">", True), (None, False)]:
        assert one(spark, text.has_rogue_brackets, value) is rogue


def turns(spark, rows):
    return spark.createDataFrame([(rows,)], f"t array<{TURN.simpleString()}>")


def test_renderers_skip_blank_parts(spark):
    df = turns(spark, [(1, "hi ", "greet", ""), (2, "", "x", "ok")])
    row = df.select(
        text.render_pair_text(C("t")).alias("pair"),
        text.render_embedding_text(F.lit("S"), C("t")).alias("emb"),
        text.render_moderation_text(C("t")).alias("mod")).first()
    assert row.pair == "User: hi Assistant: ok"
    assert row.emb == "S"
    assert row.mod == "User: hi \nIntent: greet\nAssistant: \n\nUser: \nIntent: x\nAssistant: ok\n\n"


def test_content_hash_ignores_case_and_outer_blanks(spark):
    a = turns(spark, [(1, "Hello ", "GREET", None)]).select(content_hash(C("t")).alias("h")).first().h
    b = turns(spark, [(9, " hello", "greet", "")]).select(content_hash(C("t")).alias("h")).first().h
    c = turns(spark, [(1, "hell", "ogreet", "")]).select(content_hash(C("t")).alias("h")).first().h
    assert a == b != c


def test_label_keys(spark):
    for label, key in [("['b', 'a']", ["a", "b"]), ("'one'", ["'one'"]), ("oops", []), (None, []),
                       ("[broken", []), ("[]", [])]:
        assert one(spark, text.label_key, label) == key


def test_seed_turns_cut_to_shortest(spark):
    df = spark.createDataFrame(
        [(([str(i) for i in range(4)], [0, 1, 2], ["a", "b", "c", "d"]),)],
        "turns struct<turn_id:array<string>,speaker:array<int>,utterance:array<string>>")
    zipped = shape.zip_seed_turns(C("turns"))
    row = df.select(zipped.alias("z"), shape.base_conversation(zipped).alias("b")).first()
    assert [t.speaker for t in row.z] == ["USER", "ASSISTANT", "UNKNOWN"]
    assert row.b == "USER: a\nASSISTANT: b\nUNKNOWN: c"


def dialogue(spark, **change):
    base = {"dialogue_id": "d1", "services": ["taxi"], "turns": [(1, "u", "i", "a"), (2, "u2", "i2", "a2")],
            "num_lines": 2, "user_emotions": ["Happy"], "assistant_emotions": ["Patient"],
            "scenario_category": "complaint", "generated_scenario": "s", "time_slot": '[9, 12, "Late"]',
            "regions": ["Rome"], "resolution_status": "Resolved"} | change
    return spark.createDataFrame([tuple(base[f.name] for f in DIALOGUE_JSON.fields)], DIALOGUE_JSON)


def test_flatten_both_slot_forms(spark):
    for slot in ('[9, 12, "Late"]', '{"start": 9, "end": 12, "description": "Late"}'):
        rows = shape.flatten_dialogues(dialogue(spark, time_slot=slot)).collect()
        assert len(rows) == 2
        assert (rows[0].time_slot_start, rows[0].time_slot_end, rows[0].time_slot_description) == (9, 12, "Late")


def test_no_turns_no_row(spark):
    assert shape.flatten_dialogues(dialogue(spark, turns=[])).count() == 0


def test_missing_lists_become_empty(spark):
    row = shape.with_joined_lists(shape.flatten_dialogues(dialogue(spark, services=None))).first()
    assert row.services == [] and row.services_str == ""


def test_validation_names_each_rule(spark):
    flat = shape.flatten_dialogues(dialogue(spark))
    assert shape.require_valid(flat) is flat
    broken = flat.drop("intent").withColumn("generated_scenario", F.lit(None).cast("string"))
    rules = {r.rule for r in shape.violations(broken).collect()}
    assert rules == {"missing:intent", "null:generated_scenario"}


def test_validation_rejects_text_for_a_number(spark):
    flat = shape.flatten_dialogues(dialogue(spark), strict=False).withColumn("num_lines", F.lit("six"))
    assert "not_integer:num_lines" in {r.rule for r in shape.violations(flat).collect()}


def test_exact_set(spark):
    df = spark.createDataFrame(
        [(["taxi", "hotel"],), (["hotel", "taxi", "hotel"],), (["taxi"],), (["taxi", "hotel", "bus"],), (None,)],
        "s array<string>")
    got = [r.m for r in df.select(filters.is_exact_set(C("s"), {"hotel", "taxi"}).alias("m")).collect()]
    assert got == [True, True, False, False, False]


def test_empty_selection_does_not_restrict(spark):
    df = dialogue(spark).withColumn("time_slot", F.struct(F.lit("Late").alias("description")))
    assert filters.selected(df).count() == 1
    assert filters.selected(df, regions=["Rome", "Paris"], statuses=["Resolved"]).count() == 1
    assert filters.selected(df, regions=["Paris"]).count() == 0
    assert filters.selected(df, regions=["Ro"]).count() == 0


def test_slot_times(spark):
    df = spark.range(400).select(
        draws.slot_time(C("id"), "s", F.lit(9), F.lit(17)).alias("day"),
        draws.slot_time(C("id"), "s", F.lit(23), F.lit(5)).alias("night"),
        draws.slot_time(C("id"), "s", F.lit(24), F.lit(5)).alias("bad"))
    rows = df.collect()
    assert all(9 <= int(r.day[:2]) < 17 and int(r.day[3:]) % 5 == 0 for r in rows)
    hours = {int(r.night[:2]) for r in rows}
    assert hours == {23, 0, 1, 2, 3, 4}
    assert {r.bad for r in rows} == {"00:00"}


def test_weighted_draw_shares(spark):
    counts = dict(spark.range(20000).select(
        draws.draw_weighted(C("id"), "w", [("a", 0.3), ("b", 0.4), ("c", 0.3)]).alias("x")
    ).groupBy("x").count().collect())
    assert abs(counts["a"] / 20000 - 0.3) < 0.02 and abs(counts["b"] / 20000 - 0.4) < 0.02


def test_sentiment_examples(spark):
    texts = ["I love this product!", "This is the worst experience ever.", "I have a meeting at 10 AM.",
             "I am extremely happy with the service!", "This is terrible and disappointing.",
             "I do not love it", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.score for r in sentiment.score(df, ["id"], "t").collect()}
    assert got[0] > 0.5 and got[1] < -0.5 and -0.1 <= got[2] <= 0.1
    assert got[3] > 0.1 and got[4] < -0.1 and got[5] < 0 and got[6] == 0


def test_entities_and_masking(spark):
    body = "Meet me in Kuala Lumpur at 9:30, it costs $1,200 million or 7 pounds."
    df = spark.createDataFrame([(1, body), (2, "This sentence has no named entities.")], "id int, t string")
    found = {(r.id, r.label, r.entity) for r in entities.extract(df, ["id"], "t").collect()}
    assert found == {(1, "GPE", "Kuala Lumpur"), (1, "TIME", "9:30"), (1, "MONEY", "$1,200 million")}
    assert one(spark, entities.anonymise, "In Rome at 9:30 for 7") == "In [LOCATION] at [TIME] for [NUMBER]"
