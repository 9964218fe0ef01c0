"""Prompt texts for a caller-supplied generator, filled from columns.

A template is plain text with ``{name}`` slots; callers may pass their own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SCENARIO_SYSTEM = (
    "Invent short customer-service situations. Stay with the category and the services named, "
    "write two or three lines, and tell the situation as this persona would live it: {persona}. "
    "It happens at {time}, in the {slot} hours, in {region}; use local detail where it fits."
)

SCENARIO_USER = (
    "Category '{category}', services '{services}': write one situation of two or three lines that "
    "takes place at {time} in {region} and keeps service, place and time in view."
)

DIALOGUE_SYSTEM = (
    "Write service dialogues between a user and an assistant for: {services}.\n"
    "Situation: {scenario}\nRegion: {region}\nThe user sounds {user_emotions}; the assistant "
    "sounds {assistant_emotions}.\nLength: {min_turns} to {max_turns} turns.\n"
    "Write every turn as\n<User> what the user says </User>\n<Intent> the user's intent </Intent>\n"
    "<Assistant> what the assistant says </Assistant>\n"
)

DIALOGUE_USER = (
    "Take the conversation below as a model of style only and write a new dialogue for {services}; "
    "reuse none of its sentences.\n\n{base_conversation}\n\n{ending}"
)

ENDING_ESCALATED = (
    "By the end the request is escalated: the assistant says why it goes to a supervisor or "
    "another department and what happens next."
)

ENDING_OTHER = "By the end the request is {status}, and the last turn shows it."

_SLOT = re.compile(r"\{(\w+)\}")


def pieces(template: str) -> list[tuple[bool, str]]:
    """(is a slot, text) in order."""
    return [(i % 2 == 1, part) for i, part in enumerate(_SLOT.split(template)) if part]


def fill(template: str, **slots: Column) -> Column:
    return F.concat(*[slots[part] if is_slot else F.lit(part) for is_slot, part in pieces(template)])


def scenario_prompts(persona: Column, time: Column, slot: Column, region: Column, category: Column,
                     services: Column) -> tuple[Column, Column]:
    """(system, user) messages that ask for a scenario."""
    named = {"persona": persona, "time": time, "slot": slot, "region": region,
             "category": category, "services": F.array_join(services, ", ")}
    return fill(SCENARIO_SYSTEM, **named), fill(SCENARIO_USER, **named)


def dialogue_prompts(base_conversation: Column, services: Column, scenario: Column, regions: Column,
                     user_emotions: Column, assistant_emotions: Column, status: Column,
                     min_turns: int, max_turns: int) -> tuple[Column, Column]:
    """(system, user) messages that ask for a dialogue; escalated ones end in their own way."""
    ending = F.when(status == "Escalated", F.lit(ENDING_ESCALATED)).otherwise(
        fill(ENDING_OTHER, status=F.lower(status)))
    named = {
        "services": F.array_join(services, ", "), "scenario": scenario,
        "region": F.array_join(regions, ", "),
        "user_emotions": F.array_join(user_emotions, " and "),
        "assistant_emotions": F.array_join(assistant_emotions, " and "),
        "min_turns": F.lit(str(min_turns)), "max_turns": F.lit(str(max_turns)),
        "base_conversation": base_conversation, "ending": ending,
    }
    return fill(DIALOGUE_SYSTEM, **named), fill(DIALOGUE_USER, **named)
