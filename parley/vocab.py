"""Vocabularies of the dialogue domain and small dimension tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The corpus is defined over exactly these lists, weights and hours.

GENERAL = "general"

CATEGORIES = {
    "general": [
        "account_management", "cancellation_general", "complaint", "refund_request_general",
        "payment_issues", "general_inquiry", "feedback", "technical_support",
        "lost_and_found_general",
    ],
    "restaurant": [
        "dining_reservation", "dietary_requirements", "table_modification", "special_occasion",
        "menu_inquiry", "order_status", "reservation_cancellation",
    ],
    "hotel": [
        "room_reservation", "check_in_out", "amenity_inquiry", "room_service",
        "booking_modification", "housekeeping_request", "reservation_cancellation",
    ],
    "train": [
        "journey_planning", "schedule_inquiry", "ticket_booking", "platform_information",
        "ticket_change", "ticket_cancellation", "seat_selection",
    ],
    "attraction": [
        "ticket_availability", "opening_hours", "guided_tour", "venue_information",
        "group_booking", "ticket_cancellation", "accessibility_inquiry",
    ],
    "taxi": [
        "ride_booking", "pickup_location", "fare_inquiry", "driver_tracking",
        "ride_cancellation", "ride_feedback", "service_type_inquiry",
    ],
    "hospital": [
        "appointment_booking", "department_inquiry", "medical_information",
        "emergency_services", "appointment_cancellation", "insurance_inquiry",
        "medical_record_request",
    ],
    "bus": [
        "route_information", "schedule_inquiry", "ticket_booking", "stop_location",
        "ticket_change", "ticket_cancellation", "seat_selection",
    ],
    "flight": [
        "flight_booking", "cancellation_flight", "ticket_change", "baggage_inquiry", "check_in",
        "seat_selection", "flight_status", "upgrade_request", "refund_request_flight",
        "lounge_access", "boarding_pass_issue", "special_meals", "pet_transportation",
    ],
}

REGIONS = [
    "Tokyo", "Delhi", "Shanghai", "Sao Paulo", "Mumbai", "Beijing", "Cairo", "Mexico City",
    "Dhaka", "Osaka", "Karachi", "Chongqing", "Istanbul", "Buenos Aires", "Kolkata", "Kinshasa",
    "Lagos", "Manila", "Rio de Janeiro", "Guangzhou", "Los Angeles", "Moscow", "Paris", "Bangkok",
    "Jakarta", "London", "Lima", "New York", "Shenzhen", "Bangalore", "Ho Chi Minh City",
    "Hyderabad", "Bogota", "Tianjin", "Santiago", "Sydney", "Berlin", "Madrid", "Toronto",
    "Johannesburg", "Dubai", "Singapore", "Tehran", "Baghdad", "Riyadh", "Rome", "Cape Town",
    "Casablanca", "Barcelona", "Seoul", "Melbourne", "Copenhagen", "Zurich", "Kuala Lumpur",
]

USER_EMOTIONS = [
    "Frustrated", "Angry", "Confused", "Worried", "Disappointed", "Happy", "Anxious",
    "Impatient", "Skeptical", "Desperate", "Overwhelmed", "Hopeful", "Satisfied", "Stressed",
    "Suspicious", "Tired", "Excited", "Indifferent", "Grateful", "Demanding",
]

ASSISTANT_EMOTIONS = [
    "Professional", "Informative", "Reassuring", "Diplomatic", "Patient", "Efficient",
    "Accommodating", "Solution-focused", "Methodical", "Proactive", "Analytical", "Composed",
    "Detail-oriented", "Responsive", "Thorough", "Systematic", "Precise", "Objective",
    "Resourceful", "Knowledgeable",
]

TIME_SLOTS = [
    (5, 9, "Early Morning"),
    (9, 12, "Late Morning"),
    (12, 17, "Afternoon"),
    (17, 21, "Evening"),
    (21, 23, "Late Night"),
    (23, 5, "Overnight"),
]

RESOLUTION_WEIGHTS = [("Resolved", 0.4), ("Failed", 0.3), ("Escalated", 0.3)]

SERVICES = ["hotel", "restaurant", "train", "attraction", "taxi", "bus", "hospital", "flight"]

PAIRS = [
    ["hospital", "taxi"], ["hospital", "hotel"], ["flight", "taxi"], ["flight", "hotel"],
    ["flight", "train"], ["flight", "bus"], ["flight", "restaurant"], ["hotel", "taxi"],
    ["hotel", "train"], ["hotel", "bus"], ["restaurant", "taxi"], ["restaurant", "attraction"],
    ["attraction", "taxi"], ["train", "taxi"], ["bus", "taxi"], ["train", "bus"],
    ["hotel", "restaurant"],
]

TRIPLES = [
    ["hospital", "taxi", "hotel"], ["hospital", "hotel", "restaurant"],
    ["hotel", "restaurant", "taxi"], ["hotel", "train", "taxi"], ["hotel", "bus", "taxi"],
    ["attraction", "restaurant", "taxi"], ["attraction", "hotel", "taxi"],
    ["attraction", "train", "taxi"], ["train", "hotel", "restaurant"],
    ["bus", "hotel", "restaurant"], ["train", "restaurant", "taxi"], ["flight", "hotel", "taxi"],
    ["flight", "train", "taxi"], ["flight", "bus", "taxi"], ["flight", "restaurant", "taxi"],
]

QUADRUPLES = [
    ["hospital", "hotel", "restaurant", "taxi"], ["hotel", "restaurant", "attraction", "taxi"],
    ["train", "hotel", "restaurant", "taxi"], ["bus", "hotel", "restaurant", "taxi"],
    ["train", "hotel", "attraction", "taxi"], ["bus", "hotel", "attraction", "taxi"],
    ["flight", "hotel", "restaurant", "taxi"], ["flight", "train", "hotel", "taxi"],
    ["flight", "bus", "hotel", "taxi"],
]

SIZE_WEIGHTS = [("single", 0.30), ("double", 0.40), ("triple", 0.20), ("quadruple", 0.10)]
SIZE_WEIGHTS_SERIAL = [("single", 0.30), ("double", 0.35), ("triple", 0.25), ("quadruple", 0.10)]

# Words left out of the frequent-word table.
STOP_WORDS = [
    "the", "and", "to", "of", "a", "in", "that", "is", "for", "on", "with", "be", "this", "will",
    "can", "at", "by", "an", "are", "so", "it", "as", "would", "could", "should", "i", "you",
    "your", "we", "my", "me", "he", "she", "they", "am", "was", "were", "been", "being",
]

TEMPERATURES = [0.6, 0.7, 0.8]
TOP_PS = [0.95, 1.0]
PENALTIES = [0.4, 0.5, 0.6, 0.7]

# End of fixed values.

COMBINATIONS = {
    "single": [[s] for s in SERVICES],
    "double": PAIRS,
    "triple": TRIPLES,
    "quadruple": QUADRUPLES,
}


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: list[str]) -> Column:
    """Array literal of strings."""
    return F.expr(f"array({', '.join(_text(v) for v in values)})")


def combinations_of(size_class: str) -> Column:
    """Array literal holding the service combinations of one size class."""
    items = (f"array({', '.join(_text(s) for s in c)})" for c in COMBINATIONS[size_class])
    return F.expr(f"array({', '.join(items)})")


def slot_structs() -> Column:
    """Array literal of time-slot structs."""
    items = (f"named_struct('start', {a}, 'end', {b}, 'description', {_text(d)})"
             for a, b, d in TIME_SLOTS)
    return F.expr(f"array({', '.join(items)})")


def category_table(spark: SparkSession) -> DataFrame:
    """(service, position, category), general rows included under their own name."""
    rows = [(s, i, c) for s, cats in CATEGORIES.items() for i, c in enumerate(cats)]
    return spark.createDataFrame(rows, "service string, position int, category string")


def categories_for(service: Column) -> Column:
    """Categories that apply to a service: the general ones, then its own.

    An unknown service has the general ones only.
    """
    picked = strings(CATEGORIES[GENERAL])
    general = picked
    for name in SERVICES:
        picked = F.when(
            F.lower(service) == name, strings(CATEGORIES[GENERAL] + CATEGORIES[name])
        ).otherwise(picked)
    return F.coalesce(picked, general)


def region_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, r) for i, r in enumerate(REGIONS)], "position int, region string")


def stop_word_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")
