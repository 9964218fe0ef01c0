"""Whole records: one canonical text of a JSON object, whatever fields it has.

Names are sorted, no blanks stand between, letters are themselves, and numbers have one form. Reading
is that of Python's ``json``: of equal names the last one counts, NaN and Infinity are numbers, and
nothing may follow the object.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_text(line: str, known: frozenset[str] | None = None) -> str:
    """The canonical text of an object; with ``known``, of its other fields, NaN and Infinity as text."""
    try:
        record = json.loads(line) if known is None else json.loads(line, parse_constant=str)
    except ValueError as problem:
        raise ValueError(f"no JSON: {line[:200]!r} ({problem})") from None
    if not isinstance(record, dict):
        raise ValueError(f"no JSON object: {line[:200]!r}")
    return json.dumps({k: v for k, v in record.items() if k not in (known or ())}, sort_keys=True,
                      ensure_ascii=False, separators=(",", ":"))


def _each(known: frozenset[str] | None = None):
    @F.arrow_udf(T.StringType())
    def run(lines: pa.Array) -> pa.Array:
        return pa.array([None if x is None else canonical_text(x, known) for x in lines.to_pylist()], pa.string())

    return run


def canonical(line: Column) -> Column:
    """Canonical text of an object's JSON text; any other text fails the query."""
    return _each()(line)


def other_fields(line: Column, schema: T.StructType) -> Column:
    """Fields outside the schema as one VARIANT object; null where there are none.

    A VARIANT has no NaN and no Infinity, so these are their names as text there.
    """
    rest = _each(frozenset(schema.names))(line)
    return F.parse_json(F.when(rest != "{}", rest))


def as_record(*columns: Column | str) -> Column:
    """Canonical text of typed columns, nulls included; a VARIANT column stands for its fields."""
    return canonical(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def with_fields(line: Column, others: Column) -> Column:
    """Canonical text with the fields of a VARIANT object added."""
    more = F.to_json(others)
    return canonical(F.when(others.isNull(), line).otherwise(F.concat(
        F.lit("{"), F.substring(line, F.lit(2), F.length(line) - 2),
        F.when(line == "{}", "").otherwise(","), F.substring(more, F.lit(2), F.length(more) - 1))))


def record_hash(record: Column) -> Column:
    """sha256 of a canonical record: of all its fields."""
    return F.sha2(record, 256)
