"""Content hashes and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import strip


def fingerprint(text: Column) -> Column:
    """sha256 of a text; the one key used for every seen-before check."""
    return F.sha2(text, 256)


def content_hash(turns: Column) -> Column:
    """md5 over the turns' texts, blind to case and outer white space."""
    def bare(text: Column) -> Column:
        return strip(F.lower(F.coalesce(text, F.lit(""))))

    return F.md5(F.to_json(F.transform(F.coalesce(turns, F.array()), lambda t: F.struct(
        bare(t["utterance"]).alias("utterance"),
        bare(t["intent"]).alias("intent"),
        bare(t["assistant_response"]).alias("response"),
    ))))
