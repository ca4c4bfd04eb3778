"""Deterministic identifiers as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.functions.text import bind


def uuid5_url(name: Column) -> Column:
    """Name-based UUID (version 5, URL name space), equal to Python's ``uuid5``."""
    digest = F.sha1(F.concat(F.unhex(F.lit(rules.UUID_URL_NAMESPACE)), F.encode(name, "UTF-8")))

    def layout(h: Column) -> Column:
        variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
        return F.concat(
            F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
            F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
        )

    return bind(digest, layout)


def point_id(external_message_id: Column, chunk_index: Column) -> Column:
    return uuid5_url(F.concat(external_message_id, F.lit(":"), chunk_index.cast("string")))


def email_id(external_message_id: Column) -> Column:
    """Primary key of an email, derived from its external id."""
    return uuid5_url(external_message_id)


def bucket(identifier: Column, digits: int = 2) -> Column:
    """Even buckets from the first hex digits of an identifier: 16, 256, 4096 ..."""
    return F.substring(identifier, 1, digits)
