"""Incoming email events: address, type, thread, sender kind, gate, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.functions.ids import uuid5_url
from mailloom.functions.text import first_address


def event_type(subject: Column) -> Column:
    """A subject with the response mark makes a response, any other a request."""
    return F.when(subject.contains(rules.RESPONSE_MARK), rules.EVENT_RESPONSE).otherwise(rules.EVENT_REQUEST)


def thread_id(kind: Column, snippet: Column, message_id: Column) -> Column:
    """A response carries its thread in the snippet; a request starts one from its own id."""
    return F.when(kind == rules.EVENT_RESPONSE, snippet).otherwise(uuid5_url(message_id))


def to_events(emails: DataFrame, *carry: str) -> DataFrame:
    """Event rows; ``sender`` is NULL where no address can be read.

    Stateless, so the same projection serves batch and stream.
    """
    address = first_address(F.col("sender"))
    typed = emails.withColumns({"__address": address, "__type": event_type(F.col("subject"))})
    return typed.select(
        "message_id",
        F.col("__address").alias("sender"),
        F.col("__type").alias("type"),
        F.struct("snippet", "body", "subject", F.col("__address").alias("sender")).alias("content"),
        thread_id(F.col("__type"), F.col("snippet"), F.col("message_id")).alias("thread_id"),
        *carry,
    )


def readable(events: DataFrame) -> DataFrame:
    return events.filter(F.col("sender").isNotNull())


def unreadable(events: DataFrame) -> DataFrame:
    """Events without a sender address, for quarantine."""
    return events.filter(F.col("sender").isNull())


def sender_type(address: Column, internal_address: str) -> Column:
    return F.when(address == internal_address, rules.SENDER_INTERNAL).otherwise(rules.SENDER_EXTERNAL)


def with_sender_type(events: DataFrame, internal: DataFrame) -> DataFrame:
    """Sender kind against a table of internal addresses (column ``address``)."""
    known = internal.select("address").distinct().withColumn("__known", F.lit(True))
    return (
        events.join(known, events["sender"] == known["address"], "left")
        .withColumn("sender_type", F.when(F.col("__known"), rules.SENDER_INTERNAL).otherwise(rules.SENDER_EXTERNAL))
        .drop("address", "__known")
    )


def resume_matches(events: DataFrame, decisions: str | None = None) -> DataFrame:
    """Responses joined to the request whose thread they continue."""
    requests = events.filter(F.col("type") == rules.EVENT_REQUEST).select(
        "thread_id", F.col("message_id").alias("request_id"), F.col("sender").alias("requested_by")
    )
    responses = events.filter(F.col("type") == rules.EVENT_RESPONSE).select(
        "thread_id",
        F.col("message_id").alias("response_id"),
        F.col("sender").alias("answered_by"),
        *([F.col(decisions).alias("decisions")] if decisions else []),
    )
    return requests.join(responses, "thread_id")


def unmatched_responses(events: DataFrame) -> DataFrame:
    """Responses whose thread no request has started."""
    known = events.filter(F.col("type") == rules.EVENT_REQUEST).select("thread_id")
    return events.filter(F.col("type") == rules.EVENT_RESPONSE).join(known, "thread_id", "left_anti")


def security_route(status: Column) -> Column:
    """Clean and suspicious input is planned, anything else is shut down."""
    return F.when(status.isin(*rules.SECURITY_OPEN), rules.ROUTE_PLAN).otherwise(rules.ROUTE_SHUTDOWN)
