"""Look-ups and newest-first listings on the emails table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.functions.ids import bucket, email_id


def by_external_id(emails: DataFrame, external_message_id: str, *, bucket_digits: int | None = None) -> DataFrame:
    """The row with this external id: none or one; more than one is an error.

    The key also gives the bucket, so only one bucket of a bucketed table is read.
    """
    wanted = F.col("external_message_id") == external_message_id
    if bucket_digits:
        wanted &= F.col("bucket") == bucket(email_id(F.lit(external_message_id)), bucket_digits)
    found = emails.filter(wanted).agg(
        F.count("*").alias("n"), F.first(F.struct(*emails.columns)).alias("row")
    )
    one = F.when(F.col("n") > 1, F.raise_error(F.lit("more than one row for an external id"))).otherwise(F.col("row"))
    return found.filter(F.col("n") > 0).select(one.alias("row")).select("row.*")


def duplicate_ids(emails: DataFrame, key: str = "external_message_id") -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (
        emails.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
    )


def by_external_ids(emails: DataFrame, ids: DataFrame | Iterable[str]) -> DataFrame:
    """Rows whose external id is in a list or in a table of ids."""
    if isinstance(ids, DataFrame):
        return emails.join(ids.select("external_message_id"), "external_message_id", "left_semi")
    return emails.filter(F.col("external_message_id").isin(list(ids)))


def _newest(emails: DataFrame, limit: int) -> DataFrame:
    return emails.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def recent(emails: DataFrame, limit: int = rules.RECENT_LIMIT) -> DataFrame:
    return _newest(emails, limit)


def by_sender(emails: DataFrame, sender: str, limit: int = rules.SENDER_LIMIT) -> DataFrame:
    return _newest(emails.filter(F.col("sender") == sender), limit)


def by_thread(emails: DataFrame, thread_id: str, limit: int = rules.THREAD_LIMIT) -> DataFrame:
    return _newest(emails.filter(F.col("external_thread_id") == thread_id), limit)


def newest_per(emails: DataFrame, key: str, limit: int) -> DataFrame:
    """Newest rows of every group at once.

    Each map task keeps at most ``limit`` rows per group before the shuffle,
    so one dominant group does not overload its task.
    """
    rank = "__rank"
    newest = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))
    return emails.withColumn(rank, F.row_number().over(newest)).filter(F.col(rank) <= limit).drop(rank)


def latest(emails: DataFrame) -> DataFrame:
    """The message sent last; none from an empty table."""
    row = F.max_by(F.struct(*emails.columns), F.struct("sent_at", "id")).alias("row")
    return emails.filter(F.col("sent_at").isNotNull()).agg(row).filter(F.col("row").isNotNull()).select("row.*")


def matching(emails: DataFrame, condition: Column, limit: int = rules.MAILBOX_LIMIT) -> DataFrame:
    """First messages that satisfy a condition, newest first."""
    return _newest(emails.filter(condition), limit)
