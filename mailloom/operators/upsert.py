"""Keyed changes to a table, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_update_per_id(updates: DataFrame, order: str | None = None) -> DataFrame:
    """(id, body_cleaned) with each id once: the last by ``order``.

    Without an order, repeats that agree are one update and repeats that differ
    are an error. Combined before the shuffle.
    """
    body = F.struct("body_cleaned")
    if order is not None:
        picked = updates.groupBy("id").agg(F.max(F.struct(order, "body_cleaned")).alias("last"))
        return picked.select("id", "last.body_cleaned")
    seen = updates.groupBy("id").agg(F.min(body).alias("least"), F.max(body).alias("most"))
    differ = F.raise_error(F.concat(F.lit("different updates of id "), F.col("id"))).cast("string")
    return seen.select("id", F.when(F.col("least") != F.col("most"), differ).otherwise(F.col("least.body_cleaned")).alias("body_cleaned"))


def update_bodies(emails: DataFrame, updates: DataFrame, order: str | None = None, *, ids_differ: bool = False) -> DataFrame:
    """The table with ``body_cleaned`` replaced where ``updates`` (id, body_cleaned) has the id.

    An update to NULL is one too; for repeated ids see ``one_update_per_id``. Where
    the caller knows that all ids differ, bodies are not compared.

    An old body that equals the text is not moved beside it.
    """
    new, hit, as_text = "__new", "__hit", "__as_text"
    patch = updates if ids_differ else one_update_per_id(updates, order)
    patch = patch.select("id", F.col("body_cleaned").alias(new), F.lit(True).alias(hit))
    old = emails.withColumn(as_text, F.col("body_cleaned").eqNullSafe(F.col("body_text")))
    old = old.withColumn("body_cleaned", F.when(~F.col(as_text), F.col("body_cleaned")))
    body = F.when(F.col(hit), F.col(new)).when(F.col(as_text), F.col("body_text")).otherwise(F.col("body_cleaned"))
    return old.join(patch, "id", "left").withColumn("body_cleaned", body).select(*emails.columns)


def delete_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The table without the rows whose key is listed."""
    return table.join(ids.select(key), key, "left_anti")


def one_point_per_id(points: DataFrame, order: str | None = None) -> DataFrame:
    """Each id of a batch once: the last by ``order``, without one the greatest by content.

    Filtered per map task before the shuffle.
    """
    rank = "__rank"
    first = [order] if order else []
    last = Window.partitionBy("id").orderBy(*map(F.desc, first + [n for n in points.columns if n not in ("id", order)]))
    return points.withColumn(rank, F.row_number().over(last)).filter(F.col(rank) == 1).drop(rank)


def upsert_points(
    points: DataFrame, new: DataFrame, *, replace_emails: bool = False, order: str | None = None
) -> DataFrame:
    """Points after writing ``new`` over ``points``, by id; ids repeated in ``new`` count once.

    Only the ids of ``new`` meet the old points. With ``replace_emails`` the
    old points of every re-ingested email go first, so a shorter email leaves
    no stale tail; the default keeps them.
    """
    new = one_point_per_id(new, order).select(*points.columns)
    if replace_emails:
        touched = new.select(F.col("payload.external_message_id").alias("__email")).distinct()
        kept = points.join(touched, points["payload.external_message_id"] == touched["__email"], "left_anti")
    else:
        kept = points.join(new.select("id"), "id", "left_anti")
    return kept.select(*new.columns).unionByName(new)


def merge_points(points: DataFrame, new: DataFrame, *, replace_emails: bool = False) -> DataFrame:
    """As ``upsert_points`` for ids that ``new`` has once, as one full join by id.

    A side that is stored in buckets by id stays where it is, and so do the rows of
    the result; only ``new`` is dealt to the buckets.
    """
    names = [n for n in points.columns if n != "id"]
    if replace_emails:
        touched = new.select(F.col("payload.external_message_id").alias("__email")).distinct()
        points = points.join(touched, points["payload.external_message_id"] == touched["__email"], "left_anti")
    old = points.select("id", F.struct(*names).alias("__old"))
    both = old.join(new.select("id", F.struct(*names).alias("__new")), "id", "full_outer")
    return both.select("id", F.coalesce("__new", "__old").alias("__one")).select("id", "__one.*")
