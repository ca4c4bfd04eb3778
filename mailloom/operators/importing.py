"""Raw messages to rows of the emails table: parse, check, deduplicate, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom import rules
from mailloom.functions.ids import email_id
from mailloom.functions.mime import PARSED_FIELDS, parse_batches


def decode_raw(raw: Column) -> Column:
    """Bytes of a base64url string with or without padding; NULL if malformed."""
    standard = F.replace(F.replace(raw, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    return F.try_to_binary(F.rtrim(standard, F.lit("=")), F.lit("base64"))


def parse_messages(raw: DataFrame) -> DataFrame:
    """One row per raw message with the parsed fields and ``error``.

    Columns other than ``raw`` pass through, ``id`` and ``threadId`` under the
    names of the emails table.
    """
    source = raw.withColumnsRenamed({"id": "external_message_id", "threadId": "external_thread_id"})
    source = source.withColumn("content", decode_raw(F.col("raw"))).drop("raw")
    kept = [f for f in source.schema.fields if f.name != "content"]
    return source.mapInArrow(parse_batches, T.StructType(kept + PARSED_FIELDS.fields))


def to_email_rows(parsed: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Add the key, the body to clean and the creation time."""
    return parsed.withColumns(
        {
            "id": email_id(F.col("external_message_id")),
            "body_cleaned": F.col("body_text"),
            "created_at": F.current_timestamp() if created_at is None else created_at,
        }
    )


def skip_reason() -> Column:
    """Why a row is not imported, NULL for a valid one."""
    reason = F.when(F.coalesce(F.col("external_message_id"), F.lit("")) == "", "no external_message_id").when(
        F.coalesce(F.col("sender"), F.lit("")) == "", "no sender"
    )
    for column, limit in rules.COLUMN_LIMITS.items():
        reason = reason.when(F.length(column) > limit, f"{column} too long")
    return reason


def check_rows(rows: DataFrame) -> DataFrame:
    """Add ``skip_reason``; a parse error comes first where there is one."""
    reason = skip_reason()
    if "error" in rows.columns:
        reason = F.coalesce(F.when(F.col("error").isNotNull(), "parse error"), reason)
    return rows.withColumn("skip_reason", reason)


def valid_rows(rows: DataFrame) -> DataFrame:
    return check_rows(rows).filter(F.col("skip_reason").isNull()).drop("skip_reason")


def quarantined_rows(rows: DataFrame) -> DataFrame:
    return check_rows(rows).filter(F.col("skip_reason").isNotNull())


def keep_first(rows: DataFrame, order: str = "arrival", key: str = "external_message_id") -> DataFrame:
    """First row per key in arrival order.

    Each map task keeps its own first row per key before the shuffle, so a key
    that holds a large part of the rows costs one row per task.
    """
    rank = "__rank"
    # Rows that share the order value as well are told apart by their content.
    first = Window.partitionBy(key).orderBy(order, F.xxhash64(*rows.columns))
    return rows.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1).drop(rank)


def repeated_keys(
    rows: DataFrame, order: str = "arrival", key: str = "external_message_id", *, newest: bool = False
) -> DataFrame:
    """Keys that occur more than once, with the first (or last) order value of each.

    A narrow pass over key and order, combined on the map side.
    """
    pick = F.max(order) if newest else F.min(order)
    counted = rows.groupBy(key).agg(pick.alias("__pick"), F.count("*").alias("__n"))
    return counted.filter((F.col("__n") > 1) & F.col(key).isNotNull()).drop("__n")


def without_repeats(
    rows: DataFrame, repeated: DataFrame, order: str = "arrival", key: str = "external_message_id"
) -> DataFrame:
    """``rows`` without the repeats of the listed keys; NULL keys all stay."""
    return (
        rows.join(repeated, key, "left")
        .filter(F.col("__pick").isNull() | (F.col(order) == F.col("__pick")))
        .select(*rows.columns)
    )


def keep_one_per_key(
    rows: DataFrame, order: str = "arrival", key: str = "external_message_id", *, newest: bool = False
) -> DataFrame:
    """First (or newest) row per key of a written table, without sorting the wide rows.

    ``order`` is unique within a key. The list of repeated keys is usually short,
    and adaptive execution then broadcasts it; a long one is joined by shuffle,
    where hot keys are split. A job that can write the list first (``staged``)
    saves the wide rows the shuffle.
    """
    return without_repeats(rows, repeated_keys(rows, order, key, newest=newest), order, key)


def existing_ids(table: DataFrame, wanted: DataFrame, key: str = "external_message_id") -> DataFrame:
    """Distinct keys of ``wanted`` that the table already holds, NULL never.

    The wanted keys are the side that may be broadcast, so a small batch is
    looked up in one pass over the key column, without moving the table.
    """
    keys = wanted.select(key).filter(F.col(key).isNotNull()).distinct()
    return table.select(key).join(keys, key, "left_semi").distinct()


def insert_if_absent(table: DataFrame, new: DataFrame, key: str = "external_message_id") -> DataFrame:
    """Rows of ``new`` whose key the table does not hold."""
    return new.join(existing_ids(table, new, key), key, "left_anti")


def oldest_sent(table: DataFrame) -> DataFrame:
    """One row: the earliest sending time in the table, NULL if it has none."""
    return table.agg(F.min("sent_at").alias("oldest_sent_at"))


def backfill_bound(oldest: Column, overlap_days: int = rules.BACKFILL_OVERLAP_DAYS) -> Column:
    """Midnight UTC of the oldest time plus the overlap."""
    return F.date_trunc("day", oldest + F.make_dt_interval(F.lit(overlap_days)))


def older_messages(
    messages: DataFrame, table: DataFrame, overlap_days: int = rules.BACKFILL_OVERLAP_DAYS
) -> DataFrame:
    """Messages before the backfill bound of the table; all if it has no time yet.

    Messages without a readable date are offered as well: nothing tells that they
    are new, and a second offer does no harm where keys are inserted if absent.

    The bound is read first, as one value, so the comparison is with a literal
    that prunes partitions and row groups of the scan.
    """
    bound = oldest_sent(table).select(backfill_bound(F.col("oldest_sent_at"), overlap_days).alias("b")).first()["b"]
    return messages if bound is None else messages.filter(
        F.col("sent_at").isNull() | (F.col("sent_at") < F.lit(bound))
    )


def backfill_query(base_query: str, bound: Column) -> Column:
    """Mailbox query text limited to messages before the bound, by date."""
    return F.when(bound.isNull(), base_query).otherwise(
        F.concat(F.lit(f"{base_query} before:"), F.date_format(bound, "yyyy/MM/dd"))
    )


def with_chunk(rows: DataFrame, position: str, size: int = rules.IMPORT_CHUNK) -> DataFrame:
    """Number of the import chunk from a zero-based listing position."""
    return rows.withColumn("chunk", F.floor(F.col(position) / F.lit(size)))


def import_counters(checked: DataFrame, table: DataFrame | None, position: str = "arrival") -> DataFrame:
    """One row of run counters over checked rows (see ``check_rows``).

    Without a table the new keys are not counted; an insert knows them itself.

    ``checked`` holds every listed message: ``fetched`` tells whether its raw
    form was read. Keys are counted per chunk first, which combines on the map
    side, and only these counts are matched with the table.
    """
    has_fetch = "fetched" in checked.columns
    fetched = F.col("fetched") if has_fetch else F.lit(True)
    error = F.col("skip_reason") == "parse error"
    totals = checked.agg(
        F.count("*").alias("refs_seen"),
        F.count_if(fetched).alias("raw_fetched"),
        F.count_if(~fetched).alias("fetch_errors"),
        F.count_if(fetched & error).alias("parse_errors"),
        F.count_if(fetched & F.col("skip_reason").isNotNull()).alias("skipped"),
    )
    valid = with_chunk(checked.filter(fetched & F.col("skip_reason").isNull()), position)
    per_chunk = valid.groupBy("external_message_id", "chunk").agg(F.count("*").alias("n"))
    per_key = per_chunk.groupBy("external_message_id").agg(F.sum(F.col("n") - 1).alias("repeats"))
    duplicates = per_key.agg(F.coalesce(F.sum("repeats"), F.lit(0)).alias("duplicate_in_chunk"))
    if table is None:
        return totals.withColumn("duplicate_in_chunk", duplicates.scalar())
    created = insert_if_absent(table, per_key).agg(F.count("*").alias("created"))
    return totals.withColumns(
        {"duplicate_in_chunk": duplicates.scalar(), "created": created.scalar()}
    )


