"""The three batch jobs: import, clean, vectorize."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.operators import chunking, cleaning, embedding, importing
from mailloom.session import observed, staged
from mailloom.sources.tables import EmailTable, PointTable


def import_messages(
    raw: DataFrame, table: EmailTable, *, position: str = "arrival", created_at: Column | None = None
) -> DataFrame:
    """Import raw messages that the table does not hold; returns one row of counters.

    ``raw`` has id, threadId, raw and a listing number (see
    ``ordering.with_row_index``), by which chunks are counted and the first of
    equal keys is kept. Parsing is the only Python step and its result is written
    once. Messages that cannot be read or stored go to ``table.rejected()`` with
    their reason.
    """
    parsed = importing.to_email_rows(importing.parse_messages(raw), created_at)
    with staged(importing.check_rows(parsed), "parsed") as checked:
        counted = importing.import_counters(checked, None, position)
        counters = counted.first().asDict()  # one row
        table.reject(checked.filter(F.col("skip_reason").isNotNull()))
        counters["created"] = table.insert_if_absent(checked.filter(F.col("skip_reason").isNull()), position)
    schema = T.StructType([*counted.schema.fields, T.StructField("created", T.LongType())])
    return raw.sparkSession.createDataFrame([tuple(counters.values())], schema)


def clean_emails(emails: DataFrame, out_path: str, **options: bool) -> dict[str, int]:
    """Write the table with cleaned bodies to a new folder; returns the counts.

    Map-only. The folder must not be the one being read.
    """
    seen = Observation("cleaned")
    (
        cleaning.clean_table(emails, **options)
        .observe(seen, F.count("*").alias("processed"), F.count_if("changed").alias("updated"))
        .drop("changed")
        .write.mode("errorifexists")
        .parquet(out_path)
    )
    return observed(seen, "processed", "updated")


def clean_into(table: EmailTable, **options: bool) -> dict[str, int]:
    """Clean the bodies of a table in place; returns the counts.

    Only rows whose body changes are written, and only their buckets replaced.
    """
    seen = Observation("cleaned")
    cleaned = cleaning.clean_table(table.read(), **options).observe(
        seen, F.count("*").alias("processed"), F.count_if("changed").alias("updated")
    )
    with staged(cleaned.filter("changed").select("id", "body_cleaned"), "cleaned") as updates:
        table.update_bodies(updates)
    return observed(seen, "processed", "updated")


def to_point_rows(
    emails: DataFrame,
    make_encoder: Callable,
    *,
    batch_size: int = 200,
    mode: str = chunking.COMPAT,
    spell_empty: bool = True,
) -> DataFrame:
    """Points of emails: chunk, number, embed. Map-only with one Python step."""
    chunks = chunking.with_point_id(chunking.chunk_emails(emails, mode=mode, spell_empty=spell_empty))
    return embedding.to_points(embedding.embed(chunks, make_encoder, batch_size=batch_size))


def vectorize_emails(
    emails: DataFrame, points: PointTable, make_encoder: Callable, *, replace_emails: bool = False, **options
) -> dict[str, int]:
    """Chunk, embed and upsert; returns emails processed and chunks upserted.

    Vectors of a size that the point table does not take are in ``points.rejected()``.
    """
    seen = Observation("vectorized")
    rows = to_point_rows(emails.observe(seen, F.count("*").alias("n")), make_encoder, **options)
    upserted = points.upsert(rows, replace_emails=replace_emails)
    return {"emails_processed": observed(seen, "n")["n"], "chunks_upserted": upserted}


def vectorize_one(emails: DataFrame, external_message_id: str, points: PointTable, make_encoder: Callable) -> dict:
    """The same job for a single email."""
    one = emails.filter(F.col("external_message_id") == external_message_id)
    return vectorize_emails(one, points, make_encoder)
