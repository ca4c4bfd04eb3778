"""Streaming forms: import, clean and vectorize, classify, resume."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailloom import rules
from mailloom.operators import cleaning, events, importing
from mailloom.plans.jobs import to_point_rows
from mailloom.session import staged
from mailloom.sources.tables import EmailTable, PointTable
from mailloom.streaming.state import keep_state_on_disk


def without_redelivered(raw: DataFrame, within: str) -> DataFrame:
    """Raw messages without the copies (same id and content) that come again within a time of the first.

    The engine's state holds a digest of each message for that time, counted by the
    clock, so no message is ever too late. Of copies in one micro-batch any one stays.
    """
    keep_state_on_disk(raw.sparkSession)
    marked = raw.withColumns({"__content": F.sha2(F.col("raw"), 256), "__came": F.current_timestamp()})
    return marked.withWatermark("__came", within).dropDuplicatesWithinWatermark(["id", "__content"]).drop("__content", "__came")


def import_stream(
    raw: DataFrame,
    table: EmailTable,
    checkpoint: str,
    *,
    order: str = "arrival",
    redelivered_within: str | None = None,
    compact_every: int = 50,
) -> StreamingQuery:
    """Parse, check, deduplicate and insert each micro-batch.

    ``order`` is a column of the stream that tells which of equal keys came
    first; ``stream_messages`` adds ``arrival``. Equal ones go by their place in
    the batch. The table itself remembers the
    keys, so no state grows with the stream and a repeated batch inserts nothing
    twice. Messages that cannot be read or stored go to ``table.rejected()``, those
    of a repeated batch in place of its first ones. After ``compact_every`` batches the
    buckets with many small files are merged.

    A source that delivers messages more than once may be given
    ``redelivered_within``: copies within that time are then dropped before they are
    parsed and looked up (see ``without_redelivered``), later ones by the table.
    """
    if redelivered_within is not None:
        raw = without_redelivered(raw, redelivered_within)

    run = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def insert(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn("__order", F.struct(order, F.monotonically_increasing_id().alias("place")))
        rows = importing.to_email_rows(importing.parse_messages(placed))
        # One write of the parsed batch, since Spark would otherwise parse per use.
        with staged(importing.check_rows(rows), "import-batch") as checked:
            table.reject(checked.filter(F.col("skip_reason").isNotNull()).drop("__order"), f"{run}-{batch_id}")
            table.insert_if_absent(checked.filter(F.col("skip_reason").isNull()), "__order")
        if batch_id % compact_every == compact_every - 1:
            table.compact()

    return _run(raw.writeStream.foreachBatch(insert), checkpoint)


def vectorize_stream(
    emails: DataFrame,
    points: PointTable,
    make_encoder: Callable,
    checkpoint: str,
    *,
    spread_to: int | None = None,
    replace_emails: bool = False,
    spell_empty: bool = True,
) -> StreamingQuery:
    """Clean, chunk, embed and upsert emails as they arrive. All but the sink is stateless.

    Counters (see ``counters``): ``emails_processed``, ``chunks_upserted``.

    ``spread_to`` deals the rows out to that many tasks first, for sources that
    bring few large files per batch.
    """
    emails = emails.repartition(spread_to) if spread_to else emails
    emails = emails.observe("vectorized_emails", F.count("*").alias("emails_processed"))
    rows = to_point_rows(cleaning.clean_table(emails).drop("changed"), make_encoder, spell_empty=spell_empty)
    rows = rows.observe("vectorized_chunks", F.count("*").alias("chunks_upserted"))
    upsert = lambda batch, _id: points.upsert(batch, replace_emails=replace_emails)
    return _run(rows.writeStream.foreachBatch(upsert), checkpoint)


def clean_stream(emails: DataFrame, path: str, checkpoint: str, **options: bool) -> StreamingQuery:
    """Append emails with cleaned bodies to parquet as they arrive; counters ``processed`` and ``updated``."""
    cleaned = cleaning.clean_table(emails, **options).observe(
        "cleaned", F.count("*").alias("processed"), F.count_if("changed").alias("updated")
    )
    return write_stream(cleaned.drop("changed"), path, checkpoint)


def classify(emails: DataFrame, internal_address: str, *carry: str) -> DataFrame:
    """Events with sender kind; a stateless projection of a stream or a batch."""
    return events.readable(events.to_events(emails, *carry)).withColumn(
        "sender_type", events.sender_type(F.col("sender"), internal_address)
    )


def _asked(events_: DataFrame, time: str) -> DataFrame:
    return events_.filter(F.col("type") == rules.EVENT_REQUEST).select(
        "thread_id", F.col("message_id").alias("request_id"), F.col(time).alias("requested_at")
    )


def _answered(events_: DataFrame, time: str) -> DataFrame:
    return events_.filter(F.col("type") == rules.EVENT_RESPONSE).select(
        "thread_id", F.col("message_id").alias("response_id"), F.col(time).alias("answered_at")
    )


def _matched(asked: DataFrame, answered: DataFrame) -> DataFrame:
    joined = asked.join(answered, "thread_id").filter("answered_at >= requested_at")
    return joined.select("thread_id", "request_id", "requested_at", "response_id", "answered_at")


def resume(requests: DataFrame, responses: DataFrame, *, time: str = "ts", wait: str | None = None) -> DataFrame:
    """Emit a response once its request is known.

    Batch frames are matched without a limit of time. Streams need ``wait``,
    which lets the state of unanswered requests expire and so loses later answers;
    ``resume_stream`` has no such limit.
    """
    asked, answered = _asked(requests, time), _answered(responses, time)
    if wait is None:
        if requests.isStreaming or responses.isStreaming:
            raise ValueError("a stream is matched within a wait, or without a limit by resume_stream")
        return _matched(asked, answered)
    answered = answered.withColumnRenamed("thread_id", "answered_thread")
    if requests.isStreaming:
        asked, answered = asked.withWatermark("requested_at", wait), answered.withWatermark("answered_at", wait)
    within = (
        (F.col("thread_id") == F.col("answered_thread"))
        & (F.col("answered_at") >= F.col("requested_at"))
        & (F.col("answered_at") <= F.col("requested_at") + F.expr(f"interval {wait}"))
    )
    return asked.join(answered, within).drop("answered_thread")


def resume_stream(events_: DataFrame, out: str, checkpoint: str, *, time: str = "ts") -> StreamingQuery:
    """Emit each response with its request, however far apart they come and in either order.

    A join of the stream with itself on the thread: both sides wait in keyed state
    without a watermark, so nothing expires, and each micro-batch reads only the
    threads it brings. Events without a thread never match and are not kept. The
    sink and the state share a checkpoint, so each pair comes out once, also after
    a restart.
    """
    keep_state_on_disk(events_.sparkSession)
    named = events_.filter(F.col("thread_id").isNotNull())
    return write_stream(_matched(_asked(named, time), _answered(named, time)), out, checkpoint)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stateless or joined stream to parquet."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _run(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
