"""Every registered query with its comparison SQL.

Names start with the id of the operator they cover. All queries run over whole
tables. Times are compared as text, so that both engines give the same type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import duck, fixtures
from mailloom import rules
from mailloom.functions import html_tree, lines, mime, text
from mailloom.operators import (
    chunking,
    cleaning,
    embedding,
    events,
    importing,
    lookups,
    ordering,
    plan_steps,
    upsert,
    vector_search,
)
from mailloom.plans import jobs
from mailloom.session import is_folder, new_work_folder
from mailloom.sources.messages import read_messages
from mailloom.sources.tables import EmailTable, PointTable
from mailloom.streaming import jobs as streams
from mailloom.streaming import plans as plan_streams
from mailloom.streaming.counters import stream_counters

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

c = F.col


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def as_text(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def duck_time(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') as {name or column}"


SRC = f"emails_src as ({fixtures.emails_src_sql('duckdb')})"
KEPT = f"""{SRC}, kept as (select * from (select *,
 row_number() over (partition by external_message_id order by arrival) as rn from emails_src
 where coalesce(external_message_id, '') <> '' and coalesce(sender, '') <> '') where rn = 1)"""
EMAILS = f"{KEPT}, emails as (select *, body_text as body_cleaned, {duck.uuid5('external_message_id')} as id from kept)"
TARGET = f"{EMAILS}, target as (select * from emails where arrival % 2 = 0)"
RAW = f"{SRC}, raw as ({fixtures.raw_messages_sql('duckdb')})"
PAGES = f"pages_noisy as ({fixtures.PAGES_NOISY_SQL})"
EVENTS = f"event_emails as ({fixtures.EVENT_EMAILS_SQL})"
STEPS = f"plan_steps as ({fixtures.PLAN_STEPS_SQL})"


# ---------------------------------------------------------------- sources and sinks


@query("s1_message_dump", f"with {RAW} select id, \"threadId\", length(message) as chars from raw")
def _(spark, sf):
    folder = new_work_folder(spark, "dump")
    fixtures.raw_messages(spark, sf).select("id", "threadId", "raw").write.json(folder)
    message = F.decode(importing.decode_raw(c("raw")), "UTF-8")
    return read_messages(spark, folder).select("id", "threadId", F.length(message).cast("long").alias("chars"))


@query("s2_full_scan", f"with {EMAILS} select id, external_message_id, sender, subject, coalesce(length(body_text), -1) as chars from emails")
def _(spark, sf):
    table = EmailTable(spark, new_work_folder(spark, "emails"), digits=1)
    table.append(fixtures.emails(spark, sf))
    return table.read().select("id", "external_message_id", "sender", "subject", F.coalesce(F.length("body_text").cast("long"), F.lit(-1)).alias("chars"))


@query("s3_bounded_scan", f"with {EMAILS} select arrival, external_message_id from emails order by arrival limit 110 offset 40")
def _(spark, sf):
    return ordering.bounded_scan(fixtures.emails(spark, sf), 150, 20, 2, "arrival").select("arrival", "external_message_id")


@query("s4_append", f"with {TARGET} select external_message_id, count(*) as n from (select * from target union all select * from target) group by 1")
def _(spark, sf):
    table = EmailTable(spark, new_work_folder(spark, "emails"), digits=1)
    rows = fixtures.target_emails(spark, sf)
    table.append(rows)
    table.append(rows)
    return table.read().groupBy("external_message_id").agg(F.count("*").alias("n"))


@query("s5_insert_if_absent", f"with {EMAILS} select id, external_message_id, arrival % 2 as late, {duck_time('created_at')} from emails")
def _(spark, sf):
    table = EmailTable(spark, new_work_folder(spark, "emails"), digits=1)
    table.append(fixtures.target_emails(spark, sf))
    table.insert_if_absent(fixtures.emails(spark, sf))
    late = F.pmod(F.unix_timestamp("created_at"), F.lit(2)).alias("late")
    return table.read().select("id", "external_message_id", late, as_text("created_at"))


@query(
    "s5_repeats_in_batch",
    f"""with {SRC}, named as (select * from emails_src where coalesce(sender, '') <> '')
select external_message_id, min(arrival) as arrival from named where external_message_id is not null group by 1""",
)
def _(spark, sf):
    rows = fixtures.emails_src(spark, sf).filter("coalesce(sender, '') <> '' and external_message_id is not null")
    rows = importing.to_email_rows(rows, c("created_at")).withColumn("subject", c("arrival").cast("string"))
    table = EmailTable(spark, new_work_folder(spark, "emails"), digits=1)
    table.insert_if_absent(rows.unionByName(rows), "arrival")
    table.insert_if_absent(rows, "arrival")
    return table.read().select("external_message_id", c("subject").cast("long").alias("arrival"))


@query(
    "s6_repeated_updates",
    f"""with {EMAILS} select id, case when arrival % 3 = 0 then 'second ' || external_message_id
 else body_cleaned end as body_cleaned from emails""",
)
def _(spark, sf):
    rows = fixtures.emails(spark, sf)
    table = EmailTable(spark, new_work_folder(spark, "emails"), digits=1)
    table.append(rows)
    some = rows.filter(c("arrival") % 3 == 0)
    both = [
        some.select("id", F.lit(k).alias("at"), F.concat(F.lit(word), "external_message_id").alias("body_cleaned"))
        for k, word in enumerate(("first ", "second "))
    ]
    table.update_bodies(both[1].unionByName(both[0]), order="at")
    return table.read().select("id", "body_cleaned")


@query(
    "s6_update_bodies",
    f"""with {EMAILS} select id, case when arrival % 3 = 0 then 'new ' || external_message_id
 else body_cleaned end as body_cleaned from emails""",
)
def _(spark, sf):
    rows = fixtures.emails(spark, sf)
    table = EmailTable(spark, new_work_folder(spark, "emails"), digits=1)
    table.append(rows)
    table.update_bodies(
        rows.filter(c("arrival") % 3 == 0).select(
            "id", F.concat(F.lit("new "), "external_message_id").alias("body_cleaned")
        )
    )
    return table.read().select("id", "body_cleaned")


@query("s7_delete_ids", f"with {EMAILS} select id, external_message_id from emails where arrival % 4 <> 1")
def _(spark, sf):
    rows = fixtures.emails(spark, sf)
    table = EmailTable(spark, new_work_folder(spark, "emails"), digits=1)
    table.append(rows)
    table.delete(rows.filter(c("arrival") % 4 == 1).select("id"))
    return table.read().select("id", "external_message_id")


POINTS_SQL = f"""with p as (select vec_id, {duck.uuid5("concat('v', vec_id, ':0')")} as id, label from embeddings)
select id, 'v' || vec_id as external_message_id, cast(0 as integer) as chunk_index,
 cast(case when vec_id % 3 = 0 then label + 1 else label end as varchar) as chunk_text, cast(64 as integer) as dim
from p where vec_id % 2 = 0 or vec_id % 3 = 0"""


def _old_and_new_points(spark, sf):
    points = fixtures.points(spark, sf)
    old = points.filter(c("vec_id") % 2 == 0)
    new = points.filter(c("vec_id") % 3 == 0).withColumn(
        "payload", c("payload").withField("chunk_text", (c("label") + 1).cast("string"))
    )
    return old.select("id", "payload", "vector"), new.select("id", "payload", "vector")


@query("s8_upsert_points", POINTS_SQL)
def _(spark, sf):
    old, new = _old_and_new_points(spark, sf)
    return upsert.upsert_points(old, new).select("id", "payload.*", F.size("vector").alias("dim"))


@query("s8_point_table", POINTS_SQL)
def _(spark, sf):
    old, new = _old_and_new_points(spark, sf)
    table = PointTable(spark, new_work_folder(spark, "points"))
    table.upsert(old)
    table.upsert(new)
    return table.read().select("id", "payload.*", F.size("vector").alias("dim"))


@query("s8_repeats_in_batch", POINTS_SQL)
def _(spark, sf):
    old, new = _old_and_new_points(spark, sf)
    table = PointTable(spark, new_work_folder(spark, "points"))
    both = new.withColumn("at", F.lit(1)).unionByName(old.withColumn("at", F.lit(0)))
    table.upsert(both, order="at")
    table.upsert(new.unionByName(new))
    return table.read().select("id", "payload.*", F.size("vector").alias("dim"))


@query("s8_point_table_compacted", POINTS_SQL)
def _(spark, sf):
    old, new = _old_and_new_points(spark, sf)
    table = PointTable(spark, new_work_folder(spark, "points"))
    PointTable(spark, table.path).upsert(old)
    PointTable(spark, table.path).upsert(new)
    return table.read().select("id", "payload.*", F.size("vector").alias("dim"))


@query(
    "s8_replace_emails",
    f"""with {EMAILS}, old as ({duck.chunks('emails', 'body_cleaned')}),
 new as (select external_message_id, 0 as chunk_index, 'short' as chunk_text from emails where arrival % 2 = 0)
select external_message_id, chunk_index, chunk_text from old where external_message_id not in (select external_message_id from new)
union all select * from new""",
)
def _(spark, sf):
    rows = fixtures.emails(spark, sf)
    payload = F.struct("external_message_id", "chunk_index", "chunk_text").alias("payload")
    old = chunking.with_point_id(chunking.chunk_emails(rows)).select(c("point_id").alias("id"), payload)
    short = rows.filter(c("arrival") % 2 == 0).select(
        "external_message_id", F.lit(0).alias("chunk_index"), F.lit("short").alias("chunk_text")
    )
    new = chunking.with_point_id(short).select(c("point_id").alias("id"), payload)
    return upsert.upsert_points(old, new, replace_emails=True).select("payload.*")


# ---------------------------------------------------------------- import


@query("i1_base64url", f"with {RAW} select arrival, md5(message) as digest, strlen(message) as n_bytes from raw")
def _(spark, sf):
    content = importing.decode_raw(c("raw"))
    return fixtures.raw_messages(spark, sf).select(
        "arrival", F.md5(content).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes")
    )


PARSED = f"""parsed as (select arrival, external_message_id, external_thread_id,
 case when subject is null then null when arrival % 3 = 0 then subject || ' Илья' else subject end as subject,
 sender, recipients,
 case when arrival % 4 = 1 then '<p>' || coalesce(body_text, '') || '</p>' else coalesce(body_text, '') end as body_text,
 case when arrival % 4 in (1, 2) then '<p>' || coalesce(body_text, '') || '</p>' end as body_html,
 case when arrival % 61 = 0 then null else sent_at end as sent_at,
 arrival % 4 = 3 as has_attachments from emails_src)"""


@query(
    "i2_mime_parse",
    f"""with {SRC}, {PARSED} select arrival, external_message_id, external_thread_id, subject, sender, recipients,
 body_text, body_html, {duck_time('sent_at')}, has_attachments, cast(null as varchar) as error from parsed""",
)
def _(spark, sf):
    return importing.parse_messages(fixtures.raw_messages(spark, sf)).withColumn("sent_at", as_text("sent_at"))


@query("i3_header_words", f"with {SRC} select arrival, subject || ' Илья' as subject from emails_src")
def _(spark, sf):
    word = F.concat(
        F.lit("=?UTF-8?B?"), F.base64(F.encode(F.concat("subject", F.lit(" Илья")), "UTF-8")), F.lit("?=")
    )
    return fixtures.emails_src(spark, sf).select("arrival", mime.decode_mime_words(word).alias("subject"))


@query(
    "i3_encoded_words",
    """select doc_id, case doc_id % 5 when 0 then 'Re: Grüße ' || doc_id || ' <u' || doc_id || '@x.org>' when 1 then 'one' || doc_id || 'two'
 when 2 then 'a + b % = ' || doc_id when 3 then 'ÄÖ ' || doc_id || ' tail' else 'plain ' || doc_id end as subject from documents""",
)
def _(spark, sf):
    """Quoted and base64 words, beside text, next to each other on two lines, in another charset."""
    forms = [
        "'Re: =?utf-8?q?Gr=C3=BC=C3=9Fe_' || doc_id || '?= <u' || doc_id || '@x.org>'",
        "'=?UTF-8?B?' || base64(encode('one' || doc_id, 'UTF-8')) || '?=\n =?us-ascii?Q?two?='",
        "'=?UTF-8?Q?a_+_b_%_=3D_' || doc_id || '?='",
        "'=?iso-8859-1?Q?=C4=D6?= ' || doc_id || ' tail'",
        "'plain ' || doc_id",
    ]
    cases = " ".join(f"when {k} then {form}" for k, form in enumerate(forms))
    value = F.expr(f"case doc_id % 5 {cases} end")
    return fixtures.table(spark, sf, "documents").select("doc_id", mime.decode_mime_words(value).alias("subject"))


@query(
    "i7_date_headers",
    f"""with {SRC} select arrival, {duck_time("case when arrival % 6 = 5 then null else sent_at end", "sent_at")} from emails_src""",
)
def _(spark, sf):
    """Dates with offset, zone name, comment, two-digit year, no day name, and none at all."""
    day, clock = "date_format(sent_at, 'EEE, d MMM yyyy ')", "date_format(sent_at, 'HH:mm:ss')"
    forms = [
        f"{day} || {clock} || ' +0000'",
        f"date_format(sent_at - interval 5 hours, 'd MMM yyyy HH:mm:ss') || ' EST'",
        f"{day} || {clock} || ' +0000 (UTC)'",
        f"date_format(sent_at, 'EEE, dd MMM yy HH:mm:ss') || ' GMT'",
        f"date_format(sent_at, 'dd MMM yyyy HH:mm') || ' +0000'",
        "'no date ' || arrival",
    ]
    cases = " ".join(f"when {k} then {form}" for k, form in enumerate(forms))
    rows = fixtures.emails_src(spark, sf).withColumn("header", F.expr(f"case arrival % 6 {cases} end"))
    return rows.select("arrival", mime.sent_times(c("header")).alias("sent_at")).select("arrival", as_text("sent_at"))


@query("i4_plain_body", f"with {SRC}, {PARSED} select arrival, body_text from parsed")
def _(spark, sf):
    return importing.parse_messages(fixtures.raw_messages(spark, sf)).select("arrival", "body_text")


@query("i5_html_body", f"with {SRC}, {PARSED} select arrival, body_html from parsed")
def _(spark, sf):
    return importing.parse_messages(fixtures.raw_messages(spark, sf)).select("arrival", "body_html")


@query("i6_attachment_flag", f"with {SRC}, {PARSED} select has_attachments, count(*) as n from parsed group by 1")
def _(spark, sf):
    parsed = importing.parse_messages(fixtures.raw_messages(spark, sf))
    return parsed.groupBy("has_attachments").agg(F.count("*").alias("n"))


@query("i7_sent_time", f"with {SRC}, {PARSED} select arrival, {duck_time('sent_at')} from parsed")
def _(spark, sf):
    return importing.parse_messages(fixtures.raw_messages(spark, sf)).select("arrival", as_text("sent_at"))


@query(
    "i8_length_limits",
    f"""with {SRC} select arrival, case when coalesce(external_message_id, '') = '' then 'no external_message_id'
 when coalesce(sender, '') = '' then 'no sender' when length(body_text) > 1000 then 'subject too long' end as skip_reason
from emails_src""",
)
def _(spark, sf):
    rows = fixtures.emails_src(spark, sf).withColumn("subject", c("body_text"))
    return importing.check_rows(rows).select("arrival", "skip_reason")


REJECTED_SQL = f"""with {SRC} select arrival, external_message_id, case when sender is null then 'parse error'
 when coalesce(external_message_id, '') = '' then 'no external_message_id' else 'no sender' end as skip_reason
from emails_src where sender is null or coalesce(external_message_id, '') = '' or sender = ''"""


@query("i8_rejected_rows", REJECTED_SQL)
def _(spark, sf):
    raw = fixtures.raw_messages(spark, sf)
    table = EmailTable(spark, new_work_folder(spark, "emails"), digits=1)
    jobs.import_messages(raw, table)
    return table.rejected().select("arrival", "external_message_id", "skip_reason")


@query("i8_rejected_stream", REJECTED_SQL)
def _(spark, sf):
    table = EmailTable(spark, new_work_folder(spark, "emails"), digits=1)
    folder = new_work_folder(spark, "dump")
    fixtures.raw_messages(spark, sf).write.parquet(folder)
    raw = spark.readStream.schema("arrival long, id string, threadId string, raw string").parquet(folder)
    streams.import_stream(raw, table, new_work_folder(spark, "check")).awaitTermination()
    return table.rejected().select("arrival", "external_message_id", "skip_reason")


@query(
    "i9_validity",
    f"""with {SRC} select case when coalesce(external_message_id, '') = '' then 'no external_message_id'
 when coalesce(sender, '') = '' then 'no sender' else 'valid' end as outcome, count(*) as n from emails_src group by 1""",
)
def _(spark, sf):
    checked = importing.check_rows(fixtures.emails_src(spark, sf))
    return checked.groupBy(F.coalesce("skip_reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


@query("i10_keep_first", f"with {KEPT} select arrival, external_message_id, sender, coalesce(length(body_text), -1) as chars from kept")
def _(spark, sf):
    kept = importing.keep_first(importing.valid_rows(fixtures.emails_src(spark, sf)))
    return kept.select("arrival", "external_message_id", "sender", F.coalesce(F.length("body_text").cast("long"), F.lit(-1)).alias("chars"))


@query(
    "i10_keep_one_narrow",
    f"with {KEPT} select arrival, external_message_id, sender, coalesce(length(body_text), -1) as chars from kept",
)
def _(spark, sf):
    kept = importing.keep_one_per_key(importing.valid_rows(fixtures.emails_src(spark, sf)))
    return kept.select(
        "arrival", "external_message_id", "sender", F.coalesce(F.length("body_text").cast("long"), F.lit(-1)).alias("chars")
    )


@query(
    "i11_insert_absent",
    f"""with {TARGET} select e.external_message_id, e.id, e.subject from emails e
 where not exists (select 1 from target t where t.external_message_id = e.external_message_id)""",
)
def _(spark, sf):
    new = importing.insert_if_absent(fixtures.target_emails(spark, sf), fixtures.emails(spark, sf))
    return new.select("external_message_id", "id", "subject")


@query(
    "i12_existing_ids",
    f"""with {TARGET} select distinct external_message_id from emails_src
 where external_message_id in (select external_message_id from target)""",
)
def _(spark, sf):
    return importing.existing_ids(fixtures.target_emails(spark, sf), fixtures.emails_src(spark, sf))


@query("i13_oldest_sent", f"with {EMAILS} select strftime(min(sent_at), '%Y-%m-%d %H:%M:%S') as oldest_sent_at from emails")
def _(spark, sf):
    return importing.oldest_sent(fixtures.emails(spark, sf)).select(as_text("oldest_sent_at"))


HALF = "sent_at >= (select timestamp '2024-01-01' + max(arrival) // 2 * interval '1' minute from emails_src)"


@query(
    "i14_backfill",
    f"""with {EMAILS}, late as (select * from emails where {HALF}),
 b as (select date_trunc('day', min(sent_at) + interval '1' day) as bound from late)
select arrival, {duck_time('sent_at')} from emails_src, b where sent_at < b.bound or b.bound is null or sent_at is null""",
)
def _(spark, sf):
    src = fixtures.emails_src(spark, sf)
    middle = src.agg(F.floor(F.max("arrival") / 2).alias("m")).scalar()
    start = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + middle * 60)
    late = fixtures.emails(spark, sf).filter(c("sent_at") >= start)
    return importing.older_messages(src, late).select("arrival", as_text("sent_at"))


@query(
    "i14_backfill_query",
    f"""with {EMAILS} select 'in:inbox before:' || strftime(min(sent_at) + interval '1' day, '%Y/%m/%d') as query from emails""",
)
def _(spark, sf):
    oldest = importing.oldest_sent(fixtures.emails(spark, sf))
    bound = importing.backfill_bound(c("oldest_sent_at"))
    return oldest.select(importing.backfill_query("in:inbox", bound).alias("query"))


@query("i15_fixed_batches", "select event_id, cast((row_number() over (order by ts, event_id) - 1) // 100 as bigint) as batch from events")
def _(spark, sf):
    return ordering.with_batch_number(fixtures.table(spark, sf, "events"), 100, "ts", "event_id", unique=True).select("event_id", "batch")


@query("i15_numbers_by_index", "select event_id, row_number() over (order by ts, event_id) - 1 as row_index from events")
def _(spark, sf):
    rows = fixtures.table(spark, sf, "events")
    index = ordering.PositionIndex.build(rows, new_work_folder(spark, "positions"), "ts", "event_id")
    return index.number(rows).select("event_id", "row_index")


@query(
    "i16_run_counters",
    f"""with {TARGET}, checked as (select *, arrival % 71 <> 0 as fetched, arrival % 73 = 0 as broken,
  coalesce(external_message_id, '') = '' or coalesce(sender, '') = '' as invalid, arrival // 100 as chunk from emails_src),
 good as (select * from checked where fetched and not broken and not invalid)
select (select count(*) from checked) as refs_seen, (select count(*) from checked where fetched) as raw_fetched,
 (select count(*) from checked where not fetched) as fetch_errors,
 (select count(*) from checked where fetched and broken) as parse_errors,
 (select count(*) from checked where fetched and (broken or invalid)) as skipped,
 (select cast(sum(n - 1) as bigint) from (select count(*) as n from good group by external_message_id, chunk)) as duplicate_in_chunk,
 (select count(distinct external_message_id) from good
  where external_message_id not in (select external_message_id from target)) as created""",
)
def _(spark, sf):
    rows = (
        fixtures.emails_src(spark, sf)
        .withColumn("fetched", c("arrival") % 71 != 0)
        .withColumn("error", F.when(c("arrival") % 73 == 0, "broken"))
    )
    return importing.import_counters(importing.check_rows(rows), fixtures.target_emails(spark, sf))


@query(
    "i16_import_job",
    f"""with {TARGET}, {PARSED}, good as (select * from parsed
  where coalesce(external_message_id, '') <> '' and coalesce(sender, '') <> ''),
 ranked as (select *, row_number() over (partition by external_message_id order by arrival) as rn from good)
select external_message_id, subject, sender, body_cleaned, has_attachments, {duck_time('sent_at')} from (
 select external_message_id, subject, sender, body_cleaned, has_attachments, sent_at from target
 union all
 select external_message_id, subject, sender, body_text, has_attachments, sent_at from ranked
 where rn = 1 and external_message_id not in (select external_message_id from target))""",
)
def _(spark, sf):
    table = EmailTable(spark, new_work_folder(spark, "emails"), digits=1)
    table.append(fixtures.target_emails(spark, sf))
    jobs.import_messages(fixtures.raw_messages(spark, sf), table)
    return table.read().select(
        "external_message_id", "subject", "sender", "body_cleaned", "has_attachments", as_text("sent_at")
    )


# ---------------------------------------------------------------- cleaning rules


def _bodies(spark, sf) -> DataFrame:
    return fixtures.emails_src(spark, sf).select("arrival", "body_text")


def _body_rule(name: str, expression: str, rule: Callable[[F.Column], F.Column]) -> None:
    """A rule on the noisy bodies, as (arrival, body)."""

    @query(name, f"with {SRC} select arrival, {expression} as body from emails_src")
    def _(spark, sf):
        return _bodies(spark, sf).select("arrival", rule(c("body_text")).alias("body"))


def _page_rule(name: str, expression: str, rule: Callable[[F.Column], F.Column]) -> None:
    """A rule on the noisy pages, as (page_id, html)."""

    @query(name, f"with {PAGES} select page_id, {expression} as html from pages_noisy")
    def _(spark, sf):
        return fixtures.pages_noisy(spark, sf).select("page_id", rule(c("html")).alias("html"))


_body_rule("c1_invisible", duck.drop_invisible("body_text"), text.drop_invisible)
_body_rule("c2_unicode_spaces", duck.fold_spaces("body_text"), text.fold_spaces)
_page_rule("c3_declarations", duck.drop_declarations("html"), text.drop_declarations)
_page_rule("c4_root_tags", duck.drop_root_tags("html"), text.drop_root_tags)
_page_rule("c5_namespaces", duck.drop_namespaces("html"), text.drop_namespaces)
_page_rule("c7_garbage_tags", duck.drop_garbage("html"), text.drop_garbage)
_page_rule("c8_hidden_elements", duck.drop_hidden("html"), html_tree.prune_hidden)
_body_rule("c10_whitespace", duck.normalise(duck.visible("body_text")), lambda b: text.normalise(text.visible(b)))
_body_rule(
    "c11_blank_lines",
    duck.normalise(duck.visible("replace(body_text, '. ', chr(10) || chr(10) || ' ' || chr(10) || chr(10))")),
    lambda b: text.tidy_lines(text.single_spaces(text.visible(F.replace(b, F.lit(". "), F.lit("\n\n \n\n"))))),
)
_body_rule("c12_reply_cut", duck.cut_reply("body_text"), text.cut_reply)
_body_rule(
    "c18_signatures",
    duck.blank_signatures(duck.normalise(duck.visible("body_text"))),
    text.drop_signatures,
)


@query(
    "c6_main_content",
    f"""with {PAGES}, blocks as (select page_id, unnest(string_split(regexp_replace(html,
  '(?i)(<(?:p|div|section|article|li|tr|table|ul|ol|nav|header|footer|main|blockquote|h[1-6])(?:[\\s/][^>]*)?>)', chr(1) || '\\1', 'g'), chr(1))) as block,
  generate_subscripts(string_split(regexp_replace(html,
  '(?i)(<(?:p|div|section|article|li|tr|table|ul|ol|nav|header|footer|main|blockquote|h[1-6])(?:[\\s/][^>]*)?>)', chr(1) || '\\1', 'g'), chr(1)), 1) as pos
  from pages_noisy),
 scored as (select *, length({duck.strip("regexp_replace(block, '(?s)<[^>]*>', '', 'g')")}) as chars,
  length(regexp_replace(coalesce(array_to_string(regexp_extract_all(block, '(?is)<a\\b[^>]*>(.*?)</a>', 1), ''), ''), '(?s)<[^>]*>', '', 'g')) as linked from blocks),
 worths as (select *, case when linked > chars * 0.5 or regexp_matches(block, '(?i)^<(?:nav|header|footer)[\\s/>]') then -chars - 25 else chars end as worth from scored),
 sums as (select *, sum(worth) over (partition by page_id order by pos) as total from worths),
 gains as (select *, least(0, coalesce(min(total) over (partition by page_id order by pos rows between unbounded preceding and 1 preceding), 0)) as low from sums),
 best as (select page_id, max(total - low) as gain from gains group by 1),
 ends as (select g.page_id, min_by(g.pos, g.pos) as last, min_by(g.low, g.pos) as low from gains g join best b on b.page_id = g.page_id and g.total - g.low = b.gain where b.gain > 0 group by 1),
 runs as (select e.page_id, e.last, case when e.low = 0 then 1 else min(g.pos) + 1 end as first
  from ends e left join gains g on g.page_id = e.page_id and g.total = e.low and g.pos < e.last group by e.page_id, e.last, e.low),
 kept as (select s.page_id, string_agg(block, '' order by pos) as html from scored s join runs r on r.page_id = s.page_id and s.pos between r.first and r.last group by 1)
select p.page_id, coalesce(nullif(k.html, ''), p.html) as html from pages_noisy p left join kept k on k.page_id = p.page_id""",
)
def _(spark, sf):
    return cleaning.pick_main_content(fixtures.pages_noisy(spark, sf), "html", "html")


@query(
    "c9_text_extraction",
    f"with {PAGES} select page_id, {duck.entities(duck.break_tags(duck.drop_hidden(duck.drop_garbage(duck.preclean('html')))))} as body from pages_noisy",
)
def _(spark, sf):
    pages = fixtures.pages_noisy(spark, sf).withColumn("html", text.preclean(c("html")))
    return cleaning.markup_to_text(pages, "html", "body").select("page_id", "body")


def _line_rule(name: str, duck_rule: Callable[[str], str], rule: Callable[[F.Column], F.Column]) -> None:
    """Lines a rule drops, as (arrival, dropped, kept) texts."""

    @query(
        name,
        f"""with {SRC} select arrival,
 coalesce(string_agg(line, chr(10) order by pos) filter (where {duck_rule('low')}), '') as dropped,
 coalesce(string_agg(line, chr(10) order by pos) filter (where not {duck_rule('low')}), '') as kept
from ({duck.line_rows("(select * from emails_src where body_text is not null)", 'arrival', 'body_text')}) group by arrival""",
    )
    def _(spark, sf):
        pairs = lines.with_lowered(lines.split_lines(c("body_text")))

        def joined(condition):
            return lines.join_lines(F.transform(F.filter("pairs", condition), lambda p: p.line))

        return (
            _bodies(spark, sf)
            .filter(c("body_text").isNotNull())
            .select("arrival", pairs.alias("pairs"))
            .select(
                "arrival",
                joined(lambda p: rule(p.lowered)).alias("dropped"),
                joined(lambda p: ~rule(p.lowered)).alias("kept"),
            )
        )


_line_rule("c13_separator_lines", duck.is_separator, lines.is_separator)
_line_rule("c14_image_lines", duck.is_image, lines.is_image_mark)
_line_rule("c15_markup_lines", duck.is_markup, lines.is_markup)
_line_rule("c16_footer_lines", duck.is_footer, lines.is_footer)


@query(
    "c17_repeated_lines",
    f"""with {SRC} {duck.dedupe_rows("select * from (" + duck.line_rows("emails_src", "arrival", "body_text") + ")", "arrival").replace("as txt", "as body")}""",
)
def _(spark, sf):
    kept = lines.drop_repeats(lines.with_keys(lines.with_lowered(lines.split_lines(c("body_text")))))
    bodies = _bodies(spark, sf).filter(c("body_text").isNotNull())
    return bodies.select("arrival", text.strip(lines.join_lines(kept)).alias("body"))


CLEANED = f"""with {EMAILS}, cleaned as ({duck.clean('emails', 'id', 'body_cleaned', markup=False)})"""


@query(
    "c19_clean_table",
    f"""{CLEANED} select e.id, c.txt as body_cleaned, c.txt is distinct from e.body_cleaned as changed
from emails e join cleaned c on c.id = e.id""",
)
def _(spark, sf):
    return cleaning.clean_table(fixtures.emails(spark, sf)).select("id", "body_cleaned", "changed")


@query(
    "c19_clean_job",
    f"""{CLEANED} select count(*) as processed, count(*) filter (where c.txt is distinct from e.body_cleaned) as updated
from emails e join cleaned c on c.id = e.id""",
)
def _(spark, sf):
    counts = jobs.clean_emails(fixtures.emails(spark, sf), new_work_folder(spark, "cleaned"))
    return spark.createDataFrame([(counts["processed"], counts["updated"])], "processed long, updated long")


@query("c19_clean_in_place", f"{CLEANED} select id, txt as body_cleaned, cast(16 as bigint) as buckets from cleaned")
def _(spark, sf):
    table = EmailTable(spark, new_work_folder(spark, "emails"), digits=1)
    table.append(fixtures.emails(spark, sf))
    jobs.clean_into(table)
    buckets = table.read().select(F.count_distinct("bucket")).scalar()
    return table.read().select("id", "body_cleaned", buckets.alias("buckets"))


@query(
    "c19_clean_pages",
    f"""with {PAGES}, cleaned as ({duck.clean('pages_noisy', 'page_id', 'html', markup=True)}) select page_id, txt as body from cleaned""",
)
def _(spark, sf):
    return cleaning.clean_bodies(fixtures.pages_noisy(spark, sf), "html", "body").select("page_id", "body")


@query(
    "q7_html_fallback",
    f"""with {PAGES}, cleaned as ({duck.clean('pages_noisy', 'page_id', 'html', markup=True)}) select page_id, txt as body_cleaned, true as changed from cleaned""",
)
def _(spark, sf):
    rows = fixtures.pages_noisy(spark, sf).select(
        "page_id", F.lit(None).cast("string").alias("body_cleaned"), c("html").alias("body_html")
    )
    return cleaning.clean_table(rows, fall_back_to_html=True).select("page_id", "body_cleaned", "changed")


# ---------------------------------------------------------------- chunks and vectors


@query(
    "v1_words",
    f"with {EMAILS} select id, cast(len(w) as integer) as n_words, array_to_string(w, ' ') as joined from (select *, {duck.words('body_cleaned')} as w from emails)",
)
def _(spark, sf):
    rows = fixtures.emails(spark, sf).select("id", chunking.words(c("body_cleaned")).alias("w"))
    return rows.select("id", F.size("w").alias("n_words"), F.array_join("w", " ").alias("joined"))


CHUNKS = f"{EMAILS}, chunks as ({duck.chunks('emails', 'body_cleaned', 'sender, subject,')})"
SUBJECT = f"case when subject is null then 'None' when subject = '' then '{rules.EMPTY_SUBJECT}' else subject end"


@query("v2_chunks", f"with {CHUNKS} select external_message_id, chunk_index, chunk_text from chunks")
def _(spark, sf):
    return chunking.chunk_emails(fixtures.emails(spark, sf)).select("external_message_id", "chunk_index", "chunk_text")


@query(
    "q1_plain_empty_phrase",
    f"""with {EMAILS} select external_message_id, cast(k as integer) as chunk_index,
 coalesce(array_to_string(case when k = 0 then w[1:120] else w[120*k-29:120*k+90] end, ' '), '') as chunk_text
from (select *, unnest(generate_series(0, len(w)//120)) as k from (select *, case when body_cleaned is null or body_cleaned = ''
 then ['Empty', 'email', 'body'] else {duck.words('body_cleaned')} end as w from emails))""",
)
def _(spark, sf):
    return chunking.chunk_emails(fixtures.emails(spark, sf), spell_empty=False).select(
        "external_message_id", "chunk_index", "chunk_text"
    )


@query(
    "q2_cover_tail",
    f"""with {EMAILS} select external_message_id, cast(k as integer) as chunk_index,
 coalesce(array_to_string(case when k = len(w)//120 then w[greatest(120*k-29, 1):len(w)]
  when k = 0 then w[1:120] else w[120*k-29:120*k+90] end, ' '), '') as chunk_text
from (select *, unnest(generate_series(0, len(w)//120)) as k from (select *, {duck.words('body_cleaned')} as w from emails))""",
)
def _(spark, sf):
    return chunking.chunk_emails(fixtures.emails(spark, sf), mode=chunking.COVER_TAIL).select(
        "external_message_id", "chunk_index", "chunk_text"
    )


@query(
    "q3_sliding",
    f"""with {EMAILS} select external_message_id, cast(k as integer) as chunk_index,
 coalesce(array_to_string(w[90*k+1:90*k+120], ' '), '') as chunk_text
from (select *, unnest(generate_series(0, greatest(len(w) - 31, 0) // 90)) as k from (select *, {duck.words('body_cleaned')} as w from emails))""",
)
def _(spark, sf):
    return chunking.chunk_emails(fixtures.emails(spark, sf), mode=chunking.SLIDING).select(
        "external_message_id", "chunk_index", "chunk_text"
    )


@query("v3_subject_text", f"with {EMAILS} select id, {SUBJECT} as subject from emails")
def _(spark, sf):
    return fixtures.emails(spark, sf).select("id", chunking.subject_text(c("subject")).alias("subject"))


@query(
    "v4_embedding_text",
    f"""with {CHUNKS} select external_message_id, chunk_index,
 'Sender: ' || sender || '; Subject: ' || {SUBJECT} || '; Text: ' || chunk_text as input from chunks""",
)
def _(spark, sf):
    joined = chunking.embedding_text(c("sender"), c("subject"), c("chunk_text"))
    return chunking.chunk_emails(fixtures.emails(spark, sf)).select(
        "external_message_id", "chunk_index", joined.alias("input")
    )


POINT_ID = duck.uuid5("external_message_id || ':' || chunk_index")


@query("v5_point_ids", f"with {CHUNKS} select external_message_id, chunk_index, {POINT_ID} as point_id from chunks")
def _(spark, sf):
    chunks = chunking.with_point_id(chunking.chunk_emails(fixtures.emails(spark, sf)))
    return chunks.select("external_message_id", "chunk_index", "point_id")


@query(
    "v6_payload",
    f"with {CHUNKS} select {POINT_ID} as id, external_message_id, chunk_index, chunk_text from chunks",
)
def _(spark, sf):
    chunks = chunking.with_point_id(chunking.chunk_emails(fixtures.emails(spark, sf)))
    rows = chunks.select(c("point_id").alias("id"), chunking.payload().alias("payload"))
    return rows.select("id", "payload.*")


def _hashed(dim: int) -> str:
    return f"""inputs as (select external_message_id, chunk_index,
  'Sender: ' || sender || '; Subject: ' || {SUBJECT} || '; Text: ' || chunk_text as input from chunks),
 slots as (select external_message_id, chunk_index, cast(('0x' || substr(md5(token), 1, 8)) as bigint) % {dim} as slot
  from (select *, unnest(string_split(input, ' ')) as token from inputs))"""


@query(
    "v7_hash_embedding",
    f"""with {CHUNKS}, {_hashed(rules.VECTOR_DIM)} select external_message_id, chunk_index, cast(slot as integer) as slot,
 cast(count(*) as integer) as weight from slots group by 1, 2, 3""",
)
def _(spark, sf):
    chunks = chunking.chunk_emails(fixtures.emails(spark, sf))
    vectors = embedding.embed(chunks, embedding.hashing_encoder())
    slots = vectors.select("external_message_id", "chunk_index", F.posexplode("vector").alias("slot", "weight"))
    return slots.filter(c("weight") > 0).withColumn("weight", c("weight").cast("int"))


@query(
    "v8_vector_checks",
    """select vec_id, len(embedding) = 64 as fits,
 cast(cast(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as decimal(10, 4)) as varchar) as norm from embeddings""",
)
def _(spark, sf):
    points = fixtures.points(spark, sf)
    norm = embedding.norm(c("vector")).cast("decimal(10,4)").cast("string").alias("norm")
    return points.select("vec_id", embedding.has_dim(c("vector"), 64).alias("fits"), norm)


@query(
    "v8_cosine_to_label",
    """with first_ as (select label, arg_min(embedding, vec_id) as e from embeddings group by label)
select v.vec_id, cast(cast(list_cosine_similarity(v.embedding::double[], f.e::double[]) as decimal(10, 4)) as varchar) as cosine
from embeddings v join first_ f on f.label = v.label""",
)
def _(spark, sf):
    points = fixtures.points(spark, sf)
    first = points.groupBy("label").agg(F.min_by("vector", "vec_id").alias("first"))
    similarity = embedding.cosine(c("vector"), c("first")).cast("decimal(10,4)").cast("string").alias("cosine")
    return points.join(first, "label").select("vec_id", similarity)


@query(
    "v9_ingest_job",
    f"""with {CHUNKS}, {_hashed(256)}, counts as (select external_message_id, chunk_index, slot, count(*) as n from slots group by all)
select {POINT_ID} as id, external_message_id, chunk_index, chunk_text,
 cast((select sum(n * n) from counts s where s.external_message_id = chunks.external_message_id and s.chunk_index = chunks.chunk_index) as bigint) as squares
from chunks""",
)
def _(spark, sf):
    table = PointTable(spark, new_work_folder(spark, "points"))
    jobs.vectorize_emails(fixtures.emails(spark, sf), table, embedding.hashing_encoder(256))
    squares = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x.cast("double")).cast("long")
    return table.read().select("id", "payload.*", squares.alias("squares"))


@query(
    "v9_rejected_vectors",
    f"with {CHUNKS} select {POINT_ID} as id, external_message_id, chunk_index, cast(64 as integer) as dim from chunks",
)
def _(spark, sf):
    table = PointTable(spark, new_work_folder(spark, "points"), dim=256)
    jobs.vectorize_emails(fixtures.emails(spark, sf), table, embedding.hashing_encoder(64))
    rows = table.rejected().select("id", "payload.external_message_id", "payload.chunk_index", F.size("vector").alias("dim"))
    return rows.unionByName(table.read().select("id", "payload.external_message_id", "payload.chunk_index", F.size("vector").alias("dim")))


@query(
    "v9_replace_emails",
    f"""with {CHUNKS}, few as (select external_message_id, min(chunk_index) as chunk_index from chunks group by 1),
 heads as (select chunks.* from chunks join few using (external_message_id, chunk_index))
select {POINT_ID} as id, external_message_id, chunk_index, chunk_text from heads""".replace("from heads", "from heads chunks"),
)
def _(spark, sf):
    """Emails with one chunk each come over the same emails with all chunks."""
    emails = fixtures.emails(spark, sf)
    table = PointTable(spark, new_work_folder(spark, "points"), dim=64)
    jobs.vectorize_emails(emails, table, embedding.hashing_encoder(64))
    heads = jobs.to_point_rows(emails, embedding.hashing_encoder(64)).filter("payload.chunk_index = 0")
    table.upsert(heads, replace_emails=True)
    return table.read().select("id", "payload.*")


@query(
    "v9_ingest_counts",
    f"with {CHUNKS} select (select count(*) from emails) as emails_processed, (select count(*) from chunks) as chunks_upserted",
)
def _(spark, sf):
    table = PointTable(spark, new_work_folder(spark, "points"))
    counts = jobs.vectorize_emails(fixtures.emails(spark, sf), table, embedding.hashing_encoder(64))
    return spark.createDataFrame(
        [(counts["emails_processed"], counts["chunks_upserted"])], "emails_processed long, chunks_upserted long"
    )


@query(
    "v10_single_email",
    f"with {CHUNKS} select {POINT_ID} as id, external_message_id, chunk_index, chunk_text from chunks where external_message_id = 'm50'",
)
def _(spark, sf):
    table = PointTable(spark, new_work_folder(spark, "points"))
    jobs.vectorize_one(fixtures.emails(spark, sf), "m50", table, embedding.hashing_encoder(64))
    return table.read().select("id", "payload.*")


NEAREST = f"""with unit as (select vec_id, {duck.uuid5("concat('v', vec_id, ':0')")} as id,
  list_transform(embedding, lambda x: x::double) as v from embeddings),
 p as (select *, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) as norm from unit),
 scored as (select q.id as query_id, p.id, round(list_inner_product(q.v, p.v) / (q.norm * p.norm), 6) as score,
  list_inner_product(q.v, p.v) / (q.norm * p.norm) as exact from p q join p on q.vec_id % 100 = 0 and q.id <> p.id),
 ranked as (select *, row_number() over (partition by query_id order by exact desc, id) as rank from scored)"""


@query(
    "v8_nearest_points",
    f"{NEAREST} select query_id, cast(rank as integer) as rank, id, cast(round(score * 1000000) as bigint) as millionths from ranked where rank <= 10",
)
def _(spark, sf):
    """The ten nearest points by cosine of every point whose key is divisible by 100, by cells."""
    table = PointTable(spark, new_work_folder(spark, "points"), dim=64)
    points = fixtures.points(spark, sf)
    table.upsert(points.select("id", "payload", "vector"))
    index = vector_search.build_index(table.read(), cells=24).write(new_work_folder(spark, "cells"))
    found, _ = vector_search.search(index, points.filter(c("vec_id") % 100 == 0).select("id", "vector"))
    return found.select("query_id", "rank", "id", F.round(c("score") * 1_000_000).cast("long").alias("millionths"))


@query(
    "v8_cells_read",
    f"{NEAREST} select count(distinct query_id) as queries, true as skips_add_up from ranked",
)
def _(spark, sf):
    """Of every query the cells and points it has read; never more than there are, and enough for its answer."""
    points = fixtures.points(spark, sf)
    index = vector_search.build_index(points.select("id", "vector"), cells=24)
    found, counts = vector_search.search(index, points.filter(c("vec_id") % 100 == 0).select("id", "vector"))
    answers = found.groupBy("query_id").agg(F.count("*").alias("n"))
    sound = (c("cells_read") <= c("cells")) & (c("points_read") >= c("n")) & (c("cells_read") >= 1)
    return counts.join(answers, "query_id").agg(F.count("*").alias("queries"), F.bool_and(sound).alias("skips_add_up"))


@query(
    "flagship_clean_chunk",
    f"""{CLEANED}, bodies as (select e.external_message_id, e.sender, e.subject, c.txt as body from emails e join cleaned c on c.id = e.id),
 chunks as ({duck.chunks('bodies', 'body', 'sender, subject,')})
select {POINT_ID} as point_id, external_message_id, chunk_index, chunk_text,
 'Sender: ' || sender || '; Subject: ' || {SUBJECT} || '; Text: ' || chunk_text as input from chunks""",
)
def flagship(spark, sf):
    """Emails cleaned, chunked, numbered and made ready for an encoder."""
    rows = cleaning.clean_table(fixtures.emails(spark, sf)).drop("changed")
    chunks = chunking.with_point_id(chunking.chunk_emails(rows))
    joined = chunking.embedding_text(c("sender"), c("subject"), c("chunk_text"))
    return chunks.select("point_id", "external_message_id", "chunk_index", "chunk_text", joined.alias("input"))


# ---------------------------------------------------------------- look-ups and listings

SHOWN = ["id", "external_message_id", "external_thread_id", "sender", "subject"]
SHOWN_SQL = ", ".join(SHOWN)


def _listing(name: str, sql: str, run: Callable[[DataFrame], DataFrame]) -> None:
    @query(name, f"with {EMAILS} select {SHOWN_SQL}, {duck_time('created_at')} from {sql}")
    def _(spark, sf):
        return run(fixtures.emails(spark, sf)).select(*SHOWN, as_text("created_at"))


NEWEST = "order by created_at desc, id desc limit"
_listing("f1_by_external_id", "emails where external_message_id = 'm100'", lambda e: lookups.by_external_id(e, "m100"))
_listing(
    "f2_by_external_ids",
    "emails where external_message_id in ('m1', 'm20', 'm21', 'absent')",
    lambda e: lookups.by_external_ids(e, ["m1", "m20", "m21", "absent"]),
)
_listing(
    "f3_by_sender",
    f"emails where sender = 'User <u1@src1.example.com>' {NEWEST} 50",
    lambda e: lookups.by_sender(e, "User <u1@src1.example.com>"),
)
_listing("f4_by_thread", f"emails where external_thread_id = 't7' {NEWEST} 100", lambda e: lookups.by_thread(e, "t7"))
_listing(
    "f4_newest_per_thread",
    "(select *, row_number() over (partition by external_thread_id order by created_at desc, id desc) as r from emails) where r <= 5",
    lambda e: lookups.newest_per(e, "external_thread_id", 5),
)
_listing("t1_recent", f"emails {NEWEST} 20", lookups.recent)
_listing("t2_latest", "emails order by sent_at desc nulls last, id desc limit 1", lookups.latest)
_listing(
    "t3_matching",
    f"emails where has_attachments {NEWEST} 1000",
    lambda e: lookups.matching(e, c("has_attachments")),
)
_listing("t4_page", "emails order by created_at, id limit 30 offset 60", lambda e: ordering.page(e, 30, 60, "created_at", "id"))
_listing(
    "t4_deep_page",
    "emails order by created_at, id limit 30 offset 60",
    lambda e: ordering.deep_page(e, 30, 60, "created_at", "id"),
)


def _index_page(emails):
    index = ordering.PositionIndex.build(emails, new_work_folder(emails.sparkSession, "positions"), "created_at", "id")
    return index.page(emails, 30, 60)


_listing("t4_index_page", "emails order by created_at, id limit 30 offset 60", _index_page)


@query("f1_duplicate_ids", f"with {SRC} select external_message_id, count(*) as n from emails_src where external_message_id is not null group by 1 having count(*) > 1")
def _(spark, sf):
    return lookups.duplicate_ids(fixtures.emails_src(spark, sf))


# ---------------------------------------------------------------- events

DUCK_ADDRESS = f"nullif(regexp_extract(sender, '{rules.EMAIL_ADDRESS}'), '')"
DUCK_KIND = "case when contains(subject, 'HITL_RESPONSE') then 'hitl_response' else 'new_request' end"
TYPED = f"{EVENTS}, typed as (select *, {DUCK_ADDRESS} as address, {DUCK_KIND} as type from event_emails)"
INTERNAL = "u5@example.com"


@query("e1_first_address", f"with {EVENTS} select message_id, {DUCK_ADDRESS} as address from event_emails")
def _(spark, sf):
    return fixtures.event_emails(spark, sf).select("message_id", text.first_address(c("sender")).alias("address"))


@query("e2_event_type", f"with {EVENTS} select message_id, {DUCK_KIND} as type from event_emails")
def _(spark, sf):
    return fixtures.event_emails(spark, sf).select("message_id", events.event_type(c("subject")).alias("type"))


@query(
    "e3_thread_id",
    f"with {TYPED} select message_id, case when type = 'hitl_response' then snippet else {duck.uuid5('message_id')} end as thread_id from typed",
)
def _(spark, sf):
    kind = events.event_type(c("subject"))
    return fixtures.event_emails(spark, sf).select(
        "message_id", events.thread_id(kind, c("snippet"), c("message_id")).alias("thread_id")
    )


@query(
    "e4_events",
    f"""with {TYPED} select message_id, address as sender, type, snippet, body, subject, address as content_sender,
 case when type = 'hitl_response' then snippet else {duck.uuid5('message_id')} end as thread_id from typed where address is not null""",
)
def _(spark, sf):
    rows = events.readable(events.to_events(fixtures.event_emails(spark, sf)))
    return rows.select(
        "message_id", "sender", "type", "content.snippet", "content.body", "content.subject",
        c("content.sender").alias("content_sender"), "thread_id",
    )


@query("e1_unreadable_senders", f"with {TYPED} select message_id from typed where address is null")
def _(spark, sf):
    return events.unreadable(events.to_events(fixtures.event_emails(spark, sf))).select("message_id")


@query(
    "e5_sender_type",
    f"with {TYPED} select message_id, case when address = '{INTERNAL}' then 'internal' else 'external' end as sender_type from typed where address is not null",
)
def _(spark, sf):
    return streams.classify(fixtures.event_emails(spark, sf), INTERNAL).select("message_id", "sender_type")


@query(
    "e5_internal_table",
    f"""with {TYPED}, internal as (select distinct address from typed where address is not null and regexp_matches(address, '^u[0-9]@'))
select message_id, case when address in (select address from internal) then 'internal' else 'external' end as sender_type
from typed where address is not null""",
)
def _(spark, sf):
    rows = events.readable(events.to_events(fixtures.event_emails(spark, sf)))
    internal = rows.filter(c("sender").rlike("^u[0-9]@")).select(c("sender").alias("address"))
    return events.with_sender_type(rows, internal).select("message_id", "sender_type")


def _threaded(events_frame: DataFrame) -> DataFrame:
    """Request threads under the message id, so that responses find them."""
    return events_frame.withColumn(
        "thread_id", F.when(c("type") == rules.EVENT_REQUEST, c("message_id")).otherwise(c("thread_id"))
    )


@query(
    "e6_resume",
    f"""with {TYPED}, ok as (select * from typed where address is not null)
select q.message_id as thread_id, q.message_id as request_id, q.address as requested_by, r.message_id as response_id,
 r.address as answered_by, 'approve' as decisions
from ok q join ok r on q.type = 'new_request' and r.type = 'hitl_response' and r.snippet = q.message_id""",
)
def _(spark, sf):
    rows = _threaded(events.readable(events.to_events(fixtures.event_emails(spark, sf))))
    return events.resume_matches(rows.withColumn("decision", F.lit("approve")), "decision")


@query(
    "e6_unmatched",
    f"""with {TYPED}, ok as (select * from typed where address is not null)
select r.message_id, r.snippet as thread_id from ok r where r.type = 'hitl_response'
 and not exists (select 1 from ok q where q.type = 'new_request' and q.message_id = r.snippet)""",
)
def _(spark, sf):
    rows = _threaded(events.readable(events.to_events(fixtures.event_emails(spark, sf))))
    return events.unmatched_responses(rows).select("message_id", "thread_id")


@query(
    "e7_security_route",
    f"""with {EVENTS} select message_id, case when security_status in ('clean', 'suspicious') then 'build_execution_plan' else 'shutdown' end as route
from event_emails""",
)
def _(spark, sf):
    return fixtures.event_emails(spark, sf).select("message_id", events.security_route(c("security_status")).alias("route"))


# ---------------------------------------------------------------- plans

PLAN_IDS = f"{STEPS}, plans as (select distinct plan_id from plan_steps union all select max(plan_id) + 1 from plan_steps)"


@query(
    "e8_next_pending",
    f"""with {PLAN_IDS}, nxt as (select plan_id, arg_min(step_index, step_index) as step_index, arg_min(type, step_index) as type
 from plan_steps where status = 'pending' group by 1)
select p.plan_id, cast(coalesce(n.step_index, -1) as integer) as step_index, n.type from plans p left join nxt n on n.plan_id = p.plan_id""",
)
def _(spark, sf):
    rows = fixtures.plans(spark, sf).withColumn("step", plan_steps.next_pending(c("steps")))
    return rows.select("plan_id", F.coalesce("step.step_index", F.lit(-1)).alias("step_index"), "step.type")


@query(
    "e8_next_pending_rows",
    f"""with {STEPS} select plan_id, cast(min(step_index) as bigint) as step_index, arg_min(type, step_index) as type
 from plan_steps where status = 'pending' group by 1""",
)
def _(spark, sf):
    return plan_steps.next_pending_rows(fixtures.plan_steps(spark, sf)).select("plan_id", "step_index", "type")


@query(
    "e9_mark_completed",
    f"""with {STEPS} select plan_id, cast(step_index as integer) as step_index,
 case when step_index = (select min(step_index) from plan_steps s where s.plan_id = p.plan_id and s.status = 'pending')
  then 'completed' else status end as status from plan_steps p""",
)
def _(spark, sf):
    rows = fixtures.plans(spark, sf).withColumn("step", plan_steps.next_pending(c("steps")))
    marked = rows.withColumn(
        "steps",
        F.when(c("step").isNull(), c("steps")).otherwise(plan_steps.mark_completed(c("steps"), c("step.step_index"))),
    )
    return marked.select("plan_id", F.inline("steps")).select("plan_id", "step_index", "status")


@query(
    "e10_route",
    f"""with {PLAN_IDS} select plan_id, case when plan_id in (select plan_id from plan_steps where status = 'pending')
 then 'dispatch_execution_plan_step' else 'shutdown' end as route from plans""",
)
def _(spark, sf):
    return fixtures.plans(spark, sf).select("plan_id", plan_steps.route_after_dispatch(c("steps")).alias("route"))


@query(
    "e10_route_rows",
    f"""with {STEPS} select plan_id, case when bool_or(status = 'pending') then 'dispatch_execution_plan_step' else 'shutdown' end as route
 from plan_steps group by 1""",
)
def _(spark, sf):
    return plan_steps.route_rows(fixtures.plan_steps(spark, sf))


ARTIFACTS = f"""{PLAN_IDS}, artifacts as (select plan_id, step_index, unnest(generate_series(1, n_artifacts)) as i from plan_steps)"""


@query(
    "e11_earlier_artifacts",
    f"""with {ARTIFACTS}, flat as (select plan_id, string_agg(plan_id || '/' || step_index || '/' || i, ',' order by step_index, i) as artifacts
 from artifacts group by 1) select p.plan_id, coalesce(f.artifacts, '') as artifacts from plans p left join flat f on f.plan_id = p.plan_id""",
)
def _(spark, sf):
    flat = F.array_join(plan_steps.earlier_artifacts(c("results")), ",")
    return fixtures.plans(spark, sf).select("plan_id", flat.alias("artifacts"))


@query(
    "e11_artifact_rows",
    f"""with {ARTIFACTS} select plan_id, step_index, cast(i - 1 as integer) as position, plan_id || '/' || step_index || '/' || i as artifact from artifacts""",
)
def _(spark, sf):
    artifacts = fixtures.artifacts(c("n_artifacts")).alias("artifacts")
    return plan_steps.artifact_rows(fixtures.plan_steps(spark, sf).select("plan_id", "step_index", artifacts))


@query(
    "e12_merge_results",
    f"""with {STEPS} select plan_id, cast(step_index as varchar) as step_id, n_artifacts from plan_steps""",
)
def _(spark, sf):
    def results(kept):
        return F.map_from_entries(
            F.transform(
                F.filter("results", kept),
                lambda r: F.struct(r.step_index.cast("string"), F.size(r.artifacts).cast("long")),
            )
        )

    merged = plan_steps.merge_results(results(lambda r: r.step_index < 2), results(lambda r: r.step_index >= 2))
    return fixtures.plans(spark, sf).select("plan_id", F.explode(merged).alias("step_id", "n_artifacts"))


@query(
    "e13_number_steps",
    f"""with {STEPS} select plan_id, 'by turn' as ordering_reason,
 cast(row_number() over (partition by plan_id order by step_index) - 1 as integer) as step_index,
 'pending' as status, type, summary, reason, action_spec from plan_steps""",
)
def _(spark, sf):
    suggested = fixtures.plans(spark, sf).select(
        "plan_id",
        F.lit("by turn").alias("ordering_reason"),
        c("steps").alias("suggested_steps"),
        F.lit(0.9).alias("confidence"),
    )
    return plan_steps.number_steps(suggested).drop("errors")


@query(
    "e13_plan_record",
    f"""with {STEPS} select plan_id, cast(step_index as integer) as step_index, 'pending' as status, type, summary, reason, action_spec from plan_steps""",
)
def _(spark, sf):
    record = fixtures.plans(spark, sf).select("plan_id", plan_steps.numbered(c("steps")).alias("steps"))
    return record.select("plan_id", F.inline("steps")).drop("errors")


@query("e14_type_queues", f"with {STEPS} select type, count(*) as n from plan_steps where status = 'pending' group by 1")
def _(spark, sf):
    pending = fixtures.plan_steps(spark, sf).filter(c("status") == rules.STEP_PENDING)
    sizes = [q.groupBy("type").agg(F.count("*").alias("n")) for q in plan_steps.type_queues(pending).values()]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


ODD_TYPES = "case when step_index % 5 = 3 then null when step_index % 5 = 4 then 'fly' else type end"


@query(
    "e14_unknown_types",
    f"""with {STEPS}, odd as (select plan_id, step_index, {ODD_TYPES} as type from plan_steps)
select plan_id, step_index, type from odd where coalesce(type, '') not in ('perform_local_action', 'send_email', 'do_nothing')""",
)
def _(spark, sf):
    steps = fixtures.plan_steps(spark, sf).withColumn("type", F.expr(ODD_TYPES))
    return plan_steps.type_queues(steps)[plan_steps.UNKNOWN].select("plan_id", "step_index", "type")


@query(
    "e14_wrong_values",
    f"""with {STEPS}, odd as (select plan_id, step_index, {ODD_TYPES} as type, case when step_index % 7 = 2 then 'lost' else status end as status from plan_steps)
select plan_id, step_index, case when status not in ('pending', 'completed') then 'unknown status' else 'unknown type' end as reason
from odd where coalesce(type, '') not in ('perform_local_action', 'send_email', 'do_nothing') or status not in ('pending', 'completed')""",
)
def _(spark, sf):
    steps = fixtures.plan_steps(spark, sf).withColumn("type", F.expr(ODD_TYPES))
    steps = steps.withColumn("status", F.expr("case when step_index % 7 = 2 then 'lost' else status end"))
    return plan_steps.wrong_values(steps).select("plan_id", "step_index", "reason")


@query(
    "e14_reply_context",
    f"""with {ARTIFACTS}, nxt as (select plan_id, arg_min(type, step_index) as type from plan_steps where status = 'pending' group by 1),
 lists as (select plan_id, step_index, list(plan_id || '/' || step_index || '/' || i order by i) as names from artifacts group by all),
 state as (select p.plan_id, list(struct_pack(step_index := cast(p.step_index as integer), status := status, type := type, summary := summary, reason := reason,
   action_spec := action_spec) order by p.step_index) as steps,
  list(struct_pack(step_index := p.step_index, artifacts := coalesce(l.names, [])) order by p.step_index) as results
  from plan_steps p left join lists l on l.plan_id = p.plan_id and l.step_index = p.step_index group by p.plan_id)
select s.plan_id, cast(to_json(struct_pack(plan_id := s.plan_id, steps := s.steps, results := s.results)) as varchar) as reply_context
from state s join nxt n on n.plan_id = s.plan_id and n.type = 'send_email'""",
)
def _(spark, sf):
    rows = plan_steps.step_inputs(fixtures.plans(spark, sf))
    return rows.filter(c("type") == "send_email").select("plan_id", "reply_context")


@query(
    "e14_step_inputs",
    f"""with {ARTIFACTS}, nxt as (select plan_id, min(step_index) as step_index, arg_min(type, step_index) as type
  from plan_steps where status = 'pending' group by 1),
 flat as (select plan_id, string_agg(plan_id || '/' || step_index || '/' || i, ',' order by step_index, i) as artifacts from artifacts group by 1)
select n.plan_id, n.type, cast(n.step_index as integer) as step_index,
 case when n.type = 'perform_local_action' then coalesce(f.artifacts, '') end as artifacts
from nxt n left join flat f on f.plan_id = n.plan_id""",
)
def _(spark, sf):
    rows = plan_steps.step_inputs(fixtures.plans(spark, sf))
    return rows.select("plan_id", "type", "step_index", F.array_join("artifacts", ",").alias("artifacts"))


SUGGESTED = "case step_index % 3 when 0 then 'execute_browser_action' when 1 then 'execute_bash_action' else 'fly' end"


def _suggestions(spark, sf):
    rows = fixtures.plan_steps(spark, sf).withColumn("suggested_capability_name", F.expr(SUGGESTED))
    capabilities = spark.createDataFrame([(name, None) for name in rules.CAPABILITIES], "capability_name string, capability_description string")
    return plan_steps.match_capability(rows, capabilities)


@query("e15_capability", f"with {STEPS} select plan_id, step_index, {SUGGESTED} as capability_name from plan_steps where step_index % 3 <> 2")
def _(spark, sf):
    return _suggestions(spark, sf)[0].select("plan_id", "step_index", "capability_name")


@query("e15_unknown_capability", f"with {STEPS} select plan_id, step_index from plan_steps where step_index % 3 = 2")
def _(spark, sf):
    return _suggestions(spark, sf)[1].select("plan_id", "step_index")


# ---------------------------------------------------------------- streams


def _stream(spark, sf, name: str, sql: str) -> DataFrame:
    """A view over one given table, a file or a folder of files, read as a file stream."""
    path = f"{sf}/{name}.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    # A stream reads folders only: a table of one file is picked by its name.
    source = source.parquet(path) if is_folder(spark, path) else source.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return spark.sql(sql.replace(f"from {name}", f"from {{{name}}}"), **{name: source})


@query(
    "r1_import_stream",
    ORACLES["i16_import_job"],
)
def _(spark, sf):
    table = EmailTable(spark, new_work_folder(spark, "emails"), digits=1)
    table.append(fixtures.target_emails(spark, sf))
    folder = new_work_folder(spark, "dump")
    fixtures.raw_messages(spark, sf).write.parquet(folder)
    raw = spark.readStream.schema("arrival long, id string, threadId string, raw string").parquet(folder)
    streams.import_stream(raw, table, new_work_folder(spark, "check"), order="arrival").awaitTermination()
    return table.read().select(
        "external_message_id", "subject", "sender", "body_cleaned", "has_attachments", as_text("sent_at")
    )


@query("r1_redelivered", ORACLES["i16_import_job"])
def _(spark, sf):
    """Every message twice, in deliveries of their own: the second one is dropped by the engine's state."""
    table = EmailTable(spark, new_work_folder(spark, "emails"), digits=1)
    table.append(fixtures.target_emails(spark, sf))
    folder, check = new_work_folder(spark, "dump"), new_work_folder(spark, "check")
    messages = fixtures.raw_messages(spark, sf)
    for delivery in (messages, messages.withColumn("arrival", c("arrival") + 1_000_000)):
        # A run of the stream takes what has come since the last one, in files of any number.
        delivery.write.mode("append").parquet(folder)
        raw = spark.readStream.schema("arrival long, id string, threadId string, raw string").parquet(folder)
        streams.import_stream(raw, table, check, redelivered_within="1 day").awaitTermination()
    return table.read().select(
        "external_message_id", "subject", "sender", "body_cleaned", "has_attachments", as_text("sent_at")
    )


@query(
    "c19_stream_counters",
    f"""with {SRC}, named as (select 's' || arrival as external_message_id, body_text from emails_src),
 cleaned as ({duck.clean('named', 'external_message_id', 'body_text', markup=False)})
select count(*) as processed, count(*) filter (txt is distinct from body_text) as updated from cleaned join named using (external_message_id)""",
)
def _(spark, sf):
    src = _stream(spark, sf, "documents", fixtures.emails_src_sql("spark"))
    rows = src.withColumns({"external_message_id": F.concat(F.lit("s"), "arrival"), "body_cleaned": c("body_text")})
    with stream_counters(spark) as counters:
        run = streams.clean_stream(rows, new_work_folder(spark, "cleaned"), new_work_folder(spark, "check"))
        counts = counters.of(run)
    return spark.createDataFrame([(counts["processed"], counts["updated"])], "processed long, updated long")


@query(
    "r2_vectorize_stream",
    f"""with {SRC}, named as (select 's' || arrival as external_message_id, sender, subject, body_text from emails_src),
 cleaned as ({duck.clean('named', 'external_message_id', 'body_text', markup=False)}),
 chunks as ({duck.chunks('cleaned', 'txt')})
select {POINT_ID} as id, external_message_id, chunk_index, chunk_text from chunks""",
)
def _(spark, sf):
    src = _stream(spark, sf, "documents", fixtures.emails_src_sql("spark"))
    rows = src.withColumn("external_message_id", F.concat(F.lit("s"), "arrival")).withColumn("body_cleaned", c("body_text"))
    table = PointTable(spark, new_work_folder(spark, "points"))
    streams.vectorize_stream(
        rows,
        table,
        embedding.hashing_encoder(64),
        new_work_folder(spark, "check"),
        spread_to=spark.sparkContext.defaultParallelism,
    ).awaitTermination()
    return table.read().select("id", "payload.*")


@query(
    "r3_classify_stream",
    f"""with {TYPED} select message_id, address as sender, type,
 case when type = 'hitl_response' then snippet else {duck.uuid5('message_id')} end as thread_id,
 case when address = '{INTERNAL}' then 'internal' else 'external' end as sender_type from typed where address is not null""",
)
def _(spark, sf):
    rows = streams.classify(_stream(spark, sf, "events", fixtures.EVENT_EMAILS_SQL), INTERNAL)
    out = new_work_folder(spark, "events")
    streams.write_stream(rows.drop("content"), out, new_work_folder(spark, "check")).awaitTermination()
    return spark.read.parquet(out)


@query(
    "r4_resume_stream",
    f"""with {TYPED}, ok as (select * from typed where address is not null)
select q.message_id as thread_id, q.message_id as request_id, {duck_time('q.ts', 'requested_at')}, r.message_id as response_id, {duck_time('r.ts', 'answered_at')}
from ok q join ok r on q.type = 'new_request' and r.type = 'hitl_response' and r.snippet = q.message_id and r.ts >= q.ts""",
)
def _(spark, sf):
    rows = _threaded(streams.classify(_stream(spark, sf, "events", fixtures.EVENT_EMAILS_SQL), INTERNAL, "ts"))
    out = new_work_folder(spark, "resumed")
    streams.resume_stream(rows, out, new_work_folder(spark, "check")).awaitTermination()
    return spark.read.parquet(out).select(
        "thread_id", "request_id", as_text("requested_at"), "response_id", as_text("answered_at")
    )


@query(
    "e8_plan_stream",
    f"""with {STEPS}, events as (select *, turn_done or status = 'completed' as done from (select *, step_index % 4 = 1 or status = 'completed' as turn_done from plan_steps)),
 results as (select plan_id, step_index, unnest(generate_series(1, n_artifacts)) as i from events where done),
 flat as (select plan_id, string_agg(plan_id || '/' || step_index || '/' || i, ',' order by step_index, i) as artifacts from results group by 1),
 heads as (select plan_id, min(step_index) filter (not done) as step_index, arg_min(type, step_index) filter (not done) as type,
  count(*) filter (done) as completed, count(*) filter (done and plan_id % 5 = 0) as n_repeated from events group by 1)
select h.plan_id, cast(coalesce(step_index, -1) as bigint) as step_index, type,
 case when step_index is null then 'shutdown' else 'dispatch_execution_plan_step' end as route, completed, n_repeated,
 coalesce(artifacts, '') as artifacts from heads h left join flat f on f.plan_id = h.plan_id""",
)
def _(spark, sf):
    """E8 to E12 on a stream: steps and results in any order over several batches, some results twice."""
    steps = fixtures.plan_steps(spark, sf)
    done = (c("status") == rules.STEP_COMPLETED) | (c("step_index") % 4 == 1)
    names = ("plan_id", "step_index", "type")
    announced = steps.select(*names, F.lit(rules.STEP_PENDING).alias("status"), F.lit(None).cast("array<string>").alias("artifacts"))
    results = steps.filter(done).select(*names, F.lit(None).cast("string").alias("status"), fixtures.artifacts(c("n_artifacts")).alias("artifacts"))
    rows = announced.unionByName(results).unionByName(results.filter(c("plan_id") % 5 == 0))
    folder, out = new_work_folder(spark, "plan-events"), new_work_folder(spark, "plan-progress")
    rows.repartition(3, F.rand(7)).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    streams.write_stream(plan_streams.advance(stream), out, new_work_folder(spark, "check")).awaitTermination()
    last = plan_streams.standing(spark.read.parquet(out))
    return last.select(
        "plan_id", F.coalesce("step_index", F.lit(-1).cast("long")).alias("step_index"), "type", "route", "completed", F.size("repeated").cast("long").alias("n_repeated"),
        F.array_join("artifacts", ",").alias("artifacts"),
    )
