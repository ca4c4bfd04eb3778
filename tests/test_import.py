"""Raw messages, checks and deduplication."""

import base64
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mailloom.functions import mime
from mailloom.operators import importing
from mailloom.plans import jobs
from mailloom.sources.tables import EmailTable


def b64(message: str) -> str:
    return base64.urlsafe_b64encode(message.encode()).decode().rstrip("=")


def parsed(spark, message):
    raw = spark.createDataFrame([("i", "t", b64(message))], "id string, threadId string, raw string")
    return importing.parse_messages(raw).first()


def test_base64url(values):
    items = [b64("ab"), b64("abc"), b64("abcd"), b64("abcd") + "==", base64.urlsafe_b64encode(b"\xfb\xff\xfe").decode(), "A", "!!"]
    assert [v and bytes(v) for v in values(importing.decode_raw, items)] == [
        b"ab", b"abc", b"abcd", b"abcd", b"\xfb\xff\xfe", None, None,
    ]


def test_header_words(values):
    items = [
        "=?UTF-8?B?0JjQvNGP?= <a@b.co>",
        "=?UTF-8?Q?Your_order=E2=80=99s_delivered?=",
        "plain",
        "",
        None,
        "=?unknown-charset?B?AAAA?=",
    ]
    assert values(mime.decode_mime_words, items) == ["Имя <a@b.co>", "Your order’s delivered", "plain", "", None, "=?unknown-charset?B?AAAA?="]


PLAIN = "From: A <a@b.co>\nTo: c@d.ef\nSubject: Hi\nDate: Mon, 1 Jan 2024 10:00:00 +0200\n\nbody\n"
MIXED = """From: A <a@b.co>
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=X

--X
Content-Type: text/plain
Content-Disposition: Attachment; filename=n.txt

not this
--X
Content-Type: multipart/alternative; boundary=Y

--Y
Content-Type: text/html

<p>rich</p>
--Y
Content-Type: text/plain; charset=no-such-charset

first
--Y
Content-Type: text/plain

second
--Y--
--X--
"""


def test_plain_message(spark):
    r = parsed(spark, PLAIN)
    assert (r.external_message_id, r.external_thread_id, r.sender, r.recipients, r.subject) == ("i", "t", "A <a@b.co>", "c@d.ef", "Hi")
    assert r.body_text == "body\n" and r.body_html is None and not r.has_attachments and r.error is None
    assert r.sent_at == datetime(2024, 1, 1, 8)


def test_mixed_message(spark):
    r = parsed(spark, MIXED)
    assert r.body_html.strip() == "<p>rich</p>" and r.has_attachments and r.sent_at is None
    # The part with an unknown charset cannot be decoded, the next one is used.
    assert r.body_text.strip() == "second"


def test_single_html_part_is_both_bodies(spark):
    r = parsed(spark, "From: a@b.co\nContent-Type: text/html\n\n<p>x</p>")
    assert r.body_text == r.body_html == "<p>x</p>"


def test_html_only_multipart_has_no_text(spark):
    r = parsed(spark, "From: a@b.co\nContent-Type: multipart/alternative; boundary=X\n\n--X\nContent-Type: text/html\n\n<p>x</p>\n--X--\n")
    assert r.body_text is None and r.body_html.strip() == "<p>x</p>"


def test_unreadable_messages_are_reported(spark):
    raw = spark.createDataFrame([("1", "t", "A"), ("2", "t", None), ("3", "t", b64(PLAIN))], "id string, threadId string, raw string")
    errors = {r["external_message_id"]: r["error"] for r in importing.parse_messages(raw).collect()}
    assert errors["1"] and errors["2"] and errors["3"] is None
    binary = parsed(spark, "From: a@b.co\nContent-Type: application/pdf\nContent-Transfer-Encoding: base64\n\nAAAA")
    assert "not text" in binary.error


@pytest.mark.parametrize("value", [None, "", "not a date", "Mon, 99 Jan 2024 10:00:00 +0000"])
def test_unreadable_dates(value):
    assert mime.sent_time(value) is None


def test_dates_outside_the_nanosecond_range(spark):
    r = parsed(spark, PLAIN.replace("1 Jan 2024", "1 Jan 1502"))
    assert r.sent_at.year == 1502


def test_length_limits_and_order_of_reasons(spark):
    rows = [("m" * 255, "s"), ("m" * 256, "s"), ("", "s"), ("m", ""), ("m", "s" * 321), (None, None)]
    df = spark.createDataFrame(rows, "external_message_id string, sender string").withColumns(
        {"external_thread_id": F.lit(None).cast("string"), "subject": F.lit(None).cast("string")}
    )
    reasons = [r["skip_reason"] for r in importing.check_rows(df).collect()]
    assert reasons == [None, "external_message_id too long", "no external_message_id", "no sender", "sender too long", "no external_message_id"]


def test_keep_first_filters_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("arrival"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("external_message_id"))
    kept = importing.keep_first(df)
    assert kept.filter("external_message_id = 'hot'").first()["arrival"] == 0 and kept.count() == 667
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_backfill(spark):
    messages = spark.createDataFrame([(1, datetime(2024, 1, 1, 5)), (2, datetime(2024, 1, 3)), (3, None)], "i int, sent_at timestamp")
    empty = messages.filter("false")
    assert importing.older_messages(messages, empty).count() == 3
    table = messages.filter("i = 2")
    assert {r["i"] for r in importing.older_messages(messages, table).collect()} == {1, 2, 3}
    bound = importing.oldest_sent(table).select(importing.backfill_bound(F.col("oldest_sent_at")).alias("b"))
    query = bound.select(importing.backfill_query("in:inbox", F.col("b"))).first()[0]
    assert query == "in:inbox before:2024/01/04"
    none = importing.oldest_sent(empty).select(importing.backfill_query("in:inbox", importing.backfill_bound(F.col("oldest_sent_at"))))
    assert none.first()[0] == "in:inbox"


def test_import_job_twice(spark, tmp_path):
    rows = [(0, "a", "t", b64(PLAIN)), (1, "a", "t", b64(PLAIN)), (2, "b", "t", b64("Subject: no sender\n\nx")), (3, "c", "t", "A"), (150, "a", "t", b64(PLAIN))]
    raw = spark.createDataFrame(rows, "arrival long, id string, threadId string, raw string")
    table = EmailTable(spark, str(tmp_path / "emails"), digits=1)
    first = jobs.import_messages(raw, table).first().asDict()
    assert first == {
        "refs_seen": 5, "raw_fetched": 5, "fetch_errors": 0, "parse_errors": 1, "skipped": 2, "duplicate_in_chunk": 1, "created": 1,
    }
    assert table.read().count() == 1
    assert jobs.import_messages(raw, table).first()["created"] == 0
    assert table.read().count() == 1


def test_encoded_words_like_the_library(values):
    import base64
    import random

    rng = random.Random(7)

    def word():
        text = "".join(rng.choice("abc ÄßИ=?_%+.é") for _ in range(rng.randint(1, 6)))
        charset = rng.choice(["utf-8", "UTF-8", "us-ascii", "iso-8859-1", "nonsense"])
        try:
            data = text.encode(charset)
        except (LookupError, UnicodeEncodeError):
            data = text.encode()
        if rng.random() < 0.5:
            return f"=?{charset}?B?{base64.b64encode(data).decode()}?="
        return f"=?{charset}?q?{''.join(chr(b) if chr(b).isalnum() and b < 128 else '_' if b == 32 else f'={b:02X}' for b in data)}?="

    items = ["".join(rng.choice([word(), word(), "text", " ", "  ", "\n ", "a b", "(x)", "=?", "?="]) for _ in range(rng.randint(1, 6))) for _ in range(600)]
    items += ["=?utf-8?B?!!!?=", "=?utf-8?q?=GG?=", "=?utf-8?b??=", "=?utf-8?q?=FF?= x", "", None]
    assert values(mime.decode_mime_words, items) == [mime.decoded(x) for x in items]


def test_dates_like_the_library(values):
    items = [
        "Mon, 1 Jan 2024 10:00:00 +0200", "01 Jan 2024 10:00 -0130", "Tue, 02 Jan 2024 03:04:05 GMT (x)", "2 Jan 24 03:04:05 EST",
        "Mon, 1 Jan 2024 10:00:00", "no date", "", None, "Mon, 31 Feb 2024 10:00:00 +0000", "1 jan 2024 10:00:00 +0000",
        "Mon,  1  Jan 2024  10:00:00  PDT", "1 Jan 2024 10:00:00 +2500", "1 Jan 2024 25:00:00 +0000", "1 Jan 0001 00:00:00 +0000",
    ]
    naive = [t and t.replace(tzinfo=None) for t in map(mime.sent_time, items)]
    assert values(lambda c: F.date_format(mime.sent_times(c), "yyyy-MM-dd HH:mm:ss"), items) == [t and t.isoformat(" ") for t in naive]


def test_batches_are_parsed_in_portions(monkeypatch):
    """What a worker holds goes by a fixed number of bytes, not by the size of the batch it is sent."""
    import pyarrow as pa

    from mailloom.functions import batches, mime

    held, parse = [], mime.parse
    monkeypatch.setattr(mime, "parse", lambda raw, using: held.append(len(raw or b"")) or parse(raw, using))
    content = [None if k % 7 == 0 else b"From: a@b.c\n\n" + b"x" * (1000 * (k % 50)) for k in range(2000)] + [b"From: a@b.c\n\n" + b"y" * (6 << 20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2001)), pa.array(content, pa.binary())], ["arrival", "content"])
    out = []
    for part in mime.parse_batches(iter([batch, batch.slice(0, 0)])):
        assert sum(held) <= batches.PORTION or len(held) == 1
        held.clear()
        out += part.to_pylist()
    assert [r["arrival"] for r in out] == list(range(2001))
    assert [r["body_text"] for r in out] == [c and c[13:].decode() for c in content]
