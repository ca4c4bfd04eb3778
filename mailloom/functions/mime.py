"""Raw RFC 2822 bytes to email fields, on Arrow batches.

The standard library parser is the per-row helper; Spark decides how the
messages are split and how large the batches are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email import message_from_bytes, policy
from email.header import decode_header, make_header
from email.message import EmailMessage
from email.utils import parsedate_to_datetime
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.functions.batches import portions

PARSED_FIELDS = T.StructType(
    [
        T.StructField("subject", T.StringType()),
        T.StructField("sender", T.StringType()),
        T.StructField("recipients", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("body_html", T.StringType()),
        T.StructField("sent_at", T.TimestampType()),
        T.StructField("has_attachments", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)

_ARROW_TYPES = {
    "sent_at": pa.timestamp("us", tz="UTC"),
    "has_attachments": pa.bool_(),
}


def decoded(value: str | None) -> str | None:
    """Encoded words of a header value decoded; the value itself if that fails."""
    try:
        return None if value is None else str(make_header(decode_header(value)))
    except Exception:  # any malformed word keeps the raw value
        return str(value)


@F.pandas_udf(T.StringType())
def _decode_odd_words(values: pd.Series) -> pd.Series:
    """Encoded words decoded by the standard library, NULL stays NULL."""
    return values.map(decoded, na_action="ignore").astype(object).where(values.notna(), None)


_WORD = r"=\?([^?\s]*)\?([bBqQ])\?([^?\s]*)\?="


def _word_text(charset: Column, encoding: Column, encoded: Column) -> Column:
    """Text of one encoded word; NULL if it is not plain UTF-8 or ASCII."""
    base64 = F.try_to_binary(encoded, F.lit("base64")).cast("string")
    escaped = F.replace(F.replace(F.replace(encoded, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B")), F.lit("_"), F.lit("%20"))
    quoted = F.try_url_decode(F.regexp_replace(escaped, "=([0-9A-Fa-f]{2})", "%$1"))
    text = F.when(F.lower(encoding) == "b", base64).otherwise(F.when(~escaped.rlike("=(?![0-9A-Fa-f]{2})"), quoted))
    fits = F.is_valid_utf8(text) & ~text.contains("\ufffd") & (text != "") & ~text.rlike(r"^\s|\s$|[\n\r]")
    known = (F.lower(charset) == "utf-8") | ((F.lower(charset) == "us-ascii") & text.rlike(r"^[\x00-\x7F]*$"))
    return F.when(known & fits, text)


def decode_mime_words(value: Column) -> Column:
    """Encoded words decoded, NULL stays NULL.

    Built-in functions decode words in UTF-8 or ASCII, in base64 or quoted form,
    that stand apart from other text by one space. White space between two words
    goes. All other values with encoded words take the standard library.
    """
    words = F.arrays_zip(*(F.regexp_extract_all(value, F.lit(_WORD), F.lit(k)).alias(n) for k, n in ((1, "c"), (2, "e"), (3, "t"))))
    texts = F.transform(words, lambda w: _word_text(w["c"], w["e"], w["t"]))
    gaps = F.split(value, _WORD, -1)
    last = F.size(gaps) - 1

    def joint(gap: Column, at: Column) -> Column:
        """The text between two words, NULL if its spacing is not the usual one."""
        usual = F.when(at == 0, gap.rlike(r"^$|^\S(.*\S)? $")).when(at == last, gap.rlike(r"^$|^ \S(.*\S)?$"))
        return F.when(F.coalesce(usual, gap.rlike(r"^ \S(.*\S)? $")), gap).when((at > 0) & (at < last) & gap.rlike(r"^\s+$"), "")

    pieces = F.zip_with(F.transform(gaps, joint), F.concat(texts, F.array(F.lit(""))), lambda gap, text: F.concat(gap, text))
    simple = F.when(F.forall(pieces, lambda p: p.isNotNull()), F.array_join(pieces, ""))
    return F.when(~value.contains("=?"), value).otherwise(
        F.coalesce(simple, _decode_odd_words(F.when(value.contains("=?") & simple.isNull(), value)))
    )


#: Zone names of the mail standard.
ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
    "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


@F.pandas_udf(T.TimestampType())
def _odd_times(values: pd.Series) -> pd.Series:
    return pd.to_datetime(pd.Series([sent_time(v) for v in values], index=values.index, dtype=object), utc=True)


def sent_times(header: Column) -> Column:
    """A Date header as a time, NULL if missing or unreadable.

    The usual form (day name or none, four-digit year, offset or zone name, with or
    without seconds and a comment) is read by built-in functions; only what they
    cannot read takes the standard library.
    """
    bare = F.trim(F.regexp_replace(header, r"\([^()]*\)|^\s*[A-Za-z]{3},", ""))
    zone = F.regexp_extract(bare, r"\s(" + "|".join(ZONES) + r")$", 1)
    names = F.create_map(*(F.lit(x) for item in ZONES.items() for x in item))
    stem = F.regexp_replace(bare, r"\s[A-Z]{1,3}$", "")
    offset = F.when(zone != "", F.concat(stem, F.lit(" "), F.element_at(names, zone))).otherwise(bare)
    spaced = F.regexp_replace(offset, r"\s+", " ")
    usual = spaced.rlike(r"^[0-9]{1,2} [A-Z][a-z]{2} [1-9][0-9]{3} [0-9]{2}:[0-9]{2}(:[0-9]{2})? [+-][0-9]{4}$")
    read = F.when(
        usual,
        F.coalesce(
            F.try_to_timestamp(spaced, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(spaced, F.lit("d MMM yyyy HH:mm xx"))
        ),
    )
    return F.coalesce(read, _odd_times(F.when(read.isNull(), header)))


def sent_time(value: str | None) -> datetime | None:
    """A Date header as UTC time, NULL if missing or unreadable."""
    try:
        parsed = parsedate_to_datetime(str(value)) if value else None
        if parsed is None:
            return None
        return parsed.replace(tzinfo=UTC) if parsed.tzinfo is None else parsed.astimezone(UTC)
    except Exception:  # unreadable dates are not errors of the message
        return None


def _content(part: EmailMessage):
    try:
        return part.get_content()
    except Exception:  # an undecodable part counts as absent
        return None


def _fields(message: EmailMessage) -> dict:
    multipart = message.is_multipart()
    inline: dict[str, str | None] = {"text/plain": None, "text/html": None}
    attached = False
    if multipart:
        for part in message.walk():
            kind = part.get_content_type()
            is_attachment = "attachment" in str(part.get("Content-Disposition", "")).lower()
            attached |= is_attachment
            if not is_attachment and kind in inline and inline[kind] is None:
                inline[kind] = _content(part)
    else:
        # A single part is the body whatever its type, and also the HTML body if it is HTML.
        inline["text/plain"] = _content(message)
        if message.get_content_type() == "text/html":
            inline["text/html"] = inline["text/plain"]
    if not isinstance(inline["text/plain"], str | None):
        raise ValueError("body is not text")
    return {
        "subject": decoded(message.get("Subject")),
        "sender": decoded(message.get("From")),
        "recipients": decoded(message.get("To")),
        "body_text": inline["text/plain"],
        "body_html": inline["text/html"],
        "sent_at": sent_time(message.get("Date")),
        "has_attachments": attached,
        "error": None,
    }


def _storable(value):
    """Lone surrogates of broken charsets cannot be stored as UTF-8."""
    return value.encode("utf-8", "replace").decode("utf-8") if isinstance(value, str) else value


class _RememberingPolicy(policy.EmailPolicy):
    """The default policy with parsed headers remembered.

    The parser asks for the content type of a part a dozen times, and the same
    few values come back in message after message.
    """

    remembered: Callable | None = None

    def header_fetch_parse(self, name, value):
        return self.remembered(name, value)


def parsing_policy() -> policy.EmailPolicy:
    return _RememberingPolicy(remembered=lru_cache(maxsize=1024)(policy.default.header_fetch_parse))


def parse(raw: bytes | None, using: policy.EmailPolicy = policy.default) -> dict:
    """Fields of one message; ``error`` is set where it cannot be read."""
    if raw is None:
        return {"error": "raw message cannot be decoded"}
    try:
        return {k: _storable(v) for k, v in _fields(message_from_bytes(raw, policy=using)).items()}
    except Exception as failure:  # one bad message must not fail the job
        return {"error": f"{type(failure).__name__}: {failure}"}


def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the ``content`` column of each batch by the parsed fields.

    A batch is parsed in portions, so that memory goes by them and not by what the
    engine puts into one batch.
    """
    using = parsing_policy()
    for batch in batches:
        at = batch.schema.get_field_index("content")
        names = [n for n in batch.schema.names if n != "content"]
        for start, length in portions(batch.column(at)):
            part = batch.slice(start, length)
            rows = [parse(value.as_py(), using) for value in part.column(at)]
            columns = [part.column(part.schema.get_field_index(n)) for n in names]
            for field in PARSED_FIELDS.names:
                columns.append(pa.array([r.get(field) for r in rows], type=_ARROW_TYPES.get(field, pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names + PARSED_FIELDS.names)
