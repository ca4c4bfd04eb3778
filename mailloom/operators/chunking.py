"""Overlapping word chunks with deterministic point ids. Map-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.functions.ids import point_id
from mailloom.functions.text import bind

# How chunk windows are laid over the words.
COMPAT = "compat"  # n div 120 + 1 windows; words past the last window are left out
COVER_TAIL = "cover_tail"  # as compat, the last window runs to the end
SLIDING = "sliding"  # every window overlaps the one before it

SIZE, OVERLAP = rules.CHUNK_WORDS, rules.CHUNK_OVERLAP


def words(body: Column, *, spell_empty: bool = True) -> Column:
    """White-space separated words of a body.

    A missing or empty body stands for a fixed phrase, which is spelled out
    letter by letter unless ``spell_empty`` is off.
    """
    phrase = list(rules.EMPTY_BODY) if spell_empty else rules.EMPTY_BODY.split(" ")
    found = F.filter(F.split(body, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    return F.when(body.isNull() | (body == ""), F.array(*map(F.lit, phrase))).otherwise(found)


def windows(tokens: Column, mode: str = COMPAT) -> Column:
    """Array of (chunk_index, chunk_text) laid over an array of words."""

    def cut(t: Column) -> Column:
        n = F.size(t)
        if mode == SLIDING:
            step = SIZE - OVERLAP
            last = F.floor(F.greatest(n - OVERLAP - 1, F.lit(0)) / step).cast("int")
            start, length = (lambda k: k * step + 1), (lambda k: F.lit(SIZE))
        else:
            last = F.floor(n / SIZE).cast("int")
            start = lambda k: F.when(k == 0, 1).otherwise(k * SIZE - OVERLAP + 1)
            if mode == COVER_TAIL:
                length = lambda k: F.when(k == last, F.greatest(n, F.lit(SIZE))).otherwise(SIZE)
            else:
                length = lambda k: F.lit(SIZE)
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.struct(
                k.alias("chunk_index"),
                F.array_join(F.slice(t, start(k), length(k)), " ").alias("chunk_text"),
            ),
        )

    return bind(tokens, cut)


def subject_text(subject: Column) -> Column:
    """Subject as text: a missing one reads 'None', an empty one has a phrase."""
    return F.when(subject.isNull(), "None").when(subject == "", rules.EMPTY_SUBJECT).otherwise(subject)


def embedding_text(sender: Column, subject: Column, chunk_text: Column) -> Column:
    return F.concat(F.lit("Sender: "), sender, F.lit("; Subject: "), subject, F.lit("; Text: "), chunk_text)


def chunk_emails(
    emails: DataFrame, body: str = "body_cleaned", *, mode: str = COMPAT, spell_empty: bool = True
) -> DataFrame:
    """One row per chunk: external_message_id, sender, subject, chunk_index, chunk_text."""
    return emails.select(
        "external_message_id",
        "sender",
        subject_text(F.col("subject")).alias("subject"),
        F.inline(windows(words(F.col(body), spell_empty=spell_empty), mode)),
    )


def with_point_id(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("point_id", point_id(F.col("external_message_id"), F.col("chunk_index")))


def payload() -> Column:
    """What is stored next to the vector."""
    return F.struct("external_message_id", "chunk_index", "chunk_text")
