"""Lines that many documents share, kept in one document only.

Lines are exploded as hashes of their normalised keys, the documents of each
hash are counted, and a document is put together again from the positions that
stay. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import LOWER, UPPER, cut, settled

#: White space that a key loses at both ends: space and the controls 9 to 13.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Stands for a NULL id in the comparison of ids: larger than any other.
NO_ID = (1 << 63) - 1


def lines_of(text: Column) -> Column:
    """Lines between newlines; NULL and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _document(id_column: str, text_column: str) -> list[Column]:
    """What names a document's content: its id and a hash of its text.

    Rows that repeat an id with another text keep their own line positions.
    """
    return [
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("__id"),
        F.coalesce(F.xxhash64(text_column), F.lit(0)).alias("__content"),
    ]


def _keyed_lines(docs: DataFrame, min_chars: int, id_column: str, text_column: str) -> DataFrame:
    """One row per line with a key long enough: document, position, 128-bit hash of the key."""
    # Named before the lines are exploded, so that a text is hashed once and not for each line.
    named = docs.select(*_document(id_column, text_column), F.col(text_column).alias("__text"))
    lines = named.select("__id", "__content", F.posexplode(lines_of(F.col("__text"))).alias("position", "line"))
    keys = lines.select("__id", "__content", "position", line_key(F.col("line")).alias("key"))
    return keys.filter(F.length("key") >= min_chars).select(
        "__id", "__content", "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def drop_shared_lines(
    docs: DataFrame,
    min_chars: int = 10,
    max_documents: int = 1,
    counts: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with ``text`` cut, plus ``n_lines`` and ``n_dropped`` unless ``counts`` is false.

    A key found in more than ``max_documents`` documents loses all its lines but
    those in the document with the least id that holds it. Keys shorter than
    ``min_chars`` code points are never counted. Ids must be integers.

    The counts are minima, maxima and, only where ``max_documents`` is above 1,
    distinct counts; all are combined before the shuffle, so a line that a third
    of all documents hold costs one row per task. Its occurrences meet the short
    list of shared keys in a join that Spark broadcasts or splits by its size.
    Only positions travel back to the documents.

    NULL and empty texts: one empty line, text ``''``. A NULL id counts as one
    document with the largest id. Rows that repeat an id are one document: lines
    they share stay in both. An empty table gives no rows. Other columns pass
    through; with ``counts``, those named ``n_lines`` and ``n_dropped`` are replaced.
    """
    names = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_dropped")]
    # Hashed once: the counts and the places of shared lines both read this narrow table.
    lines = cut(_keyed_lines(docs, min_chars, id_column, text_column))
    holds = [F.min("__id").alias("keeper"), F.max("__id").alias("last")]
    if max_documents == 1:
        shared = lines.groupBy("h1", "h2").agg(*holds).filter("keeper < last")
    else:
        holders = lines.select("__id", "h1", "h2").distinct().groupBy("h1", "h2")
        shared = holders.agg(*holds, F.count("*").alias("n")).filter(F.col("n") > max_documents)
    # A table of its own: the join below can then split a hot key's lines.
    shared = cut(shared.select("h1", "h2", "keeper"))
    gone = (
        lines.join(shared, ["h1", "h2"])
        .filter("__id != keeper")
        .groupBy("__id", "__content")
        .agg(F.collect_set("position").alias("__gone"))
    )
    keyed = docs.select(*names, *_document(id_column, text_column)).join(gone, ["__id", "__content"], "left")
    # Split once, and only what is put together anew.
    keyed = settled(keyed, {"__lines": F.when(F.col("__gone").isNotNull(), lines_of(F.col(text_column)))})
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.coalesce(text_column, F.lit(""))).otherwise(
        F.array_join(F.transform(F.sort_array(stay), lambda at: F.get(F.col("__lines"), at)), "\n")
    )
    dropped = F.coalesce(F.size("__gone"), F.lit(0))
    kept = [text.alias(c) if c == text_column else F.col(c) for c in names]
    if not counts:
        return keyed.select(*kept)
    return keyed.select(
        *kept,
        F.coalesce(F.size("__lines"), F.size(lines_of(F.col(text_column)))).cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(dropped).cast("long").alias("n_dropped"),
    )
