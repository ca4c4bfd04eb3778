"""Secrets in texts: fixed rules, and random strings told by character Markov models.

Two first-order models of characters are counted from labelled samples: random
strings (values that the fixed rules found, and digests of the sampled texts in
three common spellings) and ordinary identifiers (the other words of the
sample). A string is random if the logarithm of the ratio of its two likelihoods
is over a threshold. Built-in functions only; the models are one array of
log ratios, a literal of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import sampled, settled, with_matches, without_overlaps

#: The rules and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

#: Strings that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Words that count as identifiers in training.
IDENTIFIER = r"[A-Za-z0-9+/_=-]{8,}"
#: Printable ASCII, the alphabet of the models.
FIRST, SIZE = 32, 96
KINDS = ("assign", "access", "hex", "random")


def with_base_places(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add ``assign``, ``access`` and ``hex``: places by the fixed rules.

    ``HEX`` has its least length in the pattern: matches of hex digits are
    maximal runs, so this finds the same ones and skips short runs early.
    """
    found = with_matches(texts, text, {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0)})
    return settled(
        found,
        {
            "assign": F.filter("assign", lambda p: F.length(p["value"]) >= ASSIGN_CHARS),
            "access": F.filter("access", lambda p: F.length(p["value"]) >= ACCESS_CHARS),
        },
    )


def _code(word: Column, at: Column) -> Column:
    return F.ascii(F.substring(word, at, F.lit(1))) - FIRST


def _pair(word: Column, at: Column) -> Column:
    """Place of the characters at and after ``at`` in a table of SIZE by SIZE."""
    return _code(word, at) * SIZE + _code(word, at + 1)


def _pairs(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda at: _pair(word, at))


def labelled_strings(sample: DataFrame, text: str = "text") -> DataFrame:
    """(word, random, n): strings of the sample with their label and how often they occur.

    Ordinary are the words that occur more than once and in no value that the
    rules found; a random string that no rule knows seldom comes twice.
    """
    found = with_base_places(sample, text)
    digest = F.sha2(F.col(text).cast("binary"), 256)
    spellings = F.array(digest, F.base64(F.unhex(digest)), F.upper(F.translate(F.base64(F.unhex(digest)), "+/=", "")))
    values = F.concat(*(F.transform(k, lambda p: p["value"]) for k in KINDS[:3]))
    words = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    ordinary = F.filter(words, lambda w: ~F.contains("hidden", w))
    found = settled(found, {"hidden": F.concat_ws(" ", values)})
    both = found.select(
        F.concat(
            F.transform(F.concat(values, spellings), lambda w: F.struct(w.alias("word"), F.lit(True).alias("random"))),
            F.transform(ordinary, lambda w: F.struct(w.alias("word"), F.lit(False).alias("random"))),
        ).alias("labelled")
    )
    words = both.select(F.inline("labelled")).filter(F.length("word") >= 2).groupBy("random", "word")
    return words.agg(F.count("*").alias("n")).filter(F.col("random") | (F.col("n") > 1))


def log_ratios(labelled: DataFrame, backing: float = 20.0) -> list[float]:
    """For each pair of characters, log P(second | first) under random less that under ordinary.

    Pairs that are rare or unknown lean on how common their second character is,
    with the weight of ``backing`` pairs. The counts are summed in Spark; what
    reaches the driver has at most two rows per pair of characters.
    """
    pairs = labelled.select("random", "n", F.explode(_pairs(F.col("word"))).alias("pair")).groupBy("random", "pair")
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return [0.0] * (SIZE * SIZE)
    model = {}
    for kind in (True, False):
        table = [[counts.get((kind, first * SIZE + second), 0) for second in range(SIZE)] for first in range(SIZE)]
        seconds = [sum(column) + 0.5 for column in zip(*table)]
        common = [n / sum(seconds) for n in seconds]
        model[kind] = [
            math.log((n + backing * c) / (sum(row) + backing)) for row in table for n, c in zip(row, common)
        ]
    return [a - b for a, b in zip(model[True], model[False])]


def randomness(word: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a string over its pairs of characters."""
    table = F.split(F.lit(",".join(f"{r:.6f}" for r in ratios)), ",").cast("array<double>")
    return F.aggregate(_pairs(word), F.lit(0.0), lambda total, pair: total + F.get(table, pair))


def find_secrets(
    docs: DataFrame,
    threshold: float = 12.0,
    sample_rows: int = 4000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id`` and places ``assign``, ``access``, ``hex``, ``random``.

    A place has ``start``, ``end`` and ``value``. The first three kinds follow
    the fixed rules. ``random`` has the strings of 16 or more characters whose
    log-likelihood ratio exceeds ``threshold`` and that overlap none of the
    others; whole texts are searched. The models are counted from about
    ``sample_rows`` documents, picked by a hash of the id.

    NULL and empty texts have no places. Repeated rows give repeated results. An
    empty table gives no rows and models that find nothing. Other columns are not read.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    ratios = log_ratios(labelled_strings(sampled(texts, sample_rows, "doc_id")))
    found = with_matches(with_base_places(texts), "text", {"random": (CANDIDATE, 0)})
    random = F.filter("random", lambda p: randomness(p["value"], ratios) > threshold)
    found = settled(found, {"random": random}).drop("text")
    return without_overlaps(found, {"random": list(KINDS[:3])})
