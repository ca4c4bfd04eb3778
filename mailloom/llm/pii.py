"""Personal data in texts: fixed rules, and a span classifier from weak supervision.

Candidate spans (those of the fixed rules, other long numbers, written-out mail
addresses, given names with a family name) are judged by labelers: patterns of
shape, a gazetteer, and words before the span. Each votes for, against, or not
at all. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is and how likely each pattern is personal data; with
these as weights a naive Bayes classifier of span features is trained. It alone
decides on the spans that the fixed rules do not cover. Built-in functions only;
what reaches the driver are counts of vote and feature patterns, whose number is
bounded by the labelers and features.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import sampled, settled, with_matches, without_overlaps

#: The rules. Their repeats are possessive and starts inside a run
#: that has failed are skipped, which changes no match but keeps long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: Common given names in the corpus languages, and endings of mail domains.
GIVEN_NAMES = (
    "Anna Antonio Carlos Charles Claire Daniel David Elena Elizabeth Emily Emma Felix Francisco Hans Heinrich "
    "Isabel James Jean John Jorge Jose Juan Julia Karl Laura Lucas Luis Manuel Marie Maria Mark Martin Mary Michael "
    "Miguel Olivia Paul Peter Pierre Robert Sarah Sophie Stefan Susan Thomas William Wolfgang"
).split()
DOMAIN_ENDINGS = "com org net edu gov info de fr es uk eu".split()

NUMBER = r"(?<![A-Za-z0-9+.(-])\(?[0-9]++(?:[\x20().-]{1,2}[0-9]++){1,6}+(?![A-Za-z])"
WRITTEN_MAIL = r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}){1,4}"
NAME = r"\b(?:" + "|".join(GIVEN_NAMES) + r")\x20[A-Z][a-z]+\b"
EXTRA = ("number", "mail", "name")

PHONE_SHAPE = r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$"
ID_SHAPE = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
PLAIN_SHAPE = r"^[0-9]+\.[0-9]+(\.[0-9]+)?$|^[0-9]{1,4}[ .-][0-9]{1,4}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}"
SAID = r"(?i)\b(phone|tel|call|mobile|fax|ssn|social security|contact|mail|reach|born|dob|telefon|anruf|téléphone|appel|teléfono|llam\w*|correo|courriel)\b[^\n]{0,24}$"
UNLIKE = r"(?i)\b(version|page|pages|chapter|section|copyright|figure|table|isbn|vol|license[d]?|cc by\S*|article|seite|kapitel|página)\b[^\n]{0,16}$"
#: Characters before a span that labelers see.
CONTEXT = 48


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(digits, at, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when((F.length(digits) - at) % 2 == 1, twice).otherwise(digit)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small(part: Column) -> Column:
    short = F.ltrim(part, F.lit("0"))
    return (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))


def with_places(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add the places of the fixed rules and of the further candidates, none of which overlap the rules'."""
    patterns = {
        "email": EMAIL,
        "ip": IP,
        "card": CARD,
        "phone": PHONE,
        "number": NUMBER,
        "mail": WRITTEN_MAIL,
        "name": NAME,
    }
    found = with_matches(texts, text, {kind: (pattern, 0) for kind, pattern in patterns.items()})

    def is_card(p: Column) -> Column:
        digits = _digits(p["value"])
        return F.length(digits).between(14, 19) & luhn(digits)

    right = settled(
        found,
        {
            "ip": F.filter("ip", lambda p: F.forall(F.split(p["value"], r"\."), _small)),
            "card": F.filter("card", is_card),
            "phone": F.filter("phone", lambda p: F.length(_digits(p["value"])).between(10, 15)),
        },
    )
    return without_overlaps(right, {kind: list(BASE) for kind in EXTRA})


def _before(text: Column, place: Column) -> Column:
    """The characters before a place that labelers see."""
    first = F.greatest(place["start"] - CONTEXT, F.lit(0))
    return F.substring(text, first + 1, place["start"] - first)


def votes(value: Column, before: Column, kind: Column) -> dict[str, Column]:
    """1 for personal data, 0 against, NULL for no vote."""
    n = F.length(_digits(value))
    names = F.array(*map(F.lit, GIVEN_NAMES))
    endings = F.array(*map(F.lit, DOMAIN_ENDINGS))
    return {
        "rule": F.when(kind.isin(*BASE), 1),
        "shape": F.when(value.rlike(PHONE_SHAPE) | value.rlike(ID_SHAPE) | (kind == "mail"), 1).when(
            value.rlike(PLAIN_SHAPE), 0
        ),
        "length": F.when((kind == "number") & (n < 7), 0).when((n >= 9) & (n <= 16), 1),
        "gazetteer": F.when(F.array_contains(names, F.split_part(value, F.lit(" "), F.lit(1))), 1).when(
            value.contains("@"),
            F.array_contains(endings, F.lower(F.substring_index(value, ".", -1))).cast("int"),
        ),
        "said": F.when(before.rlike(SAID), 1),
        "unlike": F.when(before.rlike(UNLIKE), 0),
    }


def features(value: Column, before: Column, kind: Column) -> dict[str, Column]:
    """Small categories that the span classifier sees."""
    n = F.length(_digits(value))
    return {
        "what": F.when(kind.isin("number", "phone", "card", "ip"), "digits").when(kind.isin("email", "mail"), "mail").otherwise("name"),
        "digits": F.least(n, F.lit(20)).cast("string"),
        "groups": F.least(F.size(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))), F.lit(6)).cast("string"),
        "marks": F.concat(
            *(F.when(value.contains(mark), mark).otherwise("") for mark in ("(", "-", ".", "+", "@"))
        ),
        "said": before.rlike(SAID).cast("string"),
        "unlike": before.rlike(UNLIKE).cast("string"),
    }


def vote_counts(found: DataFrame, text: str = "text") -> tuple[list[str], list[str], list[tuple]]:
    """Names of labelers and features, and (votes, features, count) of every pattern that occurs."""
    def tagged(kind: str) -> Column:
        before = lambda p: _before(F.col(text), p).alias("before")
        return F.transform(kind, lambda p: F.struct(p["value"].alias("value"), before(p), F.lit(kind).alias("kind")))

    spans = found.select(F.inline(F.concat(*map(tagged, BASE + EXTRA))))
    given = votes(F.col("value"), F.col("before"), F.col("kind"))
    seen = features(F.col("value"), F.col("before"), F.col("kind"))
    patterns = spans.select(
        F.array(*(v.cast("int") for v in given.values())).alias("votes"), F.array(*seen.values()).alias("features")
    )
    rows = patterns.groupBy("votes", "features").count().collect()
    return list(given), list(seen), [(tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in rows]


def estimate(
    counts: dict[tuple, int], rounds: int = 50
) -> tuple[dict[tuple, float], list[dict[int | None, tuple[float, float]]]]:
    """Posterior of each vote pattern, and per labeler how likely each outcome is (if not, if so).

    An outcome is a vote for, a vote against, or none: a labeler that can only vote
    one way is told by how often it speaks about either class. Starts from the
    share of votes in favour, a little for the votes that were given.
    """
    patterns = sorted(counts, key=str)
    posterior = {p: (sum(v or 0 for v in p) + 0.5) / (sum(v is not None for v in p) + 1) for p in patterns}
    chances: list[dict[int | None, tuple[float, float]]] = []
    for _ in range(rounds):
        yes = sum(counts[p] * posterior[p] for p in patterns)
        prior = (yes + 1) / (sum(counts.values()) + 2)
        chances = []
        for k in range(len(patterns[0]) if patterns else 0):
            # One imagined vote in the right direction for each class, and half of each other outcome.
            told = {0: {0: 1.0, 1: 0.5, None: 0.5}, 1: {0: 0.5, 1: 1.0, None: 0.5}}
            for p in patterns:
                told[1][p[k]] += counts[p] * posterior[p]
                told[0][p[k]] += counts[p] * (1 - posterior[p])
            total = [sum(told[c].values()) for c in (0, 1)]
            chances.append({v: (told[0][v] / total[0], told[1][v] / total[1]) for v in (0, 1, None)})
        for p in patterns:
            odds = math.log(prior / (1 - prior))
            odds += sum(math.log(chances[k][v][1] / chances[k][v][0]) for k, v in enumerate(p))
            posterior[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return posterior, chances


def train(rows: list[tuple], names: list[str]) -> tuple[float, dict[str, dict[str, float]]]:
    """Bias and log ratios per feature value, from patterns weighted by their posteriors."""
    counts: dict[tuple, int] = defaultdict(int)
    for given, _, n in rows:
        counts[given] += n
    posterior, _ = estimate(counts)
    total = [1.0, 1.0]
    told: list[dict[str, list[float]]] = [defaultdict(lambda: [0.0, 0.0]) for _ in names]
    for given, seen, n in rows:
        for label, weight in ((1, posterior[given]), (0, 1 - posterior[given])):
            total[label] += n * weight
            for k, value in enumerate(seen):
                told[k][value][label] += n * weight
    weights = {}
    for name, table in zip(names, told):
        size = len(table) + 1
        weights[name] = {
            value: math.log((c[1] + 0.5) / (total[1] + 0.5 * size)) - math.log((c[0] + 0.5) / (total[0] + 0.5 * size))
            for value, c in table.items()
        }
    return math.log(total[1] / total[0]), weights


def log_odds(seen: dict[str, Column], bias: float, weights: dict[str, dict[str, float]]) -> Column:
    """What the classifier says of a span; values it has not met tell nothing."""
    total = F.lit(bias)
    for name, value in seen.items():
        table = weights.get(name) or {}
        if table:
            pairs = [F.lit(x) for item in sorted(table.items()) for x in item]
            total = total + F.coalesce(F.element_at(F.create_map(*pairs), value), F.lit(0.0))
    return total


def find_personal_data(
    docs: DataFrame,
    threshold: float = 3.0,
    sample_rows: int = 20_000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id`` and places ``email``, ``ip``, ``card``, ``phone``, ``other``.

    A place has ``start``, ``end`` and ``value``. The first four follow the fixed
    rules. ``other`` has the candidates outside them whose log odds by the
    trained classifier exceed ``threshold``. Whole texts are searched; the
    classifier is trained on the spans of about ``sample_rows`` documents, picked
    by a hash of the id.

    NULL and empty texts have no places. Repeated rows give repeated results. An
    empty table gives no rows; without any candidate nothing is added. Other
    columns are not read.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    _, names, rows = vote_counts(with_places(sampled(texts, sample_rows, "doc_id")))
    bias, weights = train(rows, names)
    found = with_places(texts)

    def judged(kind: str) -> Column:
        def personal(p: Column) -> Column:
            seen = features(p["value"], _before(F.col("text"), p), F.lit(kind))
            return log_odds(seen, bias, weights) > threshold

        return F.filter(kind, personal)

    number, mail, name = map(judged, EXTRA)
    found = settled(found, {"number": number, "mail": mail, "name": name}).drop("text")
    found = without_overlaps(found, {"number": ["mail"]})
    return settled(found, {"other": F.concat("number", "mail", "name")}).select("doc_id", *BASE, "other")
