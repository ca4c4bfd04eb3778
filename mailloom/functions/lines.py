r"""Line rules on an array of lines, without leaving the row.

A text is split, filtered and joined inside its own row, so no shuffle moves
text between machines and one frequent line or sender cannot overload a task.
Repeats are found by sorting the keys of one text and comparing neighbours,
which is n log n in the number of its lines.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.functions.text import bind, strip_value


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


_SEPARATOR = rf"{rules.SEPARATOR_LINE}\z"
_IMAGE = rf"{rules.IMAGE_LINE}\z"
_MARKUP = "|".join(rules.MARKUP_LINES)

# Letters of English text, the rarest first.
_RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate "


def _any_phrase(phrases: list[str]) -> str:
    """A pattern for any of ``phrases``, which begin with plain letters, in one fast pass over a text.

    Each is told from the rarest letter of its beginning, by looking back and ahead
    from there, so that most places of a text cost one look into a small class.
    """
    by_letter: dict[str, list[str]] = {}
    for phrase in phrases:
        head = re.match(r"[a-z ]+", phrase)[0]
        at = min(range(len(head)), key=lambda i: _RARE_FIRST.index(head[i]))
        by_letter.setdefault(head[at], []).append(f"(?<={phrase[: at + 1]}){phrase[at + 1 :]}")
    told = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())
    return f"(?=[{''.join(by_letter)}])(?:{told})"


_PHRASE = _any_phrase(rules.FOOTER_PHRASES)


def is_separator(line: Column) -> Column:
    return line.rlike(rf"\A{_SEPARATOR}")


def is_image_mark(lowered: Column) -> Column:
    return lowered.rlike(rf"(?s)\A{_IMAGE}")


def is_markup(lowered: Column) -> Column:
    return lowered.rlike(rf"(?dU)\A(?:{_MARKUP})")


def is_footer(lowered: Column) -> Column:
    """Footer phrase anywhere, a lone web address, two or more addresses, an exact value."""
    lone_address = lowered.rlike(rf"(?U)\A{rules.WEB_ADDRESS}\z")
    many_addresses = F.regexp_count(lowered, F.lit(rf"(?U){rules.WEB_ADDRESS}")) >= 2
    return (
        (lowered.contains("://") & (lone_address | many_addresses))
        | lowered.rlike(_PHRASE)
        | lowered.isin(*rules.FOOTER_LINES)
    )


# First characters that the anchored rules know.
_FIRST = sorted({*"-_=~*#[", *(line[0] for line in rules.MARKUP_LINES)})


def is_noise(lowered: Column) -> Column:
    """Any of the four kinds; the anchored ones are tried in one pass."""
    may_start = reduce(or_, [lowered.startswith(first) for first in _FIRST])
    return (may_start & lowered.rlike(rf"(?dsU)\A(?:{_SEPARATOR}|{_IMAGE}|{_MARKUP})")) | is_footer(lowered)


# Starts of the lines that the anchored rules know.
_STARTS = "|".join([rules.SEPARATOR_LINE, r"\[image", _MARKUP.replace("$", ""), *map(re.escape, rules.FOOTER_LINES)])


def may_hold_noise(lowered: Column) -> Column:
    """False only for a lower-cased text none of whose lines can be noise.

    A pass over the whole text in place of one per line; it may say yes too often.
    ``lowered`` is bound, for the optimiser copies it into the lambda that asks, once per use.
    """
    anchored = rf"(?dmU)^[\s\p{{Z}}]*+(?:{_STARTS})"
    return bind(lowered, lambda t: t.contains("://") | t.rlike(_PHRASE) | t.rlike(anchored))


def with_lowered(lines: Column, *, stripped: bool = False) -> Column:
    """Lines as structs of the stripped line and its lower-cased form; ``stripped`` lines are taken as they are."""
    lines = lines if stripped else F.transform(lines, strip_value)
    return F.transform(lines, lambda line: F.struct(line.alias("line"), F.lower(line).alias("lowered")))


def drop_noise(pairs: Column) -> Column:
    """Keep blank lines and lines no rule calls noise."""
    return F.filter(pairs, lambda p: ~is_noise(p.lowered))


def _with_previous(items: Column) -> Column:
    """Pair each element with the one before it, without an index look-up per element."""
    return F.filter(
        bind(
            items,
            lambda a: F.zip_with(
                a,
                F.array_insert(a, 1, F.lit(None)),
                lambda item, before: F.struct(item.alias("item"), before.alias("before")),
            ),
        ),
        lambda z: z.item.isNotNull(),
    )


def with_keys(pairs: Column, *, normal: bool = False) -> Column:
    """Lines as structs of their key, by which repeats are told, their place and the line.

    Lines of a ``normal`` text have white space that is more than one plain space
    only with a line or paragraph separator.
    """

    def key(lowered: Column) -> Column:
        folded = F.regexp_replace(lowered, r"(?U)\s+", " ")
        wide = lowered.contains("\u2028") | lowered.contains("\u2029")
        return F.when(wide, folded).otherwise(lowered) if normal else folded

    return F.transform(
        pairs, lambda p, i: F.struct(key(p.lowered).alias("key"), i.alias("pos"), p.line.alias("line"))
    )


def has_repeats(keyed: Column) -> Column:
    """Whether any line that is not blank occurs twice."""
    keys = F.filter(F.transform(keyed, lambda k: k.key), lambda k: k != "")
    return bind(keys, lambda k: F.size(F.array_distinct(k)) < F.size(k))


def drop_repeats(keyed: Column) -> Column:
    """Keep the first of each short repeated line and one of equal neighbours.

    Neighbours are compared after the short repeats are gone. Blank lines have
    an empty key: they separate neighbours and collapse among themselves.
    """
    firsts = F.filter(
        _with_previous(F.sort_array(keyed)),
        lambda z: (F.length(z.item.key) >= rules.SHORT_LINE)
        | (z.item.key == "")
        | z.before.isNull()
        | (z.item.key != z.before.key),
    )
    in_order = F.sort_array(
        F.transform(
            firsts,
            lambda z: F.struct(z.item.pos.alias("pos"), z.item.key.alias("key"), z.item.line.alias("line")),
        )
    )
    kept = F.filter(
        _with_previous(in_order),
        lambda z: z.before.isNull() | (z.item.key != z.before.key),
    )
    return F.transform(kept, lambda z: z.item.line)
