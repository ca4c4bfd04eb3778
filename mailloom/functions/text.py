r"""Text rules as Column expressions.

Each function uses its input once, so chains stay linear in size and run
inside whole-stage code generation. Flags used throughout: ``d`` so that only
``\n`` ends a line, ``U`` so that ``\s``, ``\w``, ``\b`` and case folding follow Unicode.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom import rules


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_value(text: Column) -> Column:
    """As ``strip``, for a column or lambda variable: it is read several times.

    ``trim`` lays out the places of all characters of a text; the ends alone tell whether it has to.
    """
    at_ends = reduce(or_, [text.endswith(w) for w in rules.WHITESPACE], F.ascii(text).isin(*map(ord, rules.WHITESPACE)))
    return F.when(at_ends, F.trim(text, F.lit(rules.WHITESPACE))).otherwise(text)


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return bind(text, strip_value)


def drop_invisible(text: Column) -> Column:
    """Remove control, format, private-use and surrogate characters but newline and tab."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t\p{Cn}]]", "")


def fold_spaces(text: Column) -> Column:
    """Turn typographic space characters (``rules.UNICODE_SPACES``) into plain spaces."""
    return F.regexp_replace(text, r"[\p{Zs}&&[^ ]]", " ")


# Whole texts of one class, for a greedy run from the start is told much faster than a search at each place.
# A plain class is told fastest; the second may say no for code points that are not assigned.
_PLAIN = r"\A[\n\t -~]*\z"
_VISIBLE = r"\A[[\n\t -~][^\p{C}\p{Zs}]]*\z"
_NO_SEPARATOR = r"\A[[\n\t -~][^\p{Z}]]*\z"


def visible(text: Column) -> Column:
    """Both rules; a text that holds nothing for them is not written anew."""
    held = lambda t: ~t.rlike(_PLAIN) & ~t.rlike(_VISIBLE)
    return bind(text, lambda t: F.when(held(t), fold_spaces(drop_invisible(t))).otherwise(t))


def drop_declarations(text: Column) -> Column:
    """Remove a leading XML declaration, document types and comments."""

    def dropped(t: Column) -> Column:
        t = F.regexp_replace(t, r"(?isU)\A\s*<\?xml[^>]*\?>", "")
        t = F.regexp_replace(t, r"(?is)<!doctype[^>]*>", "")
        return F.regexp_replace(t, r"(?is)<!--.*?-->", "")

    return bind(text, lambda t: F.when(t.contains("<!") | t.contains("<?"), dropped(t)).otherwise(t))


_ROOT_TAG = r"(?isU)</?(html|body)\b[^>]*>"


def drop_root_tags(text: Column) -> Column:
    """Remove the ``html`` and ``body`` tags, keeping what they hold."""
    return bind(text, lambda t: F.when(t.rlike(_ROOT_TAG), F.regexp_replace(t, _ROOT_TAG, "")).otherwise(t))


def drop_namespaces(text: Column) -> Column:
    """Remove name-space attributes, then strip."""
    dropped = lambda t: F.regexp_replace(t, r'(?isU)\sxmlns(:\w+)?="[^"]*"', "")
    return strip(bind(text, lambda t: F.when(t.contains('="'), dropped(t)).otherwise(t)))


def preclean(text: Column) -> Column:
    """Document-level markup removal on text that is already visible."""
    return drop_namespaces(drop_root_tags(drop_declarations(text)))


_ATTRIBUTES = r"(?:[\s/][^>]*)?"
_PAIRED_GARBAGE = [tag for tag in rules.GARBAGE_TAGS if tag not in rules.VOID_TAGS]
_VOID_GARBAGE = [tag for tag in rules.GARBAGE_TAGS if tag in rules.VOID_TAGS]

# A dropped element still separates the texts around it, so this tag stays.
GAP = "<wbr>"


def drop_garbage(html: Column) -> Column:
    """Drop elements that never hold readable content, by pattern.

    Exact for well-formed markup; ``needs_tree`` tells which rows are not.
    """
    for tag in _PAIRED_GARBAGE:
        html = F.regexp_replace(html, rf"(?is)<{tag}{_ATTRIBUTES}>.*?</{tag}[^>]*>", GAP)
    return F.regexp_replace(html, rf"(?is)<(?:{'|'.join(_VOID_GARBAGE)}){_ATTRIBUTES}>", GAP)


def hides_elements(html: Column) -> Column:
    """True where an inline style or an accessibility mark may hide an element."""
    spaced = "|".join(" *".join(rule) for rule in rules.HIDDEN_STYLES)
    hides = html.rlike(r"(?i)aria-hidden") | (html.rlike(r"(?i)style\s*=") & html.rlike(f"(?i){spaced}"))
    return html.rlike(r"(?i)aria-hidden|style\s*=") & hides


_ANY_GARBAGE = "|".join(rules.GARBAGE_TAGS)
_PAIRED = "|".join(_PAIRED_GARBAGE)


def garbage_is_unpaired(html: Column) -> Column:
    """True where opening and closing garbage tags differ in number, or a tag closes itself.

    Such rows are left to the tree, where an unclosed tag costs nothing extra;
    a pattern would search the rest of the text for every one of them.
    """
    opened = F.regexp_count(html, F.lit(rf"(?i)<(?:{_PAIRED})[\s/>]"))
    closed = F.regexp_count(html, F.lit(rf"(?i)</(?:{_PAIRED})[\s/>]"))
    return (opened != closed) | html.rlike(rf"(?i)<(?:{_PAIRED})(?:\s[^>]*)?/>")


def holds_garbage(html: Column) -> Column:
    """True where a garbage tag opens or closes; pattern removal leaves one where they are nested."""
    return html.rlike(rf"(?i)</?(?:{_ANY_GARBAGE})[\s/>]")


BLOCK_TAG = rf"(?i)<(?:/?(?:{'|'.join(rules.BLOCK_TAGS)})|br){_ATTRIBUTES}>"
OTHER_TAG = r"<(?:/?[a-zA-Z]|[!?])[^>]*>"

# Stands for a tag until runs of tags are one break; visible text cannot hold it.
TAG_MARK = "\x01"


def break_tags(html: Column) -> Column:
    """Replace tags by line breaks: a blank line for blocks, a new line for the rest.

    Runs of tags are joined through a one-character mark, since a repeated
    group would recurse once per tag.
    """
    html = F.regexp_replace(html, BLOCK_TAG, "\n\n\n")
    return F.regexp_replace(F.regexp_replace(html, OTHER_TAG, TAG_MARK), f"{TAG_MARK}+", "\n")


# Character references that built-in functions decode; the tree helper knows all.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™",
    "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“",
    "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "sect": "§", "deg": "°",
    "times": "×", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é",
    "egrave": "è", "agrave": "à", "ccedil": "ç", "ntilde": "ñ", "iexcl": "¡", "iquest": "¿",
}
_REFERENCE = rf"&(?:{'|'.join(ENTITIES)}|#(?:3[2-9]|[4-9][0-9]|1[01][0-9]|12[0-6]|1[6-9][0-9]|[2-9][0-9][0-9]|[1-9][0-9]{{3}}));"


def plain_entities(html: Column) -> Column:
    """Whether every ``&`` that may begin a reference begins one that ``decode_entities`` knows."""
    return F.regexp_count(html, F.lit("&[#A-Za-z]")) == F.regexp_count(html, F.lit(_REFERENCE))


def decode_entities(text: Column) -> Column:
    """Known names and decimal numbers up to 9999 decoded, each once."""
    names = F.create_map(*(F.lit(x) for item in ENTITIES.items() for x in item))

    def character(name: Column) -> Column:
        code = F.lpad(F.hex(F.try_to_number(F.substring(name, F.lit(2), F.length(name)), F.lit("9999")).cast("long")), 8, "0")
        return F.when(name.startswith("#"), F.decode(F.unhex(code), "UTF-32")).otherwise(F.element_at(names, name))

    found = F.transform(
        F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), lambda r: character(F.substring(r, F.lit(2), F.length(r) - 2))
    )
    pieces = F.zip_with(F.split(text, _REFERENCE), found, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit(""))))
    return F.array_join(pieces, "")


def collapse_blank_lines(text: Column) -> Column:
    """At most one blank line in a row, none at the ends, for stripped lines."""
    collapsed = lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    return strip(bind(text, collapsed))


def tidy_lines(text: Column) -> Column:
    """Strip the lines of visible, single-spaced text and collapse blank ones.

    Single plain spaces go by plain replacement. In the pattern for the rest a
    trailing run is matched from its first character only, so a long run costs
    linear time.
    """
    odd = lambda t: t.contains("  ") | ((F.octet_length(t) != F.length(t)) & ~t.rlike(_NO_SEPARATOR))
    by_pattern = lambda t: F.regexp_replace(t, r"\p{Z}(?<!\p{Z}{2})\p{Z}*\n\p{Z}*|\n\p{Z}+", "\n")
    plainly = lambda t: F.replace(F.replace(t, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return collapse_blank_lines(bind(text, lambda t: F.when(odd(t), by_pattern(t)).otherwise(plainly(t))))


def single_spaces(text: Column) -> Column:
    """Runs of spaces and tabs become one space; single spaces are not touched."""
    wide = lambda t: t.contains("\t") | t.contains("  ")
    narrowed = lambda t: F.regexp_replace(t, r"[ \t](?:(?<=\t)|[ \t])[ \t]*", " ")
    return bind(text, lambda t: F.when(wide(t), narrowed(t)).otherwise(t))


def normalise(text: Column) -> Column:
    """One space between words, stripped lines, single blank lines."""
    return tidy_lines(single_spaces(text))


_REPLY = rf"(?imdU)^(?:{'|'.join(rules.REPLY_HEADERS)})$"


def cut_reply(text: Column) -> Column:
    """Keep what stands before the first quoted-reply header."""
    head = F.split(text, _REPLY, 2)
    return bind(head, lambda h: F.when(F.size(h) > 1, F.trim(h[0], F.lit(rules.WHITESPACE))).otherwise(h[0]))


_SIGNATURE = rf"(?imdU)^(?:{'|'.join(rules.SIGNATURE_LINES)})$"


def blank_signatures(text: Column) -> Column:
    """Blank app and device signatures and leaked tags in text with stripped lines."""
    blanked = lambda t: F.when(t.rlike(_SIGNATURE), F.regexp_replace(t, _SIGNATURE, "")).otherwise(t)
    return collapse_blank_lines(bind(text, blanked))


def drop_signatures(text: Column) -> Column:
    """The last pass on any text: make it visible and tidy, then blank signatures."""
    text = F.regexp_replace(normalise(visible(text)), _SIGNATURE, "")
    return collapse_blank_lines(text)


def first_address(text: Column) -> Column:
    """First email address in a free-form string, NULL if there is none."""
    found = F.regexp_extract(text, f"(?U){rules.EMAIL_ADDRESS}", 0)
    return F.nullif(found, F.lit(""))
