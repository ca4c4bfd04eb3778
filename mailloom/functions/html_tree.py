"""Tree-shaped markup rules for the few rows that patterns cannot decide.

``prune`` is a small per-row helper on the standard library parser. The UDFs
receive NULL for every other row, so almost nothing crosses to Python.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom import rules
from mailloom.functions import text as text_functions
from mailloom.functions.batches import portions

_GARBAGE = frozenset(rules.GARBAGE_TAGS)
_VOID = frozenset(rules.VOID_TAGS)


def _is_hidden(attributes: list[tuple[str, str | None]]) -> bool:
    values = dict(attributes)
    style = (values.get("style") or "").lower().replace(" ", "")
    return values.get("aria-hidden") == "true" or any(rule in style for rule in rules.HIDDEN_STYLES)


class _Pruner(HTMLParser):
    """Notes the text spans of unwanted elements; the outermost one wins."""

    def __init__(self, source: str, garbage: bool, hidden: bool):
        super().__init__(convert_charrefs=False)
        self.source, self.garbage, self.hidden = source, garbage, hidden
        self.line_starts = list(itertools.accumulate(map(len, source.split("\n")), lambda a, n: a + n + 1, initial=0))
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.dropping_from: tuple[int, int] | None = None  # (depth, offset)
        self.spans: list[tuple[int, int]] = []
        self.feed(source)
        self.close()
        if self.dropping_from:
            self.spans.append((self.dropping_from[1], len(source)))

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def _unwanted(self, tag, attributes) -> bool:
        return (self.garbage and tag in _GARBAGE) or (self.hidden and _is_hidden(attributes))

    def handle_starttag(self, tag, attrs):
        void = tag in _VOID
        if self.dropping_from is None and self._unwanted(tag, attrs):
            start = self._offset()
            if void:
                self.spans.append((start, start + len(self.get_starttag_text())))
            else:
                self.dropping_from = (len(self.open), start)
        if not void:
            self.open.append(tag)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        if self.dropping_from is None and self._unwanted(tag, attrs):
            start = self._offset()
            self.spans.append((start, start + len(self.get_starttag_text())))

    def handle_endtag(self, tag):
        if not self.count[tag]:
            return
        # Closing a tag closes what is open inside it; each element is popped once.
        closed = None
        while closed != tag:
            closed = self.open.pop()
            self.count[closed] -= 1
        depth = len(self.open)
        if self.dropping_from and depth <= self.dropping_from[0]:
            own = depth == self.dropping_from[0]
            end = self._offset()
            if own:
                end = self.source.find(">", end) + 1 or len(self.source)
            self.spans.append((self.dropping_from[1], end))
            self.dropping_from = None


def prune(source: str, *, garbage: bool = True, hidden: bool = True) -> str:
    """Cut unwanted elements with all they hold, leaving a gap tag in place.

    What follows the last ``>`` holds no whole tag; it stays out of the parser,
    which would search it once per ``<``.
    """
    end = source.rfind(">") + 1
    markup, tail = source[:end], source[end:]
    pruner = _Pruner(markup, garbage, hidden)
    pieces, at = [], 0
    for start, stop in pruner.spans:
        pieces += [markup[at:start], text_functions.GAP]
        at = stop
    # An element still open at the end reaches over the tail.
    return "".join(pieces) + markup[at:] + ("" if pruner.dropping_from else tail)


_BLOCK_TAG = re.compile(text_functions.BLOCK_TAG)
_OTHER_TAG = re.compile(text_functions.OTHER_TAG)
_MARKS = re.compile(f"{text_functions.TAG_MARK}+")


def _tree_text(source: str) -> str:
    pruned = prune(source) if "<" in source else source
    marked = _OTHER_TAG.sub(text_functions.TAG_MARK, _BLOCK_TAG.sub("\n\n\n", pruned))
    return html.unescape(_MARKS.sub("\n", marked))


def _each(arrays: Iterator[pa.Array], fn: Callable[[str], str]) -> Iterator[pa.Array]:
    """The texts of each batch by ``fn``, a portion at a time, so that memory does not go by the size of a batch."""
    for texts in arrays:
        for start, length in portions(texts):
            part = texts.slice(start, length)
            yield pa.array([fn(v.as_py()) if v.is_valid else None for v in part], pa.string())


@F.arrow_udf(T.StringType())
def tree_text(source: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Visible text of markup, with elements pruned by tree and entities decoded."""
    return _each(source, _tree_text)


@F.arrow_udf(T.StringType())
def prune_hidden(source: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Markup without its hidden elements."""
    return _each(source, lambda s: prune(s, garbage=False))
