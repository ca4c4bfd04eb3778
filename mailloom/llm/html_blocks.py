"""Web pages to leaf blocks of text with the path of tags above them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Fixed values of the HTML standard: elements that break lines, have no content, or hold raw text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav ol option p pre "
    "noscript search section select summary table tbody td template tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Raw elements that end with the page if nothing else ends them; the others hold text of the page then.
ENDLESS_TAGS = frozenset(("script", "style"))
#: What an opening tag closes if it is open and nearest: a paragraph, or a sibling.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"},
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.DOTALL
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int = 0


@dataclass
class _State:
    stack: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    links: int = 0
    linked: int = 0
    blocks: list[Block] = field(default_factory=list)

    def text(self, raw: str) -> None:
        if raw:
            self.pieces.append(html.unescape(raw) if "&" in raw else raw)
            if self.links:
                self.linked += len(raw)

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            path = tuple(token for tag, names in self.stack for token in (tag, *names))
            self.blocks.append(Block(path, text, min(self.linked, len(text))))
        self.pieces.clear()
        self.linked = 0

    def open(self, tag: str, attributes: str) -> None:
        self.flush()
        if self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        while self.stack and self.stack[-1][0] in CLOSES.get(tag, ()):
            self.stack.pop()
        if tag not in VOID_TAGS:
            self.stack.append((tag, names_of(attributes)))

    def close(self, tag: str) -> None:
        self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return


def names_of(attributes: str) -> tuple[str, ...]:
    """Lower-case parts of class, id and role, marked with a dot."""
    if not attributes or "=" not in attributes:
        return ()
    found = (a or b or c for a, b, c in _NAMES.findall(attributes))
    return tuple("." + part.lower() for name in found for part in _PARTS.findall(name))


def blocks_of(page: str | None) -> list[Block]:
    """Blocks with text in page order; all of the page but raw elements and comments.

    Character references are decoded, white space in a block is one space. Tags
    that are never closed or never opened do no harm; a page that ends inside a
    tag ends before it.
    """
    page = page or ""
    state, at = _State(), 0
    while (token := _TOKEN.search(page, at)) is not None:
        state.text(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            if tag in BLOCK_TAGS:
                state.close(tag)
            elif tag == "a":
                state.links = max(0, state.links - 1)
        elif tag in RAW_TAGS and not token[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page) if tag in ENDLESS_TAGS else at
        elif tag in BLOCK_TAGS:
            state.open(tag, token[3])
        elif tag == "br":
            state.text(" ")
        elif tag == "a":
            state.links += 1
    state.text(page[at:])
    state.flush()
    return state.blocks
