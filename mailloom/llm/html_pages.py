"""Made-up pages with known main text, to train the block labeller on many layouts."""

from __future__ import annotations

import html
import random

MAIN_BOXES = (
    "article|main|section.content|div.content|div.post-content|div.entry-content|div.article-body|div.story|div.post|"
    "div.main-content|div.page-body|div#content|div#main|div.text|div.body-copy|article.post|main.article|div.rich-text"
).split("|")
NAV_BOXES = "nav|div.menu|ul.navigation|div.navbar|div#nav|nav.main-menu|div.breadcrumbs|div.topbar-links|div.site-nav".split("|")
HEADER_BOXES = "header|div.header|div#header|div.masthead|header.site-header|div.top-banner|div.branding".split("|")
FOOTER_BOXES = "footer|div.footer|div#footer|footer.site-footer|div.bottom|div.copyright|div.page-footer".split("|")
SIDE_BOXES = "aside|div.sidebar|div#sidebar|aside.widget|div.widget-area|div.related|section.related-posts|div.recommended|div.share-bar|div.social".split("|")
AD_BOXES = "div.ad|div.ads|div.advert|div.advertisement|aside.ad|div.sponsored|div.promo|section.promotion|div.ad-slot|div.banner-ad".split("|")
NOTICE_BOXES = "div.cookie-notice|div.cookies|div#consent|div.notice|div.alert|div.newsletter|div.popup|div.gdpr-banner|section.subscribe|div.modal".split("|")
COMMENT_BOXES = "section.comments|div.comments|div#comments|ol.comment-list|div.discussion|section.responses|div.reader-comments".split("|")
NAV_WORDS = "home about contact login register search news sports products services help faq sitemap archive profile blog shop".split()
LEGAL_WORDS = "copyright rights reserved privacy policy terms cookies imprint impressum datenschutz mentions légales aviso legal".split()
NOTICE_WORDS = "we use cookies accept decline subscribe newsletter sign up email consent settings agree".split()
AD_WORDS = "sponsored advertisement buy now offer sale discount free shipping deal click here anzeige publicité".split()
COMMENT_WORDS = "reply says great thanks agree posted comment like report ago".split()


class PageMaker:
    """Pages of random layout over given words; each block's text is known as main or not."""

    def __init__(self, words: list[str], seed: int):
        self.rng, self.words = random.Random(seed), words or ["word"]

    def _text(self, low: int, high: int, extra: list[str] = (), share: float = 0.0) -> str:
        rng = self.rng
        words = [rng.choice(extra) if extra and rng.random() < share else rng.choice(self.words) for _ in range(rng.randint(low, high))]
        return " ".join(words).capitalize() + rng.choice([".", ".", "", "!"])

    def _leaf(self, tag: str, text: str, main: bool, linked: bool = False) -> str:
        if main is not None:
            self.labels.append((" ".join(text.split()), main))
        body = html.escape(text, quote=False)
        if linked:
            body = f'<a href="/x">{body}</a>'
        elif self.rng.random() < 0.1:
            body = f"<b>{body}</b>"
        elif self.rng.random() < 0.05:
            body = f"<b>{body}<br>"
        end = "" if tag in ("p", "li") and self.rng.random() < 0.1 else f"</{tag}>"
        return f"<{tag}>{body}{end}"

    def _box(self, box: str, inner: str) -> str:
        tag, mark, name = box.partition("." if "." in box else "#")
        if self.disguised and self.rng.random() < 0.7:
            tag, name, mark = ("div" if tag not in ("ul", "ol") else tag), "x" + str(self.rng.randint(0, 999)), "."
        kind = {".": "class", "#": "id"}.get(mark)
        return f'<{tag} {kind}="{name}">{inner}</{tag}>' if kind else f"<{tag}>{inner}</{tag}>"

    def _links(self, words: list[str], low: int = 3, high: int = 9) -> str:
        items = [self._leaf("li", self._text(1, 2, words, 0.5), False, linked=True) for _ in range(self.rng.randint(low, high))]
        return "<ul>" + "".join(items) + "</ul>"

    def _nav(self) -> str:
        return self._box(self.rng.choice(NAV_BOXES), self._links(NAV_WORDS, 1, 9))

    def _header(self) -> str:
        inner = self._leaf(self.rng.choice(["h1", "div", "p"]), self._text(1, 5), False, self.rng.random() < 0.5)
        if self.rng.random() < 0.5:
            inner += self._leaf("p", self._text(2, 8), False)
        return self._box(self.rng.choice(HEADER_BOXES), inner + (self._nav() if self.rng.random() < 0.4 else ""))

    def _footer(self) -> str:
        text = "© " * self.rng.randint(0, 1) + self._text(1, 14, LEGAL_WORDS, self.rng.choice([0, 0.4]))
        inner = self._leaf(self.rng.choice(["p", "div", "small"]) if self.rng.random() < 0.5 else "p", text, False)
        return self._box(self.rng.choice(FOOTER_BOXES), inner + (self._links(LEGAL_WORDS) if self.rng.random() < 0.4 else ""))

    def _side(self) -> str:
        inner = self._leaf(self.rng.choice(["h2", "h3", "h4"]), self._text(1, 4), False)
        if self.rng.random() < 0.6:
            inner += self._links(NAV_WORDS)
        else:
            inner += "".join(self._leaf("p", self._text(3, 25), False) for _ in range(self.rng.randint(1, 3)))
        return self._box(self.rng.choice(SIDE_BOXES), inner)

    def _ad(self) -> str:
        texts = [self._text(2, 20, AD_WORDS, self.rng.choice([0, 0, 0.4])) for _ in range(self.rng.choice([1, 1, 2]))]
        return self._box(self.rng.choice(AD_BOXES), "".join(self._leaf("p", t, False) for t in texts))

    def _notice(self) -> str:
        inner = self._leaf("p", self._text(3, 20, NOTICE_WORDS, self.rng.choice([0, 0.5])), False)
        if self.rng.random() < 0.5:
            inner += self._leaf("button", self._text(1, 2, NOTICE_WORDS, 0.7), False)
        return self._box(self.rng.choice(NOTICE_BOXES), inner)

    def _form(self) -> str:
        inner = "".join(
            self._leaf("label", self._text(1, 3, NOTICE_WORDS, 0.3), False) + "<input>" for _ in range(self.rng.randint(1, 4))
        )
        inner += self._leaf(self.rng.choice(["button", "p"]), self._text(1, 6, NOTICE_WORDS, 0.3), False)
        return f'<form action="/f">{inner}</form>'

    def _comments(self) -> str:
        inner = self._leaf("h3", self._text(1, 3, COMMENT_WORDS, 0.5), False)
        for _ in range(self.rng.randint(1, 6)):
            one = self._leaf("p", self._text(3, 40, COMMENT_WORDS, self.rng.choice([0, 0.2])), False)
            box = self.rng.choice(["div.comment", "li.comment", "article.comment", "div.reply", "div.response"])
            inner += self._box(box, self._leaf("div", self._text(1, 3, COMMENT_WORDS, 0.4), False) + one)
        return self._box(self.rng.choice(COMMENT_BOXES), inner)

    def _article(self) -> str:
        rng = self.rng
        title = self._leaf(rng.choice(["h1", "h1", "h2"]), self._text(2, 14), True)
        inner = f"<header>{title}</header>" if rng.random() < 0.15 else title
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            kind = rng.random()
            if kind < 0.72:
                inner += self._leaf("p", self._text(*rng.choice([(1, 4), (5, 40), (20, 120)])), True)
            elif kind < 0.80:
                inner += self._leaf(rng.choice(["h2", "h3"]), self._text(1, 6), True)
            elif kind < 0.85:
                inner += "<ul>" + "".join(self._leaf("li", self._text(1, 20), True) for _ in range(rng.randint(2, 5))) + "</ul>"
            elif kind < 0.88:
                inner += "<blockquote>" + self._leaf("p", self._text(5, 40), True) + "</blockquote>"
            elif kind < 0.90:
                cells = "".join(self._leaf("td", self._text(1, 5), True) for _ in range(rng.randint(2, 4)))
                inner += f"<table><tr>{cells}</tr></table>"
            elif kind < 0.95:
                inner += self._ad()
            else:
                inner += self._notice()
        return self._box(rng.choice(MAIN_BOXES), inner)

    def page(self) -> tuple[str, dict[str, bool]]:
        """Html, and for the text of each block whether it is main."""
        rng = self.rng
        self.labels: list[tuple[str, bool]] = []
        self.disguised = rng.random() < 0.08
        before = [make for make, share in ((self._nav, 0.8), (self._header, 0.5), (self._notice, 0.3), (self._ad, 0.5), (self._form, 0.15)) if rng.random() < share]
        after = [make for make, share in ((self._side, 0.5), (self._ad, 0.2), (self._comments, 0.35), (self._form, 0.2), (self._notice, 0.15)) if rng.random() < share]
        rng.shuffle(before)
        rng.shuffle(after)
        body = "".join(make() for make in before) + self._article() + "".join(make() for make in after)
        body += self._footer() if rng.random() < 0.85 else ""
        page = f"<!DOCTYPE html><html><head><title>{self._text(1, 6)}</title></head><body>{body}</body></html>"
        main = {text for text, is_main in self.labels if is_main}
        other = {text for text, is_main in self.labels if not is_main}
        return page, {text: text in main for text in main ^ other}
