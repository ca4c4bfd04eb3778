"""Literal rows per text rule, expected values worked out by hand."""

import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from mailloom import rules
from mailloom.functions import lines, text
from mailloom.operators import cleaning


def test_invisible_and_spaces(values):
    items = ["a\rb", "a\r\nb", "zero​width­soft﻿", "keep\ttab\nline", "\u0085x", None]
    assert values(text.drop_invisible, items) == ["ab", "a\nb", "zerowidthsoft", "keep\ttab\nline", "x", None]
    spaced = "".join(rules.UNICODE_SPACES) + "x"
    assert values(text.fold_spaces, [spaced]) == [" " * 16 + "x"]


def test_declarations_and_roots(values):
    items = [
        '  <?XML version="1.0"?>a',
        'b<?xml version="1.0"?>',
        "<!DocType html\n>a<!-- c\n-->d<!--e-->",
        "<html lang=x><BODY>a</body></HTML><bodyguard>",
    ]
    assert values(lambda c: text.drop_root_tags(text.drop_declarations(c)), items) == [
        "a",
        'b<?xml version="1.0"?>',
        "ad",
        "a<bodyguard>",
    ]


def test_namespaces(values):
    assert values(text.drop_namespaces, [' <p xmlns:o="urn:x" xmlns="y">a</p> ']) == ["<p>a</p>"]


def test_garbage(values):
    items = ["a<script>x</script >b", "<header>h</header>", "a<meta charset=x>b<input/>c", "<STYLE a=b>x\ny</Style>z"]
    assert values(text.drop_garbage, items) == ["a<wbr>b", "<header>h</header>", "a<wbr>b<wbr>c", "<wbr>z"]


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("Hello <b>World</b>!", "Hello\nWorld\n!"),
        ("a<br>b", "a\n\nb"),
        ("a<p>b</p>c", "a\n\nb\n\nc"),
        ("a</b></i>c", "a\nc"),
        ("x &amp; y &lt;b&gt; &#8212; &eacute;", "x & y <b> — é"),
        ("<div>keep<div style='display: none'>gone<div>in</div></div>tail</div>", "keep\ntail"),
        ('<p style="OPACITY: 0.8">gone</p>stay', "stay"),
        ('<span aria-hidden="true">x<b>y</b></span>z', "z"),
        ('<span aria-hidden="false">x</span>z', "x\nz"),
        ("a<form>q<form>r</form>s</form>b", "a\nb"),
        ("a<footer>never closed", "a"),
        ("<td><button>x</td>y", "y"),
        ("a<script>if (x < 1) { y = '<p>'; }</script>b", "a\nb"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("mail <a@b.co> me", "mail\nme"),
        ("<img style='height:0' src=x>seen", "seen"),
        ("a" + "<i></i>" * 30000 + "b", "a\nb"),
        ("a<svg/>b<script src=x />c", "a\nb\nc"),
        ("a" + "<form>x" * 3000, "a"),
    ],
)
def test_markup_to_text(spark, html, expected):
    df = spark.createDataFrame([(html,)], "h string")
    out = cleaning.markup_to_text(df, "h", "t").select(text.normalise(text.visible(F.col("t"))))
    assert out.first()[0] == expected


def test_whitespace(values):
    items = ["  a \t b  \n\n\n\n  c d \n", "\n\n \n", "a \n b", "x \n \n \n \ny", "a" + " " * 50000 + "b"]
    assert values(lambda c: text.normalise(text.visible(c)), items) == ["a b\n\nc d", "", "a\nb", "x\n\ny", "a b"]


def test_reply_cut(values):
    items = [
        "hi\n\nOn Mon, Bob wrote:\nold",
        "From: x\nhi",
        "a\nfrom:\nsomeone\nb",
        "a\n--- Original Message ---\nb",
        "a\nBegin forwarded message:\nb",
        "On time, she wrote: nothing",
        "On   x wrote:\nold",
        " untouched ",
    ]
    assert values(text.cut_reply, items) == ["hi", "", "a", "a", "a", "On time, she wrote: nothing", "", " untouched "]


def test_reply_cut_is_the_earliest_of_all_headers(values):
    rng = random.Random(7)
    pieces = [
        "On Tue, A wrote:", "From: a@b", "from:", "Sent: now", "To: you", "SUBJECT: x", "-- original message --",
        "--Forwarded message--", "begin forwarded message:", "hello there", "", "on it", "Subject:", "to: ",
    ]
    texts = ["\n".join(rng.choices(pieces, k=rng.randint(1, 8))).strip() for _ in range(300)]

    def expected(t):
        hits = [m.start() for h in rules.REPLY_HEADERS for m in [re.search(f"(?im)^{h}$", t)] if m]
        return t[: min(hits)].strip() if hits else t

    assert values(text.cut_reply, texts) == [expected(t) for t in texts]


LINE_CASES = [
    ("-----", True),
    ("--", False),
    ("-_=~*#", True),
    ("[image: logo]", True),
    ("[image] x", False),
    ("<html lang=en>", True),
    ("<htmlx>", False),
    ("</html>", True),
    ("</html> x", False),
    ("<title>x", True),
    ("xmlns:v=", True),
    ("http://www.w3.org/tr/xhtml1/dtd", True),
    ("i met him on facebook", True),
    ("copyright 2020", True),
    ("virus-free mail", True),
    ("viruses free", False),
    ("https://x.example.com/a", True),
    ("go to https://x.example.com/a", False),
    ("see https://a.example https://b.example", True),
    ("view online", True),
    ("view online now", False),
    ("", False),
]


def test_noise_lines(values):
    assert values(lines.is_noise, [line for line, _ in LINE_CASES]) == [noise for _, noise in LINE_CASES]


def _dedupe(t):
    """First of every short repeat, then one of each run of equal keys."""
    key = lambda line: re.sub(r"\s+", " ", line.lower())
    rows = [line.strip() for line in t.split("\n")]
    first = {}
    for at, line in enumerate(rows):
        first.setdefault(key(line), at)
    kept = [
        line
        for at, line in enumerate(rows)
        if key(line) == "" or len(key(line)) >= rules.SHORT_LINE or first[key(line)] == at
    ]
    return "\n".join(next(run) for _, run in groupby(kept, key)).strip()


def test_repeated_lines_against_a_sequential_form(values):
    rng = random.Random(11)
    pieces = ["Thanks", "thanks ", "x", "", "", "A" * 119, "A" * 120, "b" * 130, "B" * 130, "mid", "mid  dle", "Mid dle"]
    texts = ["\n".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(500)]
    deduped = lambda c: text.strip(
        lines.join_lines(lines.drop_repeats(lines.with_keys(lines.with_lowered(lines.split_lines(c)))))
    )
    assert values(deduped, texts) == [_dedupe(t) for t in texts]


def test_signatures(values):
    items = ["a\nSent from my phone\nb", "Powered by X", "get the app", "sent from my", "a\n\nDownload the app now\n\nb"]
    assert values(text.drop_signatures, items) == ["a\n\nb", "", "", "sent from my", "a\n\nb"]


def test_whole_cleaning(spark):
    cases = [
        (None, ""),
        ("", ""),
        (" \n\t", ""),
        ("I met him on facebook\nok", "ok"),
        ("Hi\r\nthere\r\n\r\nOn Mon, Bob wrote:\r\nold", "Hi\nthere"),
        ("&lt;html&gt;\nbody\n&lt;title&gt;x", "body"),
        ("Thanks\nx\nTHANKS \nx\n\n\n\ny\nSent from my phone", "Thanks\nx\n\ny"),
        ("<!DOCTYPE html><html><head><title>t</title></head><body><p>Hi</p></body></html>", "Hi"),
    ]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, body_cleaned string")
    rows = sorted(cleaning.clean_bodies(df).collect())
    assert [r["cleaned"] for r in rows] == [want for _, want in cases]


def test_changed_flag(spark):
    rows = [("1", None, None), ("2", "same", None), ("3", "a  b", None), ("4", "", None)]
    df = spark.createDataFrame(rows, "id string, body_cleaned string, body_html string")
    got = {r["id"]: (r["body_cleaned"], r["changed"]) for r in cleaning.clean_table(df).collect()}
    assert got == {"1": ("", True), "2": ("same", False), "3": ("a b", True), "4": ("", False)}


def test_cleaning_moves_no_rows(spark):
    df = spark.createDataFrame([("a",)], "body_cleaned string")
    plan = cleaning.clean_bodies(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_main_content(spark):
    html = (
        "<nav><ul><li><a href=x>Home of the long link text</a></li></ul></nav>"
        "<p>This paragraph is long enough to be content.</p><p>short</p>"
    )
    df = spark.createDataFrame([(html,), ("<p>tiny</p>",)], "h string")
    got = {r["h"]: r["m"] for r in cleaning.pick_main_content(df, "h", "m").collect()}
    assert got[html] == "<p>This paragraph is long enough to be content.</p><p>short</p>"
    assert got["<p>tiny</p>"] == "<p>tiny</p>"


def test_first_address(values):
    items = ["Wolt <info@wolt.com>", "nobody", "a@b.c x_y+z@sub.example.org", "=?UTF-8?B?0JjQvNGP?= <ab@c.de>"]
    assert values(text.first_address, items) == ["info@wolt.com", None, "x_y+z@sub.example.org", "ab@c.de"]


def test_entities_like_the_library(spark, values):
    import html

    items = ["a &amp; b", "&amp;lt; &#65;&#233;&#8364;x", "&lt;p&gt;&nbsp;&copy;", "no & here &", "&auml;&Auml;", ""]
    assert values(text.decode_entities, items) == [html.unescape(x) for x in items]
    assert values(text.plain_entities, items) == [True] * len(items)
    odd = ["&amp", "&ampx;", "&#x41;", "&#128;", "&#0;", "&unknown;", "a&b", "&NotEqualTilde;"]
    assert values(text.plain_entities, odd) == [False] * len(odd)


def test_only_odd_pages_reach_the_tree(spark, monkeypatch):
    """Rows handed to Python: those with hidden or unpaired markup or rare references."""
    rows = ["<p>a &amp; b &copy;</p>", "<p>plain</p>", "x &lt; y", "<p style='display:none'>h</p>t", "<p>&AElig;</p>"]
    df = spark.createDataFrame([(r,) for r in rows], "h string")
    handed = []
    monkeypatch.setattr(cleaning.html_tree, "tree_text", lambda c: handed.append(c) or c)
    plan = cleaning.markup_to_text(df, "h", "out")
    assert len(handed) == 1 and "ArrowEvalPython" not in plan._jdf.queryExecution().executedPlan().toString()
    got = [r["out"] for r in plan.collect()]
    assert [g.strip() for g in got[:3]] == ["a & b ©", "plain", "x < y"]
    assert got[3] == rows[3] and got[4] == rows[4]


def test_markup_is_read_in_portions(monkeypatch):
    """The tree helper holds a bounded number of bytes of markup, whatever the size of a batch."""
    import pyarrow as pa

    from mailloom.functions import batches, html_tree

    held = []
    each = html_tree.prune
    monkeypatch.setattr(html_tree, "prune", lambda s, **k: held.append(len(s)) or each(s, **k))
    pages = [None if k % 5 == 0 else f'<p>{"x" * (3000 * (k % 20))}<i aria-hidden="true">no</i></p>' for k in range(500)]
    out = []
    for part in html_tree.prune_hidden.func(iter([pa.array(pages), pa.array([], pa.string())])):
        assert sum(held) <= batches.PORTION
        held.clear()
        out += part.to_pylist()
    assert out == [p and p.replace('<i aria-hidden="true">no</i>', "<wbr>") for p in pages]


def test_cleaning_lowers_a_text_once(spark):
    emails = spark.range(2).selectExpr("id", "concat('Line ', id) as body_cleaned")
    plan = cleaning.clean_table(emails)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2  # of the text, to tell whether it may hold noise, and of each line


def test_phrases_are_those_of_the_list(values):
    rnd, plain = random.Random(3), re.compile("|".join(rules.FOOTER_PHRASES))
    samples = ["copyright ©", "copyright (c)", "virus-free", "virus free", *filter(str.islower, rules.FOOTER_PHRASES)]
    cut = [s[:i] + s[i + 1 :] for s in samples for i in range(len(s))]
    mixed = ["".join(rnd.sample(samples, 1) + rnd.sample("ubvkyfpgwm un", 4) + [s]) for s in cut]
    items = samples + cut + mixed + [s + s for s in cut]
    assert values(lambda t: t.rlike(lines._PHRASE), items) == [bool(plain.search(s)) for s in items]


def test_normal_lines_have_the_keys_of_all_lines(values):
    items = ["a b\nA  b\n\nA b", "x  y\nX y\n", "one\n\ntwo", ""]
    for normal in (False, True):
        keyed = lambda t: lines.with_keys(lines.with_lowered(lines.split_lines(t)), normal=normal)  # noqa: B023, E731
        keys = values(lambda t: F.array_join(F.transform(keyed(text.normalise(t)), lambda k: k.key), "|"), items)
        assert keys == ["a b|a b||a b", "x y|x y", "one||two", ""]


def test_rules_write_a_text_anew_only_if_it_holds_something_for_them(spark, values):
    for rule in (text.visible, text.single_spaces, text.tidy_lines, text.collapse_blank_lines, text.blank_signatures, text.strip):
        plan = spark.range(1).select(rule(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
        assert "CASE WHEN" in plan, rule
    items = ["a \n \n b", "a\n \nb", " a \n b ", "a\n\n\n\nb\n", "a b\n\nc", " \n", "a　\n\n\n　b", ""]
    assert values(text.tidy_lines, items) == ["a\n\nb", "a\n\nb", "a\nb", "a\n\nb", "a b\n\nc", "", "a\n\nb", ""]


def test_single_spaces_at_line_ends_need_no_pattern(spark, values):
    """The pattern of tidy lines is kept for runs and for separators beyond the plain space."""
    shown = spark.range(1).select(text.tidy_lines(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(replace(" in shown
    rnd = random.Random(5)
    items = ["".join(rnd.choices(["a", " ", "\n", "é", "\u2028", "\u00a0", "\u3000"][: 3 + k % 5], k=rnd.randrange(14))) for k in range(600)]
    tidied = [re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \u2028\u00a0\u3000]*\n[ \u2028\u00a0\u3000]*", "\n", t)).strip() for t in items]
    assert values(text.tidy_lines, items) == tidied


def test_markup_rules_run_only_on_texts_that_hold_their_marks(spark, values):
    """Declarations, root tags, name spaces and garbage tags are told by one cheap pass each."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rules_ = (text.drop_declarations, text.drop_root_tags)
    for rule in rules_:
        assert "CASE WHEN" in plan(spark.range(1).select(rule(F.col("id").cast("string")))), rule
    bits = ["<", ">", "<?xml ?>", "<?XML", "<!DocType x>", "<!-- a\n-->", "<!", "-->", "<HTML", "</body x>", ' XMLNS:a="u"', 'xmlns="', '="', "a", " ", "\n", "é"]
    bits += ["<script>", "</SCRIPT >", "<style/>", "<input ", "<scripted>", "</form", "<div aria-Hidden=true>", "<p STYLE = 'display:none'>", "&amp;", "&"]
    rnd = random.Random(11)
    items = [None, "", *("".join(rnd.choices(bits, k=rnd.randrange(9))) for _ in range(500))]

    def every_rule(t):
        t = F.regexp_replace(t, r"(?isU)\A\s*<\?xml[^>]*\?>", "")
        t = F.regexp_replace(F.regexp_replace(t, r"(?is)<!doctype[^>]*>", ""), r"(?is)<!--.*?-->", "")
        t = F.regexp_replace(t, r"(?isU)</?(html|body)\b[^>]*>", "")
        return text.strip(F.regexp_replace(t, r'(?isU)\sxmlns(:\w+)?="[^"]*"', ""))

    assert values(text.preclean, items) == values(every_rule, items)
    df = spark.createDataFrame([(t,) for t in items], "t string")
    skipped = df.filter(~text.holds_garbage(F.col("t")))
    assert skipped.count() > 50
    odd = text.garbage_is_unpaired(F.col("t")) | (text.drop_garbage(F.col("t")) != F.col("t"))
    assert skipped.filter(odd).count() == 0
