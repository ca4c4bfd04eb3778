"""DuckDB expressions of the text rules, for the comparison SQL only."""

from __future__ import annotations

from mailloom import rules

NL = "\n"


def _sub(expr: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({expr}, '{pattern.replace(chr(39), chr(39) * 2)}', '{replacement}', 'g')"


def strip(expr: str) -> str:
    return f"trim({expr}, '{rules.WHITESPACE}')"


def drop_invisible(expr: str) -> str:
    return _sub(expr, r"[\x00-\x08\x0b-\x1f\x7f-\x9f\p{Cf}\p{Co}]")


def fold_spaces(expr: str) -> str:
    return f"translate({expr}, '{rules.UNICODE_SPACES}', '{' ' * 16}')"


def visible(expr: str) -> str:
    return fold_spaces(drop_invisible(expr))


def drop_declarations(expr: str) -> str:
    expr = _sub(expr, r"(?is)\A\s*<\?xml[^>]*\?>")
    expr = _sub(expr, r"(?is)<!doctype[^>]*>")
    return _sub(expr, r"(?is)<!--.*?-->")


def drop_root_tags(expr: str) -> str:
    return _sub(expr, r"(?is)</?(html|body)\b[^>]*>")


def drop_namespaces(expr: str) -> str:
    return strip(_sub(expr, r'(?is)\sxmlns(:\w+)?="[^"]*"'))


def preclean(expr: str) -> str:
    return drop_namespaces(drop_root_tags(drop_declarations(expr)))


def drop_garbage(expr: str) -> str:
    for tag in rules.GARBAGE_TAGS:
        if tag not in ("meta", "embed", "input"):
            expr = _sub(expr, rf"(?is)<{tag}(?:[\s/][^>]*)?>.*?</{tag}[^>]*>", "<wbr>")
    return _sub(expr, r"(?is)<(?:meta|embed|input)(?:[\s/][^>]*)?>", "<wbr>")


def drop_hidden(expr: str) -> str:
    """The hidden elements the fixture pages hold; they do not nest in their own kind."""
    expr = _sub(expr, r'(?is)<p style="display: none">.*?</p>', "<wbr>")
    expr = _sub(expr, r'(?is)<span aria-hidden="true">.*?</span>', "<wbr>")
    return _sub(expr, r'(?is)<div style="Font-Size:0;color:red">.*?</div>', "<wbr>")


def break_tags(expr: str) -> str:
    blocks = "|".join(rules.BLOCK_TAGS)
    expr = _sub(expr, rf"(?i)<(?:/?(?:{blocks})|br)(?:[\s/][^>]*)?>", NL * 3)
    return _sub(expr, r"(?:<(?:/?[a-zA-Z]|[!?])[^>]*>)+", NL)


def entities(expr: str) -> str:
    """The entities the given pages hold, the ampersand last."""
    for name, value in (("copy", "©"), ("middot", "·"), ("quot", '"')):
        expr = f"replace({expr}, '&{name};', '{value}')"
    return _sub(expr, "&amp;?", "&")


def collapse(expr: str) -> str:
    return strip(_sub(expr, r"\n{3,}", NL * 2))


def normalise(expr: str) -> str:
    """The rule's steps one by one on visible text."""
    expr = _sub(expr, r"[ \t]+\n", NL)
    expr = _sub(expr, r"\n[ \t]+", NL)
    expr = _sub(expr, r"[ \t]+", " ")
    return collapse(expr)


_REPLY = "|".join(h.replace(".+", r"[^\n]+") for h in rules.REPLY_HEADERS)


def cut_reply(expr: str) -> str:
    return (
        f"case when regexp_matches({expr}, '(?im)^(?:{_REPLY})$') "
        f"then {strip(_sub(expr, rf'(?ims)^(?:{_REPLY})$.*'))} else {expr} end"
    )


def is_separator(line: str) -> str:
    return f"regexp_full_match({line}, '{rules.SEPARATOR_LINE}')"


def is_image(line: str) -> str:
    return f"regexp_full_match({line}, '{rules.IMAGE_LINE}')"


def is_markup(line: str) -> str:
    return f"regexp_matches({line}, '^(?:{'|'.join(rules.MARKUP_LINES)})')"


def is_footer(line: str) -> str:
    exact = ", ".join(f"'{v}'" for v in rules.FOOTER_LINES)
    return (
        f"(regexp_matches({line}, '{'|'.join(rules.FOOTER_PHRASES)}') "
        f"or regexp_full_match({line}, '{rules.WEB_ADDRESS}') "
        f"or len(regexp_extract_all({line}, '{rules.WEB_ADDRESS}')) >= 2 or {line} in ({exact}))"
    )


def is_noise(line: str) -> str:
    return f"({is_separator(line)} or {is_image(line)} or {is_markup(line)} or {is_footer(line)})"


def blank_signatures(expr: str) -> str:
    lines = "|".join(s.replace(".+", r"[^\n]+").replace(".*", r"[^\n]*") for s in rules.SIGNATURE_LINES)
    return collapse(_sub(expr, rf"(?im)^(?:{lines})$"))


def uuid5(name: str) -> str:
    return f"""(select concat(substr(h,1,8),'-',substr(h,9,4),'-5',substr(h,14,3),'-',
 substr('89ab', 1+((instr('0123456789abcdef', substr(h,17,1))-1) % 4)::int, 1),substr(h,18,3),'-',substr(h,21,12))
 from (select sha1(unhex('{rules.UUID_URL_NAMESPACE}') || encode({name})) as h))"""


def line_rows(source: str, key: str, text: str) -> str:
    """(key, pos, line, low) rows of the stripped lines of a text column."""
    return f"""select {key}, pos, line, lower(line) as low from (
 select {key}, generate_subscripts(string_split({text}, chr(10)), 1) as pos,
  {strip(f"unnest(string_split({text}, chr(10)))")} as line from {source})"""


def dedupe_rows(source: str, key: str) -> str:
    """Texts of (key, pos, line, low) rows without short repeats and equal neighbours."""
    return f"""select {key}, {strip("string_agg(line, chr(10) order by pos)")} as txt from (
 select *, lag(k) over (partition by {key} order by pos) as pk from (
  select *, regexp_replace(low, '\\s+', ' ', 'g') as k,
   row_number() over (partition by {key}, regexp_replace(low, '\\s+', ' ', 'g') order by pos) as rn from ({source}))
 where k = '' or length(k) >= {rules.SHORT_LINE} or rn = 1)
where pk is null or k <> pk group by {key}"""


def clean(source: str, key: str, text: str, *, markup: bool) -> str:
    """The whole cleaning of a text column: (key, txt) rows, also for texts that end empty."""
    t = preclean(preclean(visible(f"coalesce({text}, '')")))
    if markup:
        t = entities(break_tags(drop_hidden(drop_garbage(t))))
    else:
        t = break_tags(drop_garbage(t))
    return f"""
with t0 as materialized (select {key}, {normalise(visible(t))} as t from {source}),
t1 as materialized (select {key}, {cut_reply('t')} as t from t0),
rows_ as (select * from ({line_rows('t1', key, 't')}) where not {is_noise('low')}),
deduped as ({dedupe_rows('select * from rows_', key)})
select t0.{key}, {blank_signatures("coalesce(d.txt, '')")} as txt from t0 left join deduped d on d.{key} is not distinct from t0.{key}"""


def words(body: str) -> str:
    return (
        f"case when {body} is null or {body} = '' then regexp_extract_all('{rules.EMPTY_BODY}', '.') "
        f"else list_filter(regexp_split_to_array({body}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '') end"
    )


def chunks(source: str, body: str, extra: str = "") -> str:
    """external_message_id, chunk_index, chunk_text and extra columns."""
    return f"""
select external_message_id, {extra} k::int as chunk_index,
 coalesce(array_to_string(case when k = 0 then w[1:120] else w[120*k-29:120*k+90] end, ' '), '') as chunk_text
from (select *, unnest(generate_series(0, len(w)//120)) as k from (select *, {words(body)} as w from {source}))"""
