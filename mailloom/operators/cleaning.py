"""Body cleaning: markup and free text to plain, deduplicated text.

The whole chain is a map over rows: no shuffle, usable on batch and streams.
Intermediate texts are columns that are read more than once, which keeps the
optimiser from copying their expressions into each use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions import html_tree, lines, text
from mailloom.functions.text import bind

_P = "__clean_"

# Largest share of linked text in content; what a block of links or of a page frame costs beside its length.
CONTENT_LINK_SHARE = 0.5
FRAME_COST = 25
_FRAME = r"(?i)^<(?:nav|header|footer)[\s/>]"

_CONTENT_SPLIT = (
    r"(?i)(?=<(?:p|div|section|article|li|tr|table|ul|ol|nav|header|footer|main|blockquote|h[1-6])(?:[\s/][^>]*)?>)"
)


def main_content(html: Column) -> Column:
    """The run of blocks that reads most like content; the input if none does.

    Markup is cut at block-level opening tags. A block is worth the length of its
    text; where most of it is link text or it opens a page frame, it costs that and
    a bit. The run with the largest sum wins, the first and longest of equal ones.
    All blocks of the run stay, short ones and opening tags included.
    """
    blocks = F.transform(
        F.split(html, _CONTENT_SPLIT),
        lambda b: F.struct(
            b.alias("block"),
            F.length(text.strip(F.regexp_replace(b, r"(?s)<[^>]*>", ""))).alias("chars"),
            F.length(
                F.regexp_replace(
                    F.array_join(F.regexp_extract_all(b, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), ""),
                    r"(?s)<[^>]*>",
                    "",
                )
            ).alias("linked"),
        ),
    )

    def worth(b: Column) -> Column:
        frame = (b.linked > b.chars * F.lit(CONTENT_LINK_SHARE)) | b.block.rlike(_FRAME)
        return F.when(frame, -b.chars - FRAME_COST).otherwise(b.chars)

    number = lambda value: F.lit(value).cast("int").alias
    before = F.struct(
        number(0)("at"), number(0)("sum"), number(0)("low"), number(1)("low_at"), number(0)("best"), number(1)("first"), number(0)("last")
    )

    def step(s: Column, b: Column) -> Column:
        # ``low`` is the least sum before a block, so the best run that ends here starts behind it.
        total = s.sum + worth(b)
        gain = total - s.low
        return F.struct(
            (s["at"] + 1).alias("at"),
            total.alias("sum"),
            F.least(s.low, total).alias("low"),
            F.when(total < s.low, s["at"] + 2).otherwise(s.low_at).alias("low_at"),
            F.greatest(s.best, gain).alias("best"),
            F.when(gain > s.best, s.low_at).otherwise(s["first"]).alias("first"),
            F.when(gain > s.best, s["at"] + 1).otherwise(s["last"]).alias("last"),
        )

    def region(all_blocks: Column) -> Column:
        run = F.aggregate(all_blocks, before, step)
        kept = bind(run, lambda r: F.slice(all_blocks, r["first"], r["last"] - r["first"] + 1))
        return F.array_join(F.transform(kept, lambda b: b.block), "")

    return F.coalesce(F.nullif(bind(blocks, region), F.lit("")), html)


def pick_main_content(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, main_content(F.col(column)))


def markup_to_text(
    df: DataFrame, column: str, out: str, *, has_tags: Column | None = None, has_entities: Column | None = None
) -> DataFrame:
    """Drop garbage and hidden elements, break at tags, decode entities.

    Patterns serve well-formed rows inside the JVM. Only rows with rare entities,
    hidden elements or unpaired garbage tags are handed to the tree helper.
    Texts that hold no garbage tag, told in one pass, skip the rules for them.
    """
    html, flat, tree, early, plain, garbage = F.col(column), *(f"{_P}{n}" for n in ("flat", "tree", "early", "plain", "garbage"))
    has_tags = html.contains("<") & html.contains(">") if has_tags is None else has_tags
    has_entities = html.contains("&") & html.rlike("&[#A-Za-z]") if has_entities is None else has_entities
    by_pattern = has_tags & ~F.col(early)
    needs_tree = F.col(early) | (F.col(garbage) & text.holds_garbage(F.col(flat)))
    unpaired = F.col(garbage) & text.garbage_is_unpaired(html)
    return (
        df.withColumn(garbage, has_tags & text.holds_garbage(html))
        .withColumn(early, (has_entities & ~text.plain_entities(html)) | (has_tags & (text.hides_elements(html) | unpaired)))
        .withColumn(flat, F.when(by_pattern & F.col(garbage), text.drop_garbage(html)).otherwise(html))
        .withColumn(tree, F.when(needs_tree, html))
        .withColumn(plain, F.when(by_pattern, text.break_tags(F.col(flat))).otherwise(F.col(flat)))
        .withColumn(
            out,
            F.coalesce(
                html_tree.tree_text(F.col(tree)),
                F.when(has_entities, text.decode_entities(F.col(plain))).otherwise(F.col(plain)),
            ),
        )
        .drop(flat, tree, early, plain, garbage)
    )


def clean_lines(body: Column, noisy: Column) -> Column:
    """Noise lines dropped and repeated lines removed, within one visible, normalised text.

    Texts that hold no noise, or no line twice, skip the work on each line;
    without repeats there are only blank lines to collapse.
    """

    def unrepeated(keyed: Column) -> Column:
        plain = text.collapse_blank_lines(F.array_join(F.transform(keyed, lambda k: k.line), "\n"))
        return F.when(lines.has_repeats(keyed), text.strip(lines.join_lines(lines.drop_repeats(keyed)))).otherwise(plain)

    pairs = lines.with_lowered(lines.split_lines(body), stripped=True)
    kept = bind(pairs, lambda p: F.when(noisy, lines.drop_noise(p)).otherwise(p))
    return bind(lines.with_keys(kept, normal=True), unrepeated)


def clean_bodies(
    df: DataFrame,
    column: str = "body_cleaned",
    out: str = "cleaned",
    *,
    only_main_content: bool = False,
) -> DataFrame:
    """Add ``out``: the cleaned form of ``column`` (NULL and blank give '')."""
    c = F.col
    names = [f"{_P}{n}" for n in ("seen", "bare", "raw", "full", "tags", "entities", "markup", "own", "noisy")]
    seen, bare, raw, full, tags, entities, markup, own, noisy = names
    df = (
        df.withColumn(seen, text.visible(F.coalesce(c(column), F.lit(""))))
        .withColumn(tags, c(seen).contains("<") & c(seen).contains(">"))
        .withColumn(entities, c(seen).contains("&") & c(seen).rlike("&[#A-Za-z]"))
        .withColumn(markup, c(tags) | c(seen).contains('="'))
    )
    # Markup is removed twice, since the first pass may uncover more.
    if only_main_content:
        df = df.withColumn(bare, F.when(c(markup), text.preclean(c(seen))).otherwise(text.strip(c(seen))))
        df = df.withColumn(bare, F.when(c(tags), main_content(c(bare))).otherwise(c(bare)))
        df = df.withColumn(bare, F.when(c(markup), text.preclean(c(bare))).otherwise(c(bare)))
    else:
        twice = text.preclean(text.preclean(c(seen)))
        df = df.withColumn(bare, F.when(c(markup), twice).otherwise(c(seen)))
    df = (
        markup_to_text(df, bare, raw, has_tags=c(tags), has_entities=c(entities))
        # Decoded entities may bring invisible characters again.
        .withColumn(full, F.when(c(entities), text.visible(c(raw))).otherwise(c(raw)))
        .withColumn(own, text.cut_reply(text.normalise(c(full))))
        .withColumn(noisy, lines.may_hold_noise(F.lower(c(own))))
        .withColumn(out, text.blank_signatures(clean_lines(c(own), c(noisy))))
    )
    return df.drop(*names)


def clean_table(
    emails: DataFrame, *, fall_back_to_html: bool = False, only_main_content: bool = False
) -> DataFrame:
    """The table with ``body_cleaned`` rewritten and ``changed`` telling where it differs.

    A NULL body becomes '' and counts as changed. With ``fall_back_to_html`` a
    message that has only an HTML part is cleaned from that part.
    """
    source = F.coalesce(F.col("body_cleaned"), F.col("body_html")) if fall_back_to_html else F.col("body_cleaned")
    cleaned = clean_bodies(
        emails.withColumn(f"{_P}source", source), f"{_P}source", f"{_P}out", only_main_content=only_main_content
    )
    return (
        cleaned.withColumn("changed", ~F.col(f"{_P}out").eqNullSafe(F.col("body_cleaned")))
        .withColumn("body_cleaned", F.col(f"{_P}out"))
        .drop(f"{_P}source", f"{_P}out")
    )
