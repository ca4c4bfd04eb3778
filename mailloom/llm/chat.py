"""Conversations as training examples: every assistant turn with all turns before it.

Prefix-target expansion: a conversation with k assistant turns gives k examples,
each with the turns before as context and that reply alone trainable. Built-in
functions only.

Template of a turn: ``<|start|>role`` newline, text, ``<|end|>`` newline. Control
strings inside texts get a backslash after their first character, and backslashes
are doubled, so one pass that drops the first of each escape pair restores the
text. Roles are URL-encoded, which leaves usual ones as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|start|>", "<|end|>"
#: Strings that public templates and vocabularies use as controls.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in sorted(CONTROLS, key=len, reverse=True):
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(turn: Column) -> Column:
    return F.concat(F.lit(START), F.url_encode(turn["role"]), F.lit("\n"))


def render(turn: Column) -> Column:
    """A turn (role, text) in the template."""
    return F.concat(_header(turn), escape(turn["text"]), F.lit(END + "\n"))


def expand(conversations: DataFrame, assistant: str = "assistant", id_column: str = "conv_id") -> DataFrame:
    """Rows ``conv_id``, ``example``, ``formatted``, ``loss_start``, ``loss_end``, ``n_turns``.

    ``conversations`` has one row per turn: id, ``turn``, ``role``, ``text``.
    ``loss_start`` and ``loss_end`` are the code points of ``formatted`` that are
    trainable, the end exclusive: the escaped reply and nothing else. Turns after
    the last reply, or a conversation without one, give one more example with an
    empty mask, so that no turn is lost.

    Turns are sorted by ``turn``, NULL first, ties by role and text. NULL roles and
    texts are empty; repeated rows are repeated turns; rows with a NULL id are
    one conversation. An empty table gives no rows. Other columns are not read.
    A conversation is one row here, so it must fit in a task's memory; the
    examples are cut from it one at a time.
    """
    turns = conversations.select(
        F.col(id_column).alias("conv_id"),
        F.struct(
            F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("said"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), n), lambda at: F.element_at("turns", at)["role"] == assistant)
    ends = F.when(F.element_at("turns", n)["role"] == assistant, replies).otherwise(F.concat(replies, F.array(n)))
    each = whole.withColumn("rendered", F.transform("turns", render)).select(
        "conv_id", "turns", "rendered", F.posexplode(ends).alias("example", "upto")
    )
    last = F.element_at("turns", F.col("upto"))
    context = F.array_join(F.slice("rendered", F.lit(1), F.col("upto") - 1), "")
    formatted = each.select(
        "conv_id",
        "example",
        F.concat(context, F.element_at("rendered", F.col("upto"))).alias("formatted"),
        F.when(last["role"] == assistant, F.length(escape(last["text"]))).otherwise(0).alias("trained"),
        F.col("upto").alias("n_turns"),
    )
    stop = F.length("formatted") - len(END) - 1
    start = F.when(F.col("trained") > 0, stop - F.col("trained")).otherwise(stop)
    return formatted.select(
        "conv_id", "example", "formatted", start.alias("loss_start"), stop.alias("loss_end"), "n_turns"
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of an example, from its text alone."""
    pieces = F.slice(F.split(formatted, r"<\|start\|>", -1), F.lit(2), F.size(F.split(formatted, r"<\|start\|>", -1)) - 1)

    def turn(piece: Column) -> Column:
        head = F.instr(piece, "\n")
        body = F.substring(piece, head + 1, F.length(piece) - head - len(END) - 1)
        return F.struct(
            F.url_decode(F.substring(piece, F.lit(1), head - 1)).alias("role"), unescape(body).alias("text")
        )

    return F.transform(pieces, turn)


def read_target(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(formatted, start + 1, end - start))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, trainable text, length.

    The last example holds all turns; each example adds its own target.
    """
    read = examples.select(
        "conv_id",
        F.struct("example", read_target(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("target")).alias("part"),
        F.length("formatted").cast("long").alias("chars"),
        "example",
        "formatted",
    )
    whole = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"),
        F.sort_array(F.collect_list("part")).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("parts", lambda p: p["target"]), "")
    turns = read_turns(F.col("last"))
    joined = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
