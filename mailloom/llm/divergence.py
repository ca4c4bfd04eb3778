"""How the sources of a language differ in their words: distances of sources, and terms a source favours.

Two passes over the texts: the first counts in how many documents of its language
each term occurs, the second how often each source uses the terms that are common
enough. Tasks count a portion of texts at a time, as arrays of word codes, and pass on
sums. From then on numbers stand for terms and sources.

The terms a source favours most come from a skyband. A term whose count in the
source is no higher, whose count in the language is no lower and whose name comes
later ranks behind whatever the totals are; so a part of the terms can drop each
one that ``k`` others of that part dominate, the parts that are left are merged
the same way, and only what remains is ranked by the exact values.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.functions.batches import PORTION, portions
from mailloom.llm.common import cut, words_in_pieces

#: Shares are counted in parts of this.
SCALE = 1_000_000_000
#: Added to every count.
PRIOR = 5
#: Sums a task holds before it passes its sums on, and rows it looks at together.
HELD, TOGETHER = 1 << 20, 1 << 17
#: Points that are compared with the skyband at once.
BLOCK = 512
#: Bytes of a vocabulary that is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_BYTES = 48 << 20
#: Sources of a tile and terms of a block in the comparison of sources.
TILE, TERMS = 128, 4096
#: A share's long division takes three digits at a time.
STEP = 1000

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_in_pieces(text: bytes) -> Iterator[list[bytes]]:
    """Runs of ASCII letters and of everything beyond ASCII, A-Z lower-cased, some of the text at a time."""
    return words_in_pieces(text.translate(_TABLE))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of some texts, and for each the place of its text."""
    firsts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or firsts[0] == firsts[-1]:
        return pa.array([], pa.string()), np.empty(0, np.int64)
    codes = np.frombuffer(data[int(firsts[0]) : int(firsts[-1])].to_pybytes().translate(_TABLE), np.uint8)
    firsts = firsts - firsts[0]
    inside = codes != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = firsts[:-1][firsts[:-1] < len(codes)]
    begins[heads] = inside[heads]
    letters = codes[inside]
    offsets = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    ends = np.searchsorted(np.flatnonzero(begins), firsts)
    return words, np.repeat(np.arange(len(texts)), np.diff(ends))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def _counted(docs: DataFrame, keys: list[str], once: bool) -> DataFrame:
    """Rows ``keys, term, n``: occurrences of a term, or with ``once`` the documents that hold it. Not yet summed."""
    names = [*keys, "term", "n"]
    wanted = docs.select(*keys, F.col("text").cast("binary"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])

    def rows(groups: np.ndarray, terms: pa.Array, numbers: np.ndarray) -> pa.Table:
        return pa.table({"group": groups, "term": terms, "n": numbers})

    def counts(texts: pa.Array, group: np.ndarray) -> pa.Table:
        words, text = _words(texts)
        coded = words.dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        size = max(len(terms), 1)
        if once:
            held, _ = _runs(text * size + code)
            text, code = held // size, held % size
        found, numbers = _runs(group[text] * size + code)
        return rows(found // size, terms.take(pa.array(found % size)), numbers)

    def counts_of_long(text: bytes, group: int) -> pa.Table:
        counter: Counter = Counter()
        pieces = terms_in_pieces(text)
        if once:
            counter.update(set().union(*pieces))
        else:
            for words in pieces:
                counter.update(words)
        terms = pa.array(list(counter), pa.binary()).view(pa.string())
        return rows(np.full(len(terms), group), terms, np.fromiter(counter.values(), np.int64, len(counter)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[tuple, int] = {}
        held: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            sums = pa.concat_tables(held).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum")])
            return sums.select(["group", "term", "n_sum"]).rename_columns(["group", "term", "n"])

        def named(table: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = [pa.array(list(k), f.type).take(table["group"]) for k, f in zip(zip(*places), types)]
            full = pa.table([*columns, table["term"], table["n"]], names)
            yield from full.combine_chunks().to_batches(max_chunksize=TOGETHER)

        for batch in batches:
            types = list(batch.schema)[: len(keys)]
            own = zip(*(batch.column(k).to_pylist() for k in range(len(keys))))
            group = np.array([places.setdefault(k, len(places)) for k in own], np.int64)
            texts = batch.column(len(keys)).cast(pa.binary())
            for start, length in portions(texts):
                part = texts.slice(start, length)
                if length == 1 and len(part[0].as_buffer()) > PORTION:
                    held.append(counts_of_long(part[0].as_py(), group[start]))
                else:
                    held.append(counts(part, group[start : start + length]))
                size += held[-1].num_rows
                if size > HELD:
                    held = [merged()]
                    size = held[0].num_rows
                    if size > HELD // 2:
                        yield from named(held[0])
                        held, size = [], 0
        if held:
            yield from named(merged())

    return wanted.mapInArrow(run, f"{fields}, term string, n long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), by long division in whole numbers.

    Exact for totals below 9 * 10^15.
    """
    below = total + PRIOR * terms
    whole, rest = F.lit(0).cast("long"), count + F.lit(PRIOR).cast("long")
    for _ in range(3):
        rest = rest * STEP
        whole, rest = whole * STEP + _div(rest, below), rest % below
    return whole + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def skyband(count: np.ndarray, other: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the points that fewer than ``k`` points dominate: more or as much ``count``, less or as much ``other``, a lesser ``name``.

    Names are distinct numbers. In order of falling count a point's dominators come
    before it, and if ``k`` dominate it, then ``k`` members of the skyband do.
    """
    order = np.lexsort((name, other, -count))
    kept = np.empty(len(order), np.int64)
    size = 0
    for at in range(0, len(order), BLOCK):
        part = order[at : at + BLOCK]
        held = kept[:size]
        worse = (other[held] <= other[part][:, None]) & (name[held] < name[part][:, None])
        inside = (other[part] <= other[part][:, None]) & (name[part] < name[part][:, None])
        stays = part[worse.sum(1) + np.tril(inside, -1).sum(1) < k]
        kept[size : size + len(stays)] = stays
        size += len(stays)
    return kept[:size]


def _skybands(rows: DataFrame, k: int) -> DataFrame:
    """Of each part of the rows (group, number, count, of_lang) the skybands of its groups; numbers are in the order of the terms."""

    def reduced(held: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(held)
        group, number, count, other = (table.column(c).to_numpy() for c in ("group", "number", "count", "of_lang"))
        order = np.argsort(group, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(group[order])) + 1)
        kept = [places[skyband(count[places], other[places], number[places], k)] for places in groups]
        return table.take(pa.array(np.sort(np.concatenate(kept))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = kept = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            # As many new rows as were left the last time, so that the work stays in proportion.
            if size >= kept + max(TOGETHER, kept):
                held = reduced(held).to_batches()
                size = kept = sum(b.num_rows for b in held)
                if kept > 8 * TOGETHER:
                    yield from held
                    held, size, kept = [], 0, 0
        if held:
            yield from reduced(held).to_batches()

    return rows.mapInArrow(run, rows.schema)


def _distances(cells: DataFrame, groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(group, item, value) for each ordered pair of sources of a language, both as numbers.

    Sources are dealt in tiles, terms in blocks. Two tiles meet once for each block
    of terms, as a matrix; a term that neither tile has counts by the shares that
    absent terms get. Only sums of pairs leave a task.
    """
    marks = groups.join(blocks, "lang").select(
        "lang", "tile", "tiles", "block", "group", F.lit(None).cast("long").alias("number"), F.col("absent").alias("p"), "in_block"
    )
    rows = cells.select("lang", "tile", "tiles", "block", "group", "number", "p", F.lit(0).cast("long").alias("in_block")).unionByName(marks)
    sides = rows.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sides = sides.withColumns({"low": F.least("tile", "mate"), "high": F.greatest("tile", "mate")})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        marked = frame["number"].isna().to_numpy()
        heads = frame[marked].sort_values("group")
        absent = heads["p"].to_numpy(np.int64)
        body = frame[~marked]
        tile, group = heads["tile"].to_numpy(), heads["group"].to_numpy()
        own, term = np.searchsorted(group, body["group"].to_numpy()), pd.factorize(body["number"])[0]
        seen = int(term.max(initial=-1)) + 1
        table = np.repeat(absent[:, None], seen, axis=1)
        table[own, term] = body["p"].to_numpy(np.int64)
        unseen = int(heads["in_block"].iloc[0]) - seen
        low = int(frame["low"].iloc[0])
        first, second, value = ([np.empty(0, np.int64)] for _ in range(3))
        for a in np.flatnonzero(tile == low):
            mates = np.flatnonzero(tile == frame["high"].iloc[0])
            mates = mates[(tile[mates] != low) | (mates > a)]
            sums = np.abs(table[mates] - table[a]).sum(axis=1) + unseen * np.abs(absent[mates] - absent[a])
            first.append(np.full(len(mates), group[a]))
            second.append(group[mates])
            value.append(sums)
        return pd.DataFrame({"a": np.concatenate(first), "b": np.concatenate(second), "value": np.concatenate(value)})

    met = sides.groupBy("lang", "low", "high", "block").applyInPandas(run, "a long, b long, value long")
    sums = met.groupBy("a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("group"), F.col("b").alias("item")), F.struct(F.col("b").alias("group"), F.col("a").alias("item")))
    return sums.select("value", F.inline(both)).select("group", "item", "value")


def audit(
    docs: DataFrame,
    min_documents: int = 30,
    top: int = 50,
    lang_column: str = "lang",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank``.

    Part ``pair`` has for each source every other source of its language and the
    distance of their shares, summed over the kept terms; part ``term`` the
    ``top`` terms whose share in the source is most above that in the language.
    A term is kept for a language if at least ``min_documents`` rows of it hold
    the term. Ranks start at 1 for each source and part, by falling value, then by
    the bytes of the item. All numbers are exact.

    NULL texts, languages and sources count as empty ones; a source without any
    term has the shares of absent terms, and distances are 0 where no term is
    kept. Each row is a document, also if it repeats another. An empty table gives
    no rows. Other columns are not read.
    """
    plain = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_column, "lang"), (source_column, "source"), (text_column, "text")))
    )
    named = _numbered(plain.select("lang", "source").distinct(), "group", "lang", "source")
    held = _counted(plain, ["lang"], once=True).groupBy("lang", "term").agg(F.sum("n").alias("n"))
    # Numbers in the order of the terms stand for them until the end.
    words = _numbered(held.filter(F.col("n") >= min_documents).select("lang", "term"), "number", "lang", "term")

    # Dealt by term, so that a term's count in its language needs no other shuffle.
    grouped = plain.join(_known(named), ["lang", "source"]).select("lang", "group", "text")
    used = _counted(grouped, ["lang", "group"], once=False).join(_known(words), ["lang", "term"]).select("group", "number", "n")
    used = used.repartition("number").groupBy("number", "group").agg(F.sum("n").alias("count"))
    used = cut(used.withColumn("of_lang", F.sum("count").over(Window.partitionBy("number"))))

    totals = used.groupBy("group").agg(F.sum("count").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = named.join(totals, "group", "left").join(words.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left")
    groups = cut(groups.select("lang", "source", "group", zero("n"), zero("terms")))
    of_langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count("*").alias("sources"))
    # A source's tile follows from a hash, so no task has to number all sources of a language.
    tiles = F.ceil(F.col("sources") / F.lit(TILE)).cast("int")
    groups = groups.join(of_langs, "lang").withColumn("tiles", tiles).drop("sources")
    groups = groups.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    absent = F.when(F.col("terms") > 0, share(F.lit(0), F.col("n"), F.greatest("terms", F.lit(1)))).otherwise(0)
    groups = cut(groups.withColumn("absent", absent.cast("long")))
    known = _known(groups)

    of_lang = groups.select("lang", "terms").distinct()
    block = F.pmod("number", F.ceil(F.col("terms") / F.lit(TERMS))).cast("int")
    blocks = words.join(_known(of_lang), "lang").groupBy("lang", block.alias("block")).agg(F.count("*").alias("in_block"))
    none = of_lang.filter("terms = 0").select("lang", F.lit(0).alias("block"), F.lit(0).cast("long").alias("in_block"))
    cells = used.join(known, "group").withColumns({"p": share(F.col("count"), F.col("n"), F.col("terms")), "block": block})
    pairs = _distances(cells, groups, blocks.unionByName(none))
    names = groups.select("lang", "source", "group")
    pairs = pairs.join(_known(names), "group").join(_known(names.select(F.col("group").alias("item"), F.col("source").alias("mate"))), "item")
    pairs = _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("mate").alias("item"), "value"), "item")

    parts = _skybands(used.select("group", "number", "count", "of_lang"), top)
    merged = _skybands(parts.repartition("group"), top)
    p, q = share(F.col("count"), F.col("n"), F.col("terms")), share(F.col("of_lang"), F.col("n_lang"), F.col("terms"))
    above = merged.join(known, "group").select("lang", "source", F.lit("term").alias("part"), "number", (p - q).alias("value"))
    best = _ranked(above.filter("value > 0"), "number").filter(F.col("rank") <= top)
    terms = best.join(words.select("number", F.col("term").alias("item")), "number")
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*out).unionByName(terms.select(*out))


def _numbered(rows: DataFrame, number: str, *order: str) -> DataFrame:
    """Written with numbers that rise in the order of the given columns."""
    # Written first: the bounds of the parts are sought by a pass of its own.
    return cut(cut(rows).orderBy(*order).withColumn(number, F.monotonically_increasing_id()))


def _known(rows: DataFrame) -> DataFrame:
    """Sent to all tasks up to a size, else joined by a shuffle."""
    texts = [F.octet_length(f.name) for f in rows.schema.fields if f.dataType.typeName() == "string"]
    size = rows.agg(F.sum(sum(texts, F.lit(24)))).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def _ranked(rows: DataFrame, tie: str) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), tie)
    return rows.withColumn("rank", F.row_number().over(best))
