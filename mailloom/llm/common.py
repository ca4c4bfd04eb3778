"""What several operators share: cut lineage, word lists of whole texts, digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.session import shared_root

#: A-Z and a-z; operators that fold case fold these letters only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and go on from there.

    The files survive lost executors; Spark's cleaner removes them once the
    frame is out of use, where the cluster asks for it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def words_in_pieces(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words between ASCII white space, about ``size`` bytes of text at a time."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
        yield text[start:end].split()
        start = end


def sha256_hex(text: Column) -> Column:
    """Lowercase hex digest of the UTF-8 bytes of a string column."""
    return F.sha2(text.cast("binary"), 256)


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """As ``withColumns``, but each column is computed once per row.

    Spark merges neighbouring projections, and a column that is used inside a
    lambda would then be computed again for each element. A generator of one row
    keeps them apart.
    """
    others = [c for c in df.columns if c not in columns]
    one = F.struct(*(value.alias(name) for name, value in columns.items()))
    return df.select(*others, F.inline(F.array(one)))


#: Type of the places found in a text; ends are exclusive, both count code points.
PLACES = "array<struct<start:int,end:int,value:string>>"


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """Add, for each name, the leftmost non-overlapping matches of a pattern in ``text``.

    A pattern comes with the group that becomes ``value``. SQL gives the matched
    strings but not their places; these follow from the lengths of matches and
    of the gaps between them, which are cut out only where there is a match. No
    pattern may match the empty string.
    """
    steps = {f"__steps_{name}": _steps(F.col(text), p, group) for name, (p, group) in patterns.items()}
    sums = {f"__sums_{name}": _running_sums(F.col(f"__steps_{name}"), lambda s: s["gap"] + s["hit"]) for name in patterns}
    placed = {name: _placed(F.col(f"__steps_{name}"), F.col(f"__sums_{name}")) for name in patterns}
    return settled(settled(settled(df, steps), sums), placed).drop(*steps, *sums)


def _steps(text: Column, pattern: str, group: int) -> Column:
    """Length of the gap before each match, of the match, and its value."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = lambda strings: F.transform(strings, lambda s: F.length(s))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    zipped = F.arrays_zip(sizes(gaps).alias("gap"), sizes(found).alias("hit"), values.alias("value"))
    return F.when(F.size(found) == 0, F.array().cast("array<struct<gap:int,hit:int,value:string>>")).otherwise(zipped)


def _running_sums(steps: Column, size: Callable[[Column], Column]) -> Column:
    """The sum of the sizes before each step; ``steps`` must be a column of its own.

    An array that grows inside a fold is copied at each step. So the steps are folded
    in stretches of about the root of their number, and then the sums of the stretches.
    """
    none = F.array().cast("array<int>")

    def sums(numbers: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        grown = lambda state, n: F.struct((state["at"] + n).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
        return F.aggregate(numbers, start, grown)

    width = F.ceil(F.sqrt(F.size(steps))).cast("int")
    firsts = F.sequence(F.lit(1), F.size(steps), width)
    stretches = F.transform(firsts, lambda first: sums(F.transform(F.slice(steps, first, width), size)))

    def joined(parts: Column) -> Column:
        before = sums(F.transform(parts, lambda p: p["at"]))["out"]
        return F.flatten(F.zip_with(parts, before, lambda p, add: F.transform(p["out"], lambda n: n + add)))

    # A fold of one step binds the stretches, so that they are computed once.
    bound = F.aggregate(F.array(stretches), none, lambda _, parts: joined(parts))
    return F.when(F.size(steps) == 0, none).otherwise(bound)


def _placed(steps: Column, sums: Column) -> Column:
    def one(step: Column, before: Column) -> Column:
        start = before + step["gap"]
        return F.struct(start.alias("start"), (start + step["hit"]).alias("end"), step["value"].alias("value"))

    return F.zip_with(steps, sums, one)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def without_overlaps(df: DataFrame, places: dict[str, list[str]]) -> DataFrame:
    """Each named column of places without those that overlap a place of the listed columns.

    The places that are in the way are sorted and cut in stretches of about the root
    of their number; a place looks only into the stretches that it reaches.
    """
    bounds = lambda part: F.struct(
        F.array_min(F.transform(part, lambda p: p["start"])).alias("start"),
        F.array_max(F.transform(part, lambda p: p["end"])).alias("end"),
        part.alias("part"),
    )
    sorted_, cut_, kept = {}, {}, {}
    for name, others in places.items():
        ends = lambda c: F.transform(c, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
        taken, parts = F.col(f"__taken_{name}"), F.col(f"__parts_{name}")
        needed = F.size(name) > 0
        none = F.array().cast("array<struct<start:int,end:int>>")
        sorted_[f"__taken_{name}"] = F.when(needed, F.sort_array(F.concat(*map(ends, others)))).otherwise(none)
        width = F.ceil(F.sqrt(F.size(taken))).cast("int")
        # Sorted, so a stretch is bound by its own places.
        stretches = lambda taken, width: F.transform(
            F.sequence(F.lit(1), F.size(taken), width), lambda first: bounds(F.slice(taken, first, width))
        )
        kind = "array<struct<start:int,end:int,part:array<struct<start:int,end:int>>>>"
        cut_[f"__parts_{name}"] = F.when(F.size(taken) > 0, stretches(taken, width)).otherwise(F.array().cast(kind))
        kept[name] = _outside(F.col(name), parts)
    return settled(settled(settled(df, sorted_), cut_), kept).drop(*sorted_, *cut_)


def _outside(places: Column, parts: Column) -> Column:
    hit = lambda p: F.exists(parts, lambda s: overlaps(p, s) & F.exists(s["part"], lambda o: overlaps(p, o)))
    return F.filter(places, lambda p: ~hit(p))


def spans_text(kinds: dict[str, Column]) -> Column:
    """``kind:start:end`` by start, then kind in the given order, joined by commas."""
    def ranked(rank: int, kind: str, places: Column) -> Column:
        fields = lambda p: (p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end"), F.lit(kind).alias("kind"))
        return F.transform(places, lambda p: F.struct(*fields(p)))

    every = F.concat(*(ranked(rank, kind, places) for rank, (kind, places) in enumerate(kinds.items())))
    texts = F.transform(F.sort_array(every), lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"]))
    return F.array_join(texts, ",")


def sampled(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """About ``rows`` rows, picked by a hash of the key columns; all of a smaller table.

    Only for fitting models: the bound is a parameter of the operator that fits.
    """
    least = hash_limit(rows, df.count())
    return df if least is None else df.filter(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *key), 1) < least)


def hash_limit(rows: int, total: int) -> int | None:
    """Below this limit lie the upper 63 bits of the hashes of about ``rows`` of ``total`` rows; None for all.

    Whole numbers, so the limit is above zero for any table that a long can count.
    """
    return None if rows >= total else max(1, (rows << 63) // total)
