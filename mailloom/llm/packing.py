"""Documents packed into token sequences by bin completion.

Texts become pieces of at most the sequence length; full pieces are sequences of
their own. The others are dealt by a hash into groups of some thousand sequences,
which are packed independently: a group first gets a best-fit solution, and if
that is above the bound of the group's tokens, a branch-and-bound search completes
one sequence after the other around the largest piece left.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import cut
from mailloom.llm.word_tokens import tokenizer_at

CAPACITY = 4096
#: The id that ends a document.
END_ID = 1
#: Tokens that are packed together.
GROUP_TOKENS = 1 << 22
#: Steps for each piece in the search of one group; the best solution so far counts.
STEPS = 40
#: Pairs and sizes that are tried before all fillings of a sequence are gone through.
QUICK, QUICK_TRIPLES = 3, 64
#: Fillings that each further one is compared with.
COMPARED = 16


def pieces_of(stretches: Iterator[np.ndarray], capacity: int) -> Iterator[bytes]:
    """The ids of a document and the end id, in pieces that are full but for the last."""
    rest = b""
    for ids in chain(stretches, [np.array([END_ID], "<u4")]):
        rest += ids.tobytes()
        full = len(rest) // (4 * capacity) * 4 * capacity
        for at in range(0, full, 4 * capacity):
            yield rest[at : at + 4 * capacity]
        rest = rest[full:]
    if rest:
        yield rest


def tokenized_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer_path: str | None = None,
    with_ids: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(tokenizer_path)
        for batch in batches:
            rows, ids = [], []
            for k, stretches in enumerate(tokenizer.encode(batch.column(1))):
                for piece, data in enumerate(pieces_of(stretches, capacity)):
                    rows.append((k, piece, piece * capacity, len(data) // 4, zlib.crc32(data)))
                    if with_ids:
                        ids.append(np.frombuffer(data, "<u4").astype(np.int64))
            own, *columns = zip(*rows) if rows else [()] * 5
            arrays = [batch.column(0).take(pa.array(own, pa.int64()))]
            arrays += [pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 3))]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    return narrow.mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Largest first, each into the fullest bin that takes it."""
    room: list[int] = []
    bins_with: dict[int, list[list[int]]] = {}
    bins: list[list[int]] = []
    for size in sorted(sizes, reverse=True):
        at = bisect_left(room, size)
        if at < len(room):
            left = room[at]
            one = bins_with[left].pop()
            if not bins_with[left]:
                del room[at]
        else:
            left, one = capacity, []
            bins.append(one)
        one.append(size)
        left -= size
        if left:
            if not bins_with.setdefault(left, []):
                insort(room, left)
            bins_with[left].append(one)
    return bins


def _fits_inside(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    """Whether the pieces of ``small`` can be dealt into rooms of the sizes of ``large``."""
    room = list(large)
    for size in sorted(small, reverse=True):
        at = min((k for k in range(len(room)) if room[k] >= size), key=lambda k: room[k], default=None)
        if at is None:
            return False
        room[at] -= size
    return True


class BinCompletion:
    """Branch and bound over the fillings of one bin after the other.

    The sizes left are also the bits of an integer and of its mirror image, so the
    largest size that fits and the pairs with a given sum are one operation each.
    """

    def __init__(self, sizes: list[int], capacity: int):
        self.capacity, self.total, self.pieces = capacity, sum(sizes), len(sizes)
        self.counts = np.bincount(sizes, minlength=capacity + 1).tolist()
        self.left = sum(1 << k for k, n in enumerate(self.counts) if n)
        self.mirror = sum(1 << (capacity - k) for k, n in enumerate(self.counts) if n)
        self.bound = -(-self.total // capacity)
        self.best = best_fit(sizes, capacity)
        self.steps = 0

    def _take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            self.left ^= 1 << size
            self.mirror ^= 1 << (self.capacity - size)

    def _give(self, size: int) -> None:
        if not self.counts[size]:
            self.left ^= 1 << size
            self.mirror ^= 1 << (self.capacity - size)
        self.counts[size] += 1

    def _pairs(self, room: int) -> Iterator[tuple[int, int]]:
        """Two sizes left that fill ``room``, the most unequal first."""
        both = (self.left & (self.mirror >> (self.capacity - room))) >> -(-room // 2) if room > 0 else 0
        while both:
            a = both.bit_length() - 1
            both ^= 1 << a
            a += -(-room // 2)
            if 2 * a > room or self.counts[a] > 1:
                yield a, room - a

    def _quick(self, room: int) -> list[tuple[int, ...]]:
        """Some fillings without waste of few and large pieces, to be tried first."""
        start: list[int] = []
        while (most := (self.left & ((2 << room) - 1)).bit_length() - 1) > 0 and room > 3 * most:
            self._take(most)
            start.append(most)
            room -= most
        found = [()] if not room else [(room,)] if self.counts[room] else []
        found += islice(self._pairs(room), QUICK)
        sizes = self.left & ((1 << room) - 1)
        for _ in range(QUICK_TRIPLES):
            if found or not sizes:
                break
            a = sizes.bit_length() - 1
            sizes ^= 1 << a
            self._take(a)
            found += [(a, *pair) for pair in islice(self._pairs(room - a), 1)]
            self._give(a)
            self.steps -= 1
        for size in start:
            self._give(size)
        self.steps -= len(start) + 1
        return [tuple(sorted((*start, *f), reverse=True)) for f in found]

    def _sums(self, room: int) -> tuple[list[int], list[int]]:
        """Sizes left up to ``room``, and for each number of them the sums they make, as bits."""
        sizes = [k for k in range(1, room + 1) if self.counts[k]]
        sums, within = [1], (2 << room) - 1
        for size in sizes:
            made, copies, batch = sums[-1], min(self.counts[size], room // size), 1
            while copies > 0:
                made |= made << (min(batch, copies) * size)
                copies, batch = copies - batch, 2 * batch
            sums.append(made & within)
        self.steps -= len(sizes) // 4 + 1
        return sizes, sums

    def _all(self, room: int, slack: int) -> Iterator[tuple[int, ...]]:
        """Every set of sizes left that leaves at most ``slack`` of ``room`` and no room for one more, least waste first.

        Only sums that smaller sizes can make are followed, so no branch is in vain.
        What the search takes between two fillings it gives back before the next;
        the sums are made again then, as a thousand open bins cannot keep theirs.
        """
        sizes, sums = self._sums(room)
        goal = room
        while (goal := (sums[-1] & ((2 << goal) - 1)).bit_length() - 1) >= max(0, room - slack):
            # Size number and copies of it; the next number is below the one before.
            path: list[tuple[int, int]] = []
            rest, at, copies = goal, len(sizes), None
            while True:
                self.steps -= 1
                if self.steps < 0:
                    return
                if rest == 0 and copies is None:
                    used = dict(path)
                    spare = next((s for k, s in enumerate(sizes, 1) if self.counts[s] > used.get(k, 0)), room + 1)
                    if spare > room - goal:
                        yield tuple(sizes[k - 1] for k, n in path for _ in range(n))
                        sizes, sums = self._sums(room)
                elif at and sums[at] >> rest & 1:
                    size = sizes[at - 1]
                    if copies is None:
                        copies = min(self.counts[size], rest // size)
                    while copies and not sums[at - 1] >> (rest - copies * size) & 1:
                        copies -= 1
                    if copies:
                        path.append((at, copies))
                        rest, at, copies = rest - copies * size, at - 1, None
                    else:
                        at, copies = at - 1, None
                    continue
                if not path:
                    break
                at, copies = path.pop()
                rest += copies * sizes[at - 1]
                copies -= 1
                if not copies:
                    at, copies = at - 1, None
            goal -= 1
            if goal < 0:
                break

    def _fillings(self, room: int, slack: int) -> Iterator[tuple[int, ...]]:
        """Fillings that are not inside one before: quick ones, then all in order of waste."""
        before: list[tuple[int, ...]] = []
        for one in chain(self._quick(room), self._all(room, slack)):
            if any(_fits_inside(one, b) for b in before[:COMPARED]):
                continue
            before.append(one)
            yield one

    def solve(self, steps: int | None = None) -> list[list[int]]:
        """Fewest bins found; surely fewest if the bound is met or the search ended before ``steps``.

        A step places a piece or looks at a size. Without a number there are ``STEPS``
        for each piece, which is several times what one whole solution takes.
        """
        self.steps = STEPS * self.pieces if steps is None else steps
        waste, bins, open_bins = 0, [], []
        while len(self.best) > self.bound and self.steps > 0:
            slack = (len(self.best) - 1) * self.capacity - self.total - waste
            if not self.left:
                if slack >= 0:
                    self.best = [list(b) for b in bins]
            elif slack >= 0:
                top = self.left.bit_length() - 1
                self._take(top)
                open_bins.append((top, self._fillings(self.capacity - top, slack)))
                bins.append(None)
            # Replace the last filling by its next, or drop its bin if there is none.
            while open_bins:
                top, fillings = open_bins[-1]
                if bins[-1] is not None:
                    for size in bins[-1][1:]:
                        self._give(size)
                    waste -= self.capacity - sum(bins[-1])
                chosen = next(fillings, None)
                if chosen is not None and self.steps > 0:
                    for size in chosen:
                        self._take(size)
                    bins[-1] = (top, *chosen)
                    waste += self.capacity - sum(bins[-1])
                    break
                self._give(top)
                open_bins.pop()
                bins.pop()
            if not open_bins:
                break
        return self.best


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its bin and its offset there."""
    bins = BinCompletion(sizes.tolist(), capacity).solve()
    waiting: dict[int, list[int]] = {}
    for k in np.argsort(sizes, kind="stable")[::-1].tolist():
        waiting.setdefault(int(sizes[k]), []).append(k)
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for number, one in enumerate(bins):
        at = 0
        for size in one:
            k = waiting[size].pop()
            bin_of[k], offset[k] = number, at
            at += size
    return bin_of, offset


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer_path: str | None = None,
    with_ids: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``ids`` follow if asked for. Only documents longer than ``capacity`` tokens
    are cut. Sequence numbers are unique, not consecutive; full pieces have
    negative ones. Offsets in a sequence have no gaps.

    Groups hold about ``GROUP_TOKENS`` tokens, so each packs on its own with at
    most a part of one sequence lost; rows are dealt by a hash of their number in
    the written pieces, never by a value that many rows may share.

    NULL and empty texts have the end id only. Repeated rows are packed each on
    its own; a NULL id passes through. An empty table gives no rows. Other columns
    are not read.
    """
    pieces = cut(tokenized_pieces(docs, capacity, tokenizer_path, with_ids, id_column, text_column))
    numbered = pieces.withColumn("__row", F.monotonically_increasing_id())
    part = F.col("length") < capacity
    tokens = pieces.filter(part).agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(tokens / GROUP_TOKENS))
    names = pieces.columns

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bin_of, offset = pack_sizes(group["length"].to_numpy(), capacity)
        sequence = group["__group"].to_numpy(np.int64) * (1 << 32) + bin_of
        return group[names].assign(sequence_id=sequence, offset=offset)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    dealt = numbered.filter(part).withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    packed = dealt.groupBy("__group").applyInPandas(run, f"{fields}, sequence_id long, offset long")
    full = numbered.filter(~part).select(*names, (-F.col("__row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
