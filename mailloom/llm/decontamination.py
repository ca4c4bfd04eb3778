"""Benchmark passages in training texts, found with suffix arrays of the texts.

Each task builds suffix arrays over the words of its documents, a shard of some
megabytes at a time. Every suffix of every test item that begins a window is
looked up by binary search, word after word, in all shards; this gives all
places of the window and the longest verbatim match. No rows are moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that are part of words once A-Z are lowered: digits, a-z, and all of
#: every character beyond ASCII.
IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Text bytes of one suffix array; a longer document is a shard alone.
SHARD_BYTES = 2 << 20
#: Test text of one pass over the documents.
BLOCK_BYTES = 16 << 20
#: An odd number; word hashes are polynomials in it.
BASE = 0x9E3779B97F4A7C15

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many words each text has.

    A hash is a polynomial of a word's bytes, taken from running sums over the
    whole buffer, so no word is handled alone.
    """
    data = np.frombuffer(b"\0".join(texts).lower(), np.uint8)
    inside = np.concatenate(([False], IS_WORD[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), BASE), out=sums[1:])
    back = _powers(len(data) + 1, pow(BASE, -1, 1 << 64))
    hashes = (sums[ends] - sums[starts]) * back[starts]
    hashes ^= (ends - starts).astype(np.uint64) << np.uint64(48)
    hashes[hashes == 0] = 1
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, text_ends))))
    return hashes, counts


class TestItems:
    """Words of the items of one block, and the suffixes that begin a window."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        self.ids, self.window = ids, window
        words, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
        heads = np.cumsum(counts) - counts
        windows = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
        self.item = np.repeat(np.arange(len(counts)), windows)
        self.start = np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows) + heads[self.item]
        self.need = np.minimum(window, counts)[self.item]
        self.room = (heads + counts)[self.item] - self.start
        self.words = words
        self.longest = int(counts.max(initial=0))


class SuffixArray:
    """Suffixes of a sequence of words in the order of their first ``depth`` words."""

    def __init__(self, words: np.ndarray, depth: int):
        self.alphabet, letters = np.unique(words, return_inverse=True)
        self.letters = letters.astype(np.int64)
        n = len(words)
        self.order = np.argsort(self.letters, kind="stable")
        first = np.searchsorted(self.letters[self.order], np.arange(len(self.alphabet)))
        rank = first[self.letters]
        tied, known = self.order, 1
        while known < depth:
            size = np.bincount(rank[tied], minlength=n)
            tied = tied[size[rank[tied]] > 1]
            if not len(tied):
                break
            after = np.where(tied + known < n, rank[np.minimum(tied + known, n - 1)] + 1, 0)
            by = np.argsort(rank[tied] * (n + 1) + after, kind="stable")
            tied, after = tied[by], after[by]
            group = rank[tied]
            opens = np.concatenate(([True], group[1:] != group[:-1]))
            breaks = opens | np.concatenate(([True], after[1:] != after[:-1]))
            at = np.arange(len(tied))
            place = at - np.maximum.accumulate(np.where(opens, at, 0))
            self.order[group + place] = tied
            rank[tied] = group + np.maximum.accumulate(np.where(breaks, at, 0)) - np.maximum.accumulate(np.where(opens, at, 0))
            known *= 2

    def _letter(self, at: np.ndarray) -> np.ndarray:
        return np.where(at < len(self.letters), self.letters[np.minimum(at, len(self.letters) - 1)], -1)

    def _narrow(self, lo: np.ndarray, hi: np.ndarray, depth: int, letter: np.ndarray) -> np.ndarray:
        """First place in [lo, hi) whose word at ``depth`` is not before ``letter``."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            middle = (lo + hi) // 2
            before = self._letter(self.order[np.minimum(middle, len(self.order) - 1)] + depth) < letter
            lo = np.where(open_ & before, middle + 1, lo)
            hi = np.where(open_ & ~before, middle, hi)
        return lo

    def search(self, items: TestItems) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(depth, suffix, lo, hi) for each depth that some test suffixes reach, until none goes on."""
        out = []
        suffix = np.arange(len(items.start))
        lo, hi = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(self.order))
        depth = 0
        while len(suffix):
            wanted = items.words[items.start[suffix] + depth]
            letter = np.searchsorted(self.alphabet, wanted)
            here = self.alphabet[np.minimum(letter, len(self.alphabet) - 1)] == wanted
            suffix, lo, hi, letter = suffix[here], lo[here], hi[here], letter[here]
            lo = self._narrow(lo, hi, depth, letter)
            hi = self._narrow(lo, hi, depth, letter + 1)
            some = lo < hi
            suffix, lo, hi = suffix[some], lo[some], hi[some]
            depth += 1
            out.append((depth, suffix, lo, hi))
            more = items.room[suffix] > depth
            suffix, lo, hi = suffix[more], lo[more], hi[more]
        return out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range each is from."""
    sizes = hi - lo
    own = np.repeat(np.arange(len(lo)), sizes)
    return np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[own], own


def scan_shard(texts: list[bytes], items: TestItems, known: list[list]) -> dict[str, list]:
    """The result columns of some documents; ``known`` has the spans of earlier passes."""
    hashes, counts = word_hashes(texts)
    # A zero after each text keeps windows from running into the next one.
    owner = np.repeat(np.arange(len(texts)), counts)
    line = np.zeros(len(hashes) + len(texts), np.uint64)
    line[np.arange(len(hashes)) + owner] = hashes
    first = np.cumsum(counts + 1) - counts - 1
    document = np.repeat(np.arange(len(texts)), counts + 1)
    steps = np.zeros(len(line) + 1, np.int64)
    longest = np.zeros(len(texts), np.int64)
    pairs: list[np.ndarray] = []
    if len(items.start):
        array = SuffixArray(line, items.longest)
        for depth, suffix, lo, hi in array.search(items):
            far = depth >= items.need[suffix]
            if far.any():
                at, _ = _ranges(lo[far], hi[far])
                np.maximum.at(longest, document[array.order[at]], depth)
            exact = depth == items.need[suffix]
            if exact.any():
                at, own = _ranges(lo[exact], hi[exact])
                place = array.order[at]
                steps += np.bincount(place, minlength=len(steps)) - np.bincount(place + depth, minlength=len(steps))
                pairs.append(np.unique(document[place] * len(items.ids) + items.item[suffix[exact]][own]))
    for k, spans in enumerate(known):
        for span in spans or []:
            steps[first[k] + span["start"]] += 1
            steps[first[k] + span["end"]] -= 1
    hit = np.concatenate(([False], np.cumsum(steps[:-1]) > 0, [False]))
    edges = np.flatnonzero(hit[1:] != hit[:-1])
    begins, ends = edges[::2], edges[1::2]
    spans: list[list] = [[] for _ in texts]
    for k, begin, end in zip(document[begins].tolist(), begins.tolist(), ends.tolist()):
        spans[k].append({"start": begin - int(first[k]), "end": end - int(first[k])})
    names: list[set[str]] = [set() for _ in texts]
    for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else []:
        names[pair // len(items.ids)].add(items.ids[pair % len(items.ids)])
    return {
        "n_words": counts.tolist(),
        "n_hit": [sum(s["end"] - s["start"] for s in one) for one in spans],
        "items": [sorted(one) for one in names],
        "longest": longest.tolist(),
        "spans": spans,
    }


def _shards(texts: list[bytes]) -> Iterator[slice]:
    start, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > SHARD_BYTES:
            yield slice(start, k)
            start, size = k, 0
        size += len(text) + 1
    if start < len(texts):
        yield slice(start, len(texts))


def _blocks(benchmark: DataFrame, window: int, item_column: str, text_column: str) -> Iterator[TestItems]:
    """The test items, at most about ``BLOCK_BYTES`` of text at a time."""
    rows = benchmark.select(F.col(item_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(blocks):
        got = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
        yield TestItems([r["id"] or "" for r in got], [r["text"] for r in got], window)


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    name: str = "contamination",
) -> DataFrame:
    """``docs`` with a struct ``name`` (``RESULT``).

    A window is ``window`` consecutive words of an item, or a shorter item as a
    whole. ``n_hit`` counts the document's words inside any occurrence of a
    window, ``items`` are the ids of the items with one, sorted as strings,
    ``longest`` is the longest verbatim match in words, ``spans`` are the hit
    words as ranges. Whole texts are searched.

    Only the test items are sent to the tasks, in blocks of bounded size, each
    of which is one pass; passes follow each other in the same job.

    NULL and empty texts have no words; items without words have no windows; a
    NULL item id reads as the empty string. Repeated rows give repeated results.
    Without documents there are no rows, without items no hits. Other columns
    pass through, an earlier one of that name is replaced.
    """
    source = docs.drop(name).withColumn(name, F.lit(None).cast(RESULT))
    context = docs.sparkSession.sparkContext
    for block in _blocks(benchmark, window, item_column, item_text_column):
        shared = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(name)
                texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(text_column)]
                before = batch.column(at).to_pylist()
                rows: list[dict] = []
                for part in _shards(texts):
                    old = before[part]
                    found = scan_shard(texts[part], shared.value, [(o or {}).get("spans") for o in old])
                    for k, o in enumerate(old):
                        row = {name: values[k] for name, values in found.items()}
                        if o:
                            row["items"] = sorted({*row["items"], *o["items"]})
                            row["longest"] = max(row["longest"], o["longest"])
                        rows.append(row)
                columns = batch.columns
                columns[at] = pa.array(rows, type=batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        source = source.mapInArrow(run, source.schema)
    return source


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, **columns: str) -> DataFrame:
    """The documents without any hit word, with all their columns."""
    marked = mark_contamination(docs, benchmark, window, name="__contamination", **columns)
    return marked.filter(F.col("__contamination.n_hit") == 0).drop("__contamination")
