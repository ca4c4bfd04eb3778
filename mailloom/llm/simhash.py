"""Near duplicates by SimHash fingerprints and a Gray-order hierarchical index.

A fingerprint summarises the word shingles of a text; near copies differ in few
bits. The index keeps fingerprints in the order of their Gray rank, where
neighbours share long bit patterns. Each node of the tree above them holds the
bits that all its members share, as a mask and a pattern. Two nodes are compared
by the bits both masks fix: the differences gathered there are a lower bound for
all pairs below, so whole groups are pruned at once, and where even the open bits
cannot exceed the limit, whole groups are linked at once.

The topmost masks are chosen so that the work spreads over tasks: the 64 bits
are cut in ``limit + j`` blocks, and two fingerprints within the limit agree on
``j`` of them at least. For each choice of ``j`` blocks the fingerprints that
share the pattern under that mask form one tree, with the chosen bits first in
Gray order. The answer is exact for any ``j``; a larger corpus takes a larger
one, so trees stay small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from mailloom.llm.common import cut, words_in_pieces
from mailloom.llm.components import roots
from mailloom.session import staged

BITS = 64
SEED = 42
#: Children of a node of the tree.
FANOUT = 8
#: Fingerprints of one tree; larger ones are cut in shards that meet in pairs.
SHARD = 1 << 15
#: Parts in which the fingerprints of a component are dealt, and ids sent to all tasks at most.
SALTS, BROADCAST_IDS = 32, 1 << 21
#: Node pairs looked at together.
PAIRS = 1 << 19


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of a text: the majority of each bit over the hashes of its shingles."""
    ones, total, carry = np.zeros(BITS, np.int64), 0, []
    words: list[bytes] = []
    for piece in words_in_pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carry + piece
        if len(words) < shingle:
            carry = words
            continue
        carry = words[len(words) - shingle + 1 :]
        joined = b" ".join(words)
        ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist() + [len(joined)]
        starts = [0, *(end + 1 for end in ends[: len(words) - shingle])]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])], "<u8")
        total += len(hashes)
        for at in range(0, len(hashes), 1 << 13):
            bits = np.unpackbits(hashes[at : at + (1 << 13)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    if total == 0:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            codes = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), codes], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, fp long")


def choose_blocks(n: int, limit: int) -> int:
    """How many blocks two linked fingerprints must agree on, by the number of fingerprints."""
    j = 1
    while j < limit and n / 2 ** (BITS * j // (limit + j)) > 64:
        j += 1
    return j


def _layouts(limit: int, agreed: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each choice of blocks: bits of the key, and the (shift, width) fields in order."""
    count = limit + agreed
    edges = [BITS * k // count for k in range(count + 1)]
    fields = [(edges[k], edges[k + 1] - edges[k]) for k in range(count)]
    out = []
    for chosen in combinations(range(count), agreed):
        order = [*chosen, *(k for k in range(count) if k not in chosen)]
        out.append((sum(fields[k][1] for k in chosen), [fields[k] for k in order]))
    return out


def _rearranged(codes: np.ndarray, fields: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros_like(codes)
    for shift, width in fields:
        out = (out << np.uint64(width)) | ((codes >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the sequence of Gray codes; equal leading bits stay together."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def _keyed(prints: DataFrame, limit: int, agreed: int) -> DataFrame:
    """One row per fingerprint and layout: table, bucket, Gray rank."""
    layouts = _layouts(limit, agreed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for table, (bits, fields) in enumerate(layouts):
                rank = gray_rank(_rearranged(codes, fields))
                columns = [
                    pa.array(np.full(len(codes), table, np.int32)),
                    pa.array((rank >> np.uint64(BITS - bits)).view(np.int64)),
                    pa.array(rank.view(np.int64)),
                    batch.column(0),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "bucket", "rank", "fp"])

    return prints.select("fp").mapInArrow(run, "tree int, bucket long, rank long, fp long")


class _Sets:
    """Disjoint sets of rows as a label per row."""

    def __init__(self, n: int):
        self.labels = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite the sets of a[i] and b[i]; keeps one edge for each union that told something new."""
        x, y = self.labels[a], self.labels[b]
        told = np.flatnonzero(x != y)
        if not len(told):
            return
        _, first = np.unique(np.minimum(x, y)[told] * len(self.labels) + np.maximum(x, y)[told], return_index=True)
        parent: dict[int, int] = {}

        def find(k: int) -> int:
            top = k
            while parent.get(top, top) != top:
                top = parent[top]
            while parent.get(k, k) != top:
                parent[k], k = top, parent[k]
            return top

        for i in told[first].tolist():
            p, q = find(int(x[i])), find(int(y[i]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                self.edges.append((int(a[i]), int(b[i])))
        renamed = np.arange(len(self.labels))
        for k in list(parent):
            renamed[k] = find(k)
        self.labels = renamed[self.labels]


class GrayTree:
    """The index over codes that are sorted by group and Gray rank."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        self.starts = [np.arange(len(codes))]
        self.pattern, self.mask = [codes], [np.full(len(codes), ~np.uint64(0))]
        self.first_child: list[np.ndarray] = []
        self.groups = group = groups
        while len(group) > len(np.unique(group)):
            opens = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            place = np.arange(len(group)) - np.repeat(opens, np.diff(np.append(opens, len(group))))
            heads = np.flatnonzero(place % FANOUT == 0)
            every, some = (
                np.bitwise_and.reduceat(self.pattern[-1], heads),
                np.bitwise_or.reduceat(self.pattern[-1], heads),
            )
            mask = np.bitwise_and.reduceat(self.mask[-1], heads) & ~(every ^ some)
            self.pattern.append(every & mask)
            self.mask.append(mask)
            self.first_child.append(np.append(heads, len(group)))
            self.starts.append(self.starts[-1][heads])
            group = group[heads]

    def link(self, limit: int, sets: _Sets) -> None:
        """Unite all codes of a group within ``limit`` bits, top down, a block of node pairs at a time."""
        # Neighbours in Gray order first: dense groups then are mostly one set, and pruned as such.
        codes = self.pattern[0]
        near = (np.bitwise_count(codes[1:] ^ codes[:-1]) <= limit) & (self.groups[1:] == self.groups[:-1])
        sets.join(np.flatnonzero(near), np.flatnonzero(near) + 1)
        top = len(self.pattern) - 1
        nodes = np.arange(len(self.pattern[top]))
        work = [(top, nodes[at : at + PAIRS], nodes[at : at + PAIRS]) for at in range(0, len(nodes), PAIRS)]
        while work:
            level, a, b = work.pop()
            shared = self.mask[level][a] & self.mask[level][b]
            apart = np.bitwise_count((self.pattern[level][a] ^ self.pattern[level][b]) & shared).astype(np.int64)
            near = apart <= limit
            a, b, apart, shared = a[near], b[near], apart[near], shared[near]
            if level == 0:
                sets.join(a, b)
                continue
            whole = apart + BITS - np.bitwise_count(shared) <= limit
            if whole.any():
                self._unite(level, np.concatenate((a[whole], b[whole])), sets)
                sets.join(self.starts[level][a[whole]], self.starts[level][b[whole]])
                a, b = a[~whole], b[~whole]
            if len(a) > 64:
                one, label = self._uniform(level, sets)
                open_ = ~(one[a] & one[b] & (label[a] == label[b]))
                a, b = a[open_], b[open_]
            if len(a):
                work.extend(self._children(level, a, b))

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        heads = self.first_child[level - 1]
        out = []
        per_block = max(1, PAIRS // (FANOUT * FANOUT))
        for at in range(0, len(a), per_block):
            x, y = a[at : at + per_block], b[at : at + per_block]
            grid = np.arange(FANOUT * FANOUT)
            left = heads[x][:, None] + grid // FANOUT
            right = heads[y][:, None] + grid % FANOUT
            real = (left < heads[x + 1][:, None]) & (right < heads[y + 1][:, None]) & ((x != y)[:, None] | (left <= right))
            if level == 1:
                real &= left != right
            out.append((level - 1, left[real], right[real]))
        return out

    def _members(self, level: int) -> np.ndarray:
        return np.append(self.starts[level], len(self.pattern[0]))

    def _uniform(self, level: int, sets: _Sets) -> tuple[np.ndarray, np.ndarray]:
        """Whether all members of a node are in one set already, and which."""
        low = np.minimum.reduceat(sets.labels, self.starts[level])
        return low == np.maximum.reduceat(sets.labels, self.starts[level]), low

    def _unite(self, level: int, nodes: np.ndarray, sets: _Sets) -> None:
        """Unite the members inside each node: all of them lie within the limit."""
        bounds = self._members(level)
        nodes = np.unique(nodes)
        sizes = bounds[nodes + 1] - bounds[nodes]
        head = np.repeat(bounds[nodes], sizes)
        inner = np.arange(len(head)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sets.join(head, head + inner)


def _link_trees(limit: int):
    """Edges between fingerprints that fall in one tree; a partition holds whole trees, sorted."""

    def solve(keys: np.ndarray, codes: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        sets = _Sets(len(codes))
        GrayTree(codes, keys).link(limit, sets)
        pairs = np.array(sets.edges, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(prints[pairs[:, 0]]), pa.array(prints[pairs[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            now = columns if rest is None else [np.concatenate(x) for x in zip(rest, columns)]
            turn = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0) | (np.diff(now[2]) != 0))
            if not len(turn):
                rest = now
                continue
            done = turn[-1] + 1
            yield solve(*_grouped([x[:done] for x in now]))
            rest = [x[done:] for x in now]
        if rest is not None and len(rest[0]):
            yield solve(*_grouped(rest))

    def _grouped(columns):
        tree, bucket, cell, rank, prints = columns
        turn = (np.diff(tree) != 0) | (np.diff(bucket) != 0) | (np.diff(cell) != 0)
        rank = rank.view(np.uint64)
        return np.concatenate(([0], np.cumsum(turn))), rank ^ (rank >> np.uint64(1)), prints

    return run


def linked_fingerprints(prints: DataFrame, limit: int = 4, agreed: int | None = None) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within ``limit`` bits.

    A spanning set per tree, not all pairs: as many edges as fingerprints per
    layout at most. A tree of more than ``SHARD`` fingerprints is cut in shards
    by a hash, and each pair of shards is a tree of its own, so that no task
    holds more than two shards of it. The list of such trees is written first, so
    Spark knows its size and broadcasts it only if it is small.
    """
    if agreed is None:
        agreed = choose_blocks(prints.count(), limit)
    keyed = _keyed(prints, limit, agreed)
    large = (
        keyed.groupBy("tree", "bucket")
        .count()
        .filter(F.col("count") > SHARD)
        .select("tree", "bucket", F.ceil(F.col("count") / SHARD).cast("int").alias("shards"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shards"), F.lit(1)) - 1))
    with staged(large, "large-trees") as sized:
        cells = (
            keyed.join(sized, ["tree", "bucket"], "left")
            .withColumn("own", F.coalesce(own, F.lit(0)))
            .withColumn("other", other)
            .withColumn("cell", F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other"))
            .select("tree", "bucket", "cell", "rank", "fp")
        )
        dealt = cells.repartition("tree", "bucket", "cell").sortWithinPartitions("tree", "bucket", "cell", "rank")
        return cut(dealt.mapInArrow(_link_trees(limit), "a long, b long"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 4,
    limit: int = 4,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the least id that can be reached over links of at most
    ``limit`` differing bits, the document's own included. Exact copies of a
    fingerprint are folded to one row before the search, so a group of copies
    costs one row per map task whatever its size.

    NULL, empty and blank texts have fingerprint zero and are linked like any
    other; a text of fewer words than a shingle is one shingle; texts of any
    length are read whole, in pieces. Repeated rows give repeated results. A NULL
    id is never the least one; a component of NULL ids only has a NULL
    ``component_id``. An empty table gives no rows. Other columns are not read.
    """
    marked = cut(with_fingerprints(docs, shingle, id_column, text_column))
    prints = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    heads = cut(roots(linked_fingerprints(prints, limit)).withColumnRenamed("node", "fp"))
    # Only linked fingerprints have a root other than their own. A large component's are
    # brought together by their least id, then dealt out in salted parts.
    linked = prints.join(heads, "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    by_root = linked.join(salted, ["root", "salt"]).select("fp", "component_id")
    alone = prints.join(heads, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    by_print = by_root.unionByName(alone)
    return marked.join(by_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, limit: int = 4, id_column: str = "doc_id") -> DataFrame:
    """The documents whose id is the least of their component, with all their columns.

    Rows without an id cannot be told apart and stay. Rows that repeat an id are
    one document: they stay if any of them is in a component that the id names.
    """
    found = near_duplicates(docs, shingle, limit, id_column)
    same = F.col("doc_id") == F.col("component_id")
    gone = found.groupBy("doc_id").agg(F.max(F.when(same, 1).otherwise(0)).alias("stays")).filter("stays = 0")
    # Known before the join: a short list goes to the documents, whose texts then stay where they are.
    ids = cut(gone.select(F.col("doc_id").alias("__gone")))
    small = isinstance(ids.schema["__gone"].dataType, NumericType) and ids.count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if small else ids
    return docs.join(ids, docs[id_column] == ids["__gone"], "left_anti")
