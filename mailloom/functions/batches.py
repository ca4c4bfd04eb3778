"""Arrow batches in portions of bounded size, for helpers that go through texts one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are Python objects at a time.
PORTION = 4 << 20


def portions(texts: pa.Array, most: int = PORTION) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of at most ``most`` bytes together; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop - start
        start = stop
