"""Functions over texts that work through Arrow batches bit by bit, so a worker holds little more than the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

#: Bytes of text that are taken out of a batch at once.
SLICE = 1 << 20


def sliced(texts: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """An array of texts in order, in pieces of about ``most`` bytes; a longer text is a piece of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def by_text(f: Callable[[str | None], object], kind: pa.DataType, returns: str) -> Callable[[Column], Column]:
    """An Arrow function of one column of texts: ``f`` of each, as ``kind`` (``returns`` to Spark)."""

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in sliced(batch):
                yield pa.array([f(t) for t in part.to_pylist()], kind)

    return run
