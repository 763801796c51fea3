"""Column functions in Python that work through an Arrow batch in slices of bounded text, whatever the batch size of the session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Bytes of text of a slice; a single longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def bounds(text: pa.Array, most: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each."""
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    out, a = [], 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] - size[a] + most, side="right")))
        out.append((a, b))
        a = b
    return out


def sliced(f: Callable[..., pa.Array], kind: str) -> Callable[..., F.Column]:
    """f of Arrow arrays, the first of which is the text, as a column function: Python objects and results exist for a slice at a time."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for a, b in bounds(columns[0]):
                yield f(*[c.slice(a, b - a) for c in columns])

    return F.arrow_udf(run, kind)
