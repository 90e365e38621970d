"""Integer vectors for the vector operators: scaled, floored and checked columns, and batches of them as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components are held within this bound, so that squared distances and sums of them fit a long.
LIMIT = 1 << 27


def usable(vector: str) -> Column:
    """The vector is not null, and no component of it is null, infinite or not a number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & finite


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, x as double, held within LIMIT."""
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    held = lambda x: F.least(F.greatest(whole(x), F.lit(-LIMIT)), F.lit(LIMIT))
    return F.transform(vector, lambda x: held(x).cast("int"))


def rows_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a list column without nulls: for each length, the places of its rows and their (rows, length) matrix."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    starts = column.offsets.to_numpy()
    lengths, values = np.diff(starts), column.values.to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, values[starts[at][:, None] + np.arange(n)]


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and whether each is there; a null id is 0."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), there
