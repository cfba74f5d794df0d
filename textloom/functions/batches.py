"""Arrow batches in slices of bounded size, so that what a Python step holds doesn't grow with its batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that a Python step turns into Python objects at a time.
STEP = 1 << 19
#: Bytes of an Arrow batch on its way to or from Python; the default is 64 MB for each task on either side.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_BYTES at most; a lower bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    value = spark.conf.get(name).rstrip("b")
    if not value.isdigit() or int(value) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, column: str, limit: int = STEP) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about `limit` bytes of a column of texts or of lists of texts; a longer row comes alone."""
    values = batch.column(column)
    if not len(values):
        return
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        size = np.zeros(len(values), np.int64)
        each = pc.fill_null(pc.binary_length(pc.list_flatten(values)), 0)
        np.add.at(size, np.asarray(pc.list_parent_indices(values)), np.asarray(each).astype(np.int64))
    else:
        size = np.asarray(pc.fill_null(pc.binary_length(values), 0)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    start = 0
    while start < len(values):
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(values))
        yield batch.slice(start, stop - start)
        start = stop
