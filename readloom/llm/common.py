"""What the operators share: tables, bounded batches, slices of long texts and scratch tables.

Scratch tables live under ``spark.checkpoint.dir``, which all executors share, so
a lost executor never takes an intermediate result with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from readloom.operators.storage import scratch_path, stored

__all__ = ["private", "scratch_path", "sliced", "small_batches", "stored", "table"]

#: Rows and bytes of text that a Python worker works on at once.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], text: str, rows: int | None = None, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and ``most`` bytes of ``text``; a longer text is a batch by itself.

    What a worker holds at once does not depend on the session's Arrow settings, which stay as they are.
    """
    rows, most = rows or BATCH_ROWS, most or BATCH_BYTES
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, n = 0, batch.num_rows
        while at < n:
            before = int(ends[at - 1]) if at else 0
            upto = min(n, at + rows, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(at, upto - at)
            at = upto
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of at most so many bytes, or one row, for what is run inside; for rows that are large by themselves."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def private(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
