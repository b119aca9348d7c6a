"""What the operators share: tables, the folder all executors see, and bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.shared import shared_dir, written

__all__ = ["SLICE_BYTES", "rest", "shared_dir", "slices", "table", "written"]

#: Bytes of text that a Python task expands into arrays at once.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below sf_dir, which may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rest(columns: Sequence[str]) -> Column:
    """Further columns as one struct named `rest`, so their names cannot clash with an operator's own; null if there are none."""
    return (F.struct(*columns) if columns else F.lit(None).cast("struct<none:int>")).alias("rest")


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that `column` holds at most `most` bytes in each part, or one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        start = total = 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and total + size > most:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)
