"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, n: int) -> Column:
    """crc32 of the key's text, modulo n; a null key falls into fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % F.lit(n), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_rows: int = 512, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of bounded rows and bytes of one text or binary column (one row may exceed it)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= max_rows or size + n > max_bytes):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def with_row_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added; a column of the same name is replaced."""
    names = [n for n in batch.schema.names if n not in columns]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays(arrays + list(columns.values()), names=names + list(columns))


def partitions_for(n_bytes: int, each: int, least: int = 1) -> int:
    """So many partitions that each has about `each` bytes; grows with the data, without an upper bound."""
    return max(least, -(-int(n_bytes) // each))
