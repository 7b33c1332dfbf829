"""Packing token pieces into sequences by bounded-space online best-fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.session import cut

from .common import partitions_for, slices, text_or_empty
from .pretokens import id_bytes, kept_cache

END_ID = 0
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, key: str = "doc_id", text: str = "text", room: int = 800_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row: its ids and END_ID, cut every `capacity` ids."""
    def cut_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_cache(vocabulary, "word", id_bytes, None, room)
        end, step = id_bytes([END_ID]), 4 * capacity
        for batch in slices(batches, "text", 256):
            out: list[tuple] = []
            for doc, parts in zip(batch.column(0).to_pylist(), pieces(batch.column(1).to_pylist()), strict=True):
                ids = b"".join(parts) + end
                out += ((doc, i, lo // 4, min(step, len(ids) - lo) // 4, zlib.crc32(ids[lo:lo + step])) for i, lo in enumerate(range(0, len(ids), step)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(cut_ids, PIECES)


class OpenBins:
    """At most `most` open bins, found by free space: bit f of an integer is set while some open bin has f ids free.

    A piece goes to the open bin that it fills best. Where none has room and `most` are open, the fullest closes first.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits = self.open = self.made = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, free = self.made, self.capacity
            self.made += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(bin_)
            self.bits |= 1 << rest
            self.open += 1
        return bin_, self.capacity - free


def pack(pieces: DataFrame, capacity: int = 2048, open_bins: int = 4096, bins_each: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to rows that have `length` (1 to capacity); all columns stay.

    The rows, without any text, are dealt out by a hash of the whole row over as many tasks as the total length needs
    (about `bins_each` sequences a task), and each task packs its rows as they come. A task that is repeated sees its rows
    in the same order, so it gives the same numbers. Sequence ids are unique, not dense. Ties, repeated rows and null keys
    are ordinary rows; an empty table gives an empty one.
    """
    written = cut(pieces)
    total = written.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    columns = [c for c in written.columns if c not in ("sequence_id", "offset")]
    mixed = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    tasks = partitions_for(total, capacity * bins_each)
    dealt = written.select(*[f"`{c}`" for c in columns]).repartition(tasks, mixed).sortWithinPartitions(mixed, *[F.col(f"`{c}`") for c in columns])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            sequence, offset = (np.array(x, "int64") for x in zip(*placed, strict=True)) if placed else (np.empty(0, "int64"),) * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence + base), pa.array(offset)], [*batch.schema.names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([f for f in dealt.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return dealt.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, open_bins: int = 4096) -> DataFrame:
    """Every document's pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds END_ID alone. Documents longer than `capacity` ids are cut, no others.
    Columns of `docs` other than doc_id and text are not read. Repeated rows are packed each.
    """
    return pack(token_pieces(docs, vocabulary, capacity), capacity, open_bins)
