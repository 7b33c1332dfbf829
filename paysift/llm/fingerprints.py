"""Order MinHash fingerprints of documents, and their likeness to an edited text and to the next document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paysift.session import cut

from .common import partitions_for, text_or_empty

K, SKETCHES, BLOCK = 6, 64, 4096
_ODD = np.random.default_rng(20240601).integers(0, 1 << 32, SKETCHES, dtype="uint32") | np.uint32(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalising step of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(text: str, k: int = K) -> np.ndarray:
    """A 64-bit hash of every run of k code points, in text order; a shorter text is one run."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("uint64")
    k = min(k, len(codes))
    n = len(codes) - k + 1 if k else 0
    out = np.zeros(n, "uint64")
    for i in range(k):
        out = out * _BASE + codes[i:i + n] + np.uint64(1)
    return _mix(out + np.uint64(k))


def elements(base: np.ndarray) -> np.ndarray:
    """A 32-bit hash of every k-mer with its occurrence number in the text."""
    order = np.argsort(base, kind="stable")
    ordered = base[order]
    first = np.arange(len(base))
    first[1:][ordered[1:] == ordered[:-1]] = 0
    del ordered
    number = np.empty(len(base), "uint64")
    number[order] = (np.arange(len(base)) - np.maximum.accumulate(first)).astype("uint64")
    return (_mix(base + number * _BASE) >> np.uint64(32)).astype("uint32")


def smallest(element: np.ndarray, length: int, sketches: int) -> np.ndarray:
    """(sketches x length) places of each sketch's elements of smallest hash, from blocks of elements with running minima."""
    odd, top = _ODD[:sketches, None], np.uint32(0xFFFFFFFF)
    best, places = np.full((sketches, length), 1 << 32), np.zeros((sketches, length), "int64")
    room = np.empty((sketches, min(BLOCK, len(element))), "uint32")
    for lo in range(0, len(element), BLOCK):
        part = element[lo:lo + BLOCK]
        hashed = np.multiply(part[None, :], odd, out=room[:, :len(part)])
        row, values, found = np.arange(sketches), [best], [places]
        for _ in range(min(length, len(part))):
            pick = hashed.argmin(1)
            values.append(hashed[row, pick][:, None].astype("int64"))
            found.append(pick[:, None] + lo)
            hashed[row, pick] = top
        values, found = np.concatenate(values, 1), np.concatenate(found, 1)
        least = np.argsort(values, axis=1, kind="stable")[:, :length]
        best, places = np.take_along_axis(values, least, 1), np.take_along_axis(found, least, 1)
    return places


def sketch(text: str, k: int = K, length: int = 2, sketches: int = SKETCHES) -> np.ndarray:
    """`sketches` 32-bit hashes of the whole text.

    A place's element is the k-mer with its occurrence number. For each sketch the `length` elements of smallest hash are
    chosen among those of all places, put back into text order, and the tuple of their k-mers is hashed.
    """
    base = kmers(text, k)
    if not len(base):
        return np.zeros(sketches, "uint32")
    total = np.zeros(sketches, "uint64")
    for place in np.sort(smallest(elements(base), min(length, len(base)), sketches), axis=1).T:
        total = total * _BASE + base[place] + np.uint64(1)
    return (_mix(total) >> np.uint64(32)).astype("uint32")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next document."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part int, edge string, text string"


def packed(a: np.ndarray) -> bytes:
    return a.astype(">u4").tobytes()


def _row(doc, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    changed = sketch(edited)
    return (doc, len(text), hashlib.sha256(edited.encode()).digest(), packed(own), packed(changed), likeness(own, changed), likeness(own, other), None, None, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES.types, strict=True)], schema=_TYPES)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition; its first and last document are also passed on as edges."""
    from pyspark import TaskContext

    part, last, out, size = TaskContext.get().partitionId(), None, [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = sketch(text)
            if last is None:
                out.append((doc, None, None, None, None, None, None, part, "head", text))
                size += len(text)
            else:
                out.append(_row(*last, text, own))
            last = (doc, text, own)
            if len(out) >= 1000 or size > 1 << 22:
                yield _batch(out)
                out, size = [], 0
    if last is not None:
        out.append((last[0], None, None, None, None, None, None, part, "tail", last[1]))
        yield _batch(out)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each partition's last document, whose next one is another partition's first."""
    for batch in batches:
        rows = [_row(doc, text, sketch(text), following, sketch(following)) for doc, text, following in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)]
        if rows:
            yield _batch(rows)


def fingerprint_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", part_bytes: int = 24 << 20) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and their likeness: COLUMNS, in ascending order of the key.

    The next document is the one that follows by (key, text), null keys first; the first follows the last, and a single
    row follows itself. The texts are range-partitioned once by the key; neighbours meet inside a partition, and only the
    first and last text of each partition are exchanged. A null text counts as empty; equal texts have equal
    fingerprints; a text without characters has the fingerprint of zeros; an empty table gives an empty one.
    """
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), text_or_empty(text).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("bigint")), F.lit(0))).first()[0]
    ordered = source.repartitionByRange(partitions_for(size, part_bytes), "doc_id").sortWithinPartitions("doc_id", "text")
    found = cut(ordered.mapInArrow(_neighbours, _SCHEMA))
    heads = found.where("edge = 'head'").select("part", F.col("text").alias("following"))
    # one small row for each partition
    chain = found.where("edge = 'head'").select("part").withColumn("to", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))))
    tails = found.where("edge = 'tail'").join(chain, "part").select("doc_id", "text", "to")
    joined = tails.join(heads, tails["to"] == heads["part"]).select("doc_id", "text", "following")
    rows = found.where("edge is null").select(*COLUMNS).unionByName(joined.mapInArrow(_across, _SCHEMA).select(*COLUMNS))
    return rows.select(*[F.lower(F.hex(c)).alias(c) if c in ("edited_sha256", "fingerprint", "edited_fingerprint") else F.col(c) for c in COLUMNS])
