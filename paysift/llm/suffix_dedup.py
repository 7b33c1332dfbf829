"""Removal of byte strings that occur elsewhere in the corpus, found by suffix arrays over grouped contexts.

Two equal strings of `length` bytes have the same minimiser: the k-gram of smallest hash in them. So all windows of a text
are dealt out by their minimiser, in runs of neighbouring windows that share one, and equal windows meet in one group. A
group's contexts are cut into content-defined chunks and a suffix array over the chunks tells which windows can have a
partner; those are compared by a 64-bit hash of all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.session import cut

from .common import slices, text_or_empty

GRAM = 64
#: Words that are padded to WORD bytes make every passage of more than 50 words 51 * WORD + 50 bytes or longer. A 400-byte
#: string loses at most the part of a short word at its start (its padding may differ) and has PASSAGE bytes left.
WORD = 7
PASSAGE = 400 - (WORD - 1)
_PAD = 0xFF  # in no UTF-8 text
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Chunks end where a hash of four bytes says so (about every CHUNK bytes), and at every byte after GAP bytes without end.
CHUNK, GAP = 24, 96
_R = np.random.default_rng(424242)
_BYTE = _R.integers(0, 1 << 63, 256, dtype="uint64")
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` bytes, by doubling."""
    base = _BYTE[data]
    out, have, power, done = base, 1, _P, None
    rest, left = width, None
    # binary expansion of the width: `left` is the hash of the bytes already joined on the left
    while True:
        if rest & 1:
            if left is None:
                left, done = out, have
            else:
                n = len(left) - have
                left = left[:n] * np.uint64(power) + out[done:done + n]
                done += have
        rest >>= 1
        if not rest:
            return left[:max(0, len(data) - width + 1)]
        out = out[:-have] * np.uint64(power) + out[have:] if len(out) > have else out[:0]
        have, power = 2 * have, power * power & _MASK


def _origins(data: np.ndarray) -> np.ndarray:
    """For each byte of the padded text the place of its own byte, or of the word's last byte before padding."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    times = np.ones(len(data), "int64")
    times[ends - 1] += np.maximum(0, WORD - (ends - starts))
    return np.repeat(np.arange(len(data)), times)


def padded(text: bytes) -> bytes:
    """The text with every word (run without ASCII white space) of fewer than WORD bytes filled up to WORD; nothing is lost."""
    data = np.frombuffer(text, "uint8")
    at = _origins(data)
    out = data[at]
    out[1:][at[1:] == at[:-1]] = _PAD
    return out.tobytes()


def unpadded(text: bytes, lo: list[int], hi: list[int]) -> tuple[list[int], list[int]]:
    """Spans of the padded text as spans of the text."""
    at = _origins(np.frombuffer(text, "uint8"))
    a, b = np.array(lo, "int64"), np.array(hi, "int64")
    filled = (a > 0) & (at[a] == at[np.maximum(a - 1, 0)])
    return (at[a] + filled).tolist(), (at[b - 1] + 1).tolist()


def _plain(text: bytes) -> bytes:
    return text


def window_runs(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, first window, windows) of the runs of windows with one minimiser, covering every window once."""
    hashes, starts, sizes = [], [], []
    windows = len(data) - length + 1
    piece = 1 << 19
    for lo in range(0, max(0, windows), piece):
        part = data[lo:lo + min(piece, windows - lo) + length - 1]
        g = _mix(_hashes(part, gram))
        w = length - gram + 1
        n = len(g) - w + 1
        named = (g >> np.uint64(20) << np.uint64(20)) | np.arange(len(g), dtype="uint64")
        rows = np.concatenate([named, np.full(-len(g) % w, np.uint64(_MASK))]).reshape(-1, w)
        ahead = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()[:n]
        at = (np.minimum(ahead, np.minimum.accumulate(rows, 1).ravel()[w - 1:w - 1 + n]) & np.uint64((1 << 20) - 1)).astype("int64")
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        hashes.append(g[at[first]])
        starts.append(first + lo)
        sizes.append(np.diff(np.append(first, n)))
    if not hashes:
        return np.empty(0, "uint64"), np.empty(0, "int64"), np.empty(0, "int64")
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(sizes)


def suffix_order(s: list[int]) -> list[int]:
    """The suffix array of s, whose last value is the only smallest one, in two linear phases.

    Phase 1 refines groups of suffixes until those of a group share their Lyndon prefix: groups are taken in descending
    order, each suffix finds the previous suffix of a lower group (everything between has been taken), and those found are
    moved, by how often they were found, to new groups just above their old one. Phase 2 goes through the order from its
    smallest suffix: a suffix is its Lyndon prefix followed by the next smaller suffix, so each suffix that comes out lets
    the suffixes that end at it, along the previous-smaller pointers, take the next free place of their group.
    """
    n = len(s)
    buckets: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        buckets.setdefault(c, []).append(i)
    names = sorted(buckets)
    members = [buckets[c] for c in names]
    size = [len(m) for m in members]
    below = list(range(-1, len(names) - 1))
    above = list(range(1, len(names) + 1))
    top = len(names) - 1
    above[top] = -1
    group = [0] * n
    for node, m in enumerate(members):
        for i in m:
            group[i] = node

    left = [i for i in range(n)]
    previous = [-1] * n
    taken: list[list[int]] = []
    node = top
    while node != -1:
        mem = members[node] if size[node] == len(members[node]) else [i for i in members[node] if group[i] == node]
        taken.append(mem)
        for i in mem:
            left[i] = i - 1
        count: dict[int, int] = {}
        for i in mem:
            j = i - 1
            while j >= 0:
                k = left[j]
                if k == j:
                    break
                if k >= 0:
                    k = left[j] = left[k]
                j = k
            left[i] = previous[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        moved: dict[int, dict[int, list[int]]] = {}
        for j, c in count.items():
            moved.setdefault(group[j], {}).setdefault(c, []).append(j)
        for old, parts in moved.items():
            for c in sorted(parts, reverse=True):
                part = parts[c]
                if len(part) == size[old]:
                    break  # the whole group moves up together
                new = len(members)
                members.append(part)
                size.append(len(part))
                size[old] -= len(part)
                for j in part:
                    group[j] = new
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                if up != -1:
                    below[up] = new
        node = below[node]
    free = [0] * len(members)
    order = [-1] * n
    at = 0
    for mem in reversed(taken):
        free[group[mem[0]]] = at
        at += len(mem)
    order[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    free[group[n - 1]] += 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            j = previous[j]
    return order


def _ends(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk ends, in one context; decided by at most GAP + 4 bytes before the place."""
    if len(data) < 4:
        return np.empty(0, "int64")
    marks = np.zeros(len(data) + 1, bool)
    marks[4:] = _mix(_hashes(data, 4)) % np.uint64(CHUNK) == 0
    last = np.maximum.accumulate(np.where(marks, np.arange(len(marks)), 0))
    marks |= np.arange(len(marks)) - last >= GAP
    return np.flatnonzero(marks)


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of several distinct contexts, which of its windows occur in another place of any of them."""
    ends = [_ends(np.frombuffer(c, "uint8")) for c in contexts]
    names: dict[bytes, int] = {}
    symbols, where, base = [], [], []
    total = 0
    for c, e in zip(contexts, ends, strict=True):
        base.append(len(symbols))
        for a, b in zip(e[:-1].tolist(), e[1:].tolist(), strict=True):
            symbols.append(names.setdefault(c[a:b], len(names)))
        where += (e[:-1] + total).tolist() if len(e) > 1 else []
        symbols.append(-len(base))  # a separator of its own
        where.append(total + (int(e[-1]) if len(e) else len(c)))
        total += len(c)
    m = len(contexts)
    ids = [m + x if x >= 0 else m + x for x in symbols]  # separators m-1 ... 0: the last is the smallest
    order = np.array(suffix_order(ids), "int64")
    numbers, place = np.array(ids, "int64"), np.array(where, "int64")
    # common prefixes of neighbours in the order, by binary search on prefix hashes
    n, top = len(numbers), 1
    values, powers = _mix(numbers.astype("uint64") * np.uint64(_P) + np.uint64(1)), _P
    spans = [values]
    while 2 * top <= max(len(e) for e in ends) + 1 and len(spans[-1]) > top:
        spans.append(spans[-1][:-top] * np.uint64(powers) + spans[-1][top:])
        powers, top = powers * powers & _MASK, 2 * top
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(spans) - 1, -1, -1):
        step, h = 1 << level, spans[level]
        fits = np.maximum(a, b) < len(h)
        same = np.zeros(len(a), bool)
        same[fits] = h[a[fits]] == h[b[fits]]
        a[same] += step
        b[same] += step
    reach = np.zeros(n, "int64")
    common = place[np.minimum(a, n - 1)] - place[order[:-1]]
    reach[order[:-1]] = common
    reach[order[1:]] = np.maximum(reach[order[1:]], common)
    out, found, owner = [], [], []
    total = 0
    for i, (c, e) in enumerate(zip(contexts, ends, strict=True)):
        windows = len(c) - length + 1
        s = np.arange(windows)
        if len(e) > 1:
            first = np.searchsorted(e, s + GAP + 4)
            last = np.searchsorted(e, s + length, "right") - 1
            inner = np.minimum(first, len(e) - 1)
            may = (last <= first) | (reach[base[i] + inner] >= e[np.maximum(last, 0)] - e[inner])
        else:
            may = np.ones(windows, bool)
        out.append(np.zeros(windows, bool))
        at = np.flatnonzero(may)
        if len(at):
            lo, hi = int(at[0]), int(at[-1])
            h = _hashes(np.frombuffer(c, "uint8")[lo:hi + length], length)
            found.append(h[at - lo])
            owner.append(at + total)
        total += windows
    if found:
        h, at = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        flat = np.zeros(total, bool)
        flat[at[twice]] = True
        out = np.split(flat, np.cumsum([len(o) for o in out])[:-1])
    return out


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as maximal ones, in order."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order]) if len(starts) else ends
    new = np.concatenate([[True], a[1:] > b[:-1]]) if len(a) else np.empty(0, bool)
    at = np.flatnonzero(new)
    return a[at], b[np.append(at[1:] - 1, len(b) - 1)] if len(at) else b[:0]


def _covered(mask: np.ndarray, start: int, length: int) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view("int8"), [0]])))
    return (edges[::2] + start).tolist(), (edges[1::2] - 1 + start + length).tolist()


FOUND = "text_key binary, lo array<bigint>, hi array<bigint>"


def _mark_groups(batches: Iterator[pa.RecordBatch], length: int, each: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows from contexts (anchor, mark, text_key, start, context) sorted by (anchor, mark)."""
    def solve(groups: list[dict[bytes, list[tuple[bytes, int]]]]) -> Iterator[pa.RecordBatch]:
        todo = [c for g in groups if len(g) > 1 for c in g]
        masks = dict(zip(todo, repeated_windows(todo, length), strict=True)) if todo else {}
        keys, los, his = [], [], []
        for g in groups:
            for c, places in g.items():
                mask = np.ones(len(c) - length + 1, bool) if len(places) > 1 else masks.get(c)
                if mask is not None and mask.any():
                    for key, start in places:
                        lo, hi = _covered(mask, start, length)
                        keys.append(key)
                        los.append(lo)
                        his.append(hi)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(los, pa.list_(pa.int64())), pa.array(his, pa.list_(pa.int64()))], ["text_key", "lo", "hi"])

    groups: list[dict] = []
    now, size = None, 0
    for batch in batches:
        for anchor, key, start, context in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("anchor", "text_key", "start", "context")), strict=True):
            if anchor != now:
                if size >= each:
                    yield from solve(groups)
                    groups, size = [], 0
                groups.append({})
                now = anchor
            if context not in groups[-1]:
                size += len(context)
            groups[-1].setdefault(context, []).append((key, start))
    yield from solve(groups)


def _hot_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same spans for anchors of very many contexts: windows are counted by their hash, over all tasks."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "context", 256):
            for key, start, context in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text_key", "start", "context")), strict=True):
                h = _hashes(np.frombuffer(context, "uint8"), length).view("int64")
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([key] * len(h), pa.binary()), pa.array(np.arange(len(h)) + start)], ["h", "text_key", "at"])

    windows = contexts.mapInArrow(explode, "h bigint, text_key binary, at bigint")
    twice = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return windows.join(twice, "h").select("text_key", F.array("at").alias("lo"), F.array(F.col("at") + length).alias("hi"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, each: int = 2 << 20, hot: int = 20_000, form: Callable[[bytes], bytes] = _plain) -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows (doc_id, row_key, text_key, n_bytes, copies, sha256) of every row, and the spans to remove
    (text_key, row_key, lo, hi sorted and disjoint) of every text that occurs once and has any. A text of `length` bytes or
    more with copies is removed whole and has no spans here. Lengths and spans are those of the bytes as `form` gives them.
    """
    if length <= GRAM + 4 + 2 * GAP:
        raise ValueError(f"the length must be above {GRAM + 4 + 2 * GAP} bytes")
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("row_key"), text_or_empty(text).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data = [form(t.encode()) for t in batch.column(2).to_pylist()]
            runs = [window_runs(np.frombuffer(d, "uint8"), length) for d in data]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([hashlib.blake2b(d, digest_size=16).digest() for d in data], pa.binary()), pa.array([len(d) for d in data], pa.int64()),
                pa.array([hashlib.sha256(d).hexdigest() for d in data]), pa.array([r[0].view("int64") for r in runs], pa.list_(pa.int64())), pa.array([r[1] for r in runs], pa.list_(pa.int64())), pa.array([r[2].astype("int32") for r in runs], pa.list_(pa.int32())),
            ], ["doc_id", "row_key", "text_key", "n_bytes", "sha256", "anchors", "starts", "windows"])

    described = cut(source.mapInArrow(describe, "doc_id bigint, row_key bigint, text_key binary, n_bytes bigint, sha256 string, anchors array<bigint>, starts array<bigint>, windows array<int>"))
    copies = cut(described.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.min("row_key").alias("least")))
    rows = described.join(copies, "text_key").select("doc_id", "row_key", "text_key", "n_bytes", "copies", "sha256")
    one = described.join(copies, "text_key").where(F.col("row_key") == F.col("least")).dropDuplicates(["text_key"])
    runs = one.select("text_key", "row_key", F.explode(F.arrays_zip("anchors", "starts", "windows")).alias("r")).select("text_key", "row_key", F.col("r.anchors").alias("anchor"), F.col("r.starts").alias("start"), F.col("r.windows").alias("windows"))
    runs = cut(runs)
    shared = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = runs.join(shared, "anchor").groupBy("row_key", "text_key").agg(F.collect_list(F.struct("anchor", "start", "windows", "n")).alias("runs"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 64, 1 << 20):
            columns: list[list] = [[], [], [], [], [], []]
            for name, words, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = form(words.encode())
                for r in found:
                    context = data[r["start"]:r["start"] + r["windows"] + length - 1]
                    mark = int.from_bytes(hashlib.blake2b(context, digest_size=8).digest(), "little", signed=True)
                    for c, v in zip(columns, (r["anchor"], r["n"], mark, name, r["start"], context), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["anchor", "n", "mark", "text_key", "start", "context"])

    texts = cut(source.select("row_key", "text").join(wanted, "row_key").dropDuplicates(["row_key"]).select("text_key", "text", "runs", "row_key"))
    around = texts.select("text_key", "text", "runs").mapInArrow(contexts, "anchor bigint, n bigint, mark bigint, text_key binary, start bigint, context binary")
    dealt = around.where(F.col("n") <= hot).repartition("anchor").sortWithinPartitions("anchor", "mark")
    found = dealt.mapInArrow(lambda b: _mark_groups(b, length, each), FOUND)
    if not shared.where(F.col("n") > hot).isEmpty():
        found = found.unionByName(_hot_windows(around.where(F.col("n") > hot), length))
    joined = found.groupBy("text_key").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            united = [spans(np.array(a, "int64"), np.array(b, "int64")) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([u[i] for u in united], pa.list_(pa.int64())) for i in range(2)), batch.column(3)], ["text_key", "lo", "hi", "text"])

    single = texts.join(copies.where("copies = 1").select("text_key"), "text_key").select("text_key", "text")
    return rows, cut(joined.join(single, "text_key").mapInArrow(merge, FOUND + ", text string"))


def _kept(data: bytes, lo: list[int], hi: list[int]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *hi], [*lo, len(data)], strict=True))


def repeat_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, **settings) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Every byte covered by a `length`-byte string that also starts elsewhere in any text, or elsewhere in its own, is
    removed; strings are judged on the input and never cross texts. A null text counts as empty; texts below `length`
    bytes lose nothing; repeated rows are copies of each other; an empty table gives an empty one.
    """
    rows, found = repeated_spans(docs, key, text, length, **settings)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [(sum(hi) - sum(lo), len(lo), hashlib.sha256(_kept(t.encode(), lo, hi)).hexdigest()) for lo, hi, t in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])], ["text_key", "n_removed", "n_spans", "kept_sha256"])

    some = found.mapInArrow(digest, "text_key binary, n_removed bigint, n_spans bigint, kept_sha256 string")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.join(some, "text_key", "left").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"), F.when(whole, empty).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, passages: bool = False, **settings) -> DataFrame:
    """The rows of `docs` with the repeated bytes taken out of the text (see repeat_digest); every row stays.

    A character of which only some bytes are removed goes. Rows that lose nothing keep their text, nulls included. With
    `passages`, lengths are those of the padded text.
    """
    rows, found = repeated_spans(docs, key, text, length, form=padded if passages else _plain, **settings)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept = []
            for lo, hi, t in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = t.encode()
                kept.append(_kept(data, *(unpadded(data, lo, hi) if passages else (lo, hi))).decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["text_key", "_repeat_kept"])

    whole = rows.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("row_key", F.lit("").alias("_repeat_kept"))
    some = rows.select("row_key", "text_key").join(found.mapInArrow(clean, "text_key binary, _repeat_kept string"), "text_key").select("row_key", "_repeat_kept")
    changed = whole.unionByName(some).dropDuplicates(["row_key"]).withColumnRenamed("row_key", "_repeat_row")
    marked = docs.withColumn("_repeat_row_of", F.xxhash64(F.col(key), F.col(text)))
    columns = [F.coalesce("_repeat_kept", F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return marked.join(changed, F.col("_repeat_row_of") == F.col("_repeat_row"), "left").select(*columns)


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of `docs` without any passage of more than 50 words, however short, and any 400-byte string that repeats.

    See remove_repeats. Both reach PASSAGE bytes once words are padded; so do some passages of 50 words and of 394 bytes.
    """
    return remove_repeats(docs, key, text, PASSAGE, passages=True, **settings)
