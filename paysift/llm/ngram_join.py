"""Similarity join on word n-grams: a chosen-path join over min-hash tokens with exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.session import cut

from .common import slices, text_or_empty

#: Tokens of a set: (coordinate, smallest hash under that coordinate's function). Two sets share a coordinate's token with
#: probability equal to their Jaccard similarity.
TOKENS = 64
#: Runs that split on the same min-hash functions; the next as many have functions of their own. Two sets agree on a fixed share
#: of one group's tokens, so more runs of that group do not help a pair which agrees on few of them.
GROUP = 16
#: The run is in the top RUN_BITS of a path, below the sign.
RUN_BITS = 11
RUNS = 1 << (RUN_BITS - 1)
_LOW = np.uint64(64 - RUN_BITS)
_R = np.random.default_rng(90210)
_ODD = (_R.integers(0, 1 << 63, TOKENS, dtype="uint64") << np.uint64(1)) | np.uint64(1)
_BYTE = _R.integers(0, 1 << 63, 256, dtype="uint64")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype="uint8")
_LOWER[ord("A"):ord("Z") + 1] += 32
LEVELS = 12


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word in order; words are runs without ASCII white space, A-Z in lower case."""
    data = _LOWER[np.frombuffer(text.encode(), "uint8")]
    inside = ~_SPACE[data]
    if not inside.any():
        return np.empty(0, "uint64")
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(begins[at])
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return _mix(np.add.reduceat(_mix(_BYTE[data[at]] + place.astype("uint64") * _STEP), starts))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of all runs of `width` words; a shorter text with words is one run."""
    words = word_hashes(text)
    width = min(width, len(words))
    if not width:
        return words
    out = np.zeros(len(words) - width + 1, "uint64")
    for i in range(width):
        out = out * _STEP + words[i:i + len(out)]
    return np.unique(_mix(out + np.uint64(width)))


def _functions(group: int) -> np.ndarray:
    if not group:
        return _ODD
    return (np.random.default_rng([90210, group]).integers(0, 1 << 63, TOKENS, dtype="uint64") << np.uint64(1)) | np.uint64(1)


def tokens(items: np.ndarray, group: int = 0) -> np.ndarray:
    """TOKENS smallest hashes of a set, 32 bits each, under the functions of a group of runs."""
    odd = _functions(group)[:, None]
    best = np.full(TOKENS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, len(items), 1 << 14):
        best = np.minimum(best, (items[None, lo:lo + (1 << 14)] * odd).min(1))
    return (best >> np.uint64(32)).astype("<u4")


def _agreements(threshold: float) -> np.ndarray:
    """The chance that a pair at the threshold agrees on k of its TOKENS tokens, by k."""
    return np.array([math.comb(TOKENS, k) * threshold**k * (1 - threshold) ** (TOKENS - k) for k in range(TOKENS + 1)])


def least_agreement(threshold: float, recall: float) -> int:
    """So many equal tokens that a pair at the threshold has fewer with at most a twentieth of the allowed misses."""
    return int((np.cumsum(_agreements(threshold)) <= (1 - recall) / 20).sum())


def missed(runs: int, depth: int, threshold: float) -> float:
    """The chance that a pair at the threshold has not met after so many runs, when buckets needed `depth` splits.

    A node is split on one token, or on two in a quarter of all nodes. A pair that agrees on k of TOKENS tokens stays
    together at the split after i others with the chance 3/4 a + 1/4 (1 - (1 - a)^2), a = (k - i) / (TOKENS - i), as a token
    splits a path only once. Runs of one group share k, which is binomial; groups are independent.
    """
    k, stay = np.arange(TOKENS + 1), np.ones(TOKENS + 1)
    for i in range(max(1, depth)):
        a = np.maximum(k - i, 0) / (TOKENS - i)
        stay *= 0.75 * a + 0.25 * (1 - (1 - a) ** 2)
    out = 1.0
    for lo in range(0, runs, GROUP):
        out *= float(_agreements(threshold) @ (1 - stay) ** min(GROUP, runs - lo))
    return out


def runs_needed(depth: int, threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met with the wanted probability, when buckets needed `depth` splits.

    A twentieth of the allowed misses is left to the comparison of tokens before verification.
    """
    for runs in range(1, RUNS):
        if missed(runs, depth, threshold) <= 0.95 * (1 - recall):
            return runs
    raise ValueError(f"a recall of {recall} at {threshold} with {depth} splits needs {RUNS} runs or more")


def _coordinates(node: int) -> tuple[int, ...]:
    """The tokens on which a node splits: chosen by its path alone, so all its sets agree."""
    h = int(_mix(np.array([node], "int64").view("uint64"))[0])
    first, second = h % TOKENS, (h >> 8) % TOKENS
    return (first, second) if (h >> 20) % 4 == 0 and second != first else (first,)


def _child(node: np.ndarray, coordinate: int, value: np.ndarray) -> np.ndarray:
    """The path of a child, with the run in its top bits."""
    h = _mix(_mix(value.astype("uint64") + np.uint64(coordinate << 32)) ^ node.view("uint64"))
    return ((node.view("uint64") >> _LOW << _LOW) | (h >> np.uint64(RUN_BITS))).view("int64")


def root(run: int) -> int:
    return (run << int(_LOW)) | (int(_mix(np.array([run + 1], "uint64"))[0]) >> RUN_BITS)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), TOKENS)


def _split(rows: DataFrame, roots: list[int] | None = None) -> DataFrame:
    """(parent, key, set_key) of rows (set_key, tokens[, parent]): every set goes to one or two children of its node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, table = batch.column(0), _matrix(batch.column(1))
            jobs = [(r, np.arange(len(table))) for r in roots] if roots else []
            if not roots:
                parent = batch.column(2).to_numpy(zero_copy_only=False)
                order = np.argsort(parent, kind="stable")
                jobs = [(int(parent[g[0]]), g) for g in np.split(order, np.flatnonzero(np.diff(parent[order])) + 1)]
            for node, at in jobs:
                nodes = np.full(len(at), node, "int64")
                for c in _coordinates(node):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(_child(nodes, c, table[at, c])), keys.take(pa.array(at))], ["parent", "key", "set_key"])

    return rows.mapInArrow(run, "parent bigint, key bigint, set_key binary")


def _paths(sets: DataFrame, runs: range, limit: int) -> tuple[DataFrame, int]:
    """Leaf buckets (key, size, set_key) of the runs, and the number of splits that were needed.

    A bucket of up to `limit` sets is a leaf. A larger one is split again, unless its largest child keeps half of it: then
    its sets are alike and splitting would only lose pairs, so it is a (large) leaf. What is large after LEVELS splits is a
    leaf as well.
    """
    leaves, front, parents, depth = [], None, None, 1
    while True:
        if front is None:
            kids = cut(_split(sets.select("set_key", "tokens"), [root(r) for r in runs]))
        else:
            kids = cut(_split(front.join(sets.select("set_key", "tokens"), "set_key").select("set_key", "tokens", "parent")))
        sized = cut(kids.groupBy("key").agg(F.first("parent").alias("parent"), F.count(F.lit(1)).alias("size")).where("size > 1"))
        if parents is not None:
            top = sized.groupBy("parent").agg(F.max("size").alias("top"))
            alike = cut(parents.join(top, "parent").where("2 * top >= size").select("parent", "size"))
            leaves.append(front.join(alike, "parent").select(F.col("parent").alias("key"), "size", "set_key"))
            sized = sized.join(alike.select("parent"), "parent", "left_anti")
        small = F.lit(True) if depth == LEVELS else F.col("size") <= limit
        leaves.append(kids.select("key", "set_key").join(sized.where(small).select("key", "size"), "key").select("key", "size", "set_key"))
        parents = cut(sized.where(~small).select(F.col("key").alias("parent"), "size"))
        if parents.isEmpty():
            break
        front = cut(kids.select(F.col("key").alias("parent"), "set_key").join(parents.select("parent"), "parent"))
        depth += 1
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out, depth


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of one (key, bi, bj) after the other, from rows sorted by them."""
    now, rows = None, None
    for batch in batches:
        table = batch.to_pydict()
        names = list(table)
        marks = list(zip(table["key"], table["bi"], table["bj"], strict=True))
        lo = 0
        for i in range(len(marks) + 1):
            if i == len(marks) or marks[i] != marks[lo]:
                if i > lo:
                    if marks[lo] != now:
                        if rows:
                            yield rows
                        now, rows = marks[lo], {n: [] for n in names}
                    for n in names:
                        rows[n] += table[n][lo:i]
                lo = i
    if rows:
        yield rows


def _first_here(rows: dict[str, list]) -> np.ndarray:
    """Which pairs of the group meet here for the first time: no smaller bucket key is common to both."""
    m, here = len(rows["set_key"]), rows["key"][0]
    out = np.triu(np.ones((m, m), bool), 1)
    if rows["bi"][0] != rows["bj"][0]:
        side = np.array(rows["b"]) == rows["bi"][0]
        out = np.triu(side[:, None] != side[None, :], 1)
    members: dict[int, list[int]] = {}
    for i, keys in enumerate(rows["keys"]):
        for k in keys:
            if k < here:
                members.setdefault(k, []).append(i)
    for at in members.values():
        if len(at) > 1:
            out[np.ix_(at, at)] = False
    return out


def _likely(rows: dict[str, list], threshold: float, least: int) -> np.ndarray:
    """Pairs that meet here first, whose sizes allow the threshold and which agree on `least` tokens."""
    ok = _first_here(rows)
    n = np.array(rows["n"], "float64")
    ok &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9
    if ok.any():
        table = np.frombuffer(b"".join(rows["tokens"]), "<u4").reshape(len(n), TOKENS)
        same = np.zeros(ok.shape, "uint8")
        for c in range(TOKENS):
            same += table[:, c, None] == table[None, :, c]
        ok &= same >= least
    return ok


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs: pair by pair if few, else by products of the sets' incidence."""
    if len(i) <= 8 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], "int64")
    flat = np.concatenate(sets)
    _, column = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total, width = np.zeros((len(sets), len(sets)), "float32"), 4096
    for lo in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        part = np.zeros((len(sets), width), "float32")
        part[row[a:b], column[a:b] - lo] = 1
        total += part @ part.T
    return total[i, j].astype("int64")


def _candidates(batches: Iterator[pa.RecordBatch], threshold: float, least: int) -> Iterator[pa.RecordBatch]:
    names = ["key", "bi", "bj", "b", "set_key", "keys"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    out: dict[str, list] = {n: [] for n in names}
    for rows in _groups(batches):
        if len(rows["set_key"]) > 1:
            ok = _likely(rows, threshold, least)
            for i in np.flatnonzero(ok.any(0) | ok.any(1)):
                for n in names:
                    out[n].append(rows[n][i])
        if len(out["key"]) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names)
            out = {n: [] for n in names}
    if out["key"]:
        yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names)


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(set_key, root, links): exact links that meet here first, each set tied to one root of its group."""
    for rows in _groups(batches):
        sets = [np.frombuffer(x, "<u8") for x in rows["items"]]
        rows["n"] = [len(x) for x in sets]
        n = np.array(rows["n"], "int64")
        i, j = np.nonzero(_first_here(rows) & (np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9))
        if not len(i):
            continue
        both = _overlaps(sets, i, j)
        # the similarity as one rounded quotient, compared with the threshold: the same in SQL
        linked = both / (n[i] + n[j] - both) >= threshold
        i, j = i[linked], j[linked]
        if not len(i):
            continue
        label = np.arange(len(sets))
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        links = np.bincount(i, minlength=len(sets)) + np.bincount(j, minlength=len(sets))
        at = np.flatnonzero(links)
        keys = rows["set_key"]
        yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in at], pa.binary()), pa.array([keys[label[k]] for k in at], pa.binary()), pa.array(links[at])], ["set_key", "root", "links"])


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of edges (a, b); vertices are hashes, so minima shrink the graph fast in any shape.

    Each round every vertex takes the least name among itself and its neighbours, and the edges are renamed.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = left.select(F.col("a").alias("v")).union(left.select("b")).distinct().select("v", F.col("v").alias("root"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        least = cut(both.groupBy(F.col("a").alias("was")).agg(F.min("b").alias("low")).select("was", F.least("was", "low").alias("now")))
        names = cut(names.join(least, names["root"] == least["was"], "left").select("v", F.coalesce("now", "root").alias("root")))
        first = left.join(least, left["a"] == least["was"]).select(F.col("now").alias("a"), "b")
        second = first.join(least, first["b"] == least["was"]).select("a", F.col("now").alias("b"))
        left = cut(second.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return names


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.9999, limit: int = 256, block: int = 512) -> DataFrame:
    """(doc_id, class_id, set_id, n_links, row_key, class_key) of every row: documents linked by Jaccard similarity >= threshold.

    Documents with the same set of word n-grams are one set; set_id is its smallest doc_id. n_links is the number of other
    sets linked to it, class_id the smallest doc_id among all documents that links connect. Candidates come from a
    chosen-path join, run until a pair at the threshold has met with probability `recall` (averaged over how many tokens such
    pairs agree on; more runs than paths can name raise an error); each candidate pair is verified
    exactly, once, in the first bucket that both share. Buckets of alike sets that splitting cannot make small are compared
    block by block. No pair is ever written: a bucket gives one row per set with its link count and a root.
    A null text, and a text without words, is alone with no links; texts shorter than `width` words are one n-gram; repeated
    rows are in one set; a null doc_id never names a class unless all are null; an empty table gives an empty one.
    row_key is a hash of doc_id and text, class_key names the class.
    """
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("row_key"), text_or_empty(text).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            items = [shingles(t, width) for t in batch.column(2).to_pylist()]
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array([len(x) for x in items], pa.int32()), pa.array([tokens(x).tobytes() if len(x) else None for x in items], pa.binary())], ["doc_id", "row_key", "set_key", "n", "tokens"])

    rows = cut(source.mapInArrow(describe, "doc_id bigint, row_key bigint, set_key binary, n int, tokens binary"))
    sets = cut(rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("set_id"), F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("tokens").alias("tokens")))

    def fresh(group: int) -> DataFrame:
        """The sets with tokens under another group's functions; the texts are not shuffled for them."""
        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                items = [x for t in batch.column(0).to_pylist() if len(x := shingles(t, width))]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in items], pa.binary()), pa.array([tokens(x, group).tobytes() for x in items], pa.binary())], ["set_key", "tokens"])

        return cut(source.select("text").mapInArrow(again, "set_key binary, tokens binary").groupBy("set_key").agg(F.first("tokens").alias("tokens")))

    done, need, deepest, group, now, leaves = 0, runs_needed(2, threshold, recall), 2, 0, sets, None
    while done < need:
        if done // GROUP != group:
            group, now = done // GROUP, fresh(done // GROUP)
        to = min(need, (group + 1) * GROUP)
        more, depth = _paths(now, range(done, to), limit)
        leaves = cut(more) if leaves is None else leaves.unionByName(cut(more))
        done, deepest = to, max(deepest, depth)
        need = max(need, runs_needed(deepest, threshold, recall))

    blocks = F.ceil(F.col("at.size") / block).cast("int")
    mine = leaves.groupBy("set_key").agg(F.collect_list(F.struct("key", "size")).alias("all"))
    placed = mine.join(sets, "set_key").select("set_key", "n", "tokens", F.col("all.key").alias("keys"), F.explode("all").alias("at"))
    placed = placed.select(F.col("at.key").alias("key"), F.pmod(F.xxhash64("set_key"), blocks).cast("int").alias("b"), blocks.alias("nb"), "set_key", "n", "tokens", "keys")
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("o", "nb")
    grouped = placed.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "set_key")
    least = least_agreement(threshold, recall)
    likely = cut(grouped.mapInArrow(lambda b: _candidates(b, threshold, least), "key bigint, bi int, bj int, b int, set_key binary, keys array<bigint>"))

    def itemise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["set_key", "items"])

    wanted = likely.select("set_key").distinct().join(sets.select("set_key", "row_key"), "set_key")
    texts = source.select("row_key", "text").join(wanted, "row_key").select("set_key", "text").dropDuplicates(["set_key"])
    items = texts.mapInArrow(itemise, "set_key binary, items binary")
    checked = likely.join(items, "set_key").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "set_key")
    links = cut(checked.select("key", "bi", "bj", "b", "set_key", "keys", "items").mapInArrow(lambda b: _verify(b, threshold), "set_key binary, root binary, links bigint"))

    names = components(links.select(F.col("set_key").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("set_key").agg(F.sum("links").alias("n_links"))
    linked = cut(sets.select("set_key", "set_id").join(names.withColumnRenamed("v", "set_key"), "set_key").join(counts, "set_key"))
    smallest = linked.groupBy("root").agg(F.min("set_id").alias("class_id"))
    named = linked.join(smallest, "root").select("set_key", "class_id", "n_links", "root")
    per_set = sets.select("set_key", "set_id").join(named, "set_key", "left").select("set_key", "set_id", F.coalesce("class_id", "set_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "set_key").alias("class_key"))
    return rows.select("doc_id", "row_key", "set_key").join(per_set, "set_key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("set_id", "doc_id").alias("set_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "row_key", F.coalesce("class_key", F.unhex(F.hex("row_key"))).alias("class_key"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One document of each class, with the columns of `docs`: the row of the class's smallest doc_id (of equal rows one).

    Rows without words have no class and stay, except that equal ones (same doc_id and text) stay once. Rows that share a
    doc_id but not a class are told apart. The texts are shuffled once, by a hash of doc_id and text.
    """
    found = similar_documents(docs, key, text, **settings)
    chosen = found.groupBy("class_key").agg(F.min(F.struct("doc_id", "row_key")).alias("least")).select(F.col("least.row_key").alias("chosen_row")).distinct()
    columns = [f"`{c}`" for c in docs.columns]
    marked = docs.withColumn("_keep_one_row", F.xxhash64(F.col(key), F.col(text)))
    return marked.join(chosen, marked["_keep_one_row"] == chosen["chosen_row"], "left_semi").dropDuplicates(["_keep_one_row"]).select(*columns)
