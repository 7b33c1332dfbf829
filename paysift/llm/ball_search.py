"""Exact top-k inner-product search by ball trees, one per shard."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paysift.session import cut

LOWEST = np.iinfo("int64").min
HITS = "query_id bigint, query_key bigint, vec_id bigint, score bigint"


def integer_vectors(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, ints, vec_key): floor(scale * component) of every vector without null, NaN or infinite components.

    Rows equal in id and vector collapse to one. vec_key is a hash of both: it deals rows over shards and tells apart
    vectors that share an id.
    """
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    ints = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & sound).select(F.col(key).cast("bigint").alias("vec_id"), ints.alias("ints")).distinct().withColumn("vec_key", F.xxhash64("vec_id", "ints"))


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether products of rows of both are exact in double precision."""
    top = lambda x: float(np.abs(x.astype("float64")).max()) if x.size else 0.0
    return top(a) * top(b) * max(1, a.shape[1]) < 2.0**53


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; Python integers where doubles are not exact, held to the range of a long."""
    if _exact(queries, rows):
        return (queries.astype("float64") @ rows.astype("float64").T).astype("int64")
    wide = queries.astype(object) @ rows.astype(object).T
    return np.clip(wide, LOWEST + 1, np.iinfo("int64").max).astype("int64")


def build_tree(ids: np.ndarray, rows: np.ndarray, leaf: int = 128) -> dict:
    """A balanced ball tree: nodes with centre, radius, children and the range of their rows, rows in tree order.

    A node is divided at the median of the direction between two far points, so equal or repeated vectors divide too.
    """
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    points, at = rows.astype("float64"), np.arange(len(ids))
    centre, radius, child, span = [], [], [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        me = len(centre)
        part = points[at[lo:hi]]
        c = part.mean(0) if hi > lo else np.zeros(points.shape[1])
        far = np.sqrt(((part - c) ** 2).sum(1)) if hi > lo else np.zeros(1)
        centre.append(c)
        radius.append(float(far.max()))
        child.append([-1, -1])
        span.append((lo, hi))
        if parent >= 0:
            child[parent][side] = me
        if hi - lo > leaf:
            a = part[far.argmax()]
            b = part[((part - a) ** 2).sum(1).argmax()]
            half = (hi - lo) // 2
            at[lo:hi] = at[lo:hi][np.argsort(part @ (b - a), kind="stable")]
            todo += [(lo + half, hi, me, 1), (lo, lo + half, me, 0)]
    return {"ids": ids[at], "rows": rows[at], "centre": np.array(centre), "radius": np.array(radius), "child": np.array(child, "int64").reshape(-1, 2), "span": np.array(span, "int64").reshape(-1, 2)}


def search_tree(tree: dict, ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vec_id, score) of each query's k best rows of this tree that are not below its `kth` score.

    Branch and bound for a block of queries at once. A node's bound is q.c + |q| r; subtrees below a query's current kth
    score are cut, leaves are then visited best bound first, and every visit raises the score that the next must reach.
    Rows of the query's own id take no part. Rows at the kth score stay in, so ties can go to the smaller id.
    """
    wide = queries.astype("float64")
    norm = np.sqrt((wide**2).sum(1))
    kth = kth.copy()
    found = (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0, "int64"))

    def bound(q: np.ndarray, node: np.ndarray) -> np.ndarray:
        near = np.einsum("ij,ij->i", wide[q], tree["centre"][node])
        reach = norm[q] * tree["radius"][node]
        return near + reach + 1e-9 * (np.abs(near) + reach) + 1e-6

    q, node = np.arange(len(ids)), np.zeros(len(ids), "int64")
    ub, leaves = bound(q, node), []
    while len(q):
        keep = ub >= kth[q]
        q, node, ub = q[keep], node[keep], ub[keep]
        last = tree["child"][node, 0] < 0
        leaves.append((q[last], node[last], ub[last]))
        q, node = np.repeat(q[~last], 2), tree["child"][node[~last]].reshape(-1)
        ub = bound(q, node) if len(q) else np.empty(0)
    q, node, ub = (np.concatenate(x) for x in zip(*leaves, strict=True)) if leaves else (q, node, ub)
    order = np.lexsort((node, -ub, q))
    q, node, ub = q[order], node[order], ub[order]
    turn = np.arange(len(q)) - np.searchsorted(q, q)  # a query's leaves, best bound first
    for r in range(int(turn.max(initial=-1)) + 1):
        now = np.flatnonzero((turn == r) & (ub >= kth[q]))
        if not len(now):
            continue
        now = now[np.argsort(node[now], kind="stable")]
        new = [found]
        for part in np.split(now, np.flatnonzero(np.diff(node[now])) + 1):
            lo, hi = tree["span"][node[part[0]]]
            who, rows = q[part], tree["ids"][lo:hi]
            score = products(queries[who], tree["rows"][lo:hi])
            i, j = np.nonzero((score >= kth[who][:, None]) & (rows[None, :] != ids[who][:, None]))
            new.append((who[i], rows[j], score[i, j]))
        a, b, c = (np.concatenate(x) for x in zip(*new, strict=True))
        order = np.lexsort((b, -c, a))
        a, b, c = a[order], b[order], c[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        found = tuple(x[place < k] for x in (a, b, c))
        full = place == k - 1
        kth[a[full]] = np.maximum(kth[a[full]], c[full])
    return found


def _pack(frame: pd.DataFrame) -> bytes:
    rows = np.array(frame["ints"].tolist(), "int64").reshape(len(frame), -1)
    return pickle.dumps((frame["vec_id"].to_numpy("int64"), frame["vec_key"].to_numpy("int64"), rows, frame["kth"].to_numpy("int64")))


def _search(trees: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Hits of query blocks in the trees of the shards they are sent to: a task holds one tree and one block at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, where = None, None
        for batch in batches:
            for dim, shard, kind, load in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if kind == 0:
                    tree, where = pickle.loads(load), (dim, shard)
                elif where == (dim, shard):
                    ids, keys, rows, kth = pickle.loads(load)
                    q, vec, score = search_tree(tree, ids, rows, kth, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(keys[q]), pa.array(vec), pa.array(score)], ["query_id", "query_key", "vec_id", "score"])

    both = trees.select("dim", "shard", F.lit(0).alias("kind"), "load").unionByName(blocks.select("dim", "shard", F.lit(1).alias("kind"), "load"))
    return both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind").mapInArrow(run, HITS)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = 8192, block_rows: int = 4096, leaf: int = 128, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest integer inner product of every query row, all rows searched.

    `is_query` is a condition on vec_id. Rows are dealt over shards by a hash, one ball tree each. First every query is
    searched in the shard it lies in; its kth score there is then the score to beat in all shards, to which blocks of
    queries are sent. A task holds one shard and one block. Ties go to the smaller vec_id; fewer than k rows give all.
    Vectors null or holding null, NaN or infinite components, and null ids, take no part; repeated rows count once; rows
    that share the query's id are its own; only vectors of equal length are compared; other columns are not read.
    """
    rows = cut(integer_vectors(vectors, scale, key, vector).withColumn("dim", F.size("ints")))
    n = rows.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-rows.where(is_query).count() // block_rows))
    rows = rows.withColumn("shard", F.pmod("vec_key", F.lit(shards)).cast("int"))

    def tree(key, frame: pd.DataFrame) -> pd.DataFrame:
        ints = np.array(frame["ints"].tolist(), "int64").reshape(len(frame), -1)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "load": [pickle.dumps(build_tree(frame["vec_id"].to_numpy("int64"), ints, leaf))]})

    def block(key, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "load": [_pack(frame)]})

    kind = "dim int, shard int, load binary"
    trees = cut(rows.groupBy("dim", "shard").applyInPandas(tree, kind))
    asked = rows.where(is_query).withColumn("kth", F.lit(LOWEST))
    home = _search(trees, asked.groupBy("dim", "shard").applyInPandas(block, kind), k)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    kth = home.withColumn("place", F.row_number().over(order)).where(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("query_key").alias("vec_key"), F.col("score").alias("kth"))
    known = asked.drop("kth").join(kth, ["vec_id", "vec_key"], "left").withColumn("kth", F.coalesce("kth", F.lit(LOWEST))).withColumn("shard", F.pmod(F.xxhash64("vec_key"), F.lit(blocks)).cast("int"))
    packed = known.groupBy("dim", "shard").applyInPandas(block, kind)
    sent = packed.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "load")
    best = _search(trees, sent, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
