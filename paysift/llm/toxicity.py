"""Toxicity by a chain of linear models over hashed words and word beginnings."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: At most so many labelled documents of each value of the decided category are fitted (a documented bound).
SAMPLE_ROWS = 2500
DIM, FOLDS, PREFIXES, LEAST_DOCS = 1 << 20, 3, (4, 5, 6), 4
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashed features of one word: the word itself and its first letters."""
    parts = [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]
    return [zlib.crc32(p.encode()) % DIM for p in parts]


def document_features(text: str) -> np.ndarray:
    """Feature indices of the distinct words of the whole text, with repeats."""
    return np.array([f for w in set(_WORD.findall(text.lower())) for f in word_features(w)], "int32")


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Linear:
    """One link of the chain: weights of features, of the earlier categories' log-odds, and a constant."""

    weights: np.ndarray
    earlier: np.ndarray
    constant: float


class Rows:
    """Documents as (row, column, count) triples over the features that LEAST_DOCS documents have."""

    def __init__(self, features: list[np.ndarray]):
        seen = np.zeros(DIM, "int32")
        for f in features:
            seen[np.unique(f)] += 1
        keep = seen >= LEAST_DOCS
        self.n, self.ids = len(features), np.flatnonzero(keep)
        place = np.zeros(DIM, "int32")
        place[self.ids] = np.arange(len(self.ids))
        pairs = [np.unique(place[f[keep[f]]], return_counts=True) for f in features]
        column = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, "int32")
        count = np.concatenate([p[1].astype("float32") for p in pairs]) if pairs else np.empty(0, "float32")
        row = np.repeat(np.arange(self.n, dtype="int32"), np.array([len(p[0]) for p in pairs], "int64"))
        del pairs
        self.by_row = self._sorted(row, column, count)
        self.by_column = self._sorted(column, row, count)

    @staticmethod
    def _sorted(target: np.ndarray, other: np.ndarray, value: np.ndarray) -> tuple:
        order = np.argsort(target, kind="stable")
        groups, starts = np.unique(target[order], return_index=True)
        return groups, starts, other[order], value[order]

    @staticmethod
    def _sum(side: tuple, x: np.ndarray, size: int) -> np.ndarray:
        groups, starts, other, value = side
        out = np.zeros(size)
        if len(groups):
            out[groups] = np.add.reduceat(value * x[other], starts)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._sum(self.by_row, w, self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return self._sum(self.by_column, g, len(self.ids))


def fit_linear(rows: Rows, earlier: np.ndarray, y: np.ndarray, use: np.ndarray, weight: np.ndarray, sparse: float = 0.09, steps: int = 80, rate: float = 0.3) -> Linear:
    """Logistic regression with an L1 penalty (sparse over the root of the rows) on word weights, by Adam with soft thresholding, on the rows `use` marks.

    A row stands for `weight` rows; weights are scaled to a mean of 1.
    """
    n, k = max(1, int(use.sum())), earlier.shape[1]
    weight = np.where(use, weight, 0.0)
    weight = weight * (n / max(float(weight.sum()), 1e-12))
    y = np.where(use, y, 0.0)
    w, c, b = np.zeros(len(rows.ids)), np.zeros(k), float(logit(np.array([((weight * y).sum() + 0.5) / (n + 1)]))[0])
    m, v = np.zeros(len(w) + k + 1), np.zeros(len(w) + k + 1)
    for t in range(1, steps + 1):
        g = weight * (sigmoid(rows.times(w) + earlier @ c + b) - y) / n
        grad = np.concatenate([rows.back(g), earlier.T @ g, [g.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        scale = rate / (1 + t / 30) / (np.sqrt(v / (1 - 0.999**t)) + 1e-4)
        step = scale * m / (1 - 0.9**t)
        w, c, b = w - step[:len(w)], c - step[len(w):-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - scale[:len(w)] * sparse / np.sqrt(n), 0)
    return Linear(w, c, float(b))


@dataclass
class Chain:
    """Fitted links in order; `threshold` is for the decided category."""

    categories: list[str]
    links: list[Linear]
    ids: np.ndarray
    decided: int
    threshold: float

    def sparse(self) -> dict[int, np.ndarray]:
        """Weights by category of the features that have any; at most DIM entries, whatever the data."""
        table = np.column_stack([x.weights for x in self.links])
        return {int(f): w for f, w in zip(self.ids, table, strict=True) if w.any()}

    def probabilities(self, linear: np.ndarray) -> np.ndarray:
        """From word sums by category (rows x categories): each link also reads the earlier links' probabilities."""
        out = np.zeros(linear.shape)
        for i, x in enumerate(self.links):
            out[:, i] = sigmoid(linear[:, i] + logit(out[:, :i]) @ x.earlier + x.constant)
        return out


def fit_chain(features: list[np.ndarray], labels: np.ndarray, categories: Sequence[str], decided: str, strong: str | None = None, weight: np.ndarray | None = None) -> Chain:
    """The chain over label columns in the given order, each link reading out-of-fold probabilities of the earlier ones.

    Where `strong` is named, a last category is added: documents of the decided category whose out-of-fold probability is
    in the upper half of that category's. The threshold is the middle between the out-of-fold cut that separates best
    (largest F1) and the next lower score. `weight` says how many labelled rows each row stands for. A label may be unknown
    (NaN): its link is fitted on the other rows, and later links read its prediction.
    """
    rows, n, names = Rows(features), len(features), list(categories)
    fold = np.arange(n) % FOLDS
    links, out_of_fold, threshold = [], np.zeros((n, 0)), 0.5
    labels = labels.astype("float64").reshape(n, len(names))
    weight = np.ones(n) if weight is None else weight.astype("float64")
    i = 0
    while i < len(names):
        y, earlier = labels[:, i], logit(out_of_fold)
        known = ~np.isnan(y)
        p = np.zeros(n)
        for f in range(FOLDS):
            part = fit_linear(rows, earlier, y, known & (fold != f), weight)
            p = np.where(fold == f, sigmoid(rows.times(part.weights) + earlier @ part.earlier + part.constant), p)
        links.append(fit_linear(rows, earlier, y, known, weight))
        out_of_fold = np.column_stack([out_of_fold, p])
        if names[i] == decided:
            positive = known & (y > 0)
            if positive.any():
                order = np.argsort(-np.where(known, p, -1.0), kind="stable")[:known.sum()]
                mass = weight[order]
                hits = np.cumsum(mass * y[order])
                best = int((2 * hits / (np.cumsum(mass) + hits[-1])).argmax())
                low = p[order[best + 1]] if best + 1 < len(order) else 0.0
                threshold = float(np.clip((p[order[best]] + low) / 2, 0.2, 0.8))
            if strong and strong not in names:
                high = positive & (p >= (np.median(p[positive]) if positive.any() else 1.0))
                names.append(strong)
                labels = np.column_stack([labels, np.where(known, high, np.nan)])
        i += 1
    return Chain(names, links, rows.ids, names.index(decided), threshold)


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str], decided: str, key: str = "doc_id", text: str = "text", most: int = SAMPLE_ROWS) -> pd.DataFrame:
    """Features and categories of at most `most` labelled documents with and without the decided category.

    All are taken where there are fewer; else a share by a hash of the key, and `weight` is the inverse of the share. A key
    labelled twice counts with the larger values; keys whose decided label is null are left out, other labels may be null;
    a key's repeated documents are joined each.
    """
    one = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("label_key")).agg(*[F.max(c).cast("double").alias(f"label_{c}") for c in categories]).dropna(subset=[f"label_{decided}"])
    counts = {r[0] > 0: r[1] for r in one.groupBy(F.col(f"label_{decided}") > 0).count().select(F.col(f"(label_{decided} > 0)").cast("int"), "count").collect()}
    u = F.pmod(F.xxhash64("label_key"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col(f"label_{decided}") > 0, F.lit(most / max(most, counts.get(True, 1)))).otherwise(F.lit(most / max(most, counts.get(False, 1))))
    names = [f"label_{c}" for c in categories] + ["weight"]
    # a bounded number of keys and labels, so the texts stay where they are
    taken = one.where(u < share).withColumn("weight", 1 / share).limit(3 * most)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns="text").assign(features=[document_features(t).tobytes() for t in frame["text"]])

    joined = docs.select(F.col(key).alias("label_key"), text_or_empty(text).alias("text")).join(F.broadcast(taken), "label_key").select("text", "label_key", *names)
    found = joined.mapInPandas(features, "label_key bigint, " + ", ".join(f"{n} double" for n in names) + ", features binary")
    return found.limit(3 * most).toPandas().sort_values("label_key", kind="stable")


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic"), decided: str = "toxic", strong: str | None = "strongly_toxic", key: str = "doc_id", text: str = "text", most: int = SAMPLE_ROWS) -> DataFrame:
    """Adds p_<category> for every link of the chain, and is_<decided>; columns of these names are replaced.

    The chain is fitted on the driver on a bounded sample of the labelled documents; every row's whole text is scored in
    one pass without a shuffle. A null or wordless text has the constant terms only. Repeated rows are scored each. Without
    labelled documents every probability is that of an empty fit and nothing is marked.
    """
    sample = labelled_sample(docs, labels, categories, decided, key, text, most)
    chain = fit_chain([np.frombuffer(x, "int32") for x in sample["features"]], sample[[f"label_{c}" for c in categories]].to_numpy(), categories, decided, strong, sample["weight"].to_numpy())
    fitted = bool(len(sample))
    model = docs.sparkSession.sparkContext.broadcast((chain, chain.sparse()))
    names = [f"p_{c}" for c in chain.categories]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chain, weights = model.value
        known: dict[str, np.ndarray | None] = {}
        for part in parts:
            sums = np.zeros((len(part), len(chain.links)))
            for i, t in enumerate(part):
                words = set(_WORD.findall(t.lower()))
                if len(known) > 400_000:
                    known = {}
                for w in words.difference(known):
                    found = [weights[f] for f in word_features(w) if f in weights]
                    known[w] = np.sum(found, 0) if found else None
                hits = [v for v in map(known.__getitem__, words) if v is not None]
                if hits:
                    sums[i] = np.sum(hits, 0)
            yield pd.DataFrame(chain.probabilities(sums), columns=names)

    found = docs.withColumn("_chain", score(text_or_empty(text)))
    for n in names:
        found = found.withColumn(n, F.col("_chain")[n])
    return found.withColumn(f"is_{decided}", (F.col(f"p_{decided}") >= F.lit(chain.threshold)) & F.lit(fitted)).drop("_chain")
