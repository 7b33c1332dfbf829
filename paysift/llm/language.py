"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: The network is fitted on at most so many documents (shared equally by the languages), SAMPLE_CHARS of each.
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 512
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


class ByteNetwork:
    """Two gated recurrent layers, one for each direction, whose states label every byte.

    A layer reads bytes by a table and has one gate: f = s(F[x] + U h), c = tanh(C[x] + V (f h)), h' = h + f (c - h).
    """

    HIDDEN = 8

    def __init__(self, languages: list[str], seed: int = 7):
        r, h, n = np.random.default_rng(seed), self.HIDDEN, len(languages)
        self.languages = languages
        self.p: dict[str, np.ndarray] = {"b": np.zeros(n, "float32")}
        for d in "fb":
            for name, shape, scale in (("F", (256, h), 0.3), ("C", (256, h), 0.5), ("U", (h, h), 0.3), ("V", (h, h), 0.3), ("W", (h, n), 0.3)):
                self.p[d + name] = r.normal(0, scale, shape).astype("float32")

    def _forward(self, d: str, x: np.ndarray) -> tuple:
        """States of one direction over x (time x rows), with what the way back needs."""
        p, (steps, rows) = self.p, x.shape
        h = np.zeros((rows, self.HIDDEN), "float32")
        before, gates, candidates, after = [], [], [], []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            f = 0.5 + 0.5 * np.tanh(0.5 * (p[d + "F"][x[t]] + h @ p[d + "U"]))
            c = np.tanh(p[d + "C"][x[t]] + (f * h) @ p[d + "V"])
            before.append(h)
            h = h + f * (c - h)
            gates.append(f)
            candidates.append(c)
            after.append(h)
        return before, gates, candidates, after

    def gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the marked positions (time x rows), and its gradient by backpropagation through time."""
        p, steps = self.p, len(x)
        run = {d: self._forward(d, x) for d in "fb"}
        states = {"f": np.array(run["f"][3]), "b": np.array(run["b"][3][::-1])}
        z = states["f"] @ p["fW"] + states["b"] @ p["bW"] + p["b"]
        z -= z.max(2, keepdims=True)
        e = np.exp(z)
        q = e / e.sum(2, keepdims=True)
        n = max(1.0, float(mask.sum()))
        onehot = np.eye(q.shape[2], dtype="float32")[y]
        loss = float(-(np.log(np.take_along_axis(q, np.broadcast_to(y[None, :, None], (*q.shape[:2], 1)), 2)[..., 0] + 1e-9) * mask).sum() / n)
        dz = ((q - onehot[None]) * mask[..., None] / n).astype("float32")
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["b"] = dz.sum((0, 1))
        for d in "fb":
            before, gates, candidates, _ = run[d]
            g[d + "W"] = np.einsum("tbh,tbc->hc", states[d], dz)
            back, dh, into_f, into_c, order = dz @ p[d + "W"].T, 0.0, [], [], []
            for i in range(steps - 1, -1, -1):
                t = i if d == "f" else steps - 1 - i
                h, f, c = before[i], gates[i], candidates[i]
                dh = dh + back[t]
                dc = dh * f * (1 - c * c)
                through = dc @ p[d + "V"].T
                df = (dh * (c - h) + through * h) * f * (1 - f)
                g[d + "V"] += (f * h).T @ dc
                g[d + "U"] += h.T @ df
                into_f.append(df)
                into_c.append(dc)
                order.append(x[t])
                dh = dh * (1 - f) + through * f + df @ p[d + "U"].T
            at = np.concatenate(order)
            for name, parts in (("F", into_f), ("C", into_c)):
                flat = np.concatenate(parts)
                for j in range(self.HIDDEN):
                    g[d + name][:, j] = np.bincount(at, flat[:, j], 256)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = 500, rows: int = 128, rate: float = 0.02, seed: int = 7) -> list[float]:
        """Adam over random rows of x (rows x time)."""
        r, m, v, losses = np.random.default_rng(seed), {}, {}, []
        for t in range(1, steps + 1):
            pick = r.integers(0, len(x), min(rows, len(x)))
            loss, g = self.gradient(np.ascontiguousarray(x[pick].T), y[pick], np.ascontiguousarray(mask[pick].T))
            losses.append(loss)
            for k in self.p:
                m[k] = 0.9 * m.get(k, 0.0) + 0.1 * g[k]
                v[k] = 0.99 * v.get(k, 0.0) + 0.01 * g[k] ** 2
                self.p[k] = (self.p[k] - rate * (1 - 0.9 * t / steps) * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype("float32")
        return losses

    def pooled(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Sum of label probabilities over the positions lo <= t < hi of each row of x (rows x time)."""
        rows, steps = x.shape
        x, p, out = np.ascontiguousarray(x.T), self.p, np.zeros((rows, len(self.languages)), "float32")
        forward = np.empty((steps, rows, len(self.languages)), "float32")
        for d in "fb":
            gate, half, table, turn, mark = 0.5 * p[d + "F"], 0.5 * p[d + "U"], p[d + "C"], p[d + "V"], p[d + "W"]
            h = np.zeros((rows, self.HIDDEN), "float32")
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                f = np.take(gate, x[t], 0)
                f += h @ half
                np.tanh(f, f)
                f += 1.0
                f *= 0.5
                c = (f * h) @ turn
                c += np.take(table, x[t], 0)
                np.tanh(c, c)
                c -= h
                c *= f
                h += c
                if d == "f":
                    np.matmul(h, mark, forward[t])
                else:
                    z = h @ mark
                    z += forward[t]
                    z += p["b"]
                    z -= z.max(1, keepdims=True)
                    np.exp(z, z)
                    z /= z.sum(1, keepdims=True)
                    z *= ((lo <= t) & (t < hi))[:, None]
                    out += z
        return out


CORE, WARM = 224, 16


def windows(data: bytes, core: int = CORE, warm: int = WARM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in rows of `core` positions with `warm` bytes of the text on either side, zero beyond its ends.

    Returns the rows and, for each, the range of positions that it labels; every byte is labelled by one row.
    """
    n = len(data)
    count = -(-n // core)
    flat = np.zeros(warm + count * core + warm, "uint8")
    flat[warm:warm + n] = np.frombuffer(data, "uint8")
    rows = np.lib.stride_tricks.sliding_window_view(flat, core + 2 * warm)[::core][:count] if count else np.empty((0, core + 2 * warm), "uint8")
    lo = np.full(count, warm)
    return rows, lo, np.minimum(warm + core, warm + n - core * np.arange(count))


def training_sample(docs: DataFrame, learn: Column, text: str = "text", language: str = "lang", key: str = "doc_id", most: int = SAMPLE_DOCS) -> pd.DataFrame:
    """(lang, text) of a bounded sample: an equal share of each language by a hash of the key, a part of each text from
    a hashed place. Neither the key nor any other column reaches the network."""
    known = docs.where(learn & F.col(text).isNotNull() & F.col(language).isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy(F.col(language).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(most).collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "text": []})
    share = most / len(counts)
    chance = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, share / n)))])
    mixed = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("sample"))
    part = F.substring(F.col(text), (F.pmod(mixed, F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(1))) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    taken = known.where(F.pmod(F.shiftright(mixed, 20), F.lit(1 << 20)) / float(1 << 20) < chance[F.col(language)])
    return taken.select(F.col(language).alias("lang"), part.alias("text")).limit(2 * most).toPandas().sort_values(["lang", "text"], kind="stable")


def fit(sample: pd.DataFrame, width: int = 96, **settings) -> ByteNetwork | None:
    """A network fitted on the sample's texts in rows of `width` bytes; None without any."""
    languages = sorted(set(sample["lang"]))
    rows, labels, masks = [], [], []
    for lang, text in zip(sample["lang"], sample["text"], strict=True):
        x, lo, hi = windows(text.encode(), width - 2 * WARM)
        rows.append(x)
        labels += [languages.index(lang)] * len(x)
        t = np.arange(width)
        masks.append(((lo[:, None] <= t) & (t < hi[:, None])).astype("float32"))
    if not labels:
        return None
    network = ByteNetwork(languages)
    network.fit(np.concatenate(rows), np.array(labels), np.concatenate(masks), **settings)
    return network


def identify(docs: DataFrame, learn: Column, text: str = "text", language: str = "lang", key: str = "doc_id", most: int = SAMPLE_DOCS, rows_each: int = 4096) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to every row; columns of these names are replaced.

    The network is fitted on the driver on a bounded sample of the rows where `learn` holds; then every byte of every text
    is labelled, in overlapping windows, and a document's score is the mean probability of its best language (ties go to
    the first in order). A null text, or one without a letter, is `und` with score 0, and so is every text where nothing
    could be learned. Rows are independent: repeated rows get the same answer; an empty table gives an empty one.
    """
    network = fit(training_sample(docs, learn, text, language, key, most))
    model = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("lang_pred string, score double")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        network = model.value

        def flush(waiting: list, sums: np.ndarray) -> None:
            if waiting:
                owner = np.concatenate([np.full(len(x[1]), x[0]) for x in waiting])
                np.add.at(sums, owner, network.pooled(*(np.concatenate(c) for c in zip(*(x[1:] for x in waiting), strict=True))))

        for part in parts:
            texts = part.tolist()
            asked = [network is not None and bool(_LETTER.search(t)) for t in texts]
            sums = np.zeros((len(texts), len(network.languages) if network else 1))
            waiting: list = []
            size = 0
            for i, t in enumerate(texts):
                if not asked[i]:
                    continue
                x, lo, hi = windows(t.encode())
                for at in range(0, len(x), rows_each):
                    piece = slice(at, at + rows_each)
                    waiting.append((i, x[piece], lo[piece], hi[piece]))
                    size += len(x[piece])
                    if size >= rows_each:
                        flush(waiting, sums)
                        waiting, size = [], 0
            flush(waiting, sums)
            total = np.maximum(sums.sum(1), 1e-9)
            yield pd.DataFrame({"lang_pred": [network.languages[j] if ok else UNKNOWN for j, ok in zip(sums.argmax(1), asked, strict=True)], "score": np.where(asked, np.clip(sums.max(1) / total, 0, 1), 0.0)})

    found = docs.withColumn("_label", label(text_or_empty(text)))
    return found.withColumn("lang_pred", F.col("_label.lang_pred")).withColumn("score", F.col("_label.score")).drop("_label")
