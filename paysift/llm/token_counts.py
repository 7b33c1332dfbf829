"""Token counts by a two-tier map-side lookup of pre-token lengths."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .pretokens import PieceCache

FREQUENT = 8192
FAN_IN = 32


def _shrink(counts: Counter, k: int) -> Counter:
    """Misra-Gries: keep the k largest, less the largest count that goes."""
    if len(counts) <= k:
        return counts
    top = counts.most_common(k + 1)
    less = top[-1][1]
    return Counter({t: n - less for t, n in top[:-1] if n > less})


def frequent_words(docs: DataFrame, text: str = "text", k: int = FREQUENT) -> list[str]:
    """About the k most frequent words of all texts, heaviest first, by mergeable summaries of at most k words.

    Every task keeps one bounded summary (Misra-Gries) of all its texts and the summaries are merged FAN_IN at a time, so
    what meets in a task, and what reaches the driver, is bounded by k words whatever the corpus.
    """
    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        kept: Counter = Counter()
        for frame in frames:
            for lo in range(0, len(frame), 512):
                for t in frame["text"].iloc[lo:lo + 512]:
                    kept.update(t.split(" "))
                kept = _shrink(kept, 16 * k)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "words": [json.dumps(_shrink(kept, k))]})

    def merge(key, frame: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        for w in frame["words"]:
            total.update(json.loads(w))
        return pd.DataFrame({"part": [int(key[0])], "words": [json.dumps(_shrink(total, k))]})

    source = docs.select(text_or_empty(text).alias("text"))
    left = source.rdd.getNumPartitions()
    summaries = source.mapInPandas(summarise, "part int, words string")
    while left > 1:
        summaries = summaries.groupBy(F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).applyInPandas(merge, "part int, words string")
        left = -(-left // FAN_IN)
    found = summaries.collect()
    return [w for row in found for w, _ in sorted(json.loads(row["words"]).items(), key=lambda x: (-x[1], x[0]))]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", frequent: int = FREQUENT, limit: int = 512, room: int = 400_000) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to every row; columns of these names are replaced.

    n_tokens is what the byte-level BPE file `vocabulary` gives for the whole text, special strings handled as the
    library's default, nothing added. First tier: lengths of the `frequent` most frequent pre-tokens, broadcast (at most
    `frequent` entries). Second tier: a cache in each worker that encodes what it has not seen. Pre-tokens are never
    shuffled. A null text counts as empty (0 tokens); repeated rows are counted each; an empty table gives an empty one.
    """
    words = frequent_words(docs, text, frequent)
    cache = PieceCache(vocabulary, "byte", len)
    keep = [w for w in (" " + w for w in words) if cache.split.fullmatch(w)]
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(keep, cache.encode(keep), strict=True)))

    @F.pandas_udf("bigint")
    def lengths(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = PieceCache(vocabulary, "byte", len, table.value, room)
        for part in parts:
            texts = part.tolist()
            out: list[int] = []
            for lo in range(0, len(texts), 256):
                out += map(sum, pieces(texts[lo:lo + 256]))
            yield pd.Series(out, dtype="int64")

    whole = text_or_empty(text)
    return docs.withColumn("n_tokens", lengths(whole)).withColumn("n_bytes", F.octet_length(whole).cast("bigint")).withColumn("over_limit", F.col("n_tokens") > limit)
