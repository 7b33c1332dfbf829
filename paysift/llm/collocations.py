"""Phrase collocations by best-first branch-and-bound growth over prefixes.

A phrase's score is the least of floor(2,000,000 a / (l + r)) over its cuts, with a, l and r the occurrences of the phrase
and of its two parts. A prefix p bounds all that grows from it: their a is at most f(p), and r at least a, so no phrase
that begins with p scores above the least of floor(2,000,000 f(p) / (f(head) + f(p))) over p's own heads. Only prefixes
whose bound reaches the score that the last reported phrase has so far are grown, the best first, in batches: one pass
over the texts counts what a batch asks for. The search ends when no open prefix can reach that score any more and
every phrase at or above it is settled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysift.session import cut

from .common import slices, text_or_empty

COUNTS = "lang string, phrase string, n bigint"
BLOCK_BYTES = 4 << 20
_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, "uint8")
_KIND[list(b" \t")] = _SPACE
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_SMALL = np.arange(256, dtype="uint8")
_SMALL[65:91] += 32


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hashes(words: list) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False) if len(words) else np.empty(0, "uint64")


class PhraseSet:
    """A set of phrases as one bit per hash: whatever it holds, it has `bits` bits. It may say yes too often, never no."""

    def __init__(self, bits: int, kept: list[tuple[int, bytes]]):
        self.bits, self.flags = bits, np.zeros(bits // 8, "uint8")
        for bucket, flags in kept:
            self.flags[bucket * 4096:(bucket + 1) * 4096] = np.frombuffer(flags, "uint8")

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes % np.uint64(self.bits)).astype("int64")
        return (self.flags[at >> 3] >> (at & 7).astype("uint8") & 1).astype(bool)

    @staticmethod
    def of(phrases: DataFrame, bits: int) -> PhraseSet:
        """Of (lang, phrase) rows; what reaches the driver is at most bits / 8 bytes."""
        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = [p.split(" ") for p in batch.column(1).to_pylist()]
                h, size = _hashes(batch.column(0).to_pylist()), np.array([len(w) for w in words], "int64")
                for k in range(int(size.max(initial=0))):
                    longer = np.flatnonzero(size > k)
                    h[longer] = _mix(h[longer], _hashes([words[i][k] for i in longer]))
                at = (h % np.uint64(bits)).astype("int64")
                yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], ["bucket", "place"])

        kept = phrases.select("lang", "phrase").mapInArrow(places, "bucket bigint, place bigint")
        return PhraseSet(bits, [tuple(r) for r in kept.groupBy("bucket").agg(F.bitmap_construct_agg("place")).collect()])


class _Block:
    """The words of some texts: ids of (language, word), their hashes, and which words follow one another in a piece."""

    def __init__(self, batch: pa.RecordBatch):
        langs = batch.column(0).dictionary_encode()
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        raw = np.frombuffer(b"\n".join(texts) + b"\n", "uint8")
        kind = _KIND[raw]
        is_word = np.r_[False, kind == _WORD, False]
        edges = np.flatnonzero(is_word[1:] != is_word[:-1])
        starts, ends = edges[::2], edges[1::2]
        offsets = np.r_[0, np.cumsum(ends - starts)].astype("int64")
        letters = _SMALL[raw[is_word[1:-1]]]
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        row_ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, "int64")
        lang = langs.indices.to_numpy()[np.searchsorted(row_ends, starts, "right")].astype("int64")
        n_langs = max(1, len(langs.dictionary))
        self.ids, distinct = pd.factorize(words.indices.to_numpy().astype("int64") * n_langs + lang)
        piece = np.cumsum(kind == _BREAK)[starts]
        self.follows = piece[1:] == piece[:-1]
        self.words = words.dictionary.take(pa.array(distinct // n_langs)).cast(pa.large_string())
        self.langs = langs.dictionary.take(pa.array(distinct % n_langs))
        self.word_hash = _hashes(self.words.to_pylist())
        names = _hashes(langs.dictionary.to_pylist())
        self.hash = _mix(names[distinct % n_langs], self.word_hash)

    def rows(self, ids: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        """Counts of the phrases of these word ids, as (lang, phrase, n)."""
        import pyarrow.compute as pc

        parts = [self.words.take(pa.array(i)) for i in ids]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if len(parts) > 1 else parts[0]
        arrays = [self.langs.take(pa.array(ids[0])).cast(pa.string()), phrase.cast(pa.string()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "phrase", "n"])

    def joined(self, heads: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (head, tail) pairs of equal-long id arrays: (pair id of each row, heads, tails, rows per pair)."""
        wide = int(tails.max(initial=0)) + 1
        ids, distinct = pd.factorize(heads.astype("int64") * wide + tails)
        return ids, distinct // wide, distinct % wide, np.bincount(ids, minlength=len(distinct))


def _single_words(block: _Block) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of all words of each language under a null phrase."""
    n = np.bincount(block.ids, minlength=len(block.words))
    yield block.rows([np.arange(len(n))], n)
    arrays = [block.langs.cast(pa.string()), pa.nulls(len(n), pa.string()), pa.array(n, pa.int64())]
    total = pa.Table.from_arrays(arrays, ["lang", "phrase", "n"]).group_by("lang").aggregate([("n", "sum")])
    for b in total.to_batches():
        names = [b.column("lang"), pa.nulls(b.num_rows, pa.string()), b.column("n_sum")]
        yield pa.RecordBatch.from_arrays(names, ["lang", "phrase", "n"])


def _word_pairs(block: _Block, words: PhraseSet) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of frequent words."""
    often = words(block.hash)[block.ids]
    at = np.flatnonzero(block.follows & often[1:] & often[:-1])
    _, a, b, n = block.joined(block.ids[at], block.ids[at + 1])
    yield block.rows([a, b], n)


def _grown(block: _Block, words: PhraseSet, sets: dict[str, PhraseSet]) -> Iterator[pa.RecordBatch]:
    """Counts of phrases one word longer than those to grow (as their prefix) or to check (as their suffix), and of those asked for.

    Phrases with an infrequent pair inside are left out early: they are infrequent themselves.
    """
    def one_of(names: list[str], hashes: np.ndarray) -> np.ndarray:
        return reduce(np.logical_or, (sets[s](hashes) for s in names if s in sets), np.zeros(len(hashes), bool))

    often = words(block.hash)[block.ids]
    at = np.flatnonzero(block.follows & often[1:] & often[:-1])
    pair, a, b, _ = block.joined(block.ids[at], block.ids[at + 1])
    pair_hash = _mix(block.hash[a], block.word_hash[b])
    kept = sets["pairs"](pair_hash)[pair]
    at, pair = at[kept], pair[kept]
    two = np.flatnonzero(at[1:] == at[:-1] + 1)  # places in `at` where three words follow one another
    third = block.ids[at[two] + 2] if len(two) else np.empty(0, "int64")
    triple, head, last, n = block.joined(pair[two], third)
    triple_hash = _mix(pair_hash[head], block.word_hash[last])
    tail = np.zeros(len(head), "int64")
    tail[triple] = pair[two + 1]
    found = one_of(["grow2"], pair_hash)[head] | one_of(["check2"], pair_hash)[tail] | one_of(["ask3"], triple_hash)
    yield block.rows([a[head[found]], b[head[found]], last[found]], n[found])
    if not {"grow3", "check3"} & set(sets):
        return
    four = np.flatnonzero(two[1:] == two[:-1] + 1)
    grows, checks = one_of(["grow3"], triple_hash), one_of(["check3"], triple_hash)
    four = four[grows[triple[four]] | checks[triple[four + 1]]]
    _, head, last, n = block.joined(triple[four], last[triple[four + 1]])
    pairs_of, thirds_of = np.zeros(len(triple_hash), "int64"), np.zeros(len(triple_hash), "int64")
    pairs_of[triple], thirds_of[triple] = pair[two], third
    first = pairs_of[head]
    yield block.rows([a[first], b[first], thirds_of[head], last], n)


def _counted(texts: DataFrame, step, *sets) -> DataFrame:
    """(lang, phrase, n) by one pass over (lang, text) rows: counts per block of texts, summed by Spark map-side first."""
    shared = texts.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4096, BLOCK_BYTES):
            yield from step(_Block(batch), *shared.value)

    return texts.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _share(a: Column, of: Column) -> Column:
    """floor(2,000,000 a / of), exactly: the product is a decimal of 38 digits."""
    return F.call_function("div", a.cast("decimal(30,0)") * F.lit(2_000_000).cast("decimal(8,0)"), of)


def _sum(l: Column, r: Column) -> Column:
    return l.cast("decimal(20,0)") + r.cast("decimal(20,0)")


def _scored(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a) with size, the deciding cut's l and r, score, bound, and whether all parts are counted.

    A part not counted yet stands at a, the least it can be, so the score is then an upper bound.
    """
    words = F.split("phrase", " ")
    cuts = nodes.select("lang", "phrase", "a", F.size(words).alias("size"), words.alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "a", "size", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"),
    )
    both = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"], "left")
    both = both.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"], "left")
    l, r, a = F.coalesce("l", "a"), F.coalesce("r", "a"), F.col("a")
    best = F.min(F.struct(_share(a, _sum(l, r)).alias("score"), "k", l.alias("l"), r.alias("r")))
    return both.groupBy("lang", "phrase", "a", "size").agg(
        best.alias("best"), F.min(_share(a, _sum(l, a))).alias("bound"), F.bool_and(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("exact"),
    ).select("lang", "phrase", "a", "size", "best.l", "best.r", "best.score", "bound", "exact")


def _with_levels(nodes: DataFrame, top: int, contained: int) -> DataFrame:
    """Nodes with `dropped` (as far as known), `level`, their language's `top`-th best score of those not dropped, and `reach`, a
    level low enough to hold `top` survivors if as many are dropped further down as were so far (half at first)."""
    w = F.split("phrase", " ")
    size = F.size(w)
    inner = F.explode(F.array(F.array_join(F.slice(w, 1, size - 1), " "), F.array_join(F.slice(w, 2, size - 1), " "))).alias("phrase")
    longer = nodes.where("size > 2").select("lang", inner, "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    known = nodes.join(longer, ["lang", "phrase"], "left")
    known = known.withColumn("dropped", F.coalesce(100 * F.col("longer") >= contained * F.col("a"), F.lit(False))).drop("longer")
    stays = ~F.col("dropped") & F.col("exact") & ((F.col("size") == 4) | (F.col("grown") & F.col("checked")))
    of_score = known.groupBy("lang", "score").agg(
        F.count_if(~F.col("dropped")).alias("open"), F.count_if(stays).alias("stay"), F.count_if(F.col("dropped")).alias("gone"))
    down = Window.partitionBy("lang").orderBy(F.desc("score"))
    every = Window.partitionBy("lang")
    ranked = of_score.select("lang", "score", F.sum("open").over(down).alias("rank"), F.sum("stay").over(every).alias("stay"), F.sum("gone").over(every).alias("gone"))
    share = F.greatest(F.lit(0.05), F.when(F.col("stay") + F.col("gone") > 0, F.col("stay") / (F.col("stay") + F.col("gone"))).otherwise(0.5))
    wanted = F.greatest(F.lit(top), F.col("stay") + 1.2 * (top - F.col("stay")) / share)
    levels = ranked.groupBy("lang").agg(
        F.coalesce(F.max(F.when(F.col("rank") >= top, F.col("score"))), F.lit(0)).alias("level"),
        F.coalesce(F.max(F.when(F.col("rank") >= wanted, F.col("score"))), F.lit(0)).alias("reach"),
    )
    return known.join(levels, "lang")


def _due(level: str) -> dict[str, Column]:
    """What is still open at or above a level: prefixes to grow, phrases to check for longer ones, parts to count."""
    short, reached = F.col("size") < 4, ~F.col("dropped") & (F.col("score") >= F.col(level))
    return {
        "grow": short & ~F.col("grown") & (F.col("bound") >= F.col(level)),
        "check": short & ~F.col("checked") & reached,
        "ask": ~F.col("exact") & reached,
    }


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, top: int = 2000, contained: int = 80, bits: int = 1 << 25) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` best phrases of two to four words.

    A-Z are lower-cased, texts are split at `.,;:!?` and line ends into pieces and those at spaces and tabs into words.
    Candidates occur `least` times; one whose words lie in a longer candidate that occurs at least `contained` percent as
    often is dropped. Order: score, then a, both descending, then phrase by its UTF-8 bytes. A null text counts as empty,
    a null language is `und`; repeated rows count each; an empty table, or one without candidates, gives no rows.

    All counts are over all texts. A pass over the texts counts per block and then by a shuffle of distinct phrases; which
    phrases a pass counts is told by sets of `bits` bits (see PhraseSet), whatever the number of phrases. Containment needs
    one-word extensions only: a phrase between a candidate and a longer one occurs at least as often as the longer one.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))
    single = cut(_counted(texts, _single_words).where(F.col("phrase").isNull() | (F.col("n") >= least)))
    words = single.where("phrase IS NOT NULL")
    frequent = PhraseSet.of(words, bits)
    pairs = cut(_counted(texts, _word_pairs, frequent).where(F.col("n") >= least))
    known_pairs = PhraseSet.of(pairs, bits)
    fresh = [F.lit(False).alias("grown"), F.lit(False).alias("checked")]
    nodes = cut(_scored(pairs.withColumnRenamed("n", "a"), words).select("*", *fresh))
    while True:
        state = cut(_with_levels(nodes, top, contained))
        if state.where(reduce(Column.__or__, _due("level").values())).isEmpty():
            break
        due = _due("reach")
        sets = {"pairs": known_pairs}
        for name in ("grow", "check"):
            for size in (2, 3):
                sets[f"{name}{size}"] = PhraseSet.of(state.where(due[name] & (F.col("size") == size)), bits)
        w = F.split("phrase", " ")
        parts = F.explode(F.array(F.array_join(F.slice(w, 1, 3), " "), F.array_join(F.slice(w, 2, 3), " "))).alias("phrase")
        sets["ask3"] = PhraseSet.of(state.where(due["ask"]).select("lang", parts), bits)
        found = cut(_counted(texts, _grown, frequent, sets).where(F.col("n") >= least))
        new = found.join(nodes.select("lang", "phrase"), ["lang", "phrase"], "left_anti").withColumnRenamed("n", "a")
        counts = words.unionByName(nodes.select("lang", "phrase", F.col("a").alias("n"))).unionByName(new.select("lang", "phrase", F.col("a").alias("n")))
        kept = nodes.columns
        old = state.withColumns({"grown": F.col("grown") | due["grow"], "checked": F.col("checked") | due["check"]}).select(kept)
        again = _scored(old.where("NOT exact").select("lang", "phrase", "a"), counts).join(old.select("lang", "phrase", "grown", "checked"), ["lang", "phrase"])
        nodes = cut(old.where("exact").unionByName(again.select(kept)).unionByName(_scored(new, counts).select("*", *fresh).select(kept)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = state.where(~F.col("dropped") & (F.col("score") >= F.col("level"))).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    totals = single.where("phrase IS NULL").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
