"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up the rank of every adjacent pair by binary search over
the sorted pair keys and merges, in every word at once, the pairs of lowest rank. Nothing is encoded by the tokenizer
library; of it only the normalizer and the pre-tokenizer are used, for stretches of text with uncommon characters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructType

from .common import slices, text_or_empty, with_row_columns
from .pretokens import _OTHER, SPLITS, load

_NONE = np.iinfo(np.int64).max
_CHUNKS = re.compile(r"[^ \t\n\r]+")
LONGEST_KEPT = 64


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    spare = count(256)
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Pair ranks and token texts of a BPE file with byte-level symbols and a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], "int64")
        self.last = np.array([vocab[c + suffix] for c in letters], "int64")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(*vocab.values(), *self.special.values())
        left, right, made = (np.array(x, "int64") for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]), strict=True))
        self._check_order(left, right, made)
        keys = left * self.size + right
        self.rank = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[self.rank], made[self.rank]
        texts = [b""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            texts[i] = token.encode()
        # no merge below a pair's rank can reach it from further than the longest token
        self.reach = max(len(t.removesuffix(suffix)) for t in vocab)
        self.text = np.frombuffer(b" ".join(texts) + b" ", "uint8")
        self.text_length = np.array([len(t) + 1 for t in texts], "int64")
        self.text_start = np.cumsum(self.text_length) - self.text_length

    @staticmethod
    def _check_order(left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        """Rounds give the same result as one merge at a time only if a merge comes after those that made its parts."""
        latest = np.full(max(left.max(), right.max(), made.max()) + 1, -1)
        np.maximum.at(latest, made, np.arange(len(made)))
        if (np.maximum(latest[left], latest[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge of this vocabulary precedes the merges that make its parts")

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in one array, ids per word) of non-empty words."""
        lengths = np.fromiter(map(len, words), "int64", len(words))
        raw = np.frombuffer(b"".join(words), "uint8")
        ids = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        ids[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            rank, made = self._ranks(ids, word)
            first = np.r_[0, np.flatnonzero(np.diff(word)) + 1]
            live = np.minimum.reduceat(rank, first) < _NONE
            if not live.all():
                keep = np.repeat(live, np.diff(np.r_[first, len(ids)]))
                done.append((word[~keep], ids[~keep]))
                ids, word, rank, made = ids[keep], word[keep], rank[keep], made[keep]
                if not len(ids):
                    break
            take = self._lowest(rank, word)
            ids[take] = made[take]
            stay = np.ones(len(ids), bool)
            stay[np.flatnonzero(take) + 1] = False
            ids, word = ids[stay], word[stay]
        if not done:
            return np.empty(0, "int64"), np.zeros(len(words), "int64")
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _ranks(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of the pair that starts at each symbol, and what it makes; _NONE where there is no merge."""
        pair = np.full(len(ids), -1)
        pair[:-1] = np.where(word[:-1] == word[1:], ids[:-1] * self.size + ids[1:], -1)
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank[at], _NONE), self.made[at]

    def _lowest(self, rank: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where to merge now: the pairs of lowest rank of each word.

        A word longer than `reach` is taken in blocks of that length. A block merges its lowest pairs if neither
        neighbouring block holds a lower one: what could still change such a pair beforehand lies within reach of it. So
        the rounds do not grow with the length of a word. Overlapping equal pairs are merged from the left.
        """
        n, here = len(rank), np.arange(len(rank))
        first = np.r_[True, word[1:] != word[:-1]]
        offset = here - np.maximum.accumulate(np.where(first, here, 0))
        start = np.flatnonzero(offset % self.reach == 0)
        low, of = np.minimum.reduceat(rank, start), word[start]
        beside = of[1:] == of[:-1]
        ready = low < _NONE
        ready[1:] &= ~beside | (low[1:] <= low[:-1])
        ready[:-1] &= ~beside | (low[:-1] <= low[1:])
        size = np.diff(np.r_[start, n])
        take = np.repeat(ready, size) & (rank == np.repeat(low, size))
        run = np.maximum.accumulate(np.where(np.r_[True, (rank[1:] != rank[:-1]) | (rank[1:] == _NONE)], here, 0))
        missed = np.cumsum(~take)
        return take & (missed == missed[run] - ~take[run]) & ((here - run) % 2 == 0)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The token texts of each list of ids, joined by single spaces as the vocabulary file, which has no decoder, asks."""
        sizes = self.text_length[ids]
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        flat = self.text[np.repeat(self.text_start[ids] - ends + sizes, sizes) + np.arange(total)].tobytes()
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(lengths)]].tolist()
        return [flat[a:max(a, b - 1)] for a, b in zip(bounds, bounds[1:], strict=False)]


class Codec:
    """Encodes whole texts; the ids of pre-tokens are kept in a bounded cache."""

    def __init__(self, path: str, room: int = 400_000):
        self.table, self.tokenizer, self.room = MergeTable(path), load(path), room
        self.bytes_of = {c: b for b, c in enumerate(byte_letters())}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.table.special)) + ")")
        self.fixed: dict = {(t,): np.array([i], "<u4").tobytes() for t, i in self.table.special.items()}
        self.cache = dict(self.fixed)

    def _words(self, text: str) -> list:
        """The pre-tokens: strings where all characters are common, bytes from stretches (between white space) with others.

        A special token stands as a tuple.
        """
        if not _OTHER.search(text):
            return SPLITS["word"].findall(text.lower())
        out: list = []
        for i, part in enumerate(self.specials.split(text) if self.table.special else [text]):
            if i % 2:
                out.append((part,))
                continue
            for chunk in _CHUNKS.findall(part):
                if _OTHER.search(chunk):
                    normal = self.tokenizer.normalizer.normalize_str(chunk)
                    pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
                    out += [bytes(map(self.bytes_of.__getitem__, w)) for w, _ in pieces if w]
                else:
                    out += SPLITS["word"].findall(chunk.lower())
        return out

    def _encode_words(self, words: list[str | bytes]) -> list[bytes]:
        ids, n = self.table.encode_words([w.encode() if isinstance(w, str) else w for w in words])
        ends = (4 * np.cumsum(n)).tolist()
        flat = ids.astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit numbers."""
        parts = [self._words(t) for t in texts]
        distinct = set(chain.from_iterable(parts))
        missing = list(distinct.difference(self.cache))
        if len(self.cache) + len(missing) > self.room:
            self.cache = dict(self.fixed)
            missing = list(distinct.difference(self.cache))
        if missing:
            self.cache.update(zip(missing, self._encode_words(missing), strict=True))
        out = [b"".join(map(self.cache.__getitem__, p)) for p in parts]
        for w in missing:
            if len(w) > LONGEST_KEPT:
                del self.cache[w]
        return out


_KEPT: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    """The codec of this worker process, kept from task to task."""
    if path not in _KEPT:
        _KEPT[path] = Codec(path)
    return _KEPT[path]


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Adds `ids`, the whole text's token ids as little-endian unsigned 32-bit numbers; a column of this name is replaced.
    A column bpe_text is dropped.

    A special token inside a text becomes its id, as by the library's default. A null text counts as empty and has no
    ids; texts of any length are encoded whole; repeated rows are encoded each; an empty table gives an empty one. One
    pass without a shuffle; memory is bounded by the longest text and a fixed number of kept words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary)
        for batch in slices(batches, "bpe_text"):
            i = batch.schema.get_field_index("bpe_text")
            ids = pa.array(codec.encode(batch.column(i).to_pylist()), pa.binary())
            yield with_row_columns(batch.drop_columns(["bpe_text"]), {"ids": ids})

    return _mapped(docs.drop("ids"), text_or_empty(text), run, "ids", BinaryType())


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded`, the text of a binary column of ids (as `encode` writes it), special tokens kept.

    The word-level vocabulary has no decoder, so the tokens are joined by spaces. Null or empty ids give an empty text.
    """
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _codec(vocabulary).table
        for batch in slices(batches, "bpe_text", max_bytes=1 << 20):
            raw = batch.column(batch.schema.get_field_index("bpe_text")).to_pylist()
            numbers = np.frombuffer(b"".join(raw), "<u4").astype("int64")
            texts = table.decode(numbers, np.array([len(x) // 4 for x in raw], "int64"))
            yield with_row_columns(batch.drop_columns(["bpe_text"]), {"decoded": pa.array(texts, pa.binary()).cast(pa.string())})

    return _mapped(encoded.drop("decoded"), F.coalesce(F.col(f"`{ids}`"), F.lit(b"")), run, "decoded", StringType())


def _mapped(df: DataFrame, value, run, name: str, kind) -> DataFrame:
    """The rows of df through `run`, which gets `value` as the column bpe_text beside all others and adds `name`."""
    schema = StructType([f for f in df.schema.fields if f.name != "bpe_text"]).add(name, kind)
    return df.withColumn("bpe_text", value).mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Every row with its `ids` and their `decoded` text; both columns are replaced if the input has them."""
    return decode(encode(docs, vocabulary, text), vocabulary)
