"""Splitting texts into pre-tokens and encoding each distinct pre-token once per worker.

Only texts of the characters below take the short way, because there Python's and the tokenizer library's Unicode
tables agree; any other text, and any text that may hold a special token, is given to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable
from itertools import chain

_RANGE = [
    c for c in range(0x250)
    if c in (9, 10, 13) or 0x20 <= c <= 0x7E or (0xA1 <= c != 0xAD and len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 0x250)
]
_OTHER = re.compile("[^" + "".join(re.escape(chr(c)) for c in _RANGE) + "]|<\\|")


def _kind(letter: str) -> str:
    return "".join(re.escape(chr(c)) for c in _RANGE if unicodedata.category(chr(c))[0] == letter)


# fixed values: the split patterns of the two public vocabularies, with the letters and digits of the range above
_ENDS = "'s|'t|'re|'ve|'m|'ll|'d"
SPLITS = {
    "byte": re.compile(rf"{_ENDS}| ?[{_kind('L')}]+| ?[{_kind('N')}]+| ?[^\s{_kind('L')}{_kind('N')}]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"{_ENDS}|[{_kind('L')}]+|[{_kind('N')}]|[^\s{_kind('L')}{_kind('N')}]+"),
}


def load(path: str):
    """The tokenizer, single-threaded: Spark gives each task its core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceCache:
    """Maps whole texts to lists of per-pre-token values: a fixed table of frequent ones, then a worker cache.

    `value` turns the ids of one pre-token (or of one whole text) into what is kept. The worker cache is emptied when it
    holds `room` entries, so memory stays bounded on any corpus; results do not depend on it.
    """

    def __init__(self, path: str, kind: str, value: Callable, frequent: dict | None = None, room: int = 800_000):
        self.tokenizer, self.split, self.value, self.lower = load(path), SPLITS[kind], value, kind == "word"
        self.frequent, self.room, self.cache = frequent or {}, room, dict(frequent or {})

    def encode(self, texts: list[str]) -> list:
        return [self.value(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[list]:
        odd = [i for i, t in enumerate(texts) if _OTHER.search(t)]
        whole = dict(zip(odd, self.encode([texts[i] for i in odd]), strict=True)) if odd else {}
        parts = [[] if i in whole else self.split.findall(t.lower() if self.lower else t) for i, t in enumerate(texts)]
        missing = list(set(chain.from_iterable(parts)).difference(self.cache))
        if missing:
            if len(self.cache) - len(self.frequent) + len(missing) > self.room:
                self.cache = dict(self.frequent)
                missing = list(set(chain.from_iterable(parts)).difference(self.cache))
            self.cache.update(zip(missing, self.encode(missing), strict=True))
        get = self.cache.__getitem__
        return [[whole[i]] if i in whole else list(map(get, p)) for i, p in enumerate(parts)]


_KEPT: dict[tuple, PieceCache] = {}


def kept_cache(path: str, kind: str, value: Callable, frequent: dict | None = None, room: int = 800_000) -> PieceCache:
    """The cache of this worker process, kept from task to task."""
    key = (path, kind, value.__name__, room)
    if key not in _KEPT:
        _KEPT[key] = PieceCache(path, kind, value, frequent, room)
    kept = _KEPT[key]
    if frequent and kept.frequent != frequent:
        kept.frequent = frequent
        kept.cache.update(frequent)
    return kept


def forget_caches() -> None:
    """Gives back this worker process's caches, in tasks that need the memory and no cache."""
    _KEPT.clear()


def id_bytes(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit numbers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()
