"""Word n-grams of many texts at a time as 64-bit hashes in numpy: words from their bytes, each order from the one before it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_MIX, _OWNER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_BASE = 0x2545F4914F6CDD1D
_VALUE = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: No byte of UTF-8 has this value, so it can part texts.
_END = 255
#: What parts words: white space (of Java's ``\s``), where empty words do not count, or each single space, where they do.
BLANKS, SPACES = b" \t\n\x0b\f\r", b" "
#: Bytes of texts that are worked on at once.
SLICE = 1 << 20


def slices(sizes: list[int], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters at most; a single longer row stands alone."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if sizes:
        yield lo, len(sizes)


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _words(texts: list[str], parts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of each word: sums of byte values times powers, taken from running sums."""
    raw = np.frombuffer(b"\xff".join([t.encode("utf-8", "surrogatepass") for t in texts]) + b"\xff", np.uint8)
    parting = np.zeros(256, bool)
    parting[[*parts, _END]] = True
    ends = np.flatnonzero(parting[raw])
    starts = np.concatenate(([0], ends[:-1] + 1))
    owner = np.cumsum(raw[ends] == _END) - (raw[ends] == _END)
    if parts != SPACES:
        some = ends > starts
        starts, ends, owner = starts[some], ends[some], owner[some]
    size = 1 << max(len(raw), SLICE).bit_length()
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _powers(_BASE, size)[: len(raw)], out=run[1:])
    return _mixed((run[ends] - run[starts]) * _powers(pow(_BASE, -1, 2**64), size)[starts] + (ends - starts).astype(np.uint64) * _OWNER), owner


class Grams:
    """n-grams of each text: hashes and owners (numbers of texts), for one order after the other."""

    def __init__(self, texts: list[str], parts: bytes = BLANKS) -> None:
        made = [(lo, *_words(texts[lo:hi], parts)) for lo, hi in slices([len(t) for t in texts])]
        self._word = np.concatenate([np.empty(0, np.uint64), *[h for _, h, _ in made]])
        self._owner = np.concatenate([np.empty(0, np.int64), *[o + lo for lo, _, o in made]])

    def orders(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        run = self._word
        for n in range(1, most + 1):
            if n > 1:
                run = (_mixed(run[:-1]) + self._word[n - 1 :])[: max(len(self._word) - n + 1, 0)]
            own = self._owner[: len(run)]
            inside = own == self._owner[n - 1 :][: len(run)]
            yield run[inside] ^ np.uint64(n), own[inside]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the values, where each different one begins in that order, how often it stands there)."""
    order = np.argsort(values)
    rising = values[order]
    begins = np.flatnonzero(np.concatenate((np.ones(min(len(rising), 1), bool), rising[1:] != rising[:-1])))
    return order, begins, np.diff(begins, append=len(rising))


def counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, a place, count) of each n-gram of each owner, by rising key."""
    key = _mixed(hashes + owner.astype(np.uint64) * _OWNER)
    order, begins, n = runs(key)
    place = order[begins]
    return key[place], place, n


def shared(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the keys that both hold."""
    if not len(b[0]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = np.flatnonzero(b[0][at] == a[0])
    return hit, at[hit]
