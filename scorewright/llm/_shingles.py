"""Sets of hashed word shingles of many texts at a time, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

SHINGLE = 5
_RANDOM = np.random.default_rng(20240229)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _RANDOM.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _powers = out[0], out[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word: sums of byte values times powers, taken from running sums."""
    gap = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(raw) and not gap[0]:
        edge = np.concatenate(([0], edge))
    if len(raw) and not gap[-1]:
        edge = np.concatenate((edge, [len(raw)]))
    start, end = edge[::2], edge[1::2]
    up, down = _power_tables(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=run[1:])
    return start, mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_BASE))


def shingle_sets(texts: list, most: int = 2 << 20) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's five-word shingles; a shorter text is one shingle, none if empty."""
    group, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if group and size + len(raw) > most:
            yield from _sets(group)
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    yield from _sets(group)


def _sets(group: list[bytes]) -> Iterator[np.ndarray]:
    raw = np.frombuffer(b"\n".join(group), np.uint8)
    ends = np.cumsum([len(g) + 1 for g in group])
    start, words = _word_hashes(raw)
    upto = np.searchsorted(start, ends).tolist()
    n = max(len(words) - SHINGLE + 1, 0)
    run = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        run += words[k : n + k] * _PLACE[k]
    run = mix(run)
    lo = 0
    for hi in upto:
        if hi - lo >= SHINGLE:
            own = np.sort(run[lo : hi - SHINGLE + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif hi > lo:
            short = (words[lo:hi] * _PLACE[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.empty(0, np.uint64)
        lo = hi


def set_key(shingles: np.ndarray) -> bytes:
    """128-bit digest of a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
