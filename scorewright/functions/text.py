"""Column builders for text: normalisers, tokenisers, edit distances, n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from scorewright.functions.grams import BLANKS, SPACES, Grams, counted, shared, slices

#: Word edges are written out: what \b means differs between Java versions.
ARTICLES = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def squad_normalize(text: Column) -> Column:
    """Lower case without ASCII punctuation and articles, single spaces."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), ARTICLES, " "))


def tokens(text: Column) -> Column:
    """Tokens between white space; none for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and marks, or else single characters that are no space."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{M}]+|\S"), F.lit(0))


def strict_number(text: Column) -> Column:
    """Double of a plain number with an optional trailing percent sign; null otherwise."""
    plain = F.regexp_replace(F.trim(text), "%$", "")
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.cast("double"))


def circled_digits(text: Column) -> Column:
    return F.translate(text, "①②③④⑤⑥⑦⑧⑨", "123456789")


def ngrams(words: Column, n: int) -> Column:
    """Space-joined n-grams, repeats kept; none for fewer than n words."""

    def grams(words: Column) -> Column:
        last = F.size(words) - (n - 1)
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    # The outer array binds the words to a name, so that they are made once for a text and not once for each n-gram.
    return F.transform(F.array(words), grams)[0]


def count_in(items: Column, item: Column) -> Column:
    return F.size(F.filter(items, lambda x: x == item))


def ned(label: Column, prediction: Column, uncased: bool = True) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty texts."""
    a, b = (F.lower(label), F.lower(prediction)) if uncased else (label, prediction)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _same(a: list | str, b: list | str, most: int) -> int:
    """How many of the first ``most`` places are alike, by comparing ever smaller slices."""
    at, step = 0, 64
    while at < most and a[at : at + step] == b[at : at + step]:
        at, step = at + step, 2 * step
    if at >= most:
        return most
    end = min(at + step, most)
    while at < end:
        half = (at + end + 1) // 2
        if a[at:half] == b[at:half]:
            at = half
        else:
            end = half - 1
    return at


def _trimmed(a: list | str, b: list | str) -> tuple[list | str, list | str, int]:
    """Both without their common start and end, and how much of that went at the start: a best alignment keeps those."""
    start = _same(a, b, min(len(a), len(b)))
    a, b = a[start:], b[start:]
    most = min(len(a), len(b))
    end = _same(a[: -most - 1 : -1], b[: -most - 1 : -1], most)
    return a[: len(a) - end], b[: len(b) - end], start


def _places(words: list | str) -> dict:
    """Positions of each word as bits of one number."""
    found: dict = {}
    for i, w in enumerate(words):
        found.setdefault(w, []).append(i)
    size = len(words) // 8 + 1

    def bits(places: list[int]) -> int:
        if len(places) == 1:
            return 1 << places[0]
        out = bytearray(size)
        for i in places:
            out[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(out, "little")

    return {w: bits(places) for w, places in found.items()}


def _within(a: list | str, b: list | str, most: int, columns: list | None = None) -> int:
    """Edit distance if it is at most ``most``; else some number of edits that does.

    A column of the table of distances (a place in ``b``) is held as the bits of its rises and falls, and only over the
    rows (places in ``a``) that an alignment of ``most`` edits can reach; these move on in steps.  Cells above them count
    as one more than the cell before.  ``columns`` gets (first row, rises, falls) of each column.
    """
    n, m = len(a), len(b)
    spare = max(most - abs(n - m), 0) // 2
    below, above = max(n - m, 0) + spare, max(m - n, 0) + spare
    step = m if below >= n else max(128, (below + above) // 4)
    lo = hi = top = rises = falls = 0
    for j in range(0, m, step):
        part = b[j : j + step]
        first, last = min(max(0, j - above), n), min(n, j + len(part) + below)
        gone = (1 << first - lo) - 1
        top += (rises & gone).bit_count() - (falls & gone).bit_count()
        rises, falls = rises >> first - lo | (1 << last - first) - (1 << hi - first), falls >> first - lo
        lo, hi, every = first, last, (1 << last - first) - 1
        places = _places(a[lo:hi])
        for w in part:
            same = places.get(w, 0)
            level = (((same & rises) + rises) ^ rises) | same
            up, down = falls | ~(level | rises) & every, rises & level
            up, down, same = (up << 1 | 1) & every, down << 1 & every, same | falls
            rises, falls = down | ~(same | up) & every, up & same
            if columns is not None:
                columns.append((lo, rises, falls))
        top += len(part)
    return top + rises.bit_count() - falls.bit_count()


def _bounded(a: list | str, b: list | str, columns: list | None = None) -> int:
    """Edit distance of two texts that are not empty, in a band that widens until it holds a best alignment."""
    apart = abs(len(a) - len(b))
    most = apart + max(64, min(len(a), len(b)) // 64)
    while True:
        if columns is not None:
            columns.clear()
        found = _within(a, b, most, columns)
        if found <= most:
            return found
        wider = min(found, apart + 8 * (most - apart))
        most = len(a) + len(b) if 4 * wider > len(a) else wider  # a wide band costs more than the whole table


def _edits(a: list | str, b: list | str) -> int:
    """Edit distance: without what both begin and end with; where the shorter one lies within the longer one, what is left."""
    a, b, _ = _trimmed(a, b)
    if len(a) < len(b):
        a, b = b, a
    rest = iter(a)
    if all(w in rest for w in b):
        return len(a) - len(b)
    return _bounded(a, b)


def _common(a: list | str, b: list | str) -> int:
    """Length of the longest common subsequence, a row of its table held as bits."""
    whole = len(a)
    a, b, _ = _trimmed(a, b)
    kept = whole - len(a)
    places, every = _places(a), (1 << len(a)) - 1
    row = every
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & every
    return kept + len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Word-level edit distance of two texts."""
    return pd.Series([_edits((x or "").split(), (y or "").split()) for x, y in zip(a, b)])


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words of the longest common subsequence of two texts."""
    return pd.Series([_common((x or "").split(), (y or "").split()) for x, y in zip(a, b)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def char_edits(labels: pd.Series, prediction: pd.Series) -> pd.Series:
    """Edit distance in characters of a text from each label; null for a null one."""
    far = lambda x, y: None if x is None or y is None else _edits(x, y)
    return pd.Series([None if names is None else [far(x, text) for x in names] for names, text in zip(labels, prediction, strict=True)])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def gram_overlaps(labels: pd.Series, prediction: pd.Series, order: pd.Series) -> pd.Series:
    """For each label (shared, of the label, of the text) word n-grams for n = 1, 2, .. one after another; repeats count."""
    return pd.Series(_by_slices(labels, prediction, lambda names, texts, most: _overlaps(names, texts, int(most), BLANKS), order))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def set_overlaps(labels: pd.Series, prediction: pd.Series, order: pd.Series) -> pd.Series:
    """For each label (shared, of the label, of the text) different n-grams of a split at each space, as above."""
    return pd.Series(_by_slices(labels, prediction, lambda names, texts, most: _overlaps(names, texts, int(most), SPACES, once=True), order))


def _different(values: np.ndarray) -> np.ndarray:
    """Different values in order."""
    values.sort()
    return values[np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1]))]


def _trigrams(text: str) -> np.ndarray:
    """Different runs of three characters as numbers, 21 bits a character; a shorter text is one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    codes = np.concatenate((codes, np.zeros(max(3 - len(codes), 0), np.uint64)))
    return _different(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:])


@F.pandas_udf(T.DoubleType())
def trigram_share(reference: pd.Series, text: pd.Series) -> pd.Series:
    """Per cent of the different trigrams of a reference that a text holds."""

    def share(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        a, b = _trigrams(x), _trigrams(y)
        return 100.0 * (len(a) + len(b) - len(_different(np.concatenate((a, b))))) / len(a)

    return pd.Series([share(x, y) for x, y in zip(reference, text, strict=True)], dtype=object)


def _by_slices(labels: pd.Series, prediction: pd.Series, make: Callable, order: pd.Series) -> list:
    """Results for rows in slices of bounded size, rows with another order apart."""
    names = [[x or "" for x in n] if n is not None else [] for n in labels]
    texts = [t or "" for t in prediction]
    most = order.to_numpy()
    out: list = [None] * len(texts)
    for kind in pd.unique(most):
        rows = [i for i, k in enumerate(most) if k == kind]
        for lo, hi in slices([len(texts[i]) + sum(map(len, names[i])) for i in rows]):
            part = rows[lo:hi]
            for i, x in zip(part, make([names[i] for i in part], [texts[i] for i in part], kind), strict=True):
                out[i] = x
    return out


def _overlaps(names: list[list[str]], texts: list[str], most: int, parts: bytes, once: bool = False) -> list[list[list[int]]]:
    """Numbers of shared and own n-grams of each label and its text; ``once``: different ones only."""
    out = [[[0] * (3 * most) for _ in n] for n in names]
    count = lambda c: np.ones(len(c[0]), np.int64) if once else c[2]
    sides = [(c, own) for hashes, own in Grams(texts, parts).orders(most) for c in [counted(hashes, own)]]
    for k in range(max(map(len, names), default=0)):
        rows = [i for i, n in enumerate(names) if len(n) > k]
        for n, (hashes, own) in enumerate(Grams([names[i][k] for i in rows], parts).orders(most)):
            own = np.array(rows, np.int64)[own]
            a, (c, mine) = counted(hashes, own), sides[n]
            i, j = shared(a, c)
            both = np.bincount(own[a[1]][i], np.minimum(count(a)[i], count(c)[j]), len(texts))
            its, ours = np.bincount(own[a[1]], count(a), len(texts)), np.bincount(mine[c[1]], count(c), len(texts))
            for row in rows:
                out[row][k][3 * n : 3 * n + 3] = int(both[row]), int(its[row]), int(ours[row])
    return out
