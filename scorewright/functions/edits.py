"""Alignments with their operations: error rates on marked words, and soft repetition by a suffix automaton of tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F, types as T

from scorewright.functions.text import _bounded, _trimmed

#: Stands at the end of both texts, so that some word is always outside the marked ones.
REST_WORD = "뷁"
_TAG = re.compile(r"<tag\s+([^>]*)>")


def edit_script(a: list, b: list) -> list[tuple[str, int, int]]:
    """(operation, place in a, place in b) of a best alignment: deletions before insertions before changes, from the end.

    Columns of the table of distances are kept as the bits of their rises and falls, in a band that holds every best
    alignment, and the way back reads them.
    """
    x, y, start = _trimmed(a, b)
    columns: list[tuple[int, int, int]] = []
    if x and y:
        _bounded(x, y, columns)
    out, i, j = [], len(x), len(y)
    while i and j:
        first, rises, _ = columns[j - 1]
        if rises >> (i - 1 - first) & 1:  # one word more is one step more
            i -= 1
            out.append(("delete", start + i, start + j))
        else:
            j -= 1
            first, _, falls = columns[j - 1] if j else (i, 0, 0)
            if j and i > first and falls >> (i - 1 - first) & 1:
                out.append(("insert", start + i, start + j))
            else:
                i -= 1
                if x[i] != y[j]:
                    out.append(("change", start + i, start + j))
    out += [("delete", start + k, start) for k in range(i - 1, -1, -1)]
    out += [("insert", start, start + k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def marked_words(text: str) -> tuple[list[str], set[int]]:
    """Words without their tags, and the places of those that stood in ``<tag ..>``."""
    words, marked, at = [], set(), 0
    for m in _TAG.finditer(text):
        words += text[at : m.start()].split()
        inside = m.group(1).split()
        marked |= set(range(len(words), len(words) + len(inside)))
        words += inside
        at = m.end()
    return words + text[at:].split(), marked


def tagged_errors(label: str, prediction: str) -> tuple[int, int, int, int]:
    """(changes, deletions, insertions, hits) on the marked words of the label; an insertion counts to the word after it."""
    words, marked = marked_words(label)
    count = dict.fromkeys(("change", "delete", "insert"), 0)
    for operation, i, _ in edit_script(words, prediction.split()):
        if i in marked:
            count[operation] += 1
    return count["change"], count["delete"], count["insert"], len(marked) - count["change"] - count["delete"]


def tagged_error_rate(label: str, prediction: str) -> float:
    """Errors on marked words in percent of these words; 0 without any."""
    ended = lambda t: t if t.endswith(REST_WORD) else f"{t} {REST_WORD}"
    changes, deletions, insertions, hits = tagged_errors(ended(label), ended(prediction))
    words = changes + deletions + hits
    return 100.0 * (changes + deletions + insertions) / words if words else 0.0


@F.pandas_udf(T.StructType([T.StructField("rate", T.DoubleType()), T.StructField("pier", T.DoubleType())]))
def pier(labels: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    """Error rate on tagged words against the best label: ``rate`` in percent; ``pier`` is a rate below 1 percent, else 1.

    A null or blank prediction, or no label, has a pier of 1 and no rate.
    """
    rows = []
    for names, text in zip(labels, prediction, strict=True):
        names = [x for x in (names if names is not None else ()) if x]
        rate = min((tagged_error_rate(x, text) for x in names), default=None) if text and text.split() else None
        rows.append((rate, 1.0 if rate is None else min(rate, 1.0)))
    return pd.DataFrame(rows, columns=["rate", "pier"]).astype("float64")


class SuffixAutomaton:
    """States of a sequence in flat lists: length, suffix link, end of the first occurrence and occurrences.

    Edges lie in one dictionary by (state, token); each state's tokens are chained, so that a clone copies its own only.
    """

    def __init__(self, tokens: list) -> None:
        self.length, self.link, self.end, self.times = [0], [-1], [-1], [0]
        edges: dict[tuple[int, object], int] = {}
        names: list[list] = [[]]
        last = 0
        for at, token in enumerate(tokens):
            new, p = self._state(self.length[last] + 1, at, 1), last
            names.append([])
            while p >= 0 and (p, token) not in edges:
                edges[p, token] = new
                names[p].append(token)
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = edges[p, token]
                if self.length[p] + 1 == self.length[q]:
                    self.link[new] = q
                else:
                    clone = self._state(self.length[p] + 1, self.end[q], 0)
                    names.append(list(names[q]))
                    for t in names[q]:
                        edges[clone, t] = edges[q, t]
                    self.link[clone] = self.link[q]
                    self.link[q] = self.link[new] = clone
                    while p >= 0 and edges.get((p, token)) == q:
                        edges[p, token] = clone
                        p = self.link[p]
            last = new
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.times[self.link[state]] += self.times[state]

    def _state(self, length: int, end: int, times: int) -> int:
        self.length.append(length)
        self.link.append(-1)
        self.end.append(end)
        self.times.append(times)
        return len(self.length) - 1


_URL, _SIGNS = re.compile(r"https?://\S+|www\.\S+"), re.compile(r"[\W_]+")


def soft_repeat_of(tokens: list[str], least: int = 4) -> tuple[float, int]:
    """(score, occurrences) of the phrase with the highest (occurrences - 1) x length.

    Phrases have at least ``least`` tokens and at most half of all; those that hold an address, or nothing but signs, do
    not count.  Of equal scores the phrase whose first occurrence ends first counts, then the longer one.
    """
    n = len(tokens)
    if n < 2 * least:
        return 0.0, 0
    seen = SuffixAutomaton(tokens)
    upto = [[0], [0]]  # addresses, and tokens that are more than signs, before each place
    for t in tokens:
        upto[0].append(upto[0][-1] + bool(_URL.search(t)))
        upto[1].append(upto[1][-1] + (not _SIGNS.fullmatch(t)))
    states = [(-(c - 1) * k, e, -k, c) for k, e, c in zip(seen.length[1:], seen.end[1:], seen.times[1:], strict=True) if c > 1 and least <= k <= n // 2]
    for score, end, length, times in sorted(states):
        lo, hi = end + length + 1, end + 1
        if upto[0][hi] == upto[0][lo] and upto[1][hi] > upto[1][lo]:
            return float(-score), times
    return 0.0, 0


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("count", T.IntegerType())]))
def soft_repeat(text: pd.Series) -> pd.DataFrame:
    """Soft repetition of the words between white space; a null text is empty."""
    return pd.DataFrame([soft_repeat_of((t or "").split()) for t in text], columns=["score", "count"]).astype({"score": "float64", "count": "int32"})
