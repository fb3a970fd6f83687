"""BLEU with several references: statistics of a sample that add up over a corpus, and the score of their sums.

A sample's n-grams count as often as they do in the reference that has them most.  Its reference length is that of the
closest or the shortest reference.  The score of a sentence is that of its own statistics, smoothed on wish.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

ORDERS = 4
# The tokenisation of the 13a rules; entities, then marks that become tokens of their own.
ENTITIES = [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
MARKS = [(re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "), (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "), (re.compile(r"([\.,])([^0-9])"), r" \1 \2"), (re.compile(r"([0-9])(-)"), r"\1 \2 ")]


def tokens_13a(text: str) -> list[str]:
    for old, new in ENTITIES:
        text = text.replace(old, new)
    text = f" {text} "
    for mark, spaced in MARKS:
        text = mark.sub(spaced, text)
    return text.split()


def _grams(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[k:] for k in range(n)), strict=False))


def sample_stats(labels: list[str], prediction: str, length: str) -> tuple[int, ...]:
    """(words, reference length, then matches and n-grams of each order)."""
    said, given = tokens_13a(prediction), [tokens_13a(x) for x in labels]
    sizes = [len(x) for x in given]
    near = min(sizes, key=lambda s: (abs(s - len(said)), s)) if length == "closest" else min(sizes)
    out = [len(said), near]
    for n in range(1, ORDERS + 1):
        most: Counter = Counter()
        for x in given:
            most |= _grams(x, n)
        own = _grams(said, n)
        out += [(own & most).total(), own.total()]
    return tuple(out)


FIELDS = ["words", "reference", *[f"{what}_{n}" for n in range(1, ORDERS + 1) for what in ("matches", "grams")]]
_TYPE = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])


@F.pandas_udf(_TYPE)
def bleu_stats(labels: pd.Series, prediction: pd.Series, length: pd.Series) -> pd.DataFrame:
    """Statistics of each sample; zeros without labels.  A null prediction is empty, null labels do not count."""
    rows = []
    for names, text, how in zip(labels, prediction, length, strict=True):
        names = [x for x in (names if names is not None else ()) if x is not None]
        rows.append(sample_stats(names, text or "", how) if names else (0,) * len(FIELDS))
    return pd.DataFrame(rows, columns=FIELDS)


def score(stats: dict[str, Column], order: int = ORDERS, smooth: bool = False) -> Column:
    """BLEU in 0..1 of statistics (of a sample, or sums of many).

    Without smoothing an order without matches makes it 0.  With it the k-th such order counts as 1 / 2^k matches.
    """
    logs, missing = F.lit(0.0), F.lit(0)
    used = F.lit(0)
    for n in range(1, order + 1):
        match, total = stats[f"matches_{n}"].cast("double"), stats[f"grams_{n}"].cast("double")
        if smooth:
            missing = missing + F.when((match == 0) & (total > 0), 1).otherwise(0)
            match = F.when(match == 0, F.pow(F.lit(2.0), -missing)).otherwise(match)
            # Texts with fewer words than the order are judged by the orders that they have.
            logs = logs + F.when(total > 0, F.log(match / total)).otherwise(0.0)
            used = used + (total > 0).cast("int")
        else:
            logs = logs + F.when((match > 0) & (total > 0), F.log(match / total))
            used = used + 1
    words, reference = stats["words"].cast("double"), stats["reference"].cast("double")
    brevity = F.when(words >= reference, 1.0).otherwise(F.exp(1 - F.try_divide(reference, words)))
    whole = brevity * F.exp(F.try_divide(logs, used))
    return F.when((words > 0) & (stats["matches_1"] > 0), F.coalesce(whole, F.lit(0.0))).otherwise(0.0)


def fields(struct: Column) -> dict[str, Column]:
    return {f: struct[f] for f in FIELDS}


def corpus_score(struct: Column, order: int = ORDERS) -> Column:
    """Aggregate: BLEU of a column of statistics."""
    return score({f: F.coalesce(F.sum(struct[f]), F.lit(0)) for f in FIELDS}, order)
