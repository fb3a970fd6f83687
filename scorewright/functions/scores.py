"""Column builders for grounding, OCR answers, mathematical answers and repetition at the end of a text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from scorewright.functions.text import ned, tokens


def parsed_box(text: Column) -> Column:
    """Numbers of ``[x1, y1, x2, y2]``; null where a part is no number."""
    parts = F.split(F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", ""), ", ")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def scaled_axis(value: Column, side: Column) -> Column:
    """A pixel position as a share of the side; shares and positions without a known side stay."""
    stays = F.coalesce(side == 0, F.lit(True)) | value.between(-0.0001, 1.0001)
    return F.when(stays, value).otherwise(value / side)


def scaled_box(box: Column, width: Column, height: Column) -> Column:
    return F.transform(box, lambda v, i: scaled_axis(v, F.when(i % 2 == 0, width).otherwise(height)))


def padded_box(box: Column, width: Column, height: Column) -> Column:
    """Shares of the picture as shares of the square that it is centred in."""
    square = F.greatest(width, height)
    return F.transform(box, lambda v, i: (v * F.when(i % 2 == 0, width).otherwise(height) + (square - F.when(i % 2 == 0, width).otherwise(height)) / 2) / square)


def ocr_answer(labels: Column, prediction: Column, joined: bool = False) -> Column:
    """Best of the labels: a short one counts if the answer holds it, a longer one by its similarity from 0.5 on.

    ``joined`` is for scripts without spaces: white space goes, and each label is short.
    """
    gap = "" if joined else " "
    plain = lambda x: F.regexp_replace(F.trim(x), "\n| " if joined else "\n", gap)

    def one(label: Column) -> Column:
        close = 1 - ned(label, answer, uncased=False)
        return F.when(F.size(tokens(label)) < (4 if joined else 5), answer.contains(label).cast("double")).otherwise(F.when(close >= 0.5, close).otherwise(0.0))

    answer = plain(F.coalesce(prediction, F.lit("")))
    return F.coalesce(F.array_max(F.transform(labels, lambda x: one(plain(x)))), F.lit(0.0))


def math_value(text: Column) -> Column:
    """Number of an answer in usual notation: boxed, between dollar signs, a fraction, with thousands; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\boxed\{(.*)\}", "$1"), r"[$\s,]|\\left|\\right|\\!", "")
    parts = r"^(-?)\\[dt]?frac\{(-?\d+(?:\.\d+)?)\}\{(-?\d+(?:\.\d+)?)\}$|^(-?)(\d+(?:\.\d+)?)/(\d+(?:\.\d+)?)$"
    piece = lambda i, j: F.coalesce(F.nullif(F.regexp_extract(bare, parts, i), F.lit("")), F.nullif(F.regexp_extract(bare, parts, j), F.lit(""))).cast("double")
    sign = F.when(bare.startswith("-\\") | (bare.startswith("-") & bare.contains("/")), -1.0).otherwise(1.0)
    return F.coalesce(sign * F.try_divide(piece(2, 5), piece(3, 6)), bare.try_cast("double"))


def math_equal(label: Column, prediction: Column) -> Column:
    """Equal as numbers within 1e-6, or as text without spaces and dollar signs; a missing answer is wrong."""
    text = lambda x: F.regexp_replace(F.regexp_replace(x, r"\\boxed\{(.*)\}", "$1"), r"[$\s]", "")
    same = F.coalesce(F.abs(math_value(label) - math_value(prediction)) <= 1e-6, F.lit(False)) | (text(label) == text(prediction))
    return F.coalesce(same, F.lit(False)).cast("double")


def _trailing(words: list[str]) -> int:
    """Words at the end that are one block repeated: by matches of the reversed text with its own shifts, in linear time."""
    back = words[::-1]
    n = len(back)
    match = [0] * n
    left = right = best = 0
    for shift in range(1, n):
        size = min(right - shift, match[shift - left]) if shift < right else 0
        while shift + size < n and back[size] == back[shift + size]:
            size += 1
        match[shift] = size
        if shift + size > right:
            left, right = shift, shift + size
        if size >= shift:
            best = max(best, shift * (1 + size // shift))
    return best


@F.pandas_udf(T.IntegerType())
def trailing_repeat(text: pd.Series) -> pd.Series:
    """Number of words at the end of the text that repeat one block; 0 where no block repeats or the text is null."""
    return text.map(lambda t: _trailing((t or "").split())).astype("int32")


def query_text(contents: Column, skipped: tuple[str, ...] = ()) -> Column:
    """Texts of a message's (kind, value) contents, one a line, without those that start with a skipped prefix."""

    def wanted(c: Column) -> Column:
        test = (c["kind"] == "text") & c["value"].isNotNull()
        for prefix in skipped:
            test = test & ~c["value"].startswith(prefix)
        return test

    return F.rtrim(F.array_join(F.transform(F.filter(contents, wanted), lambda c: c["value"]), "\n"))
