"""Accuracy over many disciplines: the choice or the open answer of a response against its labels.

Lambdas work on values bound to a name, so that each text is searched once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from scorewright.functions.choices import SPACE, stripped

# Marks that are cut off a response one after the other, words before an answer, and marks that are none.
ENDS = [",", ".", "!", "?", ";", ":", "'"]
INDICATORS = ["could be ", "so ", "is ", "thus ", "therefore ", "final ", "answer ", "result "]
NO_ANSWER = [":", ",", ".", "!", "?", ";", "'"]
WORD_CHARACTER = r"[\p{L}\p{N}_]"
GROUPED = rf"-?(?<!{WORD_CHARACTER})\d{{1,3}}(?:,\d{{3}})+(?!{WORD_CHARACTER})"
START = r"(?:-|(?<!\d))"
SCIENTIFIC = START + r"\d++(?:\.\d++)?[eE][+-]?\d++"
SIMPLE = START + rf"(?:\d++\.\d++|\.\d++|\d++(?!{WORD_CHARACTER}))(?![eE][+-]?\d)(?![,\d])"
NUMERIC = r"(?i)^[+-]?(?:\d++\.?\d*+(?:e[+-]?\d++)?|\.\d++(?:e[+-]?\d++)?|inf(?:inity)?|nan)$"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def _last_place(text: Column, part: Column) -> Column:
    """Where ``part`` begins for the last time, from 0; -1 without it."""
    back = F.call_function("instr", F.reverse(text), F.reverse(part))
    return F.when(back > 0, F.char_length(text) - back - F.char_length(part) + 1).otherwise(-1)


def _latest(letters: Column, present: Callable[[Column, Column], Column], place: Callable[[Column, Column], Column]) -> Column:
    """Of the letters that are present the one that stands last; of equal places the first letter."""
    rows = F.transform(letters, lambda c, i: F.struct(present(c, i).alias("there"), place(c, i).alias("at"), (-i).alias("order"), c.alias("letter")))
    return F.array_max(F.filter(rows, lambda r: r["there"]))["letter"]


def named_choice(response: Column, letters: Column, contents: Column | None = None) -> Column:
    """The letter that a response names: in brackets, before a space, before a period, or by its content in a longer text.

    Of several the last counts.  Where none is named the letter is drawn by a hash of the response, alike in each run.
    """
    for mark in ENDS:
        response = F.btrim(response, F.lit(mark))

    def named(t: Column) -> Column:
        spaced = lambda c, i: _last_place(t, F.concat(F.lit(" "), c, F.lit(" ")))
        bracketed = lambda c: F.concat(F.lit("("), c, F.lit(")"))
        found = [
            _latest(letters, lambda c, i: t.contains(bracketed(c)), lambda c, i: _last_place(t, bracketed(c))),
            _latest(letters, lambda c, i: t.contains(F.concat(c, F.lit(" "))), spaced),
            _latest(letters, lambda c, i: t.contains(F.concat(c, F.lit("."))), spaced),
        ]
        if contents is not None:
            told = lambda i: F.lower(F.coalesce(F.get(contents, i), F.lit("")))
            by_content = _bound(F.lower(t), lambda low: _latest(letters, lambda c, i: (told(i) != "") & low.contains(told(i)), lambda c, i: _last_place(low, told(i))))
            words = F.size(F.filter(F.split(t, rf"(?U)[{SPACE}]++"), lambda w: w != ""))
            found.append(F.when(words > 5, by_content))
        drawn = F.get(letters, F.pmod(F.xxhash64(t), F.greatest(F.size(letters), F.lit(1))).cast("int"))
        return F.coalesce(*found, drawn, F.lit(""))

    return _bound(F.concat(F.lit(" "), F.coalesce(response, F.lit("")), F.lit(" ")), named)


def forms(text: Column) -> Column:
    """Comparable forms of a text: (number, null), rounded to two places, or (null, text) in lower case.

    A single character has two forms, with a space before or behind it, so that it is not found inside words.
    """

    def of(t: Column) -> Column:
        form = lambda n, s: F.struct(n.cast("double").alias("number"), s.cast("string").alias("text"))
        plain, none = F.replace(t, F.lit(","), F.lit("")), F.lit(None)
        low = F.lower(t)
        single = F.array(form(none, F.concat(F.lit(" "), low)), form(none, F.concat(low, F.lit(" "))))
        return F.when(plain.rlike(NUMERIC), F.array(form(F.round(plain.try_cast("double"), 2), none))).when(F.char_length(low) == 1, single).otherwise(F.array(form(none, low)))

    return _bound(stripped(text), of)


def key_parts(response: Column) -> Column:
    """For each line the shortest text behind a word that announces an answer; the whole response where no line has one."""

    def shortest(line: Column, last: Column) -> Column:
        tails = [F.when(line.contains(w) if w != "=" else line.contains(w) & last, stripped(F.substring_index(line, w, -1))) for w in [*INDICATORS, "="]]
        rows = F.array(*[F.struct(F.char_length(t).alias("n"), F.lit(i).alias("order"), t.alias("tail")) for i, t in enumerate(tails)])
        return F.array_min(F.filter(rows, lambda r: r["tail"].isNotNull()))["tail"]

    def parts(text: Column) -> Column:
        found = _bound(F.split(text, "\n"), lambda lines: F.transform(lines, lambda x, i: shortest(x, i == F.size(lines) - 1)))
        kept = F.filter(found, lambda x: x.isNotNull() & (x != "") & ~x.isin(*NO_ANSWER))
        return _bound(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(text)))

    return _bound(F.lower(F.btrim(stripped(response), F.lit("."))), parts)


def open_forms(response: Column) -> Column:
    """Forms of the key parts of a response and of the numbers in them."""
    numbers = lambda x: F.concat(*[F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in (GROUPED, SCIENTIFIC, SIMPLE)])
    items = _bound(key_parts(response), lambda k: F.concat(k, F.flatten(F.transform(k, numbers))))
    return F.flatten(F.transform(items, forms))


def _same(told: Column, wanted: Column) -> Column:
    number = (told["number"] == wanted["number"]) & ~F.isnan(told["number"])
    return F.coalesce(number, F.lit(False)) | F.coalesce(told["text"].contains(wanted["text"]), F.lit(False))


def open_match(response: Column, labels: Column) -> Column:
    """Whether a form of the response holds a label's text or equals its number."""
    wanted = F.flatten(F.transform(labels, forms))
    return _bound(wanted, lambda w: F.exists(open_forms(response), lambda p: F.exists(w, lambda g: _same(p, g))))


def discipline_accuracy(prediction: Column, labels: Column, options: Column, contents: Column, kind: Column) -> Column:
    """1 for a right answer, else 0.  A null prediction is an empty one, null labels and nulls among them count as no label.

    ``kind`` tells an open question by its first letters; without a kind a question without choices is open.  The choices'
    letters are A, B, .. for the contents, or else the options.  Numbers that differ after rounding half up differ.
    """
    said, wanted = F.coalesce(prediction, F.lit("")), F.coalesce(F.array_compact(labels), F.array().cast("array<string>"))
    n, told = F.coalesce(F.size(contents), F.lit(0)), F.lower(F.coalesce(kind, F.lit("")))
    lettered = F.transform(contents, lambda c, i: F.char(F.lit(65) + i))
    letters = F.when(n > 0, lettered).otherwise(options)
    has = F.coalesce(F.size(letters) > 0, F.lit(False))
    is_open = told.startswith("open") | ((told == "") & ~has)
    right = F.when(is_open, open_match(said, wanted)).when(has, F.array_contains(wanted, named_choice(said, letters, F.when(n > 0, contents)))).otherwise(F.lit(False))
    return F.coalesce(right, F.lit(False)).cast("double")
