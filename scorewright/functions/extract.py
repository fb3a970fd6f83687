"""Answer extraction: column builders that find the final answer in free text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from scorewright.functions.text import collapse


def first_match(text: Column, patterns: list[str]) -> Column:
    """First group of the first pattern, in order, that matches; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def think(text: Column, end: str = "</think>") -> Column:
    """(reasoning, answer): text before and after the first end tag; no reasoning where there is none."""
    at = F.instr(text, end)
    reasoning = F.regexp_replace(F.substr(text, F.lit(1), at - 1), "^(?s)\\s*<think>", "")
    return F.struct(F.when(at > 0, F.trim(reasoning)).alias("reasoning"), F.trim(F.when(at > 0, F.substr(text, at + len(end))).otherwise(text)).alias("answer"))


def boxed(text: Column) -> Column:
    """Content of the ``\\boxed{..}`` that closes last, with braces nested to any depth; one that never closes counts for nothing.

    The text is cut at its braces and the depth is carried along, as Java matches repeated groups by recursion.
    """
    parts = F.regexp_extract_all(text, F.lit(r"\\boxed\{|[{}]|[^{}\\]+|\\"), F.lit(0))
    # open: (place, depth) of boxes not closed yet, the latest last; found: first and last part of the content.
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.array().cast("array<struct<i:int,depth:int>>").alias("open"), F.lit(0).alias("first"), F.lit(-2).alias("last"))

    def step(s: Column, part: Column) -> Column:
        i, depth, inner = s["i"] + 1, s["depth"], F.element_at(s["open"], -1)
        box, inside = part == "\\boxed{", F.size(s["open"]) > 0
        closes = inside & (part == "}") & (F.try_element_at(s["open"], F.lit(-1))["depth"] == depth)
        deeper = F.when(box | (inside & (part == "{")), depth + 1).when(inside & (part == "}"), depth - 1).otherwise(depth)
        opened = F.when(box, F.concat(s["open"], F.array(F.struct(i.alias("i"), (depth + 1).alias("depth"))))).when(closes, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"])
        return F.struct(i.alias("i"), deeper.alias("depth"), opened.alias("open"), F.when(closes, inner["i"] + 1).otherwise(s["first"]).alias("first"), F.when(closes, i - 1).otherwise(s["last"]).alias("last"))

    def content(parts: Column) -> Column:
        at = F.transform(F.array(F.aggregate(parts, start, step)), lambda s: F.when(s["last"] >= s["first"] - 1, F.array_join(F.slice(parts, F.greatest(s["first"], F.lit(1)), F.greatest(s["last"] - s["first"] + 1, F.lit(0))), "")))
        return at[0]

    return F.when(text.contains("\\boxed{"), F.transform(F.array(parts), content)[0])


def curly(text: Column) -> Column:
    return last_match(text, r"\{([^{}]*)\}")


def multichoice(text: Column, letters: str = "ABCD") -> Column:
    """Letter of a choice: cue phrases, then brackets, then a line of its own, then the last letter that stands alone."""
    one = f"[{letters}]"
    cues = [
        rf"(?i)answer\s*(?:is|:)\s*\(?({one})\)?(?![A-Za-z])",
        rf"\(({one})\)",
        rf"(?m)^\s*({one})[.):]?\s*$",
        rf"(?s).*(?<![A-Za-z'])({one})(?![A-Za-z'])",
    ]
    return F.upper(first_match(text, cues))


def binary(text: Column) -> Column:
    """yes or no: a text that begins with either word, then any negative word before any positive one; else null."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.rlike(r"^(no|false)"), "no").when(t.rlike(r"^(yes|true)"), "yes")
        .when(t.rlike(r"\b(no|not|false|incorrect)\b"), "no").when(t.rlike(r"\b(yes|true|correct)\b"), "yes")
    )


def freeform(text: Column) -> Column:
    """Span after an answer cue, up to the line's end, without outer quotes and a final period."""
    span = first_match(text, [r"(?i)(?:final answer|answer)\s*(?:is|:)\s*([^\n]+)", r"(?i)(?:therefore|thus|so)[, ]+([^\n]+)"])
    return F.regexp_replace(collapse(span), r"""^["'`]+|["'`.]+$""", "")


def code_block(text: Column) -> Column:
    """First fenced block, else null."""
    return F.nullif(F.regexp_extract(text, r"(?s)```[A-Za-z0-9_+-]*\n(.*?)```", 1), F.lit(""))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def box(text: Column) -> Column:
    """Last bracket of four numbers, else of two, else the last four bare numbers of the text."""
    number = r"-?\d+(?:\.\d+)?"
    of = lambda n: last_match(text, r"([\[(]\s*" + r"\s*,\s*".join([number] * n) + r"\s*[\])])")
    every = numbers(text)
    return F.coalesce(numbers(of(4)), numbers(of(2)), F.when(F.size(every) >= 4, F.slice(every, -4, 4)))


def seconds(token: Column) -> Column:
    """Seconds of ``12.5``, ``MM:SS`` or ``HH:MM:SS``."""
    parts = F.transform(F.split(token, ":"), lambda p: p.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda total, p: total * 60 + p)


def interval(text: Column) -> Column:
    """Last pair of times joined by a dash or "to", in seconds; null without one."""
    time = r"\d+(?::\d+){0,2}(?:\.\d+)?"
    pair = last_match(text, rf"({time}\s*(?:-|to|and)\s*{time})")
    ends = F.regexp_extract_all(pair, F.lit(time), F.lit(0))
    return F.when(F.size(ends) == 2, F.struct(seconds(ends[0]).alias("start"), seconds(ends[1]).alias("end")))


def transcript(text: Column) -> Column:
    """Text after a leading label with a colon, outer quotes removed; blank gives null."""
    body = F.regexp_replace(text, r"(?i)^\s*(?:the )?(?:transcription|transcript|text|audio)[^:\n]*:\s*", "")
    return F.nullif(F.trim(F.regexp_replace(body, r"""^\s*["']|["']\s*$""", "")), F.lit(""))


def chain(text: Column, steps: list[Callable[[Column], Column]]) -> Column:
    """Steps in order; a null result keeps the value before it, blank texts pass unchanged."""
    value = text
    for step in steps:
        value = F.when(F.trim(value) == "", value).otherwise(F.coalesce(step(value), value))
    return value
