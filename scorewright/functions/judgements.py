"""What judges say: reasons, scores and verdicts, overall or by rubric, and pairs split where no bracket is open."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from scorewright.functions.extract import first_match, last_match

NUMBER = r"-?\d+(?:\.\d+)?"


def split_top(text: Column, most: int = 2) -> Column:
    """Parts of a text between commas outside brackets, outer brackets of the whole text taken off first.

    Exactly ``most`` parts come back: missing ones are null, and the last one keeps all further commas.
    """
    trimmed = F.trim(text)
    marks = lambda x: F.regexp_extract_all(x, F.lit(r"[(),]|[^(),]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"), F.array().cast("array<int>").alias("zero"))

    def step(s: Column, x: Column) -> Column:
        depth = F.when(x == "(", s["depth"] + 1).when(x == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        cut = (x == ",") & (depth == 0) & (F.size(s["cuts"]) < most - 1)
        # Where the first bracket closes: the whole text stands in brackets if that is its last part.
        closed = (x == ")") & (depth == 0) & (F.size(s["zero"]) == 0)
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), F.when(cut, F.concat(s["cuts"], F.array(s["at"]))).otherwise(s["cuts"]).alias("cuts"), F.when(closed, F.concat(s["zero"], F.array(s["at"]))).otherwise(s["zero"]).alias("zero"))

    def parts(x: Column) -> Column:
        def cut(p: Column) -> Column:
            def pieces(s: Column) -> Column:
                one = lambda i: F.when(F.size(s["cuts"]) >= i, F.trim(F.array_join(F.slice(p, F.coalesce(F.get(s["cuts"], F.lit(i - 1)) + 2, F.lit(1)) if i else F.lit(1), F.coalesce(F.get(s["cuts"], F.lit(i)), F.size(p)) - (F.get(s["cuts"], F.lit(i - 1)) + 1 if i else F.lit(0))), "")))
                return F.array(*[one(i) for i in range(most)])

            return F.transform(F.array(F.aggregate(p, start, step)), pieces)[0]

        return F.transform(F.array(marks(x)), cut)[0]

    def bare(x: Column) -> Column:
        whole = lambda p: F.transform(F.array(F.aggregate(p, start, step)), lambda s: (F.get(p, F.lit(0)) == "(") & (F.get(s["zero"], F.lit(0)) == F.size(p) - 1))[0]
        return F.when(F.coalesce(F.transform(F.array(marks(x)), whole)[0], F.lit(False)), F.substr(x, F.lit(2), F.char_length(x) - 2)).otherwise(x)

    return F.transform(F.array(bare(trimmed)), parts)[0]


def reason(text: Column) -> Column:
    """What follows a tag such as ``[REASON]:`` up to the next tag or the end; null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?is)\[?\breason(?:ing)?\]?\s*:\s*(.*?)(?=\n\s*\[[a-z]+\]|$)", 1)), F.lit(""))


def rubric_text(text: Column, rubric: str) -> Column:
    """What stands after a rubric's name and a colon, to the end of that line; null without it."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^[^\p{{L}}\p{{N}}\n]*{re.escape(rubric)}[^\p{{L}}\p{{N}}\n:]*:[ \t]*([^\n]*)", 1)), F.lit(""))


def score(text: Column, most: float | None = None) -> Column:
    """Number after a score's tag, else the last number; over ``most`` if that is given.  Null without a number."""
    value = F.coalesce(F.nullif(F.regexp_extract(text, rf"(?i)(?:score|rating)\]?\s*[:=]\s*\[?({NUMBER})", 1), F.lit("")), last_match(text, f"({NUMBER})")).cast("double")
    return value / most if most else value


def verdict(text: Column) -> Column:
    """Whether the last word of agreement or denial agrees; null without such a word."""
    word = F.lower(last_match(text, r"(?i)(?<![\p{L}\p{N}])(true|false|yes|no|correct|incorrect)(?![\p{L}\p{N}])"))
    return F.when(word.isNotNull(), word.isin("true", "yes", "correct"))


def by_rubric(text: Column, rubrics: list[str], read=score) -> Column:
    """Map of what ``read`` finds for each rubric; a rubric that is not there has null."""
    return F.create_map(*[x for r in rubrics for x in (F.lit(r), read(rubric_text(text, r)))])


def verdict_share(verdicts: Column, rubrics: int) -> Column:
    """Share of the rubrics with a yes; null without any verdict."""
    values = F.map_values(verdicts)
    found = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(found) > 0, F.size(F.filter(found, lambda v: v)) / rubrics)


def choice(text: Column) -> Column:
    """A, B or tie of a pairwise judgement; null without one."""
    return F.upper(first_match(text, [r"(?i)(?:choice|winner|verdict)\]?\s*[:=]\s*\[{0,2}\s*(A|B|tie)(?![\p{L}\p{N}])", r"\[\[(A|B)\]\]"]))
