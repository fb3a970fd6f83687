"""Places on an image: the point, box or quad that a response states, in the shape that a metric takes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from scorewright.functions.choices import after_thought, folded

NUMBER = r"[-+]?(?:\d+\.\d+|\.\d+|\d+)"
#: Numbers of each shape, the richest first.
ARITY = {"quad": 8, "bbox": 4, "point": 2}


def _doubles(texts: Column) -> Column:
    return F.transform(texts, lambda x: x.cast("double"))


def _numbers(text: Column) -> Column:
    return _doubles(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def _pair(text: Column, pattern: str) -> Column:
    x, y = (F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("double") for k in (1, 2))
    return F.when(x.isNotNull() & y.isNotNull(), F.array(x, y))


def _point_tag(text: Column) -> Column:
    """x1 and y1 of the first point tag that has both, in this order."""
    tags = F.regexp_extract_all(text, F.lit(r"(?i)<points?\b([^>]*+)"), F.lit(1))

    def place(tag: Column) -> Column:
        x = rf"(?is)\bx1\s*+=\s*+['\"]?({NUMBER})(.*)"
        y = F.regexp_extract(F.regexp_extract(tag, x, 2), rf"(?i)\by1\s*+=\s*+['\"]?({NUMBER})", 1)
        both = F.array(F.nullif(F.regexp_extract(tag, x, 1), F.lit("")).cast("double"), F.nullif(y, F.lit("")).cast("double"))
        return F.when(F.forall(both, lambda v: v.isNotNull()), both)

    return F.get(F.filter(F.transform(tags, place), lambda p: p.isNotNull()), F.lit(0))


def _bracket(text: Column, n: int) -> Column:
    """Numbers of the last bracket that holds exactly n."""
    body = r"\s*+,\s*+".join([NUMBER] * n)
    groups = F.regexp_extract_all(text, F.lit(rf"[\[({{]\s*+({body})\s*+[\])}}]"), F.lit(1))
    return _numbers(F.try_element_at(groups, F.lit(-1)))


def _reshaped(v: Column, source: str, target: str) -> Column:
    if source == target:
        return v
    xs, ys = (F.array(*[v[i] for i in range(k, ARITY[source], 2)]) for k in (0, 1))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    if target == "point":
        return F.array(mean(xs), mean(ys))
    if source == "quad":
        return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    if source == "bbox":
        return F.array(v[0], v[1], v[2], v[1], v[2], v[3], v[0], v[3])
    return F.lit(None).cast("array<double>")


def place(text: Column, target: str = "bbox") -> Column:
    """Coordinates of the ``target`` shape (bbox, point or quad) as doubles; null where the response states none.

    A point that a tag or a click names comes first, then the last bracket of eight, four or two numbers, then the last
    numbers of the text, as many as the target has.  Boxes and quads become their centre, their corners or their bounds; a
    point has no extent, so it gives neither box nor quad.  Only what follows the last line of thought counts.
    """
    if target not in ARITY:
        raise ValueError(f"no shape is named {target}; there are {', '.join(ARITY)}")
    said = after_thought(folded(text))
    nested = rf"(?i)<point>\s*+<x>\s*+({NUMBER})(?:\s*+,\s*+|\s++)({NUMBER})\s*+</x>"
    click = rf"(?:click|tap)\s*+\(\s*+x\s*+=\s*+({NUMBER})\s*+,\s*+y\s*+=\s*+({NUMBER})\s*+\)"
    point = F.coalesce(_point_tag(said), _pair(said, nested), _pair(said, click))
    n = ARITY[target]
    found = _bound(_numbers(said), lambda every: F.when(F.size(every) >= n, F.slice(every, -n, n)))
    states = [("point", point), *[(shape, _bracket(said, k)) for shape, k in ARITY.items()]]
    for source, values in reversed(states):
        found = _or_else(values, source, target, found)
    return found


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _or_else(values: Column, source: str, target: str, rest: Column) -> Column:
    return _bound(values, lambda v: F.when(v.isNotNull(), _reshaped(v, source, target)).otherwise(rest))


def as_text(values: Column) -> Column:
    """``[a, b, ..]``, the form in which metrics read coordinates."""
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))
