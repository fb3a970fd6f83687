"""Column builders that shape records and runs: option parsing, names, budgets, derived run figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.extract import last_match
from scorewright.functions.text import collapse, tokens


def inline_options(text: Column) -> Column:
    """Array of (letter, content) of ``Options: A: .. B: ..``; contents have single spaces, empty without options."""
    body = F.regexp_extract(text, r"(?s)Options:\s*(.*)$", 1)
    pattern = r"(?s)\b([A-Z]):\s*(.*?)(?=\s+[A-Z]:|\s*$)"
    letters, contents = (F.regexp_extract_all(body, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(letters, contents, lambda a, b: F.struct(a.alias("letter"), collapse(b).alias("content")))


def safe_name(text: Column) -> Column:
    """A name that can be part of a file name."""
    return F.regexp_replace(F.replace(F.replace(text, F.lit("."), F.lit("_")), F.lit("/"), F.lit("__")), r"\s+", "_")


def conditional(choices: dict[str, str], key: Column) -> Column:
    """The choice that ``key`` names; null for a key without one."""
    pairs = [F.lit(x) for pair in choices.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def within_budget(text: Column, budget: int, head: float = 0.7, mark: str = " ... ") -> Column:
    """A text of more than ``budget`` words keeps its first and last words around a mark."""
    first = int(budget * head)
    words = tokens(text)
    cut = F.concat(F.array_join(F.slice(words, 1, first), " "), F.lit(mark), F.array_join(F.slice(words, -(budget - first), budget - first), " "))
    return F.when(F.size(words) > budget, cut).otherwise(text)


def _middle_out(words: Column, budget: Column, head: float, mark: str) -> Column:
    """The words' first and last ones around a mark, ``budget`` with the mark's own; hardly any room keeps the last 16."""
    room = F.greatest(F.lit(2), budget - len(mark.split()))
    first = F.greatest(F.lit(1), F.floor(room * head).cast("int"))
    last = F.greatest(F.lit(1), room - first)
    cut = F.concat(F.array_join(F.slice(words, F.lit(1), first), " "), F.lit(mark), F.array_join(F.slice(words, -F.least(last, F.size(words)), last), " "))
    return F.when(budget <= 16, F.array_join(F.slice(words, -F.least(F.lit(16), F.size(words)), F.lit(16)), " ")).otherwise(cut)


def shared_budget(df: DataFrame, reference: str, prediction: str, question: str, budget: int, head: float = 0.7) -> DataFrame:
    """The three columns cut in the middle so that their words together keep to one budget.

    The question takes up to a fifth, the reference half of the rest, and the prediction what is then left; what it does
    not need goes to the reference.  Texts that fit together, and all texts for a budget of 0 or less, stay as they are;
    null texts are empty.  Shares of 16 words or fewer are last words only.
    """
    if budget <= 0:
        return df
    names = (reference, prediction, question)
    df = df.withColumns({f"_w{i}": tokens(F.coalesce(F.col(c), F.lit(""))) for i, c in enumerate(names)})
    ref, pred, ask = (F.size(f"_w{i}") for i in range(3))
    fits = ref + pred + ask <= budget
    q = F.least(ask, F.lit(max(8, int(budget * 0.2))))
    rest = F.greatest(F.lit(2), F.lit(budget) - q)
    p = F.least(pred, rest - F.least(ref, F.floor(rest / 2).cast("int")))
    r = F.least(ref, rest - p)
    shares = ((ref, r, 0.5, "reference"), (pred, p, head, "prediction"), (ask, q, 0.5, "question"))
    cut = {c: F.when(fits | (n <= share), F.col(c)).otherwise(_middle_out(F.col(f"_w{i}"), share, ratio, f"\n...[{what} truncated]...\n")) for i, (c, (n, share, ratio, what)) in enumerate(zip(names, shares, strict=True))}
    return df.withColumns(cut).drop("_w0", "_w1", "_w2")


def budgeted_items(items: Column, n: int | None) -> Column:
    """None or 0 drops all items, a positive number keeps the first, a negative one all."""
    if not n:
        return F.slice(items, 1, 0)
    return items if n < 0 else F.slice(items, 1, n)


def choice_letter(text: Column, letters: str = "ABCD", contents: Column | None = None) -> Column:
    """Letter of a choice: brackets, then a letter between spaces, then one before a period, then the last named content."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    one = f"([{letters}])"
    found = [last_match(padded, rf"\({one}\)"), last_match(padded, rf"(?<= ){one}(?= )"), last_match(padded, rf"(?<![A-Za-z]){one}\.")]
    if contents is not None:
        places = F.transform(contents, lambda c, i: F.struct(F.char_length(text) - F.char_length(F.call_function("substring_index", text, c, F.lit(-1))), i.alias("i"), text.contains(c).alias("ok")))
        last = F.array_max(F.filter(places, lambda p: p["ok"]))
        found.append(F.substr(F.lit(letters), last["i"] + 1, F.lit(1)))
    return F.coalesce(*found)


def capital_letters(text: Column, n: int) -> Column:
    """The first n capital letters, filled with empty strings."""
    got = F.regexp_extract_all(text, F.lit("[A-Z]"), F.lit(0))
    return F.slice(F.concat(got, F.array_repeat(F.lit(""), n)), 1, n)


def score_ratio(text: Column) -> Column:
    """Last ``score/most`` of a judge's answer as a share; null without one."""
    pair = F.split(last_match(text, r"(\d+(?:\.\d+)?\s*/\s*\d+(?:\.\d+)?)"), "/")
    return F.try_divide(pair[0].cast("double"), pair[1].cast("double"))


def spider(cider: Column, spice: Column) -> Column:
    """Mean of both scores; a missing one counts as 0."""
    return (F.coalesce(cider, F.lit(0.0)) + F.coalesce(spice, F.lit(0.0))) / 2


def run_figures(latency: Column, samples: Column, runtime: Column, coverage: Column) -> dict[str, Column]:
    """Figures of a run: a missing runtime is latency times samples, coverage lies in 0..1."""
    total = F.coalesce(runtime, latency * samples)
    return {
        "runtime_inference": total,
        "coverage": F.least(F.greatest(coverage, F.lit(0.0)), F.lit(1.0)),
        "benchmark_time": latency * samples,
        "throughput": F.when(total > 0, samples / total),
    }
