"""Texts that hold literals of a programming language: lists, and values in one canonical spelling."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import functions as F, types as T


def _value(text: str | None) -> tuple[bool, object]:
    """(whether the text is a literal, its value); nothing is ever run."""
    try:
        return True, ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, AttributeError, MemoryError, RecursionError, TypeError):
        return False, None


def _same_text(value: object) -> str:
    """One spelling for equal values: sets sorted by spelling, dictionaries in their own order."""
    if isinstance(value, (set, frozenset)):
        return "{" + ", ".join(sorted(map(_same_text, value))) + "}" if value else "set()"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{_same_text(k)}: {_same_text(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(map(_same_text, value)) + "]"
    if isinstance(value, tuple):
        return "(" + ", ".join(map(_same_text, value)) + (",)" if len(value) == 1 else ")")
    return repr(value)


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_list(text: pd.Series) -> pd.Series:
    """Items of a list or tuple as texts; null for anything else."""

    def items(t: str | None) -> list[str] | None:
        ok, value = _value(t)
        return [x if isinstance(x, str) else _same_text(x) for x in value] if ok and isinstance(value, (list, tuple)) else None

    return text.map(items)


@F.pandas_udf(T.StringType())
def canonical_literal(text: pd.Series) -> pd.Series:
    """The literal in its canonical spelling; a text that is none stays, without outer white space."""

    def spelled(t: str | None) -> str | None:
        if t is None:
            return None
        ok, value = _value(t)
        return _same_text(value) if ok else t.strip()

    return text.map(spelled)
