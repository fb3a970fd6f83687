"""Record builders: what of a sample becomes index, query, choices, labels, category, meta and media, as configured.

``index``        a column, or {"name": column, "number": column, "width": n} for names with padded numbers
``query``        a text with {column} for values
``instructions`` texts of which a sample gets one by a hash of its index; it stands before the query
``choices``      {"columns": [..], "null": "skip" | text, "empty": "skip"}, {"list": column}, {"literal": column}, {"inline": column} or
                 {"fixed": [..]}; with "heading" they are written below the query, one a line
``label``        {"column": .., "clean": dollars | lower | literal | map, "map": {..}, "fold": bool, "kinds": [..]}; kinds are
                 raw, letter and content, or ``letter|raw`` for the first there is
``category``     a column, or {"constant": text}; ``meta``: columns kept as text; ``media``: kinds and their columns
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.literals import canonical_literal, literal_list
from scorewright.functions.records import inline_options

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_TEXTS = "array<string>"


def filled(template: str) -> Column:
    """A text with values of columns; null values are empty."""
    parts = re.split(r"\{([^{}]+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(F.col(f"`{p}`").cast("string"), F.lit("")) for i, p in enumerate(parts)])


def text_list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(NO_TEXTS)


def contents_of(spec: dict[str, Any] | None) -> Column:
    """Contents of the choices in order."""
    if not spec:
        return text_list([])
    if "fixed" in spec:
        return text_list(spec["fixed"])
    if "list" in spec:
        return F.coalesce(F.col(spec["list"]).cast(NO_TEXTS), text_list([]))
    if "literal" in spec:
        return F.coalesce(literal_list(F.col(spec["literal"])), text_list([]))
    if "inline" in spec:
        return F.transform(inline_options(F.col(spec["inline"])), lambda o: o["content"])
    null = spec.get("null", "skip")
    values = F.array(*[F.col(c).cast("string") if null == "skip" else F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in spec["columns"]])
    return F.filter(values, lambda v: v.isNotNull() & ((v != "") if spec.get("empty") == "skip" else F.lit(True)))


def letters_of(contents: Column) -> Column:
    return F.transform(contents, lambda _, i: F.substring(F.lit(LETTERS), i + 1, F.lit(1)))


def written_choices(spec: dict[str, Any], letters: Column, contents: Column) -> Column:
    """The heading and a line for each choice."""
    lines = F.zip_with(letters, contents, lambda a, b: F.concat(F.lit("\n"), a, F.lit(spec.get("mark", ". ")), b))
    return F.when(F.size(contents) > 0, F.concat(F.lit(spec["heading"]), F.array_join(lines, ""))).otherwise("")


def cleaned_answer(spec: dict[str, Any]) -> Column:
    answer = F.col(spec["column"]).cast("string")
    how = spec.get("clean")
    if how == "dollars":
        return F.trim(F.regexp_replace(F.trim(answer), r"^\$+|\$+$", ""))
    if how == "lower":
        return F.lower(answer)
    if how == "literal":
        return canonical_literal(answer)
    if how == "map":
        pairs = F.create_map(*[F.lit(str(x)) for pair in spec["map"].items() for x in pair])
        return F.coalesce(F.try_element_at(pairs, answer), answer)
    if how:
        raise ValueError(f"a label cannot be cleaned by {how!r}")
    return answer


def labels_of(spec: dict[str, Any], letters: Column, contents: Column) -> Column:
    """Labels of the kinds asked for; those that a sample has not are left out."""
    answer = F.col("_answer")
    fold = F.lower if spec.get("fold") else (lambda x: x)
    by_content = F.array_position(F.transform(contents, fold), fold(answer))
    at = F.coalesce(F.nullif(by_content, F.lit(0)), F.nullif(F.array_position(letters, F.upper(F.trim(answer))), F.lit(0)))
    kind = {"raw": answer, "letter": F.get(letters, (at - 1).cast("int")), "content": F.get(contents, (at - 1).cast("int"))}
    named = [F.coalesce(*[kind[k] for k in name.split("|")]) for name in spec.get("kinds", ["raw"])]
    return F.array_distinct(F.filter(F.array(*named), lambda x: x.isNotNull() & (x != "")))


def build(samples: DataFrame, spec: dict[str, Any], default_options: list[str] | None = None) -> DataFrame:
    """(index, query, labels, options, option_contents, media, meta, then all columns of the samples).

    A sample without an answer has no labels; one without choices has the task's options.  Meta values are texts, those of
    nested columns JSON; null ones are left out.
    """
    index = spec.get("index", "index")
    index = F.col(index).cast("string") if isinstance(index, str) else F.concat(F.col(index["name"]), F.lit("-"), F.lpad(F.col(index["number"]).cast("string"), index.get("width", 6), "0"))
    own = spec.get("choices")
    rows = samples.withColumns({"_index": index, "_contents": contents_of(own)})
    rows = rows.withColumn("_letters", letters_of(F.col("_contents")))
    rows = rows.withColumn("_answer", cleaned_answer(spec["label"]) if spec.get("label") else F.lit(None).cast("string"))
    letters, contents = F.col("_letters"), F.col("_contents")
    query = filled(spec.get("query", "{query}"))
    if own and "heading" in own:
        query = F.concat(query, written_choices(own, letters, contents))
    if told := spec.get("instructions"):
        one = F.get(text_list(told), F.pmod(F.xxhash64("_index"), F.lit(len(told))).cast("int"))
        query = F.concat(one, F.when(query != "", F.concat(F.lit("\n"), F.ltrim(query))).otherwise(""))
    kinds = dict(samples.dtypes)
    plain = lambda c: F.col(c).cast("string") if not kinds[c].startswith(("struct", "array", "map")) else F.to_json(c)
    meta = {c: plain(c) for c in spec.get("meta", [])}
    category = spec.get("category")
    if category is not None:
        meta["category"] = F.lit(category["constant"]) if isinstance(category, dict) else plain(category)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in meta.items()]) if meta else F.array().cast("array<struct<key:string,value:string>>")
    media = [F.struct(F.lit(kind).alias("type"), F.col(c).cast("string").alias("value")) for kind, c in spec.get("media", {}).items()]
    media = F.filter(F.array(*media), lambda m: m["value"].isNotNull()) if media else F.array().cast("array<struct<type:string,value:string>>")
    return rows.select(
        F.col("_index").alias("index"), F.rtrim(query).alias("query"), (labels_of(spec["label"], letters, contents) if spec.get("label") else text_list([])).alias("labels"),
        F.when(F.size(contents) > 0, letters).otherwise(text_list(default_options or [])).alias("options"), contents.alias("option_contents"), media.alias("media"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("meta"), F.struct(*samples.columns).alias("sample"),
    )


def described(spec: dict[str, Any]) -> str:
    """The configuration as one line of JSON, for listings."""
    return json.dumps(spec, ensure_ascii=False, sort_keys=True)
