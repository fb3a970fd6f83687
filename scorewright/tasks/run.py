"""A task compiled from its configuration: records, prompts, answers, metrics of samples, and the report.

Each stage is a plan over the stage before it; nothing runs until the result is asked for.  Steps and metrics come from
registries that callers can extend for a task of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions import bleu, extract, metrics as m, text as t
from scorewright.functions.choices import choice
from scorewright.functions.edits import pier
from scorewright.functions.grounding import as_text, place
from scorewright.functions.literals import canonical_literal
from scorewright.functions.open_answers import discipline_accuracy
from scorewright.functions.trees import tree_edit_score
from scorewright.operators import dataset as ds
from scorewright.tasks import records
from scorewright.tasks.config import chosen, evaluator, load, meta_of, metrics_of, of_mode

HANGUL, HAN = r"\x{AC00}-\x{D7A3}", r"\x{4E00}-\x{9FFF}"
# Short forms of English and what they stand for, in the order in which they are written out.
SHORT_FORMS = [("won't", "will not"), ("can't", "can not"), ("let's", "let us"), ("n't", " not"), ("'re", " are"), ("'s", " is"), ("'d", " would"), ("'ll", " will"), ("'t", " not"), ("'ve", " have"), ("'m", " am")]
LOANWORDS = "array<struct<Korean:string,English:string>>"


def answer_letter(text: Column, letters: str | None = None, version_name: str | None = None) -> Column:
    """Letter of a choice among the record's own options, or among ``letters``; a version fixes the scheme of the choices."""
    if version_name:
        return choice(text, version=version_name)
    found = extract.multichoice(text, letters or records.LETTERS)
    return found if letters else F.when(F.array_contains("options", found), found)


def spoken(text: Column, version_name: str = "default") -> Column:
    """Transcript of a response; for Korean and Chinese, from its first to its last character of that script."""
    body = extract.transcript(text)
    script = {"default_korean": HANGUL, "default_chinese": HAN}.get(version_name)
    if not script:
        return body
    # Greedy single-character loops only: from the first such character to the last one and the signs after it.
    inner = F.regexp_extract(body, rf"(?s)([{script}].*[{script}][.!?。！？]?|[{script}])", 1)
    return F.when(body.rlike(f"[{script}]"), inner).otherwise(body)


def code_switched(text: Column, loanwords: Column | None = None) -> Column:
    """Loanwords in the other language's spelling, plain lower-case words, and a space between Latin words and Hangul.

    ``loanwords`` is a JSON list of pairs (Korean, English), replaced in its order.
    """
    if loanwords is not None:
        pairs = F.coalesce(F.from_json(loanwords, LOANWORDS), F.array().cast(LOANWORDS))
        text = F.aggregate(F.filter(pairs, lambda p: p["Korean"] != ""), text, lambda s, p: F.replace(s, p["Korean"], F.coalesce(p["English"], F.lit(""))))
    out = F.lower(text)
    for short, full in SHORT_FORMS:
        out = F.replace(out, F.lit(short), F.lit(full))
    out = F.regexp_replace(out, r"[\[<][^>\]]*[>\]]", "")
    out = F.regexp_replace(out, r"(?<=[\p{L}\p{N}_])—(?=[\p{L}\p{N}_])", " ")
    out = t.collapse(F.regexp_replace(out, r"\p{P}", ""))
    return F.regexp_replace(out, rf"([A-Za-z0-9])(?=[{HANGUL}])", "$1 ")


#: Steps by name: a step takes the text and its keywords, and null leaves the text as it was.
STEPS: dict[str, Callable[..., Column]] = {
    "think": lambda x: extract.think(x)["answer"],
    "boxed": extract.boxed,
    "curly": extract.curly,
    "multichoice": answer_letter,
    "binary": extract.binary,
    "freeform": extract.freeform,
    "code": extract.code_block,
    "asr": spoken,
    "literal": canonical_literal,
    "spatial_grounding": lambda x, version_name="bbox": as_text(place(x, version_name)),
    "code_switch": code_switched,
}


def _words(x: Column) -> Column:
    return F.size(t.tokens(x))


def _mixed(x: Column) -> Column:
    return F.regexp_replace(x, rf"([{HANGUL}])", " $1 ")


def mixed_error(labels: Column, prediction: Column) -> Column:
    """Word error rate in percent after Hangul syllables are set apart, at most 100; the first label counts."""
    label, said = _mixed(F.get(labels, F.lit(0))), _mixed(prediction)
    rate = F.when(_words(label) > 0, 100.0 * t.word_edits(label, said) / _words(label)).otherwise(F.lit(100.0))
    return F.when(_words(prediction) == 0, F.lit(100.0)).otherwise(F.least(F.lit(100.0), rate))


#: Metrics of a sample: of labels and the answer, with keywords.
METRICS: dict[str, Callable[..., Column]] = {
    "exact_match": lambda labels, p, relative_tolerance=None: m.exact_match(labels, p, relative_tolerance),
    "string_match": m.string_match,
    "substring_match": m.substring_match,
    "edit_distance": m.ned_min,
    "anls": m.anls,
    "vqa": m.vqa_score,
    "mmau_string_match": lambda labels, p: m.option_words_match(F.get(labels, F.lit(0)), p, F.col("option_contents")),
    "mmmu_accuracy": lambda labels, p: discipline_accuracy(p, labels, F.col("options"), F.col("option_contents"), meta_of("question_type")),
    "mer": mixed_error,
    "pier": lambda labels, p: pier(labels, p)["pier"],
    "tree_edit_score": lambda labels, p, group=None: tree_edit_score(labels, p, F.lit(group).cast("string")),
}

def judged_yes(labels: Column, prediction: Column, column: str = "judgement") -> Column:
    """1 for a judge's yes, 0 for anything else; null without a judgement."""
    said = extract.binary(F.col(column))
    return F.when(F.trim(F.col(column)) != "", F.coalesce((said == "yes").cast("double"), (F.trim(F.col(column)) == "1").cast("double"), F.lit(0.0)))


def judged_rating(labels: Column, prediction: Column, column: str = "judgement", scale: float = 1.0) -> Column:
    """The last number of a judgement over the scale, within 0..1; null without one."""
    number = F.try_element_at(extract.numbers(F.col(column)), F.lit(-1))
    return F.when(number.isNotNull(), F.least(F.greatest(number / scale, F.lit(0.0)), F.lit(1.0)))


METRICS |= {"judge_binary": judged_yes, "judge_rating": judged_rating}
#: Metrics that need no label.
UNLABELLED = {"judge_binary", "judge_rating"}


#: Metrics of a corpus: a struct of a sample's figures, and the aggregate over it.
CORPUS: dict[str, tuple[Callable[..., Column], Callable[..., Column]]] = {
    "wer": (lambda labels, p: F.struct(t.word_edits(F.get(labels, F.lit(0)), p).alias("errors"), _words(F.get(labels, F.lit(0))).alias("units")), lambda c: F.try_divide(F.sum(c["errors"]).cast("double"), F.sum(c["units"]))),
    "cer": (lambda labels, p: F.struct(F.levenshtein(F.get(labels, F.lit(0)), p).alias("errors"), F.char_length(F.get(labels, F.lit(0))).alias("units")), lambda c: F.try_divide(F.sum(c["errors"]).cast("double"), F.sum(c["units"]))),
    "bleu": (lambda labels, p, length="shortest", **_: bleu.bleu_stats(labels, p, F.lit(length)), lambda c, max_order=4, **_: bleu.corpus_score(c, max_order)),
}


class Task:
    """A configured task.  ``steps``, ``metrics`` and ``builder`` add to or replace what the registries hold."""

    def __init__(self, config: dict | str, steps: dict[str, Callable] | None = None, metrics: dict[str, Callable] | None = None, builder: Callable[[DataFrame, dict], DataFrame] | None = None) -> None:
        self.config = load(config)
        self.name = self.config["task"]
        self.steps, self.metrics = STEPS | (steps or {}), METRICS | (metrics or {})
        self.builder = builder or (lambda samples, c: records.build(samples, c.get("record", {}), c.get("dataset", {}).get("options")))
        for name in metrics_of(self.config):
            if name not in self.metrics and name not in CORPUS:
                raise ValueError(f"{self.name}: no metric is named {name}")

    def samples(self, parts: dict[str, DataFrame]) -> DataFrame:
        """The task's rows: its parts put together as configured, and the subset taken."""
        data = self.config.get("dataset", {})
        named = {n: parts[n] for n in data.get("parts", parts)}
        if data.get("combine") == "concatenate":
            rows = ds.concatenate(named)
        elif data.get("combine") == "join":
            rows = ds.join_all(named, data["key"], data.get("order", data["key"]))
        elif len(named) == 1:
            rows = next(iter(named.values()))
        else:
            raise ValueError(f"{self.name}: several parts need a way to combine them")
        return ds.subset(rows, data["subset"]) if data.get("subset") else rows

    def records(self, parts: dict[str, DataFrame], mode: str = "direct", run: int = 0) -> DataFrame:
        """Records with their prompts; in run r the contents of the choices have moved r places and the letter labels with them."""
        rows = self.builder(self.samples(parts), self.config)
        if run:
            rows = self._turned(rows, run)
        prompts = of_mode(self.config.get("prompts"), mode)
        on, nothing = prompts.get("conditional_on") or (self.config.get("prompts") or {}).get("conditional_on"), F.lit(None).cast("string")
        system, task = (chosen(prompts.get(k), on, F.lit, nothing) for k in ("system_prompt", "task_prompt"))
        system = F.when(F.trim(system) != "", system)
        return rows.withColumns({"task": F.lit(self.name), "system": system, "prompt": F.rtrim(ds.render_prompt(task, F.col("query")))})

    def _turned(self, rows: DataFrame, run: int) -> DataFrame:
        n = F.size("option_contents")
        moved = ds.rotate_right(F.col("option_contents"), F.lit(run))
        letter = lambda x: F.get("options", F.pmod(F.array_position("options", x) - 1 + run, n).cast("int"))
        labels = F.transform("labels", lambda x: F.when(F.array_contains("options", x), letter(x)).otherwise(x))
        return rows.withColumns({"option_contents": F.when(n > 0, moved).otherwise(F.col("option_contents")), "labels": F.when(n > 0, labels).otherwise(F.col("labels"))})

    def answers(self, rows: DataFrame, prediction: str = "prediction", mode: str = "direct") -> DataFrame:
        """Adds ``answer``: the prediction after the null policy and the pipeline of the mode."""
        rules = evaluator(self.config)
        rows = ds.null_policy(rows.withColumn("answer", F.col(prediction)), "answer", rules.get("null_prediction_policy") or "miss", rules.get("fallback_value") or "")
        part = self.config.get("postprocess") or {}
        settings = of_mode(part, mode)
        on = settings.get("conditional_on") or part.get("conditional_on")
        pipeline = settings.get("pipeline", {k: v for k, v in settings.items() if k != "conditional_on"} or None)
        if not on:
            return rows.withColumn("answer", self._chain(pipeline))
        return rows.withColumn("answer", chosen(pipeline, on, self._chain, F.col("answer")))

    def _chain(self, pipeline: list | dict | None) -> Column:
        """Steps in order.  A keyword without a value is taken from the record's meta."""
        named = pipeline if isinstance(pipeline, dict) else dict.fromkeys(pipeline or [])
        chain = []
        for name, keywords in named.items():
            if name not in self.steps:
                raise ValueError(f"{self.name}: no step is named {name}")
            given = {k: meta_of(k) if v is None else v for k, v in (keywords or {}).items()}
            chain.append(lambda x, step=self.steps[name], given=given: step(x, **given))
        return extract.chain(F.col("answer"), chain)

    def scored(self, rows: DataFrame) -> DataFrame:
        """Adds a column for each metric: a number of a sample, or a struct of figures that add up; null without labels."""
        labels, answer, new = F.col("labels"), F.col("answer"), {}
        for name, keywords in metrics_of(self.config).items():
            value = (self.metrics[name] if name in self.metrics else CORPUS[name][0])(labels, answer, **keywords)
            new[name] = value if name in UNLABELLED else m.eligible(labels, value)
        return rows.withColumns(new)

    def report(self, scored: DataFrame) -> DataFrame:
        """(task, grp, whole, num_samples, metrics..): a row for each value of the group field (empty without one), and one of all.

        ``whole`` tells the row of all samples from a group of the same name.
        """
        field = evaluator(self.config).get("group_field", "category") or "category"
        named = metrics_of(self.config)
        rows = scored.select(F.coalesce(meta_of(field), F.lit("")).alias("_group"), *named)
        sets = rows.cube("_group").agg(F.count("*").alias("num_samples"), *[self._figure(n, k).alias(n) for n, k in named.items()], F.grouping("_group").alias("_all"))
        return sets.select(F.lit(self.name).alias("task"), F.when(F.col("_all") == 1, "all").otherwise(F.col("_group")).alias("grp"), (F.col("_all") == 1).alias("whole"), "num_samples", *named)

    def _figure(self, name: str, keywords: dict[str, Any]) -> Column:
        return F.avg(name) if name in self.metrics else CORPUS[name][1](F.col(name), **{k: v for k, v in keywords.items() if k == "max_order"})

    def evaluate(self, parts: dict[str, DataFrame], prediction: Callable[[DataFrame], DataFrame], mode: str = "direct", run: int = 0) -> DataFrame:
        """The report from samples: ``prediction`` adds a column of that name to the records, be it a join or an expression."""
        return self.report(self.scored(self.answers(prediction(self.records(parts, mode, run)), mode=mode)))
