"""Task configurations: reading, checking, and resolving keys that depend on the mode or on a sample.

A configuration is a mapping (a dictionary, or a JSON or YAML file) with these parts:

``dataset``      parts, combine (concatenate, join), key, order, subset, options
``record``       how a sample becomes a record, see :mod:`scorewright.tasks.records`
``prompts``      by mode: system_prompt and task_prompt, each a text or a mapping from values of the meta key ``conditional_on``
``postprocess``  by mode: pipeline, a list of steps or a mapping from values of ``conditional_on`` to lists; steps have keywords
``evaluation``   target_metrics.text_evaluator: metrics with their keywords, group_field, null_prediction_policy, fallback_value
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, functions as F

MODES = ("direct", "reasoning")
PARTS = {"task", "dataset", "record", "prompts", "postprocess", "evaluation", "inference", "description"}
#: Keys beside the metrics of an evaluator.
SETTINGS = {"group_field", "null_prediction_policy", "fallback_value", "do_normalize"}


def load(source: dict | str) -> dict[str, Any]:
    """A configuration from a mapping, or from a JSON or YAML file (the latter where a YAML library is installed)."""
    if isinstance(source, str):
        with open(source, encoding="utf-8") as file:
            if source.endswith((".yaml", ".yml")):
                import yaml

                source = yaml.safe_load(file)
            else:
                source = json.load(file)
    return checked(source)


def checked(config: dict[str, Any]) -> dict[str, Any]:
    """The configuration, or an error that names what is wrong with it."""
    if unknown := set(config) - PARTS:
        raise ValueError(f"unknown parts of a task: {sorted(unknown)}")
    if not config.get("task"):
        raise ValueError("a task needs a name")
    combine = config.get("dataset", {}).get("combine")
    if combine not in (None, "concatenate", "join"):
        raise ValueError(f"{config['task']}: combine cannot be {combine!r}")
    if combine == "join" and not config["dataset"].get("key"):
        raise ValueError(f"{config['task']}: a join needs a key")
    policy = evaluator(config).get("null_prediction_policy")
    if policy not in (None, "miss", "skip", "fallback"):
        raise ValueError(f"{config['task']}: null_prediction_policy cannot be {policy!r}")
    return config


def of_mode(part: dict[str, Any] | None, mode: str) -> dict[str, Any]:
    """A part's settings for a mode; a part without modes is the same in all."""
    if mode not in MODES:
        raise ValueError(f"mode cannot be {mode!r}")
    part = part or {}
    return (part.get(mode) or {}) if set(part) & set(MODES) else part


def evaluator(config: dict[str, Any]) -> dict[str, Any]:
    return (config.get("evaluation") or {}).get("target_metrics", {}).get("text_evaluator", {}) or {}


def metrics_of(config: dict[str, Any]) -> dict[str, dict[str, Any]]:
    """Keywords by metric; metrics may stand under ``metrics`` or beside the settings."""
    found = evaluator(config)
    named = found.get("metrics") or {k: v for k, v in found.items() if k not in SETTINGS}
    return {name: dict(keywords or {}) for name, keywords in named.items()}


def meta_of(key: str) -> Column:
    return F.try_element_at(F.col("meta"), F.lit(key))


def chosen(value: Any, conditional_on: str | None, make: Callable[[Any], Column], nothing: Column) -> Column:
    """A value that may depend on a sample's meta: ``make`` of the variant whose key is the sample's; ``nothing`` without one."""
    if not isinstance(value, dict):
        return nothing if value is None else make(value)
    out = nothing
    for key, variant in value.items() if conditional_on else ():
        out = F.when(meta_of(conditional_on) == str(key), make(variant)).otherwise(out)
    return out
