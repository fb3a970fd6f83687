"""Built-in tasks: each is configuration only.  Prompts are our own words; a configuration of a user's own can replace any."""

from __future__ import annotations

from typing import Any

LETTER = {"direct": {"task_prompt": "{}\nGive only the letter of the right choice."}, "reasoning": {"task_prompt": "{}\nThink step by step and end with the letter of the right choice in \\boxed{}."}}
BOX = {"direct": {"task_prompt": "{}\nPut the final answer in \\boxed{}."}, "reasoning": {"task_prompt": "{}\nThink step by step and put the final answer in \\boxed{}."}}
PLAIN = {"direct": {"task_prompt": None}, "reasoning": {"task_prompt": None}}
CHOICE_STEPS = {"direct": {"pipeline": ["multichoice"]}, "reasoning": {"pipeline": ["think", "multichoice"]}}
BOX_STEPS = {"direct": {"pipeline": ["boxed"]}, "reasoning": {"pipeline": ["think", "boxed"]}}
THINK_STEPS = {"direct": {"pipeline": []}, "reasoning": {"pipeline": ["think"]}}
#: Names of classes, in the order of their letters.
GENRES = ["blues", "classical", "country", "disco", "hiphop", "jazz", "metal", "pop", "reggae", "rock"]
VOCAL_SOUNDS = ["Laughter", "Sigh", "Cough", "Throat clearing", "Sneeze", "Sniff"]
SCENES = ["Bus", "Cafe", "Car", "CrowdedIndoor", "Elevator", "Kitchen", "Park", "ResidentialArea", "Restaurant", "Restroom", "Street", "Subway", "SubwayStation"]
ABCD = ["choice_a", "choice_b", "choice_c", "choice_d"]


def _task(name: str, record: dict, metrics: dict, prompts: dict = PLAIN, steps: dict | None = None, **dataset: Any) -> dict[str, Any]:
    return {"task": name, "dataset": dataset, "record": record, "prompts": prompts, "postprocess": steps or {}, "evaluation": {"target_metrics": {"text_evaluator": metrics}}}


def _speech(name: str, column: str = "transcription", version: str | None = None, metrics: tuple = ("wer", "cer"), clean: str | None = None, **dataset: Any) -> dict[str, Any]:
    """Speech to text: the sound, one of some instructions, and the text to be heard."""
    told = ["Write down what is said.", "Transcribe the recording.", "What does the speaker say?"]
    label = {"column": column} | ({"clean": clean} if clean else {})
    record = {"index": "id", "query": "", "instructions": told, "label": label, "media": {"audio": "audio"}, "meta": ["id"]}
    return _task(name, record, {k: {} for k in metrics}, steps={"asr": {"version_name": version} if version else {}}, **dataset)


def _translation(name: str, other: str, version: str | None) -> dict[str, Any]:
    """Speech translation: a sample of one language, whose label is the text of the joined sample of the other."""
    return _speech(name, f"{other}.transcription", version, ("bleu", "wer", "cer"), combine="join", key="id")


def _read(name: str, version: str | None) -> dict[str, Any]:
    record = {"index": "index", "query": "{instruction}", "label": {"column": "answer"}, "media": {"audio": "audio"}}
    return _task(name, record, {"bleu": {}, "wer": {}, "cer": {}}, steps={"asr": {"version_name": version} if version else {}})


def _named_class(name: str, column: str, fixed: list[str], label: dict, metrics: dict, told: list[str]) -> dict[str, Any]:
    record = {"index": "index", "query": "", "instructions": told, "choices": {"fixed": fixed, "heading": ""}, "label": {"column": column, "kinds": ["letter", "content"]} | label, "media": {"audio": "audio"}, "category": {"constant": name}}
    return _task(name, record, metrics, steps=THINK_STEPS)


def _listed(name: str, query: str, kinds: list[str], metrics: dict, steps: dict, choices: dict, category: Any = "category", prompts: dict = LETTER, index: str = "id", meta: list | None = None, **dataset: Any) -> dict[str, Any]:
    record = {"index": index, "query": query, "choices": {"heading": "\nChoices:"} | choices, "label": {"column": "answer", "kinds": kinds}, "category": category, "meta": meta or []}
    return _task(name, record, metrics, prompts, steps, **dataset)


EXACT, HEARD = {"exact_match": {}}, {"mmau_string_match": {}, "exact_match": {}}
_ALL = [
    _task("example", {"index": "index", "query": "{question}", "label": {"column": "answer"}}, {"edit_distance": {}, "anls": {}}),
    _listed("kdtcbench_test", "{question}", ["raw", "content"], EXACT, CHOICE_STEPS, {"columns": ABCD, "empty": "skip"}, index="index"),
    _listed("kmmbench_dev", "{question}", ["raw", "content"], EXACT, CHOICE_STEPS, {"columns": ["A", "B", "C", "D"], "empty": "skip"}, index="index"),
    _listed("kseed_test", "{question}", ["raw", "content"], EXACT, CHOICE_STEPS, {"columns": ABCD, "null": "None"}, index="index"),
    _listed("kmmstar_validation", "{question}", ["raw", "content"], EXACT, CHOICE_STEPS, {"inline": "question", "heading": ""}, index="index") | {"record": {"index": "index", "query": "{question}", "choices": {"inline": "question"}, "label": {"column": "answer", "kinds": ["raw", "content"]}, "category": "category"}},
    _listed("m3cot_test", "{question}", ["letter|raw"], EXACT, CHOICE_STEPS, {"list": "choices"}),
    _listed("zebralogic_mc_test", "{puzzle}\n{question}", ["letter|raw"], EXACT, {"direct": {"pipeline": ["multichoice"]}, "reasoning": {"pipeline": ["think", "boxed", "multichoice"]}}, {"list": "choices"}, category={"constant": "zebralogic_mc"}),
    _listed("mmau_test", "{question}", ["content", "raw"], HEARD, THINK_STEPS, {"list": "choices"}),
    _listed("mmau_test_mini", "{question}", ["content", "raw"], HEARD, THINK_STEPS, {"list": "choices"}),
    _listed("mmau_pro_test", "{question}", ["content", "raw"], {"string_match": {}, "exact_match": {}}, THINK_STEPS, {"list": "choices"}),
    _listed("mu_chomusic_test", "{question}", ["letter", "content", "raw"], EXACT, THINK_STEPS, {"list": "choices"}),
    _listed("omni_bench_test", "{question}", ["content", "raw"], EXACT, THINK_STEPS, {"list": "options"}, category="audio type"),
    _listed("mmmu_validation", "{question}", ["letter|raw"], EXACT, {"conditional_on": "question_type", "direct": {"pipeline": {"multiple-choice": ["multichoice"], "open": ["freeform"]}}, "reasoning": {"pipeline": {"multiple-choice": ["think", "multichoice"], "open": ["think", "freeform"]}}}, {"literal": "options"}, category="dataset_name", meta=["question_type"], prompts={"conditional_on": "question_type", "direct": {"task_prompt": {"multiple-choice": "{}\nGive only the letter of the right choice.", "open": "{}\nAnswer in a word or a short phrase."}}, "reasoning": {"task_prompt": "{}\nThink step by step."}}, combine="concatenate"),
    _named_class("gtzan_test", "label", GENRES, {"clean": "map", "map": dict(enumerate(GENRES))}, EXACT, ["What is the genre of this music?", "Which of these genres fits the recording?"]),
    _named_class("vocal_sound_test", "answer", VOCAL_SOUNDS, {"fold": True}, EXACT, ["Which sound is heard?", "Name the sound that the voice makes."]),
    _named_class("cochlscene_test", "label", SCENES, {"clean": "map", "map": dict(enumerate(SCENES)), "kinds": ["content"]}, HEARD, ["Where was this recorded?"]),
    _speech("librispeech_test_clean", "text", clean="lower"),
    _speech("librispeech_test_other", "text", clean="lower"),
    _speech("fleurs_en_test"),
    _speech("fleurs_ko_test", version="default_korean"),
    _speech("fleurs_zh_test", version="default_chinese"),
    _speech("common_voice_15_en_test", "answer"),
    _translation("fleurs_en2ko_test", "ko_kr", "default_korean"),
    _translation("fleurs_en2zh_test", "cmn_hans_cn", "default_chinese"),
    _translation("fleurs_ko2en_test", "en_us", None),
    _translation("fleurs_zh2en_test", "en_us", None),
    _read("covost2_en2zh_test", "default_chinese"),
    _read("covost2_zh2en_test", None),
    _task("hike_test", {"index": "sample_id", "query": "Write down what is said, each word in its own script.", "label": {"column": "text_pier_labeled"}, "category": "category", "meta": ["loanwords", "cs_level"], "media": {"audio": "audio"}}, {"mer": {}, "pier": {}}, steps={"asr": {}, "code_switch": {"loanwords": None}}),
    _task("hmmt_nov_2025_test", {"index": "problem_idx", "query": "{problem}", "label": {"column": "answer", "clean": "dollars"}, "category": {"constant": "hmmt_nov_2025"}}, EXACT, BOX, BOX_STEPS),
    _task("imo_answer_bench_test", {"index": "problem_idx", "query": "{problem}", "label": {"column": "answer", "clean": "dollars"}, "category": "category", "meta": ["subcategory"]}, EXACT, BOX, BOX_STEPS),
    _task("polymath_en_test", {"index": "id", "query": "{question}", "label": {"column": "answer", "clean": "dollars"}, "category": "dataset_name"}, EXACT, BOX, BOX_STEPS, combine="concatenate"),
    _task("vlms_are_biased_test", {"index": "id", "query": "{prompt}", "label": {"column": "ground_truth"}, "category": "topic", "meta": ["expected_bias"], "media": {"image": "image"}}, EXACT, {"direct": {"task_prompt": "{}\nWrite the answer in braces, as in {9}."}, "reasoning": {"task_prompt": "{}\nThink step by step."}}, {"direct": {"pipeline": ["curly"]}, "reasoning": {"pipeline": ["think", "boxed", "curly"]}}),
    _task("cruxeval_o_test", {"index": "id", "query": "What does this return?\n{code}\nfor the input {input}", "label": {"column": "output", "clean": "literal"}, "category": {"constant": "cruxeval_o"}}, EXACT, BOX, {"direct": {"pipeline": ["literal"]}, "reasoning": {"pipeline": ["think", "boxed", "literal"]}}),
    _task("clotho_aqa_test", {"index": "index", "query": "{instruction}", "label": {"column": "answer"}, "media": {"audio": "context"}}, {"judge_binary": {}}, steps=THINK_STEPS),
    _task("meld_emotion_test", {"index": "index", "query": "{instruction}", "label": {"column": "answer"}, "media": {"audio": "context"}}, {"judge_binary": {}, "judge_rating": {"scale": 5.0}}, steps=THINK_STEPS),
    _task("meld_sentiment_test", {"index": "index", "query": "{instruction}", "label": {"column": "answer"}, "media": {"audio": "context"}}, {"judge_binary": {}, "judge_rating": {"scale": 5.0}}, steps=THINK_STEPS),
    _task("mmvet_test", {"index": "id", "query": "{question}", "label": {"column": "answer"}, "category": "capability", "media": {"image": "image"}}, {"judge_rating": {}}, steps=THINK_STEPS),
    _task("haerae_vision_dev", {"index": "id", "query": "{question}", "category": "category", "meta": ["checklist"], "media": {"image": "image"}}, {"judge_rating": {}}),
]
TASKS: dict[str, dict[str, Any]] = {t["task"]: t for t in _ALL}


def list_tasks() -> list[str]:
    """Names of the built-in tasks."""
    return sorted(TASKS)


def task_config(name: str) -> dict[str, Any]:
    if name not in TASKS:
        raise ValueError(f"no task is named {name}")
    return TASKS[name]
