"""Choice answers: the scheme that a question's choices follow, and the choice that a response names.

Patterns have no repeated groups and their gaps give nothing back, so long texts take linear time.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# The tokens of each scheme, the words before a choice, and the marks around one.
LETTERS, NUMBERS, CIRCLED = "ABCDEFGHIJ", "123456789", "①②③④⑤⑥⑦⑧⑨"
CIRCLED_CHOICES = CIRCLED + "⑩"
NAMED = "answer|ans|option|choice"
CHOSEN = r"choose|select|pick|go{gap}with"
LABELLED = "option|project|choice"
WRAPPERS = r"*_`'\"()\[\]{}.,:; "

SPACE = r"\s\x1C-\x1F"
GAP, OPEN, STARS, EDGE = rf"[{SPACE}]*+", r"[(\[]?+", r"\*{0,2}+", r"(?<![\p{L}\p{N}_])"
UNICODE = "(?iU)"
LINE_ENDS = r"[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]+"


@lru_cache
def _ascii_forms() -> tuple[str, str]:
    """Characters whose compatibility form is one ASCII character, and these forms."""
    pairs = [(chr(c), f) for c in range(0x80, 0x110000) if len(f := unicodedata.normalize("NFKC", chr(c))) == 1 and f.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """``text`` with each character that stands for one ASCII character (full width, circled, styled) as that character."""
    return F.translate(text, *_ascii_forms())


def stripped(text: Column, marks: str = SPACE) -> Column:
    return F.regexp_replace(text, rf"(?U)^[{marks}]++|(?<![{marks}])[{marks}]++$", "")


def after_thought(text: Column) -> Column:
    """What follows the last end of a line of thought."""
    return F.substring_index(text, "</think>", -1)


def _gap(pattern: str) -> str:
    return pattern.replace("{gap}", rf"[{SPACE}]++")


def _alone(token: str) -> list[str]:
    """The whole text is the token, or it begins the text with a closing mark and more behind it."""
    return [rf"^{OPEN}{GAP}({token}){GAP}[)\].,:]?$", rf"^{OPEN}{GAP}({token}){GAP}[)\].,:][{SPACE}]++[^{SPACE}]"]


def _boxed(token: str) -> str:
    return rf"\\boxed\{{{GAP}{STARS}{OPEN}{GAP}({token}){GAP}[)\]]?+{STARS}{GAP}\}}"


def _letter_patterns() -> list[str]:
    token, before, ends = f"[{LETTERS}]", rf"{STARS}{OPEN}{GAP}", "(?![A-Za-z])"
    named = rf"{EDGE}(?:{NAMED}){GAP}(?:is{GAP}[:,]?+|[:,]){GAP}{before}({token}){ends}"
    korean = rf"답은?{GAP}[:,]?+{GAP}{before}({token})"
    chosen = _gap(rf"{EDGE}(?:{CHOSEN}){{gap}}(?:(?:{LABELLED}){{gap}})?{before}({token}){ends}")
    labelled = _gap(rf"{EDGE}(?:{LABELLED}){{gap}}{before}({token}){ends}")
    return [named, korean, chosen, labelled, *_alone(token)]


def _digit_patterns(token: str) -> list[str]:
    named = rf"{EDGE}(?:{NAMED}){GAP}(?:is|:){GAP}{OPEN}{GAP}({token})(?!\d)"
    return [named, rf"답은?{GAP}{OPEN}{GAP}({token})", *_alone(token)]


def _found(text: Column, patterns: list[str]) -> list[Column]:
    return [F.regexp_extract(text, UNICODE + p, 1) for p in patterns]


def _candidates(text: Column, scheme: str) -> list[Column]:
    """What each pattern of the scheme finds, in their order; empty where it finds nothing."""
    digits = [_boxed(f"[{NUMBERS}]"), *_digit_patterns(f"[{NUMBERS}]"), rf"^{OPEN}{GAP}([{NUMBERS}]){GAP}번{GAP}$"]
    if scheme == "number":
        return _found(text, digits)
    if scheme == "letter":
        boxes = F.regexp_extract_all(text, F.lit(UNICODE + _boxed(f"[{LETTERS}]")), F.lit(1))
        return [F.coalesce(F.try_element_at(boxes, F.lit(-1)), F.lit("")), *_found(text, _letter_patterns())]
    own = _found(text, [*_digit_patterns(f"[{CIRCLED}]"), rf"^{OPEN}{GAP}([{CIRCLED}])[{SPACE}]++[^{SPACE}]"])
    return own + [F.translate(x, NUMBERS, CIRCLED) for x in _found(text, digits)]


def _first_valid(candidates: list[Column], valid: Column, upper: bool) -> Column:
    """The first candidate that is valid, else the first one."""
    tokens = F.transform(F.array(*candidates), lambda x: F.upper(x)) if upper else F.array(*candidates)
    ranked = F.transform(tokens, lambda x, i: F.struct((~F.array_contains(valid, x)).alias("no"), i.alias("i"), x.alias("x")))
    return F.array_min(F.filter(ranked, lambda r: r["x"] != ""))["x"]


def _last_lines(text: Column, valid: Column, allowed: str) -> Column:
    """The token that is, or begins, one of the last three lines that are not blank; the later line counts."""
    lines = F.filter(F.transform(F.split(text, LINE_ENDS), lambda x: stripped(x)), lambda x: x != "")

    def token(line: Column) -> Column:
        led = F.upper(F.regexp_extract(line, rf"(?U)^([{allowed}])(?:[.):,{SPACE}]|$)", 1))
        whole = F.when(F.char_length(line) == 1, F.upper(line))
        return F.when(F.array_contains(valid, whole), whole).when(F.array_contains(valid, led), led)

    bare = F.transform(F.slice(F.reverse(lines), 1, 3), lambda x: stripped(x, WRAPPERS))
    return F.get(F.filter(F.transform(bare, token), lambda x: x.isNotNull()), F.lit(0))


def _set(tokens: str) -> Column:
    return F.array(*map(F.lit, tokens))


def _scheme_of_list(items: Column) -> Column:
    trimmed = F.transform(items, lambda x: stripped(x))
    of = lambda tokens: F.forall(trimmed, lambda x: x.isin(*tokens))
    return F.when(F.exists(items, lambda x: x.isNull()), None).when(of(NUMBERS), "number").when(of(CIRCLED_CHOICES), "circled").otherwise("letter")


def _hits(query: Column, token: str, inner: str, close: str) -> Column:
    """How many different choices of a kind stand at the start of a line or in brackets."""
    line = rf"(?:^[{SPACE}&&[^\n]]*+|^[ \t]*+[(\[]{GAP})({token}){GAP}{close}"
    pattern = F.lit(rf"(?mdU){line}|[(\[]{GAP}({inner}){GAP}[)\]]")
    both = F.concat(*[F.regexp_extract_all(query, pattern, F.lit(k)) for k in (1, 2)])
    return F.size(F.array_distinct(F.filter(F.transform(both, lambda x: F.upper(x)), lambda x: x != "")))


def _scheme_of_query(query: Column) -> Column:
    """The scheme with most different choices, two at least; of equals letters, then numbers."""
    marks, text = r"[)\].,:]", F.coalesce(query, F.lit(""))
    kinds = [("letter", f"[{LETTERS}]", "[A-Ja-j]", marks), ("number", f"[{NUMBERS}]", f"[{NUMBERS}]", marks), ("circled", f"[{CIRCLED}]", f"[{CIRCLED}]", marks + "?")]
    counts = F.array(*[F.struct(_hits(text, *rest).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("scheme")) for i, (name, *rest) in enumerate(kinds)])
    # The inner array binds the best count to a name.
    return F.transform(F.array(F.array_max(counts)), lambda best: F.when(best["n"] >= 2, best["scheme"]))[0]


def scheme(query: Column | None = None, options: Column | None = None, contents: Column | None = None) -> Column:
    """letter, number or circled, or null where the question offers no choices.

    The options tell, where there are none the contents, else the marks in the query.  An empty list counts as none; one
    that holds a null tells nothing.
    """
    told = _scheme_of_query(query) if query is not None else F.lit(None).cast("string")
    for items in (contents, options):
        if items is not None:
            told = F.when(F.size(items) > 0, _scheme_of_list(items)).otherwise(told)
    return told


def choice(text: Column, query: Column | None = None, options: Column | None = None, contents: Column | None = None, version: str | None = None) -> Column:
    """The choice that a response names, null for none and for a null response.

    ``version`` (numeric, alpha or circled) fixes the scheme; without it the scheme comes from the question, a response of
    one character is taken as it is, and where the question offers no choices the result is null.  Only what follows the
    last line of thought counts.  Patterns are tried in a fixed order: boxes, words of choosing, the whole text; the first
    find that is a valid token wins, else the first find, else one of the last three lines.  Characters that stand for one
    ASCII character are read as such, but not those that stand for several, like a letter in brackets as one sign.
    """
    said = after_thought(text)
    fixed = {"numeric": ("number", NUMBERS, "1-9"), "alpha": ("letter", LETTERS, "A-Ja-j"), "circled": ("circled", CIRCLED_CHOICES, None)}
    if version is not None:
        if version not in fixed:
            raise ValueError(f"no choices are named {version}; there are {', '.join(fixed)}")
        kind, tokens, allowed = fixed[version]

        def told(read: Column) -> Column:
            found = _first_valid(_candidates(read, kind), _set(tokens), upper=kind == "letter")
            return F.coalesce(found, _last_lines(read, _set(tokens), allowed)) if allowed else found

        return F.transform(F.array(stripped(said if kind == "circled" else folded(said))), told)[0]
    read, kind = stripped(folded(said)), scheme(query, options, contents)
    given = F.lit(None).cast("array<string>")
    for items in (contents, options):
        if items is not None:
            given = F.when(F.size(items) > 0, items).otherwise(given)
    listed = F.coalesce(F.transform(given, lambda x: stripped(x)), F.array().cast("array<string>"))

    def named(s: Column, name: str, tokens: str) -> Column:
        valid = F.concat(s["listed"], _set(tokens))
        found = _first_valid(_candidates(s["read"], name), valid, upper=False)
        return found if name == "circled" else F.coalesce(found, _last_lines(s["read"], valid, "A-Ja-j1-9"))

    # The inner array binds scheme, response and options to names, so that each is made once and not for each pattern.
    once = F.array(F.struct(kind.alias("kind"), read.alias("read"), listed.alias("listed")))
    by_scheme = F.transform(once, lambda s: F.when(s["kind"] == "letter", named(s, "letter", LETTERS)).when(s["kind"] == "number", named(s, "number", NUMBERS)).when(s["kind"] == "circled", named(s, "circled", CIRCLED_CHOICES)))[0]
    return F.when(F.char_length(text) == 1, text).otherwise(by_scheme)


def science_letter(text: Column) -> Column:
    """Letter after ``Answer:``, boxed, in dollars or plain, else the last boxed one; empty without any."""
    cue = r"(?i)answer\s*+:\s*+"
    after = [rf"{cue}\$\s*+\\boxed\{{([A-D])\}}\s*+\$", rf"{cue}\$\s*+([A-D])\s*+\$", rf"{cue}([A-Z])"]
    boxes = [r"(?i)\\boxed\{\\text\{([A-D])\}\}", r"(?i)\\boxed\{([A-D])\}"]
    ends = [F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(-1)) for p in boxes]
    firsts = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in after]
    return F.upper(F.coalesce(*firsts, *ends, F.lit("")))
