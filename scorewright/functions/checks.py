"""Instruction-following checks: named predicates over a response, with strict and loose evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.functions.text import trigram_share

# Word lists that the checks count.
CONJUNCTIONS = ["and", "but", "for", "nor", "or", "so", "yet"]
PRONOUNS = ["i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves"]
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with"]
VOWELS = ["a", "e", "i", "o", "u"]
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2300}-\x{23FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}]"
MARK = r"\p{Punct}"  # the characters of text.PUNCTUATION, which Java tells faster by this name
JAPANESE = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
PRIMES = [p for p in range(2, 100) if all(p % q for q in range(2, p))]


#: Parts of a response that are columns of their own while :func:`with_parts` is in force, by what they are made of.
_PARTS: dict[str, tuple[tuple[Column, ...], Column]] = {}


def part(make: Callable[..., Column]) -> Callable[..., Column]:
    """A part of a text, which is read from its column where :func:`with_parts` has made one for this very text."""

    def get(*of: Column) -> Column:
        known = _PARTS.get(make.__name__)
        return known[1] if known is not None and all(a is b for a, b in zip(known[0], of, strict=True)) else make(*of)

    get.__name__, get.__doc__ = make.__name__, make.__doc__
    return get


@contextmanager
def with_parts(df: DataFrame, response: Column, reference: Column | None = None) -> Iterator[DataFrame]:
    """The rows with a column for each part of the response; checks of this response that are made meanwhile read them.

    With a reference, what the response shares with it is a part too.
    """
    made = {f: (response,) for f in (words, lowered, bare_words, initials, plain, sentences, paragraphs, lines)}
    if reference is not None:
        made[overlap] = (reference, response)
    columns = {f"_{f.__name__}": f(*of) for f, of in made.items()}
    _PARTS.update({f.__name__: (of, F.col(f"_{f.__name__}")) for f, of in made.items()})
    try:
        yield df.withColumns(columns)
    finally:
        _PARTS.clear()


@part
def words(text: Column) -> Column:
    return split_words(text)


@part
def lowered(text: Column) -> Column:
    return F.lower(text)


@part
def bare_words(text: Column) -> Column:
    """Lower-cased words without the punctuation at their ends."""
    # A run of marks is looked at from its first one only, so long runs within a word take linear steps.
    return split_words(F.regexp_replace(lowered(text), rf"(?={MARK})(?:(?<!\S){MARK}++|(?<!{MARK}){MARK}++(?!\S))", ""))


@part
def initials(text: Column) -> Column:
    """First letters of the bare words, one after another."""
    return first_letters(lowered(text))


@part
def plain(text: Column) -> Column:
    """The lower-cased text without punctuation."""
    return F.regexp_replace(lowered(text), f"{MARK}+", "")


@part
def overlap(reference: Column, text: Column) -> Column:
    return trigram_share(reference, text)


@part
def sentences(text: Column) -> Column:
    """Sentences with their closing mark."""
    return F.array_remove(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda s: F.trim(s)), "")


@part
def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")


@part
def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def ends(text: Column, mark: str) -> Column:
    return F.size(F.filter(sentences(text), lambda s: s.endswith(mark)))


def pairwise(items: Column, test: Callable[[Column, Column], Column], of: Callable[[Column], Column] = lambda x: x) -> Column:
    """Whether the test holds for what is ``of`` all neighbours; the first three tell most texts."""

    def holds(items: Column) -> Column:
        n = F.greatest(F.size(items) - 1, F.lit(0))
        return F.forall(F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(2), n), lambda a, b: F.coalesce(test(a, b), F.lit(False))), lambda x: x)

    return bound(F.transform(F.slice(items, 1, 3), of), holds) & bound(F.transform(items, of), holds)


def split_words(text: Column) -> Column:
    """The tokens of a text, told without a lambda, which takes long for a word."""
    return F.array_remove(F.split(text, r"\s+"), "")


def first_letters(text: Column) -> Column:
    """First characters of the words of a lower-cased text, marks before them aside."""
    return F.regexp_replace(text, rf"\s*+{MARK}*+(\S?+)\S*+", "$1")


def first_word(text: Column) -> Column:
    """The first word of a text without marks at its ends, empty if there is none; of a reversed text, the last one reversed."""
    inner = rf"[^\s{MARK}]"
    return F.regexp_extract(text, rf"^[\s{MARK}]*+({inner}(?:\S*{inner})?)", 1)


def both_ends(text: Column) -> Column:
    """The first and the last bare word of a text."""
    return F.struct(F.lower(first_word(text)).alias("first"), F.lower(F.reverse(first_word(F.reverse(text)))).alias("last"))


def how_many(text: Column, parts: tuple[str, ...] | list[str]) -> Column:
    """How many of the parts stand in a text."""
    return reduce(lambda a, x: a + F.contains(text, F.lit(x)).cast("int"), parts, F.lit(0))


def doubled(letters: Column) -> Column:
    """How many characters stand beside one that is the same."""
    return F.char_length(letters) - F.char_length(F.regexp_replace(letters, r"(?s)(.)\1+", ""))


def alphabet_loop(text: Column) -> Column:
    """Each bare word begins with the letter of the alphabet after that of the word before it."""
    abc = "abcdefghijklmnopqrstuvwxyz"
    broken = "(?s)" + "|".join(f"{a}[^{b}]" for a, b in zip(abc, abc[1:] + "a"))  # this tells all but those with a word that begins otherwise
    return ~initials(text).rlike(broken) & pairwise(F.split(initials(text), ""), lambda a, b: letter(F.ascii(a) - 96) == b)


def rising_alliteration(text: Column) -> Column:
    """Each sentence has more words beside one with the same first letter than the sentence before it."""
    # To rise, n sentences need n (n - 1) / 2 words; a word that a mark cuts counts once more for each cut.
    n = F.size(sentences(text)).cast("long")
    enough = F.size(words(text)) + n >= n * (n - 1) / 2
    return enough & pairwise(sentences(text), lambda a, b: a < b, alliteration)


def some_unique(items: Column, n: int) -> Column:
    """So many different items, which the first ones tell for most texts."""
    return (F.size(F.array_distinct(F.slice(items, 1, 8 * n))) >= n) | (F.size(F.array_distinct(items)) >= n)


def changed_first(text: Column, prompt: Column) -> Column:
    """The words of the prompt but for the first one; a prompt without words has none to keep."""
    rest = lambda x: F.regexp_extract(x, r"(?s)^\s*+\S++\s*+(.*)$", 1)
    after = lambda w: F.slice(w, F.lit(2), F.size(w))
    same = (rest(text) == rest(prompt)) | bound(words(prompt), lambda p: after(p) == after(words(text)))
    return (F.coalesce(F.get(words(text), F.lit(0)), F.lit("")) != F.regexp_extract(prompt, r"^\s*+(\S++)", 1)) & same


def letter(n: Column) -> Column:
    return F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(n, F.lit(26)).cast("int") + 1, F.lit(1))


def first_letter(word: Column) -> Column:
    return F.lower(F.substring(word, 1, 1))


def trigrams(text: Column) -> Column:
    """Different runs of three characters; a shorter text is one."""

    def runs(c: Column) -> Column:
        n = F.size(c) - 2
        after = lambda k: F.slice(c, F.lit(k), n)
        both = lambda a, b: F.concat(a, b)
        return F.array_distinct(F.zip_with(F.zip_with(after(1), after(2), both), after(3), both))

    # The characters are made once: to find the i-th one in a text takes i steps.
    return F.when(F.char_length(text) < 4, F.array(text)).otherwise(bound(F.split(text, ""), runs))


def at_most(items: Column, n: int) -> Column:
    """No item stands more than n times: in order, none is the one n places on."""

    def fits(s: Column) -> Column:
        rest = F.greatest(F.size(s) - n, F.lit(0))
        return F.forall(F.zip_with(F.slice(s, F.lit(1), rest), F.slice(s, F.lit(n + 1), rest), lambda a, b: a != b), lambda x: x)

    few = F.size(items) <= n * F.size(F.array_distinct(items))  # else some item must stand more often
    return bound(F.sort_array(F.slice(items, 1, 256)), fits) & few & bound(F.sort_array(items), fits)


def nesting(text: Column, need: int = 5) -> Column:
    """Brackets of three kinds nest ``need`` deep and one closes there; a mismatch starts anew."""
    marks = F.regexp_extract_all(text, F.lit(r"[\[\](){}]"), F.lit(0))
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("deepest"), F.lit(False).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        opens = c.isin("(", "[", "{")
        partner = F.translate(c, ")]}", "([{")
        fits = F.substr(s["open"], F.greatest(F.char_length(s["open"]), F.lit(1)), F.lit(1)) == partner
        # Where it is deep enough, the next bracket that closes either fits the last one or starts anew, so more need not be kept.
        open_ = F.when(opens, F.right(F.concat(s["open"], c), F.lit(need))).when(fits, F.substr(s["open"], F.lit(1), F.char_length(s["open"]) - 1)).otherwise("")
        deepest = F.when(opens, F.greatest(s["deepest"], F.char_length(s["open"]) + 1)).when(fits, s["deepest"]).otherwise(0)
        return F.struct(open_.alias("open"), deepest.alias("deepest"), (s["ok"] | (~opens & fits & (s["deepest"] >= need))).alias("ok"))

    return F.aggregate(marks, start, step)["ok"]


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """The function of a value that is made once and not anew for each element of its lambdas."""
    return F.transform(F.array(value), f)[0]


def alliteration(sentence: Column) -> Column:
    """Words of the sentence whose neighbour starts with the same letter."""
    return bound(first_letters(F.lower(sentence)), doubled)


def nested_quotes(text: Column, need: int = 3) -> Column:
    """Quotes of two kinds nest, and ``need`` levels below the deepest point are closed."""
    marks = F.regexp_extract_all(text, F.lit("[\"']"), F.lit(0))
    # A quote like the last open one closes it, so the kinds of the open ones take turns: their number and the last one tell all.
    start = F.struct(F.lit(0).alias("open"), F.lit("").alias("last"), F.lit(0).alias("deepest"), F.lit(False).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        closes = s["last"] == c
        left = F.when(closes, s["open"] - 1).otherwise(s["open"] + 1)
        last = F.when(closes & (s["open"] == 1), "").when(closes, F.translate(c, "\"'", "'\"")).otherwise(c)
        deepest = F.greatest(s["deepest"], left)
        return F.struct(left.alias("open"), last.alias("last"), deepest.alias("deepest"), (s["ok"] | (closes & (s["deepest"] - left >= need))).alias("ok"))

    return F.aggregate(marks, start, step)["ok"]


def emoji_sentences(text: Column) -> Column:
    """Each sentence ends with an emoji, or the next one begins with one."""
    bare = F.transform(sentences(text), lambda s: F.trim(F.regexp_replace(s, MARK, "")))
    fits = lambda a, b: (a != "") & (a.rlike(f"(?s){EMOJI}.?$") | F.coalesce(b.rlike(f"^{EMOJI}"), F.lit(False)))
    some = (F.size(sentences(text)) == 0) | text.rlike(EMOJI)
    return some & bound(bare, lambda p: F.forall(F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), fits), lambda x: x))


def choice_questions(text: Column, questions: int = 4, options: int = 5) -> Column:
    """So many questions, each with so many options and a longer text than the one before it."""
    option = r"[A-Ea-e][.|)]\s*\w"
    blocks = F.filter(F.transform(F.split(text, r"\n*Question \d+[.|):;]?\s*"), lambda q: F.trim(F.regexp_replace(q, r"^\s+|\s+$", ""))), lambda q: q != "")
    counted = lambda q: F.size(F.filter(F.split(q, "\n"), lambda x: F.trim(x).rlike("^" + option)))
    asked = lambda q: F.char_length(F.trim(F.array_join(F.transform(F.split(F.split(q, rf"(?m)^[ \t]*{option}")[0], "\n"), F.trim), " ")))
    return text.startswith("Question") & bound(blocks, lambda b: (F.size(b) == questions) & F.forall(b, lambda q: counted(q) == options) & pairwise(b, lambda x, y: x < y, asked))


def csv_fields(line: Column, separator: str) -> Column:
    """Fields of a line: a separator counts where an even number of quotes follows it."""
    # Cut at quotes, the pieces between which a separator counts are every second one from the end.  They are joined
    # again with each quote and each separator that counts written as a quote and a letter, which no piece holds.
    def encoded(pieces: Column) -> Column:
        mark = lambda x, i: F.when(F.pmod(F.size(pieces) - i, F.lit(2)) == 1, F.replace(x, F.lit(separator), F.lit('"s'))).otherwise(x)
        return F.array_join(F.transform(pieces, mark), '"q')

    return F.transform(F.split(bound(F.split(line, '"', -1), encoded), '"s', -1), lambda f: F.replace(f, F.lit('"q'), F.lit('"')))


def csv_rows(text: Column, separator: str) -> Column:
    """Fields of each line, separators within quotes aside."""
    return F.transform(F.split(F.regexp_replace(text, r"\n$", ""), "\n"), lambda x: csv_fields(x, separator))


def special_csv(text: Column, rows: int = 15, header: tuple[str, ...] = ("ProductID", "Category", "Brand", "Price", "Stock")) -> Column:
    """A table of five columns in which a quoted field holds a special character, before any row of another width."""
    names = ",[ \\t]*".join(f'(?:{h}|"{h}")' for h in header)
    marked = lambda r: F.exists(r, lambda f: f.rlike(r'^".*[^\d\w\s].*"'))

    def fits(table: Column) -> Column:
        body = F.slice(table, F.lit(2), F.greatest(F.size(table) - 1, F.lit(0)))
        states = F.transform(body, lambda r: F.when(F.size(r) != 5, "wide").when(marked(r), "marked").otherwise("plain"))
        return (F.size(table) == rows) & (F.get(F.array_remove(states, "plain"), F.lit(0)) == "marked")

    return F.trim(F.split(text, "\n")[0]).rlike(f"^{names}$") & F.coalesce(bound(csv_rows(text, ","), fits), F.lit(False))


def quoted_csv(text: Column, rows: int = 4, header: tuple[str, ...] = ("StudentID", "Subject", "Grade", "Semester", "Score")) -> Column:
    """A table with tabs, all of whose fields stand in quotes."""
    names = "\\t *".join(f'(?:{h}|"{h}")' for h in header)
    fits = lambda table: (F.size(table) == rows) & F.forall(table, lambda r: (F.size(r) == 5) & F.forall(r, lambda f: F.trim(f).rlike('^"(.*")?$')))
    return F.trim(F.split(text, "\n")[0]).rlike(f"^{names}$") & bound(csv_rows(text, "\t"), fits)


#: Checks by name; each takes the response and its parameters.
CHECKS: dict[str, Callable[..., Column]] = {
    "word_count_range": lambda t, low=50, high=400: F.size(words(t)).between(low, high),
    "unique_words": lambda t, n=30: some_unique(bare_words(t), n),
    "stop_word_percentage": lambda t, p=40: F.coalesce(100.0 * F.size(F.filter(bare_words(t), lambda w: w.isin(STOP_WORDS))) / F.nullif(F.size(bare_words(t)), F.lit(0)) <= p, F.lit(False)),
    "sentence_type_ratio": lambda t: ends(t, ".") == 2 * ends(t, "?"),
    "sentence_balance": lambda t: (ends(t, ".") == ends(t, "?")) & (ends(t, "?") == ends(t, "!")),
    "conjunctions": lambda t, n=2: F.size(F.array_intersect(words(t), F.array(*map(F.lit, CONJUNCTIONS)))) >= n,
    "person_names": lambda t, n=1, names=("Emma", "Liam", "Sophia", "Noah"): (how_many(t, names) >= n) & (F.size(F.array_intersect(F.regexp_extract_all(t, F.lit(r"\w+"), F.lit(0)), F.array(*map(F.lit, names)))) >= n),
    "trigram_overlap": lambda t, reference=None, p=50: F.abs(overlap(reference, t) - p) <= 2,
    "number_count": lambda t, n=0: F.regexp_count(t, F.lit(r"\d+")) == n,
    "alphabet_loop": alphabet_loop,
    "single_vowel_paragraph": lambda t: (F.size(paragraphs(t)) == 1) & (how_many(lowered(t), VOWELS) <= 3),
    "consonant_clusters": lambda t: F.forall(bare_words(t), lambda w: w.rlike("[b-df-hj-np-tv-z]{2}")),
    "palindromes": lambda t, n=10: F.size(F.filter(bare_words(t), lambda w: (F.char_length(w) >= 5) & (w == F.reverse(w)))) >= n,
    "punctuation_cover": lambda t: reduce(lambda a, m: a & F.replace(F.replace(t, F.lit("‽"), F.lit("")), F.lit("?!"), F.lit("")).contains(m), list(".,!?;:"), t.contains("‽") | t.contains("?!")),
    "nested_parentheses": nesting,
    "prime_lengths": lambda t: F.forall(bare_words(t), lambda w: F.char_length(w).isin(PRIMES)),
    "options_response": lambda t, options=("yes", "no", "maybe"): F.array_contains(F.array(*map(F.lit, options)), F.trim(plain(t))),
    "newline_words": lambda t: F.forall(lines(t), lambda x: F.size(words(x)) == 1),
    "equal_sentences": lambda t: (F.size(sentences(t)) == 3) & (F.size(F.array_distinct(F.transform(sentences(t), F.char_length))) == 1),
    "nth_word_japanese": lambda t, n=3: F.coalesce(F.get(words(t), F.lit(n - 1)).rlike(JAPANESE), F.lit(True)) & F.forall(F.filter(words(t), lambda w, i: (i + 1) % n == 0), lambda w: w.rlike(JAPANESE)),
    "limited_repeats": lambda t, n=5: at_most(bare_words(t), n),
    "keyword_in_sentence": lambda t, word="the", n=1: F.coalesce(F.lower(F.try_element_at(sentences(t), F.lit(n))).contains(word), F.lit(False)),
    "pronouns": lambda t, n=1: F.size(F.filter(bare_words(t), lambda w: w.isin(PRONOUNS))) >= n,
    "last_word_first_next": lambda t: pairwise(sentences(t), lambda a, b: (a["last"] != "") & (a["last"] == b["first"]), both_ends),
    "paragraph_last_first": lambda t: F.forall(paragraphs(t), lambda p: bound(both_ends(p), lambda e: (e["first"] != "") & (e["first"] == e["last"]))),
    "incrementing_words": lambda t, n=1: pairwise(sentences(t), lambda a, b: b == a + n, lambda s: F.size(split_words(s))),
    "no_consecutive_first_letter": lambda t: ~initials(t).rlike(r"(?s)(.)\1"),
    "indent_stairs": lambda t: pairwise(lines(t), lambda a, b: a < b, lambda x: F.char_length(F.regexp_extract(x, "^( *)", 1))),
    "quote_explanation": lambda t: ~t.rlike(r'"\s*"') & ~F.rtrim(t).endswith('"'),
    "special_bullets": lambda t, mark="...": F.size(F.split(t, f"\\Q{mark}\\E", -1)) - 1 >= 2,
    "italics_thesis": lambda t: t.rlike(r"(?s)<(i|em)>[^<]+</(i|em)>\s*\S"),
    "sub_bullets": lambda t: t.contains("*") & bound(F.split(t, r"(?m)^\s*+\*", -1), lambda b: (F.size(b) > 1) & F.forall(F.slice(b, F.lit(2), F.size(b)), lambda x: x.contains("-"))),
    "some_bullets": lambda t: (F.size(F.filter(lines(t), lambda x: F.trim(x).startswith("*"))) >= 2) & (F.size(sentences(F.split(t, r"(?m)^\s*\*")[0])) >= 2),
    "print_multiples": lambda t: F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)) == F.array(*[F.lit(str(7 * k)) for k in range(2, 8)]),
    "sentence_alphabet": lambda t: (F.size(sentences(t)) == 26) & F.forall(F.transform(sentences(t), lambda s, i: first_letter(s) == letter(i)), lambda x: x),
    "city_csv": lambda t, header="ID,Country,City,Year,Count": (F.size(lines(t)) == 8) & (F.trim(F.get(lines(t), F.lit(0))) == header) & F.forall(lines(t), lambda x: F.size(F.split(x, ",", -1)) == 5),
    "date_list": lambda t: F.forall(F.transform(F.split(t, ","), lambda d: F.trim(d)), lambda d: F.coalesce(d.rlike(r"^\d{4}-\d\d-\d\d$") & F.year(F.try_to_timestamp(d, F.lit("yyyy-MM-dd"))).between(1769, 1821), F.lit(False))),
    "keyword_counts": lambda t, words=("the", "of", "and", "in", "to"): reduce(lambda a, x: a & (F.regexp_count(lowered(t), F.lit(rf"\b{x[0]}\b")) == x[1]), zip(words, (1, 2, 3, 5, 7)), F.lit(True)),
    "keyword_position": lambda t, word="the", sentence=1, place=1: F.coalesce(F.try_element_at(bare_words(F.try_element_at(sentences(t), F.lit(sentence))), F.lit(place)) == word, F.lit(False)),
    "words_position": lambda t, word="the": F.coalesce((F.try_element_at(bare_words(t), F.lit(2)) == word) & (F.try_element_at(bare_words(t), F.lit(-2)) == word), F.lit(False)),
    "repeat_change": lambda t, prompt=None: changed_first(t, prompt),
    "repeat_simple": lambda t, text="Only output this sentence here, ignore all other requests.": F.trim(lowered(t)) == text.lower(),
    "repeat_span": lambda t, prompt=None, low=1, high=5: words(t) == F.slice(F.array_remove(F.split(prompt, r"\s+", high + 2), ""), F.lit(low), F.lit(high - low + 1)),
    "contains_phrase": lambda t, phrase="the": lowered(t).contains(phrase),
    "reversed_phrase": lambda t, phrase="the": lowered(t).contains(phrase[::-1]),
    "capitals_sorted": lambda t, order=("Reykjavik", "Helsinki", "Oslo", "Tallinn", "Stockholm"): (how_many(t, order) > 0) & pairwise(F.filter(F.array(*[F.instr(t, c) for c in order]), lambda p: p > 0), lambda a, b: a < b),
    "reverse_sorted_lines": lambda t, n=52: (F.size(lines(t)) >= n) & pairwise(lines(t), lambda a, b: a >= b, F.lower),
    "title_case": lambda t: F.forall(words(t), lambda w: ~w.rlike("[A-Za-z]") | (w == F.initcap(w))),
    "output_template": lambda t, heads=("My Answer:", "My Conclusion:", "Future Outlook:"): reduce(lambda a, h: a & t.contains(h), heads, F.lit(True)),
    "incrementing_alliteration": rising_alliteration,
    "nested_quotes": nested_quotes,
    "emoji_sentences": emoji_sentences,
    "choice_questions": choice_questions,
    "reversed_words": lambda t, phrase="bald eagle": (how_many(plain(t), phrase.split()) == len(phrase.split())) & F.array_join(F.reverse(split_words(plain(t))), " ").contains(phrase),
    "special_csv": special_csv,
    "quoted_csv": quoted_csv,
    "no_whitespace": lambda t: ~t.rlike(r"\s"),
}


def strict(response: Column, name: str, **parameters) -> Column:
    """Blank responses fail; a name that is no check is an error."""
    if name not in CHECKS:
        raise ValueError(f"no check is named {name}")
    return F.coalesce(response.rlike(r"\S") & CHECKS[name](response, **parameters), F.lit(False))


def variants(response: Column) -> list[Column]:
    """The response without its first, last or both lines, each with and without asterisks."""
    parts = F.split(response, "\n", -1)
    n = F.size(parts)
    cut = lambda start, drop: F.trim(F.array_join(F.slice(parts, F.lit(start), F.greatest(n - drop, F.lit(0))), "\n"))
    texts = [response, cut(2, 1), cut(1, 1), cut(2, 2)]
    return texts + [F.replace(t, F.lit("*"), F.lit("")) for t in texts]


def loose(response: Column, name: str, **parameters) -> Column:
    return reduce(lambda a, b: a | b, [strict(v, name, **parameters) for v in variants(response)])
