"""Per-sample metrics as column builders over a prediction and an array of labels; the best label counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from scorewright.functions.text import circled_digits, count_in, ned, ngrams, set_overlaps, squad_normalize, strict_number, tokens, word_tokens


def best(labels: Column, score: Callable[[Column], Column]) -> Column:
    return F.array_max(F.transform(labels, score))


def least(labels: Column, score: Callable[[Column], Column]) -> Column:
    return F.array_min(F.transform(labels, score))


def exact_match(labels: Column, prediction: Column, relative: float | None = None, absolute: float = 1e-6) -> Column:
    """Numbers match within the tolerance (strictly below it), other texts after case, outer space and periods go."""
    plain = lambda x: F.replace(F.trim(F.lower(x)), F.lit("."), F.lit(""))

    def one(label: Column) -> Column:
        want = strict_number(label)
        got = strict_number(F.when(want.isNotNull(), circled_digits(prediction)).otherwise(prediction))
        tolerance = F.abs(want) * relative if relative is not None else F.lit(absolute)
        return F.when(want.isNotNull() & got.isNotNull(), F.abs(want - got) < tolerance).otherwise(plain(label) == plain(prediction)).cast("double")

    return best(labels, one)


def string_match(labels: Column, prediction: Column) -> Column:
    flat = lambda x: F.replace(F.trim(x), F.lit("\n"), F.lit(" "))
    return best(labels, lambda x: flat(prediction).contains(flat(x)).cast("double"))


def substring_match(labels: Column, prediction: Column) -> Column:
    """A label's tokens stand one after another in the prediction's tokens."""
    fenced = lambda x: F.concat(F.lit(" "), F.array_join(word_tokens(x), " "), F.lit(" "))
    return best(labels, lambda x: fenced(prediction).contains(fenced(x)).cast("double"))


def token_prf(overlaps: Column) -> Column:
    """Array of (p, r, f), one for each label, of :func:`gram_overlaps`; :func:`best_field` takes the best of each by itself."""

    def score(s: Column) -> Column:
        n, w, g = s[0], s[1], s[2]
        p = F.when(g == 0, F.lit(0.0)).otherwise(n / g)
        r = F.when(w == 0, F.lit(1.0)).otherwise(n / w)
        f = F.when((g == 0) & (w == 0), F.lit(1.0)).when(n == 0, F.lit(0.0)).otherwise(2.0 * n / (g + w))
        return F.struct(p.alias("p"), r.alias("r"), f.alias("f"))

    return F.transform(overlaps, score)


def squad_tokens(text: Column) -> Column:
    return tokens(squad_normalize(text))


def best_field(structs: Column, field: str) -> Column:
    return F.array_max(F.transform(structs, lambda s: s[field]))


def ned_min(labels: Column, prediction: Column, uncased: bool = True) -> Column:
    return least(labels, lambda x: ned(x, prediction, uncased))


def anls(labels: Column, prediction: Column, threshold: float = 0.5, uncased: bool = True) -> Column:
    d = ned_min(labels, prediction, uncased)
    return F.when(d < threshold, 1 - d).otherwise(F.lit(0.0))


def jaccard_distance(labels: Column, prediction: Column, n: int = 1, overlaps: Column | None = None) -> Column:
    """1 minus shared over all distinct n-grams of a single-space split; 1 without n-grams.

    ``overlaps`` gives a column of :func:`set_overlaps` up to n, where there is one.
    """
    found = set_overlaps(labels, prediction, F.lit(n)) if overlaps is None else overlaps
    here = F.when(prediction.isNotNull(), 1).otherwise(0)

    def distance(label: Column, o: Column) -> Column:
        there = F.when(label.isNotNull(), 1).otherwise(0)
        both = o[3 * n - 3] * here * there
        every = o[3 * n - 2] * there + o[3 * n - 1] * here - both
        return F.when(every == 0, F.lit(1.0)).otherwise(1 - both / every)

    return F.array_min(F.zip_with(labels, found, distance))


def vqa_score(labels: Column, prediction: Column) -> Column:
    """min(1, matches / 3) after lower case, punctuation and articles go."""
    plain = F.transform(labels, squad_normalize)
    return F.least(F.lit(1.0), count_in(plain, squad_normalize(prediction)) / 3.0)


def option_words_match(label: Column, prediction: Column, options: Column) -> Column:
    """All words of the answer and no word that only other options have stand in the prediction."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"\w+"), F.lit(0)))
    gold, got = words(label), words(prediction)
    others = F.array_except(F.flatten(F.transform(F.filter(options, lambda o: o != label), words)), gold)
    return ((F.size(got) > 0) & (F.size(F.array_except(gold, got)) == 0) & ~F.arrays_overlap(got, others)).cast("double")


def denotation_match(label: Column, prediction: Column, separator: str = r"\|") -> Column:
    """Sets of cells agree: equal sizes, and every expected cell is met as a number or a text."""
    cells = lambda x: F.array_distinct(F.transform(F.split(x, separator, -1), lambda c: F.coalesce(strict_number(c).cast("string"), squad_normalize(c))))
    a, b = cells(label), cells(prediction)
    return ((F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)).cast("double")


def scaled_number(text: Column) -> Column:
    """A figure with a unit word or percent sign as a plain number."""
    t = F.lower(F.regexp_replace(text, r"[$,]", ""))
    value = F.regexp_extract(t, r"(-?\d+(?:\.\d+)?)", 1)
    unit = F.when(t.contains("billion"), 1e9).when(t.contains("million"), 1e6).when(t.contains("thousand"), 1e3).when(t.contains("%"), 0.01).otherwise(1.0)
    return F.when(value != "", value.cast("double") * unit)


def figure_match(label: Column, prediction: Column) -> Column:
    bare = lambda x: F.regexp_extract(F.regexp_replace(x, r"[$,]", ""), r"(-?\d+(?:\.\d+)?)", 1)
    same = (scaled_number(label) == scaled_number(prediction)) | ((bare(label) != "") & (bare(label) == bare(prediction)))
    return F.coalesce(same, F.lit(False)).cast("double")


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of [x1, y1, x2, y2]; 0 where either has another arity or no area."""
    side = lambda i, j: F.greatest(F.lit(0.0), F.least(a[j], b[j]) - F.greatest(a[i], b[i]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    inter = side(0, 2) * side(1, 3)
    union = area(a) + area(b) - inter
    return F.when((F.size(a) == 4) & (F.size(b) == 4) & (union > 0), inter / union).otherwise(F.lit(0.0))


def click_accuracy(point: Column, box: Column, width: Column, height: Column, threshold: float = 0.05) -> Column:
    dx = (point[0] - (box[0] + box[2]) / 2) / width
    dy = (point[1] - (box[1] + box[3]) / 2) / height
    return (F.sqrt(dx * dx + dy * dy) <= threshold).cast("double")


def interval_iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Intersection over hull of two intervals; 0 where one is turned around."""
    hull = F.greatest(end_a, end_b) - F.least(start_a, start_b)
    inter = F.greatest(F.lit(0.0), F.least(end_a, end_b) - F.greatest(start_a, start_b))
    return F.when((end_a >= start_a) & (end_b >= start_b) & (hull > 0), inter / hull).otherwise(F.lit(0.0))


def repetition_n(text: Column, n: int) -> Column:
    """Share of n-grams that repeat another."""
    grams = ngrams(tokens(text), n)
    return F.when(F.size(grams) > 0, 1 - F.size(F.array_distinct(grams)) / F.size(grams)).otherwise(F.lit(0.0))


def repetition_window(text: Column, window: int = 16) -> Column:
    """Share of tokens seen among the ``window`` tokens before them."""

    def share(t: Column) -> Column:
        seen = F.filter(F.transform(t, lambda x, i: F.array_contains(F.slice(t, F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window))), x)), lambda x: x)
        return F.when(F.size(t) > 0, F.size(seen) / F.size(t)).otherwise(F.lit(0.0))

    # Bound as a variable, the tokens are made once for a text and not once for each token.
    return F.transform(F.array(tokens(text)), share)[0]


def eligible(labels: Column, metric: Column) -> Column:
    """Null where no label holds text: such samples get no metric of their own."""
    return F.when(F.size(F.filter(labels, lambda x: x != "")) > 0, metric)


def final_prediction(prediction: Column, processed: Column, fallback: str = "") -> Column:
    return F.coalesce(F.nullif(processed, F.lit("")), prediction, F.lit(fallback))
