"""PII: format-preserving Feistel pseudonyms, built from DataFrame functions only.

Matches are validated (Luhn for cards, octets for IPv4, the calendar for dates, number ranges for national ids) and
then permuted by a keyed Feistel network within their own format, so that equal values stay equal across documents
while the value itself goes.  Two networks are used: one on the characters of a value (digits stay digits, letters stay
letters of the same case) and one on a pair of residues (IPv4 addresses, days of a 400-year cycle).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Kinds of values in the order in which they are tried at a place; an earlier kind takes its text first.
PATTERNS = {
    # Java repeats a group by recursion, which a long domain overflows: labels and dots are taken one by one, up to the end
    # of the run or to two dots.  A local part begins where its run does, or where the last match has ended.
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@(?=[A-Za-z0-9-]+\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.\.|\.?(?![A-Za-z0-9.-]))",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-SU-Za-z-]|T(?![0-9]{2}))|(?<![0-9A-Za-z./-])[0-9]{4}(?:/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{2}(?![0-9A-SU-Za-z/-]|T(?![0-9]{2})|\.[0-9])",
    "national": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9](?:[ .()-]{0,2}[0-9]){7,14})(?![0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())
#: Cards are looked for at every place, as a check digit that fails at one place says nothing of the next: the usual
#: groups and unbroken runs; then any other groups, as long as they go.
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
GROUPED = (r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{3}", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", r"[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}", r"[0-9]{13,19}")
START, END = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
ROUNDS, WALK = 8, 32
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY, DAYS = "1700-01-01", 146_097  # the Gregorian cycle of 400 years
DAY_RADIX = (189, 773)  # 189 * 773 = 146,097


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shifted(chars: Column, digest: Column) -> Column:
    """Each digit or letter moves within its own class by two hexadecimal digits of the digest."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for alphabet in (UPPER, LOWER, DIGITS):
            at = F.instr(F.lit(alphabet), c)
            out = F.when(at > 0, F.substr(F.lit(alphabet), F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.transform(chars, move)


def permute_text(text: Column, key: str, tweak: Column) -> Column:
    """Keyed bijection of strings that keeps length, class of every character and other characters."""
    chars = _chars(text)
    half = F.floor(F.size(chars) / 2).cast("int")
    rest = F.size(chars) - half
    start = F.struct(F.slice(chars, F.lit(1), half).alias("a"), F.slice(chars, half + 1, rest).alias("b"))

    def step(state: Column, i: Column) -> Column:
        def digest(side: Column) -> Column:
            return F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), tweak, F.array_join(side, "")), 256)

        a, b = state["a"], state["b"]
        even = i % 2 == 0
        return F.struct(F.when(even, _shifted(a, digest(b))).otherwise(a).alias("a"), F.when(even, b).otherwise(_shifted(b, digest(a))).alias("b"))

    done = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)
    return F.array_join(F.concat(done["a"], done["b"]), "")


def permute_number(number: Column, radix: tuple[int, int], key: str, tweak: str) -> Column:
    """Keyed bijection of 0 .. radix[0] * radix[1] - 1."""
    start = F.struct(F.floor(number / radix[1]).cast("long").alias("a"), F.pmod(number, F.lit(radix[1])).cast("long").alias("b"))

    def step(state: Column, i: Column) -> Column:
        def spread(side: Column) -> Column:
            return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), F.lit(tweak), side.cast("string")), 256), 1, 12), 16, 10).cast("long")

        a, b = state["a"], state["b"]
        even = i % 2 == 0
        return F.struct(F.when(even, F.pmod(a + spread(b), F.lit(radix[0]))).otherwise(a).alias("a"), F.when(even, b).otherwise(F.pmod(b + spread(a), F.lit(radix[1]))).alias("b"))

    done = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)
    return done["a"] * radix[1] + done["b"]


def _luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Sum in which every second digit counts doubled, from the given place (0 or 1) counted from the right."""
    values = F.reverse(_chars(digits))
    weighed = F.transform(values, lambda c, i: F.when(F.pmod(i, F.lit(2)) == doubled_from_right, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(text: Column, digits: Column) -> Column:
    """The text's other characters with new digits at the places of the old."""
    return F.array_join(F.zip_with(F.split(text, "[0-9]", -1), _chars(digits), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _whole(kind: str) -> str:
    pattern = CARD if kind == "card" else PATTERNS[kind]
    return "^(?:" + re.sub(r"\(\?<!\[[^\]]*\]\)", "", pattern) + ")$"


def cards_in(text: Column) -> Column:
    """Distinct values of a text that are written like cards and pass their check digit, longest first."""
    found = [F.regexp_extract_all(text, F.lit(f"{START}(?=({form}){END})"), F.lit(1)) for form in GROUPED]
    found.append(F.regexp_extract_all(text, F.lit(START + CARD + END), F.lit(0)))
    valid = F.filter(F.array_distinct(F.concat(*found)), lambda v: _luhn_sum(_digits(v), 1) % 10 == 0)
    return F.transform(F.array_sort(F.transform(valid, lambda v: F.struct((-F.char_length(v)).alias("n"), v.alias("v")))), lambda x: x["v"])


def any_of(text: Column) -> Column:
    """The pattern of all values of a text: that of every kind, and the text's own valid cards."""
    # Cards hold digits, spaces and hyphens only, which stand for themselves.
    own = F.concat(F.lit(f"{ANY}|{START}(?:"), F.array_join(cards_in(text), "|"), F.lit(f"){END}"))
    own = F.when(text.rlike(START + CARD + END), F.when(F.size(cards_in(text)) > 0, own))
    return F.coalesce(own, F.lit(ANY))


def kind_of(value: Column) -> Column:
    """Kind of a matched value that passes its validation; null for one that does not."""
    digits = _digits(value)
    octets = F.split(value, r"\.", -1)
    day = F.datediff(F.try_to_timestamp(F.translate(value, "/.", "--"), F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(value.rlike(_whole("ipv4")), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), F.lit("ipv4")))
        .when(value.rlike(_whole("date")), F.when((day >= 0) & (day < DAYS), F.lit("date")))
        .when(value.rlike(_whole("national")), F.when(_valid_national(digits), F.lit("national")))
        .when(value.rlike(_whole("phone")), F.lit("phone"))
        .when(value.rlike(_whole("card")), F.when(_luhn_sum(digits, 1) % 10 == 0, F.lit("card")))
    )


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one matched value; a value that fails its validation stays as it is."""
    digits = _digits(value)
    n = F.char_length(digits)
    local, domain = F.regexp_extract(value, "^([^@]*)@", 1), F.regexp_extract(value, "@(.*)$", 1)
    octets = F.split(value, r"\.", -1)
    address = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o.cast("long"))
    moved = permute_number(address, (65_536, 65_536), key, "ipv4")
    dotted = F.concat_ws(".", *[F.pmod(F.shiftright(moved, 8 * k), F.lit(256)).cast("string") for k in (3, 2, 1, 0)])
    day = F.datediff(F.try_to_timestamp(F.translate(value, "/.", "--"), F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))
    dated = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), permute_number(day, DAY_RADIX, key, "date").cast("int")), "yyyy-MM-dd")
    dated = F.replace(dated, F.lit("-"), F.substr(value, F.lit(5), F.lit(1)))
    # A card's last digit is computed anew, which keeps the number valid and the map one-to-one on valid numbers.
    body = permute_text(F.substr(digits, F.lit(1), n - 1), key, F.lit("card"))
    card = F.concat(body, F.pmod(10 - _luhn_sum(body, 0), F.lit(10)).cast("string"))
    # A phone number keeps its country code: the last ten digits move, of a short international one all but the first.
    moving = F.when(value.startswith("+"), F.least(n - 1, F.lit(10))).otherwise(F.lit(10))
    phone = F.concat(F.substr(digits, F.lit(1), n - moving), permute_text(F.substr(digits, n - moving + 1, moving), key, F.lit("phone")))
    kind = kind_of(value)
    return (
        F.when(kind == "email", F.concat(permute_text(local, key, F.concat(F.lit("email"), domain)), F.lit("@"), domain))
        .when(kind == "ipv4", dotted)
        .when(kind == "date", dated)
        .when(kind == "national", _refill(value, permute_national(digits, key)))
        .when(kind == "card", _refill(value, card))
        .when(kind == "phone", _refill(value, phone))
        .otherwise(value)
    )


def _valid_national(digits: Column) -> Column:
    area, group, serial = F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4)
    return (area != "000") & (area != "666") & (area < "900") & (group != "00") & (serial != "0000")


def permute_national(digits: Column, key: str) -> Column:
    """Keyed bijection of valid national ids: the permutation is walked along until it meets a valid one again.

    Eight of nine numbers are valid, so that more than ``WALK`` steps (one in 10^30) do not occur.
    """
    step = lambda d, i: F.when((i > 0) & _valid_national(d), d).otherwise(permute_text(d, key, F.lit("national")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), digits, step)


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace personal values in every whole text; all other columns and rows stay as they are.

    Adds ``n_pseudonyms`` (long): the values replaced.  A null or empty text stays as it is with 0.  Texts without a
    match skip the work.  The key is a secret of whoever runs this; equal keys link equal values over runs and tables.
    """
    body, pattern = F.col(text), F.col("_pattern")
    columns = docs.columns
    docs = docs.withColumn("_pattern", F.when(body.rlike("[0-9@]"), any_of(body)))
    values = F.regexp_extract_all(body, pattern, F.lit(0))
    between = F.split(body, pattern, -1)
    has = pattern.isNotNull() & body.rlike(ANY) | (pattern != ANY)
    done = F.array_join(F.zip_with(between, F.transform(values, lambda v: pseudonym(v, key)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    count = F.size(F.filter(values, lambda v: kind_of(v).isNotNull())).cast("long")
    return docs.withColumns({text: F.when(has, done).otherwise(body), "n_pseudonyms": F.when(has, count).otherwise(F.lit(0).cast("long"))}).select(*[c for c in columns if c != "n_pseudonyms"], "n_pseudonyms")
