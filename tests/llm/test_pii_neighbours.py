"""Values beside other numbers, and further forms of phones and dates."""

import re

import pytest

from scorewright.llm import pii

CARD = r"\d{4} \d{4} \d{4} \d{4}"
CASES = [
    ("Card 4111 1111 1111 1111 12/27", rf"Card {CARD} 12/27", ["4111 1111 1111 1111"]),
    ("pay 4111111111111111 20 times", r"pay \d{16} 20 times", ["4111111111111111"]),
    ("1234 4111 1111 1111 1111", rf"1234 {CARD}", ["4111 1111 1111 1111"]),
    ("amex 3782 822463 10005 100", r"amex \d{4} \d{6} \d{5} 100", ["3782 822463 10005"]),
    ("4111 1111 1111 1111 5500 0000 0000 0004", rf"{CARD} {CARD}", ["4111 1111 1111 1111", "5500 0000 0000 0004"]),
    ("call 555-123-4567 555-987-6543", r"call \d{3}-\d{3}-\d{4} \d{3}-\d{3}-\d{4}", ["555-123-4567", "555-987-6543"]),
    ("at 555 123 4567.", r"at \d{3} \d{3} \d{4}\.", ["555 123 4567"]),
    ("at +44 20 7946 0958.", r"at \+44 \d\d \d{4} \d{4}\.", ["20 7946 0958"]),
    ("at +354 555 12", r"at \+3\d\d \d{3} \d\d", ["54 555 12"]),
    ("2024-01-02T10:00", r"\d{4}-\d\d-\d\dT10:00", ["2024-01-02"]),
    ("2024/01/02, 2024.01.02.", r"\d{4}/\d\d/\d\d, \d{4}\.\d\d\.\d\d\.", ["2024/01/02", "2024.01.02"]),
]


@pytest.fixture(scope="module")
def shown(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    return {r.doc_id: r for r in pii.pseudonymize(df, "k").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_values_and_neighbours(shown, i):
    _, form, values = CASES[i]
    assert re.fullmatch(form, shown[i].text) and not [v for v in values if v in shown[i].text]
    assert shown[i].n_pseudonyms == len(values)
