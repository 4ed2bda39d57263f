"""Cards beside other numbers and dates before a time."""

import random

import pytest

from nearfold.llm import feistel as fp

P = fp.Permutation(b"k")
CARD = "4111 1111 1111 1111"


@pytest.mark.parametrize(
    "text",
    [f"pay {CARD} 12/27", f"{CARD} 123 cvv", f"order 12 {CARD}", f"12 345 678 {CARD} 9", "4111111111111111 12/27", "no 7 5500-0000-0000-0004 12", "41111111 11111111 123"],
)
def test_card_beside_a_number(text):
    new, counts = fp.pseudonymise(text, P)
    assert counts == {"card": 1} and new != text and len(new) == len(text)
    assert "1111 1111" not in new and "0000-0000" not in new and "11111111" not in new
    assert fp.pseudonymise(new, P, back=True) == (text, counts)


def test_cards_side_by_side():
    text = f"{CARD} 5500 0000 0000 0004 and 2024-01-15 {CARD}"
    new, counts = fp.pseudonymise(text, P)
    assert counts == {"card": 3, "date": 1} and "1111 1111" not in new and "0000 0000" not in new
    assert fp.pseudonymise(new, P, back=True) == (text, counts)


def test_neighbours_roundtrip():
    rng = random.Random(5)
    same = 0
    for _ in range(300):
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = body + fp._luhn_digit(body)
        card = " ".join(card[i : i + 4] for i in range(0, 16, 4))
        text = rng.choice(["{c} {a}", "{b} {c}", "{b} {c} {a}"]).format(c=card, a=rng.randrange(100, 1000), b=rng.randrange(1, 10_000))
        new, counts = fp.pseudonymise(text, P)
        assert counts["card"] >= 1 and card not in new
        assert fp.pseudonymise(new, P, back=True) == (text, counts), (text, new)
        same += fp.pseudonymise(card, P)[0] in new
    assert same > 200


@pytest.mark.parametrize("text", ["2024-01-15T10:00:00Z", "on 1999-12-31T2359.", "[2024-01-15t10:00]"])
def test_time_stamp(text):
    new, counts = fp.pseudonymise(text, P)
    assert counts == {"date": 1} and new != text and new.upper().partition("T")[2] == text.upper().partition("T")[2]
    assert fp.pseudonymise(new, P, back=True) == (text, counts)


def test_left_alone():
    for text in ["2024-01-15Tuesday", "2024-01-15x", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20", "4111 1111 1111 1112 12/27"]:
        assert fp.pseudonymise(text, P) == (text, {}), text
