"""Cards and IBANs beside other numbers and words."""

import pytest

from sojourn.llm import pseudonyms

CARDS = ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005", "378282246310005", "6011 0009 9013 9424"]
IBANS = ["BE68 5390 0754 7034", "BE68539007547034", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "GB82 WEST 1234 5698 7654 32"]


def _permute(value, size, tweak):
    return pseudonyms.Feistel(b"key", size, tweak)(value)


def _values(text):
    return [(kind, text[a:b]) for kind, a, b in pseudonyms.pseudonymised(text, _permute)[1]]


@pytest.mark.parametrize("card", CARDS)
@pytest.mark.parametrize(
    "around",
    ["{} 12/27", "{} 123", "{} 10 items", "{} 10.1.2.3", "{}-7", "No 7 {}", "7-{}", "2024 {}", "1234 5678 {} 9012 3456", "12 {} 34", "x1 {} 2"],
)
def test_card_beside_numbers(card, around):
    assert ("card", card) in _values(around.format(card))


@pytest.mark.parametrize("iban", IBANS)
@pytest.mark.parametrize("around", ["{} IBAN", "{} 1234", "{} 12 34", "{} BIC GEBABEBB", "AB12 {}", "IBAN {} EUR 100", "No 7 {} 4111"])
def test_iban_beside_words(iban, around):
    assert ("iban", iban) in _values(around.format(iban))


def test_several_values_in_a_row():
    text = "555-010-9999 4111 1111 1111 1111 3782 822463 10005 2024-02-29 BE68 5390 0754 7034 BE68 5390 0754 7034 078-05-1120 10.1.2.3 4111111111111111"
    new, found = pseudonyms.pseudonymised(text, _permute)
    assert [k for k, _, _ in found] == ["phone", "card", "card", "date", "iban", "iban", "social", "address", "card"]
    assert "4111" not in new and "3782 822463 10005" not in new and "5390 0754" not in new


@pytest.mark.parametrize("text", ["4111 1111 1111 1112 12/27", "No 7 4111111111111112 1", "BE69 5390 0754 7034 IBAN", "41111111111111110000 7"])
def test_invalid_values_beside_numbers_stay(text):
    assert pseudonyms.pseudonymised(text, _permute) == (text, [])
