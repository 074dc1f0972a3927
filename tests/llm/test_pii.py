import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerleaf.llm import pii

from .helpers import docs, rows

KEY = b"test-key"
TEXT = 'Call +1 (487) 555-7209 or (212) 555-0100, card 4845 1681 1440 7329, 4845168114407329, mail a.b9@mail.example.com, ip 97.51.17.173, ssn 123-45-6789, born 1980-02-29, 31/12/1999 or 12/31/1999, IBAN GB82 WEST 1234 5698 7654 32, token = "04dbebab91ab8568".'


def test_every_kind_is_replaced_linked_and_restored():
    out, found = pii.pseudonymise(TEXT, KEY)
    assert [k for k, *_ in found] == ["phone", "phone", "card", "card", "email", "ip", "ssn", "date", "date", "date", "iban", "secret"]
    for _, a, b in found:
        assert TEXT[a:b] not in out
    cards = re.findall(r"card ([\d ]+), (\d+)", out)[0]
    assert cards[0].replace(" ", "") == cards[1] and pii.luhn(cards[1])
    assert [k for k, *_ in pii.pseudonymise(out, KEY)[1]] == [k for k, *_ in found]
    assert pii.restore(out, KEY) == TEXT and pii.pseudonymise(TEXT, b"other")[0] != out


def test_invalid_values_stay():
    text = "4845168114407328 1234567890123456 300.1.1.1 1.2.3 2021-02-30 000-12-3456 v1.2.3.4.5 12345 0000000000000000"
    assert pii.pseudonymise(text, KEY) == (text, [])


@settings(max_examples=200)
@given(st.integers(2, 10**30), st.data())
def test_permute_is_a_bijection(size, data):
    value = data.draw(st.integers(0, size - 1))
    out = pii.permute(value, size, KEY, "t")
    assert 0 <= out < size and pii.permute(out, size, KEY, "t", back=True) == value


def test_small_domains_are_permuted_whole():
    for size in (1, 2, 3, 10, 97):
        assert sorted(pii.permute(v, size, KEY, "t") for v in range(size)) == list(range(size))


def test_redact_edges(spark):
    data = [*rows(), (50, TEXT, "en", "s", 1, "", 0, "", ""), (51, "x" * 100_000 + " " + TEXT, "en", "s", 1, "", 0, "", "")]
    got = sorted(((r.doc_id, r.text, r.n_pii) for r in pii.redact(docs(spark, data), KEY).collect()), key=str)
    assert got == sorted(((i, *((lambda p: (p[0], len(p[1])))(pii.pseudonymise(t, KEY)))) for i, t, *_ in data), key=str)
    assert dict((i, t) for i, t, _ in got)[5] is None
    assert pii.redact(docs(spark, []), KEY).count() == 0


def test_values_with_digits_or_capitals_behind_or_before_them():
    card = "4111 1111 1111 1111"
    cases = [
        (f"card {card} 12/26", [card]),
        (f"card {card} 123", [card]),
        (f"card {card} 12/12/2026", [card, "12/12/2026"]),
        (f"no 12 {card} or 12-4111-1111-1111-1111", [card, "4111-1111-1111-1111"]),
        ("IBAN ES91 2100 0418 4502 0005 1332 EUR", ["ES91 2100 0418 4502 0005 1332"]),
        ("IBAN ES9121000418450200051332EUR", ["ES9121000418450200051332"]),
        (f"BE68 5390 0754 7034 VISA {card}", ["BE68 5390 0754 7034", card]),
    ]
    for text, want in cases:
        out, found = pii.pseudonymise(text, KEY)
        assert [text[a:b] for _, a, b in found] == want
        assert not any(w in out for w in want) and pii.restore(out, KEY) == text


def _card(stem):
    return next(stem + c for c in pii.DIGITS if pii.luhn(stem + c))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text("0123456789", min_size=1, max_size=4), st.text("123456789", min_size=12, max_size=18).map(_card), st.sampled_from(["4111 1111 1111 1111", "BE68 5390 0754 7034", "EUR", "VISA", "12/26", "97.5.1.173", "1980-02-29"])), max_size=8), st.sampled_from([" ", "-", ", "]))
def test_neighbours_are_restored(parts, mark):
    text = mark.join(parts)
    out, found = pii.pseudonymise(text, KEY)
    assert pii.restore(out, KEY) == text and [k for k, *_ in pii.pseudonymise(out, KEY)[1]] == [k for k, *_ in found]


def _new(text, key=b"k"):
    out = pii.pseudonymise(text, key)[0]
    assert pii.restore(out, key) == text
    return out


def test_spellings_of_one_number_are_linked():
    digits = lambda t: "".join(c for c in _new(t) if c.isdigit())
    a, b, c = digits("call +1 487 555 7209 now"), digits("call +14875557209 now"), digits("call (487) 555-7209 now")
    assert a == b and a[1:] == c and a[1:] != "4875557209"
    assert digits("+44 20 7946 0958 ")[:2] == "44" and digits("+353 1 679 1000 ")[:3] == "353"


def test_spellings_of_one_address_are_linked():
    a, b = _new("to Ann.Lee@Example.com!"), _new("to ann.lee@example.com!")
    assert a.lower() == b.lower() != "to ann.lee@example.com!" and a[3].isupper() and a[7].isupper()


def test_letters_beyond_ascii_are_replaced():
    for local in ("ü", "žofie", "анна", "ÅSA"):
        assert local not in _new(f"mail {local}@x.com, please")


@pytest.mark.parametrize("text", ["0 0 0 0 0 1980-02-29", "6891-415-555-2671", "123-45-6789-415-555-2671"])
def test_a_pseudonym_makes_no_new_value_with_its_neighbours(text):
    out, found = pii.pseudonymise(text, KEY)
    assert out != text and pii.restore(out, KEY) == text and [k for k, *_ in pii.pseudonymise(out, KEY)[1]] == [k for k, *_ in found]


OF_EVERY_KIND = ["4111 1111 1111 1111", "BE68 5390 0754 7034", "97.5.1.173", "1980-02-29", "01.02.2020", "415-555-2671", "(415) 555-2671", "+49 30 1234567", "123-45-6789", "x.y@ex.com", 'token="abcd1234efgh"']


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(OF_EVERY_KIND), st.text("0123456789", min_size=1, max_size=17)), max_size=8), st.sampled_from([" ", "-", ", ", ".", ""]))
def test_neighbours_of_every_kind_are_restored(parts, mark):
    text = mark.join(parts)
    out, found = pii.pseudonymise(text, KEY)
    assert pii.restore(out, KEY) == text and [k for k, *_ in pii.pseudonymise(out, KEY)[1]] == [k for k, *_ in found]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([*OF_EVERY_KIND, "4111 1111 1111 1112", "300.1.1.1", "1980-02-30", "000-45-6789", "BE68 5390 0754 7035"]), max_size=6))
def test_finds_what_was_put_in(values):
    """A brute-force finder: every valid value stands between words, every invalid one is left alone."""
    text, want = "", []
    for v in values:
        text += "words and "
        if v in OF_EVERY_KIND:
            want.append((len(text), len(text) + len(v.removesuffix('"'))))
        text += v + " here. "
    out, found = pii.pseudonymise(text, KEY)
    assert [(a, b) for _, a, b in found] == want
    at = 0
    for a, b in [*want, (len(text), len(text))]:
        assert out[at:a] == text[at:a] and (a == b or out[a:b] != text[a:b])
        at = b
