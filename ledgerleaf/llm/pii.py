"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted by a keyed Feistel network.

Equal values get equal pseudonyms in every document under one key, and ``restore`` undoes them. Each kind of value is
permuted within its own valid forms: a card number stays a card number with a right check digit, a date stays a date.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from hashlib import blake2b
from itertools import takewhile
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

#: Bytes of text handled at once; a longer text is handled alone.
SLICE = 4 << 20
ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
_PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:(?<![A-Za-z])(?:token|secret|password|passwd|api[_-]?key)[\"']?\s*[=:]\s*[\"'])[A-Za-z0-9+/_=-]{8,}(?=[\"'])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "date": r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})(?![\d-]|\.\d)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "phone": r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)",
}
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS.items()))
_EACH = {k: re.compile(p) for k, p in _PATTERNS.items()}
#: A card number right behind a dash, within a longer run of digits.
_BEHIND_DASH = re.compile(_PATTERNS["card"].removeprefix(r"(?<![\w.-])"))
_TOKEN = re.compile(r"\w+|.", re.DOTALL)
#: How far a card number or an IBAN, with its separators, can reach.
REACH = 64
#: The lengths of IBANs that countries have registered.
IBAN_LENGTHS = {
    n: codes.split()
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
_IBAN_LENGTH = {c: n for n, codes in IBAN_LENGTHS.items() for c in codes}
#: Whether a pseudonym would be found again at the same place, among the same neighbours.
Fits = Callable[[str], bool]
_MAY = re.compile(r"[0-9@=:]")
DIGITS = "0123456789"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters beyond ASCII that are permuted among their own kind: first and last code point, and what lies between and isn't one.
_RANGES = [(0xDF, 0xFF, "÷"), (0xC0, 0xDE, "×"), (0x3B1, 0x3C9, ""), (0x391, 0x3A9, "\u03a2"), (0x430, 0x44F, ""), (0x410, 0x42F, "")]
ALPHABETS = [DIGITS, UPPER, LOWER, *("".join(c for c in map(chr, range(a, b + 1)) if c not in no) for a, b, no in _RANGES)]
_SET = {c: s for s in ALPHABETS for c in s}
#: Country codes of two digits, fixed values; 1 and 7 have one digit, all others three.
TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network on two near equal halves, walked until it is in range."""
    if size < 2:
        return value
    high = isqrt(size - 1) + 1
    low = -(-size // high)

    def step(i: int, other: int, modulus: int) -> int:
        data = f"{tweak}:{size}:{i}:{other}".encode()
        return int.from_bytes(blake2b(data, key=key, digest_size=64).digest(), "big") % modulus

    while True:
        a, b = divmod(value, low)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2:
                b = (b + (-1 if back else 1) * step(i, a, low)) % low
            else:
                a = (a + (-1 if back else 1) * step(i, b, high)) % high
        value = a * low + b
        if value < size:
            return value


def permute_text(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Digits, capitals and small letters each stay what they are, and all of them are permuted as one number."""
    sets = [_SET.get(c, "") for c in text]
    size = value = 0
    for c, s in zip(text, sets, strict=True):
        if s:
            value, size = value * len(s) + s.index(c), (size or 1) * len(s)
    if not size:
        return text
    value, out = permute(value, size, key, f"{tweak}:{''.join(s[:1] for s in sets)}", back), list(text)
    for i in reversed(range(len(text))):
        if sets[i]:
            value, r = divmod(value, len(sets[i]))
            out[i] = sets[i][r]
    return "".join(out)


def _fill(template: str, symbols: str) -> str:
    """The letters and digits of a template replaced in order; what separates them stays."""
    left = iter(symbols)
    return "".join(next(left) if c.isalnum() else c for c in template)


def _walk(text: str, step: Callable[[str], str], valid: Callable[[str], bool]) -> str:
    text = step(text)
    while not valid(text):
        text = step(text)
    return text


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _read_date(text: str) -> tuple[int, str] | None:
    """A date's day number and its form; day before month where both readings are right."""
    try:
        if "-" in text:
            return date.fromisoformat(text).toordinal(), "iso"
    except ValueError:
        return None
    a, b, year = map(int, re.split(r"[/.]", text))
    for form, month, day in (("dmy", b, a), ("mdy", a, b)):
        try:
            return date(year, month, day).toordinal(), form
        except ValueError:
            continue
    return None


def _write_date(day: int, form: str, like: str) -> str:
    d = date.fromordinal(day)
    if form == "iso":
        return d.isoformat()
    mark = "/" if "/" in like else "."
    wide = "{:02d}" if len(like) == 10 else "{:d}"
    first, second = (d.day, d.month) if form == "dmy" else (d.month, d.day)
    return mark.join((wide.format(first), wide.format(second), f"{d.year:04d}"))


def _date(text: str, key: bytes, back: bool, fits: Fits) -> str | None:
    read = _read_date(text)
    if read is None or not FIRST_DAY <= read[0] <= LAST_DAY:
        return None
    day, form = read
    while True:  # the pseudonym must read back as the same form
        day = FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, f"date:{form}", back)
        if _read_date(out := _write_date(day, form, text)) == (day, form) and fits(out):
            return out


def _card(text: str, key: bytes, back: bool, fits: Fits) -> str | None:
    digits = "".join(c for c in text if c.isdigit())
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    step = lambda d: d[0] + permute_text(d[1:], key, f"card:{d[0]}", back)
    checked = lambda d: next(d + c for c in DIGITS if luhn(d + c))
    return _fill(text, checked(_walk(digits[:-1], step, lambda d: len(set(checked(d))) > 1 and fits(_fill(text, checked(d))))))


def _iban(text: str, key: bytes, back: bool, fits: Fits) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    step = lambda a: permute_text(a, key, f"iban:{plain[:2]}", back)
    checked = lambda a: _fill(text, f"{plain[:2]}{98 - _iban_rest(f'{plain[:2]}00{a}'):02d}{a}")
    return checked(_walk(plain[4:], step, lambda a: fits(checked(a))))


def _ip(text: str, key: bytes, back: bool, fits: Fits) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    value = int.from_bytes(bytes(parts), "big")
    while True:
        value = permute(value, 2**32, key, "ip", back)
        if fits(out := ".".join(map(str, value.to_bytes(4, "big")))):
            return out


def _email(text: str, key: bytes, back: bool, fits: Fits) -> str | None:
    """Letter case is kept apart, so that all spellings of an address are linked."""
    local, _, domain = text.rpartition("@")
    small = "".join(c.lower() if len(c.lower()) == 1 and c.lower().upper() == c else c for c in local)
    spelt = lambda new: "".join(n.upper() if s != c and len(n.upper()) == 1 and n.upper().lower() == n else n for n, s, c in zip(new, small, local, strict=True)) + f"@{domain}"
    return spelt(_walk(small, lambda x: permute_text(x, key, f"email:{domain.lower()}", back), lambda x: fits(spelt(x))))


def _country(digits: str) -> int:
    """How many digits of an international number are the country's code."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3


def _phone(text: str, key: bytes, back: bool, fits: Fits) -> str | None:
    """The national number is permuted by itself, so that it is linked with and without a country's code."""
    digits = "".join(c for c in text if c.isdigit())
    if not 7 <= len(digits) <= 15:
        return None
    head = _country(digits) if text[0] == "+" else 0
    filled = lambda d: _fill(text, digits[:head] + d)
    return filled(_walk(digits[head:], lambda d: permute_text(d, key, "phone", back), lambda d: fits(filled(d))))


def _ssn(text: str, key: bytes, back: bool, fits: Fits) -> str | None:
    digits = text.replace("-", "")
    return _fill(text, _walk(digits, lambda d: permute_text(d, key, "ssn", back), lambda d: _ssn_ok(d) and fits(_fill(text, d)))) if _ssn_ok(digits) else None


def _secret(text: str, key: bytes, back: bool, fits: Fits) -> str | None:
    at = max(text.rfind('"'), text.rfind("'")) + 1
    return text[:at] + _walk(text[at:], lambda x: permute_text(x, key, "secret", back), lambda x: fits(text[:at] + x))


KINDS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}


def _card_ends(text: str) -> Iterator[int]:
    """Where a card number at the start of a run of digits may end: behind 19 to 13 digits, at the end of a group."""
    ends, n = [], 0
    for m in re.finditer(r"\d+", text):
        n += len(m[0])
        if 13 <= n <= 19:
            ends.append(m.end())
    return reversed(ends)


def _iban_ends(text: str) -> Iterator[int]:
    """Where an IBAN may end: at its country's length, else at the end of a group, the longest first."""
    places = [i for i, c in enumerate(text) if c != " "]
    own = _IBAN_LENGTH.get(text[:2], 0)
    if 0 < own <= len(places):
        yield places[own - 1] + 1
    yield from (i for i in range(len(text), 0, -1) if text[i - 1] != " " and text[i : i + 1] in ("", " "))


def _valid(kind: str, text: str) -> bool:
    """Whether a value passes its kind's check."""
    plain = text.replace(" ", "")
    if kind == "card":
        digits = "".join(c for c in text if c.isdigit())
        return luhn(digits) and len(set(digits)) > 1
    if kind == "iban":
        return 15 <= len(plain) <= 34 and _iban_rest(plain) == 1
    if kind == "date":
        read = _read_date(text)
        return read is not None and FIRST_DAY <= read[0] <= LAST_DAY
    if kind == "ip":
        return all(int(p) <= 255 and (len(p) == 1 or p[0] != "0") for p in text.split("."))
    if kind == "phone":
        return 7 <= sum(c.isdigit() for c in text) <= 15
    return kind != "ssn" or _ssn_ok(text.replace("-", ""))


_ENDS = {"card": _card_ends, "iban": _iban_ends}


def _value(m: re.Match, kind: str) -> tuple[str, int, int] | None:
    """The kind, start and end of the value at a match's start, if one passes its check."""
    for n in _ENDS[kind](m[0]) if kind in _ENDS else (len(m[0]),):
        if _valid(kind, m[0][:n]):
            return kind, m.start(), m.start() + n
    return None


def spans(text: str, at: int = 0) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of each value from ``at`` on; behind a match without one the search goes on at its next token."""
    while m := _ANY.search(text, at):
        kinds = list(_EACH)
        found = _value(m, m.lastgroup)
        for kind in kinds[kinds.index(m.lastgroup) + 1 :]:
            if found is None and (other := _EACH[kind].match(text, m.start())):
                found = _value(other, kind)
        at = _TOKEN.match(text, m.start()).end()
        while found is None and text[at : at + 1] == "-" and m.lastgroup in ("card", "phone", "date", "ssn") and (m2 := _BEHIND_DASH.match(text, at + 1)):
            found = _value(m2, "card")
            at = _TOKEN.match(text, at + 1).end()
        if found:
            yield found
            at = found[2]


def pseudonymise(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with its values replaced, and each one's kind, start and end in the original, in code points.

    Values are replaced from the last to the first and restored from the first to the last, so that in both directions
    a value stands between original text and pseudonyms; those that would move a value's border are walked past.
    """
    if not text or not _MAY.search(text):
        return text, []
    found = list(spans(text))
    if back:
        return _restored(text, key, found), found
    out, right, end = [], "", len(text)
    for i in reversed(range(len(found))):
        kind, a, b = found[i]
        right = (text[b:end] + right)[:REACH]
        base = _base(found[: i + 1], a)
        new = KINDS[kind](text[a:b], key, False, _fits(text[max(base - 1, 0) : a], text[a:b], right, min(base, 1)))
        out += [text[b:end], new]
        right, end = (new + right)[:REACH], a
    return "".join([text[:end], *reversed(out)]), found


def _restored(text: str, key: bytes, found: list[tuple[str, int, int]]) -> str:
    """The original of ``text``, whose values are at ``found``."""
    out, old, left, off, end = [], [], "", 0, 0
    for kind, a, b in found:
        left += text[end:a]
        at = off + len(left)
        old.append((kind, at, at))
        base = _base(old, at)
        new = KINDS[kind](text[a:b], key, True, _fits(left[max(base - 1, 0) - off :], text[a:b], text[b : b + REACH], min(base, 1)))
        out += [text[end:a], new]
        left, end = left + new, b
        old[-1] = (kind, at, at + len(new))
        keep = max(_base([*old, ("", at + len(new), 0)], at + len(new)) - 1, off)
        left, off = left[keep - off :], keep
    return "".join([*out, text[end:]])


def _base(found: list[tuple[str, int, int]], at: int) -> int:
    """From where to search so that what may reach the last value, which begins at ``at``, is found."""
    j = len(found) - 1
    while j and found[j - 1][2] > at - REACH:
        j -= 1
    return max(found[j - 1][2] if j else 0, found[j][1] - REACH)


def _fits(left: str, old: str, right: str, at: int) -> Fits:
    """Whether a value in place of ``old`` leaves the borders of all values up to it as they are."""
    head = lambda value: [*takewhile(lambda s: s[1] <= len(left), spans(left + value + right, at))]
    want = None

    def fits(new: str) -> bool:
        nonlocal want
        want = head(old) if want is None else want
        return head(new) == want

    return fits


def restore(text: str | None, key: bytes) -> str | None:
    """The original of a pseudonymised text."""
    return pseudonymise(text, key, back=True)[0]


def redact(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_pii, pii): every whole text with its personal values replaced by pseudonyms under ``key``.

    Takes doc_id and text; other columns are ignored. Null texts stay null; texts without such values stay as they
    are; repeated rows stay. ``pii`` lists kind, start and end in the original text. Where what looks like a card number or
    an IBAN fails its check, its shorter ends and later starts are tried. Values that fail their check
    (a card's check digit, an address above 255, no such day) aren't personal values and stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(key)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                texts, found = zip(*(pseudonymise(t, shared.value) for t in part.column(1).to_pylist()), strict=True)
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, found)), pa.int64()), pa.array(spans, span)], names=["doc_id", "text", "n_pii", "pii"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, n_pii long, pii array<struct<kind:string,start:int,end:int>>")
