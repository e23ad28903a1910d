"""Format-preserving pseudonyms by keyed Feistel permutations.

Numbers and dates that validate are replaced by values of the same format: the
value's digits (letters, for the user part of an address) are one integer of a
finite domain, which a Feistel network permutes under a secret key, walking the
cycle until the result falls inside the domain and validates again.  Equal
values get equal pseudonyms in every document, whatever their separators, and
addresses whatever their case; different values of a format stay different; the
key holder can invert it.

Kinds, and what makes a candidate valid:

    card    13-19 digits, single spaces or hyphens between them, Luhn check
    iban    two letters, two check digits, 11-30 letters or digits, mod-97 check
    ssn     ddd-dd-dddd, no part zero, first not 666 or 9xx
    phone   + and 8-15 digits in the usual groups, of which the country code stays (and a
            bracketed trunk zero); without +, (ddd) ddd-dddd of the North American plan
    ip      four octets up to 255
    date    YYYY-MM-DD (a time may follow after T), YYYY/MM/DD, DD.MM.YYYY or DD/MM/YYYY in
            1900-2099, on the calendar; MM/DD/YYYY where the day is over 12 (such dates are
            permuted among themselves)
    email   user@domain.tld: the user part is permuted
    secret  32-64 hexadecimal digits of one case, letters and digits among them

A form may also take the numbers and words behind a value (card, iban, phone).
Where the whole fails its check, its shorter starts that end with a group are
tried, the longest first, then the other kinds; the scan goes on one character
further.  No value takes a part of another one (a card: in the usual groups) that
begins after a space inside it.  A number directly behind a card or telephone
number that makes a longer valid one (by chance one in ten for a card) is taken
with it: nothing stays in clear, but such a value has another pseudonym than
alone, and the way back may take it apart differently.

Anything else that looks alike (a number that fails its check) is left as it is.

Defined results: a null text stays null, an empty one empty; a text may be of
any length, in time that grows in proportion, whatever runs it holds; repeated values and rows get the same pseudonym; an empty table
gives an empty result; `pseudonymise` returns every column of its input, and
only the text changes.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email", "secret")

_FORMS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,4}){2,6}(?!\w)|(?<![\w)])\([2-9]\d\d\) ?[2-9]\d\d-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)(?![A-Za-z_])",
    "date": r"(?<![\w/.-])(?:\d{4}(?P<a>[-/])\d{2}(?P=a)\d{2}|\d{2}(?P<b>[./])\d{2}(?P=b)\d{4})(?:(?=T\d)|(?![\w/-]))(?!\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
_PATTERN = re.compile("|".join(f"(?P<{k}>{form})" for k, form in _FORMS.items()), re.ASCII)
_FORM = {k: re.compile(form, re.ASCII) for k, form in _FORMS.items()}
#: An @ with its domain behind the last character of a user part, and the characters of user parts.
_AT = re.compile(r"(?<=\w)@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}", re.ASCII)
_USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.+-")
#: The telephone country codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Kinds whose form also takes what follows a value, and the kinds that a number before them must not take.
_GREEDY = frozenset(("iban", "phone", "card"))
_FIRM = frozenset(("email", "iban", "phone", "ip", "date"))
_BOUNDARY = re.compile(r"(?<=[A-Za-z0-9])(?![A-Za-z0-9_])", re.ASCII)
_AFTER_SPACE = re.compile(r"(?<= )(?=[^\s(])")
_CARD_GROUPS = re.compile(r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5}", re.ASCII)
_MAYBE = re.compile(r"[0-9@]")


class Feistel:
    """A keyed permutation of the integers 0..size-1, for each size and tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, number: int, half: int, width: int) -> int:
        body = b"%d|%d|%d|" % (number, half, width) + tweak
        return int.from_bytes(hashlib.blake2b(body, key=self.key, digest_size=min(64, (width + 7) // 8 + 8)).digest(), "big") & ((1 << width) - 1)

    def _network(self, value: int, width: int, tweak: bytes, back: bool) -> int:
        left, right = value >> width, value & ((1 << width) - 1)
        for n in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(tweak, n, left, width), left
            else:
                left, right = right, left ^ self._round(tweak, n, right, width)
        return left << width | right

    def permute(self, value: int, size: int, tweak: bytes, valid: Callable[[int], bool] = lambda v: True, back: bool = False) -> int:
        """Walk the cycle of `value` to the next valid one; valid values are permuted among themselves."""
        if size <= 1:
            return value
        width = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            value = self._network(value, width, tweak, back)
            if value < size and valid(value):
                return value


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """The digits in the places of the shape's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


class _Addresses:
    """The addresses of a text, found from their @: each user part is walked once."""

    def __init__(self, text: str):
        self.signs, self.first, self.ends = [], [], []
        self.seen: dict[int, list[tuple[str, int]]] = {}  # (kind, end) of the values that start at a place
        for m in _AT.finditer(text):
            start = m.start()
            while start and text[start - 1] in _USER:
                start -= 1
            self.signs.append(m.start())
            self.first.append(start)
            self.ends.append(m.end())

    def before(self, limit: int, at: int) -> int:
        """Where the first address from `at` on starts, if before `limit`; else `limit`."""
        k = bisect_right(self.signs, at)
        return min(limit, max(at, self.first[k])) if k < len(self.signs) else limit

    def end(self, start: int) -> int | None:
        """The end of the address whose user part may start there."""
        k = bisect_right(self.signs, start)
        return self.ends[k] if k < len(self.signs) and self.first[k] <= start else None


class Pseudonyms:
    """Replaces the values of a text; `back` restores them under the same key."""

    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS, back: bool = False):
        self.feistel, self.kinds, self.back = Feistel(key), frozenset(kinds), back

    def _permute(self, value: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda v: True) -> int:
        return self.feistel.permute(value, size, tweak.encode(), valid, self.back)

    def _letters(self, text: str, tweak: str) -> str:
        """Permute ASCII letters and digits within their classes."""
        bases = [10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 1 for c in text]
        starts = [ord("0") if c.isdigit() else ord("a") if c.islower() else ord("A") for c in text]
        value, size = 0, 1
        for c, b, s in zip(text, bases, starts):
            if b > 1:
                value, size = value * b + ord(c) - s, size * b
        shape = "".join("0" if b == 10 else c if b == 1 else "a" if s == 97 else "A" for c, b, s in zip(text, bases, starts))
        value = self._permute(value, size, f"{tweak}|{shape}")
        out = list(text)
        for i in reversed(range(len(text))):
            if bases[i] > 1:
                value, digit = divmod(value, bases[i])
                out[i] = chr(starts[i] + digit)
        return "".join(out)

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        n = len(digits) - 2
        middle = self._permute(int(digits[1:-1]), 10**n, f"card|{digits[0]}|{len(digits)}", lambda v: len(set(self._card(digits[0], v, n))) > 1)
        return _refill(text, self._card(digits[0], middle, n))

    @staticmethod
    def _card(first: str, middle: int, n: int) -> str:
        payload = f"{first}{middle:0{n}d}"
        return f"{payload}{luhn_digit(payload)}"

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
            return None
        body = self._letters(plain[4:], f"iban|{plain[:2]}")
        plain = f"{plain[:2]}{98 - _mod97(plain[:2] + '00' + body):02d}{body}"
        it = iter(plain)
        return "".join(c if c == " " else next(it) for c in text)

    def ssn(self, text: str) -> str | None:
        digits = text.replace("-", "")

        def valid(v: int) -> bool:
            s = f"{v:09d}"
            return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

        if not valid(int(digits)):
            return None
        return _refill(text, f"{self._permute(int(digits), 10**9, 'ssn', valid):09d}")

    def phone(self, text: str) -> str | None:
        """The country code stays; numbers that the North American plan allows are permuted among themselves."""
        head, trunk, tail = text.partition("(0)") if text[0] == "+" else ("", "", text)
        digits = re.sub(r"\D", "", head + tail)
        full = digits if text[0] == "+" else "1" + digits
        if not 8 <= len(full) <= 15:
            return None
        code = full[:1] if full[0] in "17" else full[:2] if full[:2] in _TWO_DIGIT_CODES else full[:3]
        rest = full[len(code) :]

        def planned(v: int) -> bool:
            s = f"{v:010d}"
            return s[0] > "1" and s[3] > "1"

        same = (lambda v, want=planned(int(rest)): planned(v) is want) if code == "1" and len(rest) == 10 else (lambda v: True)
        rest = f"{self._permute(int(rest), 10 ** len(rest), f'phone|{code}|{len(rest)}', same):0{len(rest)}d}"
        new = (code + rest if text[0] == "+" else rest)
        cut = sum(c.isdigit() for c in head)
        return _refill(head, new[:cut]) + trunk + _refill(tail, new[cut:])

    def ip(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
            return None
        value = self._permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def date(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        first = not text[2].isdigit()
        year, month, day = (digits[4:], digits[2:4], digits[:2]) if first else (digits[:4], digits[4:6], digits[6:])
        start, end = date(1900, 1, 1), date(2099, 12, 31)
        american = first and text[2] == "/" and int(month) > 12
        if american:
            month, day = day, month
        try:
            value = date(int(year), int(month), int(day))
        except ValueError:
            return None
        if not start <= value <= end:
            return None
        late = (lambda v: (start + timedelta(days=v)).day > 12) if american else (lambda v: True)
        days = self._permute((value - start).days, (end - start).days + 1, "date", late)
        value = start + timedelta(days=days)
        if american:
            return _refill(text, value.strftime("%m%d%Y"))
        return _refill(text, value.strftime("%d%m%Y") if first else value.strftime("%Y%m%d"))

    def email(self, text: str) -> str | None:
        user, _, domain = text.rpartition("@")
        new = self._letters(user.lower(), "email|" + domain.lower())
        return "".join(n.upper() if c.isupper() else n for n, c in zip(new, user)) + "@" + domain

    def secret(self, text: str) -> str | None:
        if text.isdigit() or text.isalpha():
            return None
        n = len(text)
        value = self._permute(int(text, 16), 16**n, f"secret|{n}", lambda v: not (s := f"{v:0{n}x}").isdigit() and not s.isalpha())
        out = f"{value:0{n}x}"
        return out.upper() if text.upper() == text else out

    def replace(self, text: str, counts: dict[str, int] | None = None) -> str:
        if not _MAYBE.search(text):
            return text

        out, done, at = [], 0, 0
        mails = _Addresses(text)
        while (start := mails.before(m.start() if (m := _PATTERN.search(text, at)) else len(text), at)) < len(text):
            found = self._value(text, start, mails)
            if found is None:
                at = start + 1
                continue
            kind, at, new = found
            if kind in self.kinds:
                out += [text[done:start], new]
                done = at
                if counts is not None:
                    counts[kind] = counts.get(kind, 0) + 1
        return "".join([*out, text[done:]])

    def _candidates(self, text: str, start: int, mails: _Addresses) -> Iterator[tuple[str, int, str]]:
        """(kind, end, pseudonym) of the valid values that start there: by kind, the longest first."""
        end = mails.end(start)
        if end is not None:
            yield "email", end, self.email(text[start:end])
        for kind, form in _FORM.items():
            whole = form.match(text, start)
            if whole is None:
                continue
            ends = [whole.end()]
            if kind in _GREEDY:
                ends += reversed([b.start() for b in _BOUNDARY.finditer(text, start + 1, whole.end()) if b.start() < whole.end()])
            for end in ends:
                if end == whole.end() or form.fullmatch(text, start, end):
                    new = getattr(self, kind)(text[start:end])
                    if new is not None:
                        yield kind, end, new

    def _value(self, text: str, start: int, mails: _Addresses) -> tuple[str, int, str] | None:
        """The value that starts there: the longest valid one that does not take a part of a value behind it."""
        spare = None
        for found in self._candidates(text, start, mails):
            kind, end, _ = found
            if kind not in _GREEDY:
                return found
            taken = self._takes(text, start, end, kind, mails)
            if taken is None:
                return found
            if taken == end and spare is None:
                spare = found
        return spare

    def _takes(self, text: str, start: int, end: int, kind: str, mails: _Addresses) -> int | None:
        """The end of a value that starts after a space inside text[start:end] and goes to its end or beyond.

        A bracket inside a telephone number opens its area code, no number of its own.
        """
        loose = kind != "card" or not _CARD_GROUPS.fullmatch(text, start, end)
        for p in _AFTER_SPACE.finditer(text, start + 1, end):
            behind = mails.seen.get(p.start())
            if behind is None:
                if len(mails.seen) > 1_000:
                    mails.seen.clear()
                behind = mails.seen[p.start()] = [(other, to) for other, to, _ in self._candidates(text, p.start(), mails)]
            for other, to in behind:
                if to >= end if other in _FIRM else to > end and (other == "ssn" or (loose and bool(_CARD_GROUPS.fullmatch(text, p.start(), to)))):
                    return to
        return None


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", kinds: tuple[str, ...] = KINDS, back: bool = False) -> DataFrame:
    """The documents with the values in `text` replaced; all other columns are as they were."""
    names, schema = docs.columns, docs.schema
    at = names.index(text)

    def run(batches):
        tool = Pseudonyms(key, kinds, back)
        for batch in batches:
            out = [t if t is None else tool.replace(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(id, text, n_replaced, n_<kind>...): the new texts and what was replaced in them."""
    fields = ", ".join(f"n_{k} long" for k in KINDS)

    def run(batches):
        tool = Pseudonyms(key, kinds)
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(1).to_pylist():
                found: dict[str, int] = {}
                texts.append(t if t is None else tool.replace(t, found))
                counts.append(found)
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array([sum(c.values()) for c in counts], pa.int64())]
            columns += [pa.array([c.get(k, 0) for c in counts], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "n_replaced", *(f"n_{k}" for k in KINDS)])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id long, text string, n_replaced long, {fields}")
