"""PII (3): format-preserving pseudonyms by a keyed Feistel permutation.

Found values are validated, mapped to a number below the size of their format's
domain, permuted there under a secret key, and written back in the same format.
The same key gives the same pseudonym everywhere, so equal values stay linked
across documents, and who holds the key can invert it. The permutation is a
numeric Feistel network of ``ROUNDS`` keyed rounds (HMAC-SHA256); values that fall
out of the domain, or are not valid in the format, are permuted again until they
are (cycle walking), which keeps it one-to-one.

Formats (validation -> what is permuted):

* card: 13-19 digits, single spaces or dashes allowed, Luhn -> all but the check digit, which is set anew
* iban: country, two check digits, 11-30 letters or digits, remainder 97 -> letters and digits after these, check digits anew
* phone: + and 8-15 digits with the usual separators, or (ddd) ddd-dddd, ddd-ddd-dddd -> all digits but the country code
* ssn: ddd-dd-dddd in the ranges that are given out -> all digits, within these ranges
* ip: four numbers up to 255 -> all 32 bits
* date: a calendar day of 1900-2099 as yyyy-mm-dd (or / or .), dd/mm/yyyy, else mm/dd/yyyy (or . or -) -> the day, within what reads the same way
* email: letters and digits of the local part, each within its own kind (a-z, A-Z, 0-9, Latin-1 letters by case); the domain stays

Numbers that fail validation stay. Separators stay where they are. Of
overlapping values the one that starts first counts, then the first named. Digits or capitals that follow a card, IBAN or
phone may read as part of it, so all its beginnings that end with a group are tried: first what has a usual card layout (digits without
separators, 4-4-4-4, 4-6-5, 4-6-4) or the length of the country's IBANs, then the longest. A pseudonym is
permuted on until the beginnings tried before fail for it too, so that the same one is found again. A longer
beginning that passes by chance is taken only where none of these fits.
A value may map to itself, as in any permutation, once in the domain's size on average.

Cases: a null text stays null, an empty one empty. Rows with equal or null ids are
masked one by one. Whole texts are read. No other column is looked at.
"""

from __future__ import annotations

import datetime as dt
import functools
import hmac
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import per_text

ROUNDS = 10
#: A production job passes its own secret; this one makes the queries repeatable.
DEMO_KEY = b"corpuslake demonstration key"
FIELDS = "text string, n_masked long, kinds string"

PATTERNS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}(?P<m1>[-/.])[0-9]{1,2}(?P=m1)[0-9]{1,2}|[0-9]{1,2}(?P<m2>[-/.])[0-9]{1,2}(?P=m2)(?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])|(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "email": r"[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
}
ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: Groups of a card number that are tried first, besides a single one.
CARD_LAYOUTS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
IBAN_LENGTHS = {
    **dict.fromkeys(("NO",), 15), **dict.fromkeys(("BE",), 16), **dict.fromkeys(("DK", "FK", "FI", "FO", "GL", "NL", "SD"), 18),
    **dict.fromkeys(("MK", "SI"), 19), **dict.fromkeys(("AT", "BA", "EE", "KZ", "XK", "LT", "LU", "MN"), 20),
    **dict.fromkeys(("HR", "LV", "LI", "CH"), 21), **dict.fromkeys(("BH", "BG", "CR", "GE", "DE", "IE", "ME", "RS", "GB", "VA"), 22),
    **dict.fromkeys(("TL", "GI", "IQ", "IL", "OM", "SO", "AE"), 23), **dict.fromkeys(("AD", "CZ", "MD", "PK", "RO", "SA", "SK", "ES", "SE", "TN", "VG"), 24),
    **dict.fromkeys(("LY", "PT", "ST"), 25), **dict.fromkeys(("IS", "TR"), 26),
    **dict.fromkeys(("BI", "DJ", "FR", "GR", "IT", "MR", "MC", "SM"), 27),
    **dict.fromkeys(("AL", "AZ", "BY", "CY", "DO", "SV", "GT", "HU", "LB", "NI", "PL"), 28), **dict.fromkeys(("BR", "EG", "PS", "QA", "UA"), 29),
    **dict.fromkeys(("JO", "KW", "MU", "YE"), 30), **dict.fromkeys(("MT", "SC"), 31), "LC": 32, "RU": 33,
}
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ACCENTED = ["".join(c for c in map(chr, range(*r)) if c.isalpha()) for r in ((0xC0, 0xDF), (0xDF, 0x100))]
ALPHABETS = {c: alphabet for alphabet in (DIGITS, LOWER, UPPER, *ACCENTED) for c in alphabet}
DAY_0, DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


class Feistel:
    """Keyed permutations of 0 .. size - 1."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key, rounds

    def _f(self, tweak: str, size: int, i: int, half: int) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{tweak}|{size}|{i}|{half}".encode(), "sha256"))

    def permute(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        if size < 2:
            return x
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        while True:  # a * b >= size: walk on until back inside
            x = self._once(x, a, b, size, tweak, back)
            if x < size:
                return x

    def _once(self, x: int, a: int, b: int, size: int, tweak: str, back: bool) -> int:
        left, right = divmod(x, b)  # below a and below b
        for i in reversed(range(self.rounds)) if back else range(self.rounds):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._f(tweak, size, i, left)) % b
            else:
                left = (left + sign * self._f(tweak, size, i, right)) % a
        return left * b + right

    def walk(self, x: int, size: int, tweak: str, valid, back: bool = False) -> int:
        """Permutation of the valid numbers below ``size``; ``x`` is one."""
        while True:
            x = self.permute(x, size, tweak, back)
            if valid(x):
                return x

    def symbols(self, text: str, tweak: str, back: bool = False) -> str:
        """Permute the letters and digits of a text together, each within its alphabet; other characters stay."""
        kinds = [ALPHABETS.get(c) for c in text]
        x, size = 0, 1
        for c, kind in zip(text, kinds, strict=True):
            if kind:
                x = x * len(kind) + kind.index(c)
                size *= len(kind)
        shape = "".join(k[0] if k else c for c, k in zip(text, kinds, strict=True))
        x = self.permute(x, size, f"{tweak}|{shape}", back)
        out = []
        for c, kind in zip(reversed(text), reversed(kinds), strict=True):
            if kind:
                x, i = divmod(x, len(kind))
                c = kind[i]
            out.append(c)
        return "".join(reversed(out))


def luhn_digit(body: str) -> str:
    """The check digit that follows the digits ``body``."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def spread(digits: str, like: str) -> str:
    """Digits written over the digits of ``like``."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), like)


def is_card(v: str) -> bool:
    digits = re.sub(r"[^0-9]", "", v)
    return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def card(f: Feistel, v: str, back: bool, fits=lambda new: True) -> str | None:
    if not is_card(v):
        return None
    digits = re.sub(r"[^0-9]", "", v)
    n = len(digits) - 1
    whole = lambda x: f"{x:0{n}d}" + luhn_digit(f"{x:0{n}d}")
    valid = lambda x: len(set(whole(x))) > 1 and fits(spread(whole(x), v))
    return spread(whole(f.walk(int(digits[:-1]), 10**n, "card", valid, back)), v)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def is_iban(v: str) -> bool:
    plain = v.replace(" ", "")
    return 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]


def iban(f: Feistel, v: str, back: bool, fits=lambda new: True) -> str | None:
    if not is_iban(v):
        return None
    plain = v.replace(" ", "")
    rest = plain[4:]
    while True:
        rest = f.symbols(rest, f"iban|{plain[:2]}", back)
        it = iter(plain[:2] + iban_check(plain[:2], rest) + rest)
        new = "".join(" " if c == " " else next(it) for c in v)
        if fits(new):
            return new


def phone(f: Feistel, v: str, back: bool) -> str | None:
    digits = re.sub(r"[^0-9]", "", v)
    if not (8 if v[0] == "+" else 10) <= len(digits) <= 15:
        return None
    country = re.match(r"\+[0-9]{1,3}(?![0-9])|\+1|", v)[0]
    n = len(digits) - max(0, len(country) - 1)
    rest = f"{f.permute(int(digits[-n:]), 10**n, f'phone|{country}', back):0{n}d}"
    return country + spread(rest, v[len(country) :])


def ssn(f: Feistel, v: str, back: bool) -> str | None:
    def valid(x: int) -> bool:
        area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    x = int(v.replace("-", ""))
    return spread(f"{f.walk(x, 10**9, 'ssn', valid, back):09d}", v) if valid(x) else None


def ip(f: Feistel, v: str, back: bool) -> str | None:
    parts = v.split(".")
    if any(int(p) > 255 or (p[0] == "0" and len(p) > 1) for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts))), 2**32, "ip", back)
    return ".".join(map(str, x.to_bytes(4)))


def date(f: Feistel, v: str, back: bool) -> str | None:
    mark = re.search(r"[-/.]", v)[0]
    parts = v.split(mark)
    padded = all(len(p) != 1 for p in parts)
    year_first = len(parts[0]) == 4
    y, a, b = (int(p) for p in (parts if year_first else (parts[2], parts[1], parts[0])))
    month_first = not year_first and a > 12  # read as month/day only if it can't be day/month
    month, day = (b, a) if month_first else (a, b)
    try:
        x = dt.date(y, month, day).toordinal() - DAY_0
    except ValueError:
        return None
    fits = lambda d: (not month_first or d.day > 12) and (padded or d.month < 10 or d.day < 10)
    valid = lambda x: fits(dt.date.fromordinal(DAY_0 + x))
    if not padded and not valid(x):
        return None
    d = dt.date.fromordinal(DAY_0 + f.walk(x, DAYS, f"date|{year_first}|{month_first}|{padded}", valid, back))
    month, day = (f"{n:02d}" if padded else str(n) for n in (d.month, d.day))
    return mark.join([f"{d.year:04d}", month, day] if year_first else [month, day, str(d.year)] if month_first else [day, month, str(d.year)])


def email(f: Feistel, v: str, back: bool) -> str | None:
    local, _, domain = v.rpartition("@")
    return f"{f.symbols(local, f'email|{domain.lower()}', back)}@{domain}"


FORMATS = {"iban": iban, "date": date, "ssn": ssn, "ip": ip, "phone": phone, "card": card, "email": email}


#: Kinds whose pattern may run on into what follows -> check of a value by more than its layout, if there is one.
RUN_ON = {"card": is_card, "iban": is_iban, "phone": None}


def ends(kind: str, v: str) -> list[int]:
    """Where a value that ``v`` begins with may end, in the order to try; by layout only, so a pseudonym has the same."""
    if kind not in RUN_ON:
        return [len(v)]
    borders = [len(v), *(i for i in range(len(v) - 1, 0, -1) if v[i - 1].isalnum() and not v[i].isalnum())]
    if kind == "card":
        layout = lambda i: tuple(map(len, re.split("[ -]", v[:i])))
        usual = lambda i: layout(i) in CARD_LAYOUTS or (len(layout(i)) == 1 and i >= 13)
    else:
        usual = lambda i: kind == "iban" and len(v[:i].replace(" ", "")) == IBAN_LENGTHS.get(v[:2])
    return sorted(borders, key=lambda i: not usual(i))


def replace(f: Feistel, kind: str, v: str, back: bool) -> tuple[int, str] | None:
    """(end, pseudonym) of the value that ``v`` begins with."""
    tried: list[int] = []
    for end in ends(kind, v):
        if check := RUN_ON.get(kind):
            new = FORMATS[kind](f, v[:end], back, lambda x, tail=v[end:]: not any(check((x + tail)[:e]) for e in tried))
        else:
            new = FORMATS[kind](f, v[:end], back)
        if new is not None:
            return end, new
        tried.append(end)
    return None


def mask_text(f: Feistel, text: str, back: bool = False) -> tuple[str, list[str]]:
    """Text with pseudonyms, and the kinds found in order. ``back`` undoes it."""
    found: list[str] = []
    out, at = [], 0
    while m := ANY.search(text, at):
        first = next(k for k in FORMATS if m[k] is not None)
        for kind in (first, *(k for k in FORMATS if k != first)):  # a value that fails one check may pass another
            own = m if kind == first else one(kind).match(text, m.start())
            new = replace(f, kind, own[0], back) if own else None
            if new is not None:
                out += [text[at : m.start()], new[1]]
                found.append(kind)
                at = m.start() + new[0]
                break
        else:  # go on behind its first run of letters or digits
            stop = re.compile(r"\w+|\W").match(text, m.start()).end()
            out.append(text[at:stop])
            at = stop
    out.append(text[at:])
    return "".join(out), found


@functools.cache
def one(kind: str) -> re.Pattern:
    return re.compile(PATTERNS[kind])


def masked(text: Column, key: bytes = DEMO_KEY, back: bool = False) -> Column:
    """Struct of the masked text, the number of values replaced, and their kinds in order (comma-joined)."""

    def rows(texts: list) -> pa.Array:
        f = Feistel(key)
        out: list = []
        for t in texts:
            if t is None:
                out.append({"text": None, "n_masked": 0, "kinds": ""})
                continue
            s = t.decode("utf-8", "replace")
            new, found = mask_text(f, s, back) if SOME.search(s) else (s, [])
            out.append({"text": new, "n_masked": len(found), "kinds": ",".join(found)})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_masked", pa.int64()), ("kinds", pa.string())]))

    return per_text(rows, FIELDS)(text)


#: Without any of these there is nothing to find.
SOME = re.compile(r"[0-9@]")


def pseudonymise(docs: DataFrame, text_col: str = "text", key: bytes = DEMO_KEY) -> DataFrame:
    """``docs``, same columns, with pseudonyms in ``text_col``."""
    return docs.withColumn(text_col, masked(F.col(text_col), key)["text"])


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = DEMO_KEY) -> DataFrame:
    """(id, masked text, n_masked, kinds), a row per document."""
    return docs.select(F.col(id_col), masked(F.col(text_col), key).alias("_m")).select(id_col, "_m.*")
