import datetime as dt
import re

import pytest

from corpuslake.llm import pii as P

F_ = P.Feistel(b"key")
CASES = [
    ("call +1 (017) 555-7713 or (212) 555-1234 or 212-555-1234", ["phone"] * 3),
    ("cards 4845168114407329, 4845-1681-1440-7329.", ["card"] * 2),
    ("from DE89 3704 0044 0532 0130 00 to GB82WEST12345698765432", ["iban"] * 2),
    ("on 2021-02-28, 31/12/1999, 12/31/1999, 3.4.2005 and 2020/2/9", ["date"] * 5),
    ("mail pà.34@mail7.example.com or A.b-9@X.org", ["email"] * 2),
    ("at 97.51.17.173 and ssn 123-45-6789", ["ip", "ssn"]),
]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 26, 100, 1009])
def test_permutation_and_its_inverse(size):
    assert sorted(F_.permute(x, size, "t") for x in range(size)) == list(range(size))
    assert all(F_.permute(F_.permute(x, size, "t"), size, "t", back=True) == x for x in range(size))


@pytest.mark.parametrize("text,kinds", CASES)
def test_format_stays_and_round_trip(text, kinds):
    masked, found = P.mask_text(F_, text)
    assert found == kinds and masked != text
    if "ip" not in kinds and "date" not in kinds:
        assert re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "A", re.sub(r"[a-zà-ÿ]", "a", masked))) == re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "A", re.sub(r"[a-zà-ÿ]", "a", text)))
    assert P.mask_text(F_, masked, back=True)[0] == text
    assert P.mask_text(P.Feistel(b"other"), text)[0] != masked


def test_equal_values_stay_linked():
    a, _ = P.mask_text(F_, "4845168114407329 x")
    b, _ = P.mask_text(F_, "y 4845-1681-1440-7329")
    assert a[:16] == b[2:].replace("-", "") and P.luhn_digit(a[:15]) == a[15]


def test_invalid_values_stay():
    for text in ("1234567890123456", "0000000000000000", "2021-02-29", "999.1.1.1", "000-12-3456", "DE00 3704 0044 0532 0130 00", "v1.2.3 12345", "@ x@", ""):
        assert P.mask_text(F_, text) == (text, [])


def test_dates_stay_dates():
    seen = set()
    for day in range(0, 70000, 997):
        d = dt.date.fromordinal(P.DAY_0 + day)
        for text in (d.isoformat(), f"{d.day}.{d.month}.{d.year}", f"{d.month:02d}/{d.day:02d}/{d.year}"):
            masked, found = P.mask_text(F_, text)
            assert P.mask_text(F_, masked, back=True)[0] == text
            seen.add((text, masked))
            assert found == ["date"]
    assert len({m for _, m in seen}) == len({t for t, _ in seen})


def test_frame(make):
    docs = make([(1, CASES[0][0]), (1, CASES[0][0]), (None, "plain"), (2, None), (3, ""), (4, "a 97.51.17.173 " * 3000)], extra=("kinds", "_m", "n_masked"))
    out = P.pseudonymise(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows[2] is None and rows[3] == "" and rows[None] == "plain" and "97.51.17.173" not in rows[4]
    report = P.pii_report(docs).collect()
    assert sum(r["n_masked"] for r in report) == 6 + 3000 and len(report) == 6
    assert P.pseudonymise(docs.limit(0)).count() == 0
