import random

import pytest

from corpuslake.llm import pii as P

F_ = P.Feistel(b"key")


@pytest.mark.parametrize(
    "value,tail,kind",
    [
        ("4845168114407329", " 123", "card"),
        ("4845 1681 1440 7329", " 12/25", "card"),
        ("DE89 3704 0044 0532 0130 00", " EUR 50", "iban"),
        ("+44 20 7946 0958", " 2024", "phone"),
    ],
)
def test_what_follows_does_not_hide_a_value(value, tail, kind):
    masked, found = P.mask_text(F_, value + tail)
    assert found == [kind] and masked.endswith(tail) and len(masked) == len(value + tail) and value not in masked
    assert masked == P.mask_text(F_, value)[0] + tail
    assert P.mask_text(F_, masked, back=True)[0] == value + tail


def test_digits_behind_a_card_never_matter():
    """Some of these 200 tails make the longer digits pass the check."""
    for value in ("4845168114407329", "4845-1681-1440-7329"):
        alone = P.mask_text(F_, value)[0]
        for tail in range(100, 300):
            assert P.mask_text(F_, f"{value} {tail}")[0] == f"{alone} {tail}"


def test_round_trip_of_unusual_groups():
    rng = random.Random(1)
    for _ in range(1500):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(12, 18)))
        digits += P.luhn_digit(digits) + " " + str(rng.randrange(1000))
        at = rng.randint(1, 11)
        text = "n " + digits[:at] + " " + digits[at:] + " end"
        assert P.mask_text(F_, P.mask_text(F_, text)[0], back=True)[0] == text
