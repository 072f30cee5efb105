import random

import pytest

from skyledger.llm import op3_pseudonyms

CARDS = ("4845168114407329", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "4222222222222")


@pytest.mark.parametrize("card", CARDS)
def test_a_card_beside_other_numbers(card):
    """Whatever number stands before or after it, the card is found and gets its one pseudonym."""
    finder = op3_pseudonyms.Finder(b"a key")
    alone = finder.replace(card)[0]
    assert alone != card
    rng = random.Random(1)
    tails = ["12/27", "123", "1234", "12.50", "05-2026", "2024-05-17", *[f"{rng.randrange(1000)}" for _ in range(40)]]
    for tail in tails:
        new, found = finder.replace(f"{card} {tail}")
        assert new.startswith(alone + " ") and (0, len(card), "card") in found, tail
    for head in ("27", "12/27", "123456"):
        assert finder.replace(f"{head} {card}.")[0] == f"{head} {alone}."


def test_other_groups_try_shorter_ends():
    finder = op3_pseudonyms.Finder(b"a key")
    alone = finder.replace("41111111 11111111")[0]
    assert alone != "41111111 11111111"
    hidden = [t for t in range(10, 100) if finder.replace(f"41111111 11111111 {t}")[0] == f"{alone} {t}"]
    assert len(hidden) >= 75  # about one longer number in ten passes the check itself


def test_dates_in_timestamps():
    finder = op3_pseudonyms.Finder(b"a key")
    new, found = finder.replace("at 2024-05-17T09:00:00Z and 2024-05-17")
    assert [k for _, _, k in found] == ["iso", "iso"] and new[13:] == "T09:00:00Z and " + new[3:13] and new[3:13] != "2024-05-17"
    assert finder.replace("2024-05-17Tx")[1] == []
