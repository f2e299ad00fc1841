"""Pseudonyms: what is linked, what is not, and what stays valid."""

import random

import pytest

pytest.importorskip("quillspark.llm")

from quillspark.llm import pii
from tests.llm.test_text_operators import NAMES

KEY = b"k"
SAME = [
    ("email", "a.b@c.com", "A.B (at) c (dot) com"),
    ("email", "a.b@c.com", "a.b at c dot com"),
    ("name", "Brivodek Gavmere", "Gavmere, Brivodek"),
    ("name", "B. Gavmere", "b gavmere"),
    ("address", "62 Hazelmoor Road, Brennau", "62 hazelmoor road,  brennau"),
]
APART = [("email", "ab@c.com", "a.b@c.com"), ("name", "Brivodek Gavmere", "Brivodek Zormere"), ("address", "62 Hazelmoor Road", "63 Hazelmoor Road"), ("phone", "020 7946 0958", "020 7946 0959")]
PHONES = ["+44 20 7946 0958", "020 7946 0958", "0044 20 7946 0958", "+44 (0)20 7946 0958", "020 7946 0958 ext. 12"]


@pytest.mark.parametrize(("kind", "a", "b"), SAME)
def test_equal_values_are_linked(kind, a, b):
    assert pii.pseudonym(kind, a, KEY) == pii.pseudonym(kind, b, KEY) != pii.pseudonym(kind, a, b"other")


@pytest.mark.parametrize(("kind", "a", "b"), APART)
def test_other_values_are_not(kind, a, b):
    assert pii.pseudonym(kind, a, KEY) != pii.pseudonym(kind, b, KEY)


def test_telephone_numbers_are_linked_and_keep_their_country():
    made = [pii.pseudonym("phone", p, KEY) for p in PHONES]
    assert len({pii.canonical("phone", p) for p in made}) == 1 and pii.canonical("phone", made[0]) != pii.canonical("phone", PHONES[0])
    assert made[0].startswith("+44 ") and made[2].startswith("0044 ") and "(0)" in made[3] and " ext. " in made[4] and not made[4].endswith(" 12")
    us = [pii.pseudonym("phone", p, KEY) for p in ("+1 637 555 0168", "(637) 555-0168", "16375550168", "637.555.0168")]
    assert len({pii.canonical("phone", p) for p in us}) == 1 and us[0].startswith("+1 ") and us[2].startswith("1")


def test_numbers_stay_as_valid_as_they_were():
    rng = random.Random(1)
    for value, kind in (("123-45-6789", "ssn"), ("000-00-0000", "ssn"), ("666-12-3456", "ssn"), ("790711-0813177", "rrn"), ("86095742719", "tax"), ("00129856534", "tax"), ("12345678Z", "nif")):
        assert pii.id_kind(value) == kind
        new = pii.pseudonym("id", value, KEY)
        assert new != value and len(new) == len(value) and pii.valid(kind, new) == pii.valid(kind, value), value
    assert pii.valid("ssn", "123-45-6789") and not pii.valid("ssn", "666-12-3456") and pii.valid("tax", "86095742719") and not pii.valid("tax", "86095742718") and pii.valid("nif", "12345678Z")
    some = {f"{rng.randint(1, 899):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(500)}
    assert len({pii.pseudonym("id", v, KEY) for v in some}) == len(some)


def test_spanish_numbers_need_their_check_letter():
    assert [k for k, _, _ in pii.find("DNI 12345678Z here", NAMES)] == ["id"] and pii.find("part 12345678A here", NAMES) == []


def test_many_findings_in_one_text_are_settled_in_order():
    t = "Brivodek Gavmere a.b@c.com 07700 900 571; " * 3000
    got = pii.find(t, NAMES)
    assert len(got) == 9000 and all(x[2] <= y[1] for x, y in zip(got, got[1:]))
