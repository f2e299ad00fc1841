"""The look-alike table with the public confusables of Unicode."""

from types import SimpleNamespace

import pytest

pytest.importorskip("quillspark.llm")

from quillspark.llm import lookalike


@pytest.fixture(scope="module")
def table(spark):
    t = lookalike.confusables(spark)
    assert len(t) > 4000
    return t


@pytest.mark.parametrize(
    ("other", "latin"),
    [("Ꮃ", "W"), ("Ꮪ", "S"), ("ꓐ", "B"), ("ꓳ", "O"), ("ⲟ", "o"), ("𐐬", "o"), ("ᴏ", "o"), ("ɩ", "i"), ("ⅰ", "i"), ("Ѵ", "V"), ("ѵ", "v"), ("І", "I"), ("Ο", "O"), ("о", "o"), ("ｏ", "o"), ("օ", "o"), ("Ꭺ", "A")],
)
def test_letters_of_other_alphabets(table, other, latin):
    assert lookalike.skeleton(f"x{other}y", table) == f"x{latin}y"


def test_letters_of_one_alphabet_stay_apart(table):
    for a, b in (("I", "l"), ("O", "0"), ("rn", "m"), ("1", "l"), ("æ", "ae"), ("é", "e")):
        assert lookalike.skeleton(f"ж{a}", table) != lookalike.skeleton(f"ж{b}", table), (a, b)


def test_prototypes_are_final(table):
    for ch, look in table.items():
        assert not set(look) & table.keys() and lookalike.skeleton(lookalike.skeleton(ch, table), table) == lookalike.skeleton(ch, table), ch


def test_hot_look_gives_one_row_per_document(spark):
    """A third of all texts in one look: classes stay linear in the documents."""
    rows = [(i, "same o text" if i % 2 else "same о text") for i in range(200)] + [(1000 + i, f"text {i}") for i in range(400)]
    keys = lookalike.look_keys(spark.createDataFrame(rows, "doc_id long, text string"))
    got = lookalike.classes(keys)
    assert got.count() == 600 and got.where("n_texts = 2").count() == 200


def test_missing_or_broken_library_is_an_error_not_a_smaller_table():
    def broken():
        raise ValueError("no data file")

    without = SimpleNamespace()
    fails = SimpleNamespace(com=SimpleNamespace(ibm=SimpleNamespace(icu=SimpleNamespace(text=SimpleNamespace(SpoofChecker=SimpleNamespace(Builder=broken))))))
    for jvm in (without, fails):
        with pytest.raises(RuntimeError, match="ICU"):
            lookalike.confusables(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=jvm)))
