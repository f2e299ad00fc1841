"""Letters of less common alphabets, and marks above U+E0000, in the look-alike table."""

from quillspark.llm.lookalike import skeleton


def test_letters_of_other_alphabets():
    assert skeleton("\u13a0\u13aa\u13d9") == "DAV"  # Cherokee
    assert skeleton("\ua4d0\ua4ee\ua4e2") == "BAS"  # Lisu
    assert skeleton("\u2ca5\u2c9f\u2ca3\u2c9e") == "copO"  # Coptic
    assert skeleton("\u054d\u0575\u0581") == "Ujg"  # Armenian


def test_marks_above_e0000_are_dropped():
    assert skeleton("a\U000e0100b\U000e01efc\U000e0041d\U000e0001") == "abcd"
