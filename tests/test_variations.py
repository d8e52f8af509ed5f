"""Anchoring of writings in their readings, by hand."""

import pytest

from lexis.functions import variations


@pytest.mark.parametrize(
    "word,reading,parts",
    [
        ("取り引き", "とりひき", [("取", "と"), ("り", "り"), ("引", "ひ"), ("き", "き")]),
        ("食べ食べ", "たべたべ", [("食", "た"), ("べ", "べ"), ("食", "た"), ("べ", "べ")]),  # twice on both sides
        ("菖蒲か杜若", "しょうぶかかきつばた", None),  # once in the word, twice in the reading
        ("付け字", "つけじ", [("付", "つ"), ("け", "け"), ("字", "じ")]),
        ("お茶", "おちゃ", [("お", "お"), ("茶", "ちゃ")]),
        ("茶", "ちゃ", [("茶", "ちゃ")]),
        ("付け", "け", None),  # nothing is left for the kanji
        ("付け", "つけて", None),
        ("付け", "つき", None),
        ("あい", "あい", [("あい", "あい")]),
        ("取A", "とA", None),
    ],
)
def test_anchors(word, reading, parts):
    assert variations.anchored(word, reading) == parts


def test_variations_with_repeated_kana():
    known = variations.SAMPLE_READINGS | {"食": ["た"], "並": ["なら"]}
    assert variations.of("取り引き", "とりひき", known) == ["とり引き", "取りひき", "取引き"]
    assert variations.of("食べ並べ", "たべならべ", known) == ["たべ並べ", "食べならべ"]
