"""Classes of characters as patterns that Java and RE2 both read."""

from __future__ import annotations

# Ranges of code points by use.
HIRAGANA_WORD = "^[ぁ-ゖ]*$"
HIRAGANA = "[぀-ゟ]"
KATAKANA = "[ァ-ヾ]"
KANJI = "[一-龥\U00010000-\U0010ffff]"
LATIN = "[a-zA-Z]"
#: What can begin a search, after one leading space.
GATE = "^ ?[○、-ヿ㐀-鿿豈-﫿０-ﾝ\U00020000-\U0010ffff]"
#: Runs that the page reader takes up, half-width and supplementary characters included.
JAPANESE = "[○々-〇ぁ-ヿ㐀-䶿一-鿿豈-﫿０-９Ａ-Ｚａ-ｚｦ-ﾝ\U00020000-\U0010ffff]"

