"""Spelling variations of words whose kanjis' readings can be told apart in only one way.

The writing's kana must be found in the reading beyond doubt, the stretches between them belong to the kanjis, and a stretch of several kanjis must split
into their readings uniquely. Then a kanji can be written by its reading, and a kana behind a kanji can be left out where the kanji's reading may swallow it. A search with backtracking
inside one word is beyond column expressions, so it runs on Arrow batches.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

SAMPLE_READINGS = {"取": ["と", "とり", "とる", "しゅ"], "引": ["ひ", "ひき", "ひく", "いん"], "受": ["う", "うけ", "うける", "じゅ"], "付": ["つ", "つけ", "つける", "ふ"], "漢": ["かん"], "字": ["じ", "あざ"]}
_BLOCK = re.compile("[一-龥]+|[ぁ-ゔ]+")


def splits(kanjis: str, reading: str, known: dict[str, list[str]]) -> list[list[str]]:
    """All ways to cut a reading into readings of the kanjis."""
    if not kanjis:
        return [[]] if not reading else []
    return [[r, *rest] for r in known.get(kanjis[0], ()) if r and reading.startswith(r) for rest in splits(kanjis[1:], reading[len(r) :], known)]


def anchored(word: str, reading: str) -> list[tuple[str, str]] | None:
    """(block, its stretch of the reading) of the word's blocks of kanjis and of kana, or None where that is not certain.

    A block of kana is certain where the rest of the reading has it once, or as often as the rest of the word, so that each must be its own; the stretches between belong to the kanjis."""
    blocks = _BLOCK.findall(word)
    if "".join(blocks) != word:
        return None
    found: list[tuple[str, str]] = []
    open_, at = "", 0
    for n, block in enumerate(blocks):
        if "一" <= block[0] <= "龥":
            open_ = block
            continue
        place = reading.find(block, at)
        rest = reading.count(block, at)
        if place < 0 or (reading.find(block, place + len(block)) >= 0 and rest != "".join(blocks[n:]).count(block)):
            return None
        if bool(open_) != (place > at):
            return None
        if open_:
            found.append((open_, reading[at:place]))
        found.append((block, block))
        open_, at = "", place + len(block)
    if bool(open_) != (at < len(reading)):
        return None
    return [*found, (open_, reading[at:])] if open_ else found


def read(word: str, reading: str, known: dict[str, list[str]]) -> list[tuple[str, str]] | None:
    """(piece, its reading) of the word's kanjis and kana, or None where it is not unique."""
    parts = anchored(word, reading)
    if parts is None:
        return None
    pieces: list[tuple[str, str]] = []
    for block, part in parts:
        if "一" <= block[0] <= "龥":
            ways = [[part]] if len(block) == 1 else splits(block, part, known)
            if len(ways) != 1:
                return None
            pieces += zip(block, ways[0])
        else:
            pieces += [(c, c) for c in block]
    return pieces


def varies(word: str) -> bool:
    """Whether a word is worth it: only kanjis and hiragana, two different kanjis or more, hiragana behind one, and no three kanjis in a row."""
    kanjis = [c for c in word if "一" <= c <= "龥"]
    return "".join(_BLOCK.findall(word)) == word and len(set(kanjis)) > 1 and re.search("[一-龥][ぁ-ゔ]", word) is not None and re.search("[一-龥]{3}", word) is None


def of(word: str, reading: str, known: dict[str, list[str]]) -> list[str]:
    if not varies(word):
        return []
    pieces = read(word, reading, known)
    if pieces is None:
        return []
    found = {"".join(r if p == k else p for p, r in pieces) for k in {p for p, _ in pieces if "一" <= p <= "龥"}}
    for i, (p, r) in enumerate(pieces[:-1]):
        if "一" <= p <= "龥" and i + 2 < len(pieces) and pieces[i + 1][0] == pieces[i + 1][1] and r + pieces[i + 1][0] in known.get(p, ()):
            found.add("".join(q for j, (q, _) in enumerate(pieces) if j != i + 1))
    return sorted(found - {word})


def variations(words: DataFrame, known: dict[str, list[str]]) -> DataFrame:
    """(word, variation) of ``words`` (word, reading); words with none don't appear."""

    def run(batches):
        for batch in batches:
            rows = [(w, v) for w, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w and r for v in of(w, r, known)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.string())], ["word", "variation"])

    return words.select("word", "reading").mapInArrow(run, "word string, variation string")
