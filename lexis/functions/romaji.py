"""Romanisation: a table of kana with their Latin spellings, built by rule, and an acceptor.

The acceptor goes through the kana from the left, the longest known piece first; the first spelling of it that the Latin rest
begins with is taken, and if none fits a shorter piece is tried. There is no backtracking.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# The syllabary by rows with their consonants, and spellings that don't follow the row.
ROWS = {"": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの", "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "r": "らりるれろ"}
OWN = {"し": ["shi", "si"], "じ": ["ji", "zi"], "ち": ["chi", "ti"], "ぢ": ["dzi", "dji", "ji", "di", "zi"], "つ": ["tsu", "tu"], "づ": ["dzu", "du", "zu"], "ふ": ["fu", "hu"]}
REST = {"や": ["ya"], "ゆ": ["yu"], "よ": ["yo"], "わ": ["wa"], "ゐ": ["i", "wi"], "ゑ": ["e", "we"], "を": ["o", "wo"], "ん": ["n'", "n", "m"]}
SOFT = {"し": ["sh", "sy"], "じ": ["zy", "j"], "ち": ["ch", "ty"], "ぢ": ["dy", "dj", "dz", "zy", "j"]}
SMALL = {"しぃ": ["shii"], "しぇ": ["she"], "じぇ": ["je", "ze"], "ちぃ": ["chii"], "ちぇ": ["che", "te"], "てぃ": ["ti"], "ふぁ": ["fa", "ha"], "ふぉ": ["fo", "ho"], "ぷぅ": ["puu"], "みぃ": ["mii"], "りぃ": ["rii"], "るぅ": ["ruu"], "れぇ": ["re"]}
LONG_VOWELS = {"ああ": "ā", "いい": "ī", "うう": "ū", "えい": "ē", "ええ": "ē", "おう": "ō", "おお": "ō"}


def spellings() -> dict[str, list[str]]:
    """Spellings of each piece of kana, the preferred first: rows, then long marks (the last letter again), then small っ (the first
    letter twice) before all of them, then long vowels, plain or with a macron."""
    table: dict[str, list[str]] = {}
    vowels = dict(zip(ROWS[""], "aiueo"))
    for consonant, row in ROWS.items():
        table |= {kana: OWN.get(kana, [consonant + vowel]) for kana, vowel in zip(row, "aiueo")}
        if consonant:
            table |= {row[1] + small: [soft + vowel for soft in SOFT.get(row[1], [f"{consonant}y"])] for small, vowel in zip("ゃゅょ", "auo")}
    table |= REST | SMALL
    table |= {kana + "ー": [x + x[-1] for x in found] for kana, found in table.items()}
    table |= {"っ" + kana: [x[0] + x for x in found] for kana, found in table.items()}
    return table | {kana: [vowels[kana[0]] + vowels[kana[1]], macron] for kana, macron in LONG_VOWELS.items()}


def accepts(kana: str, latin: str) -> bool:
    """The acceptor for one pair, for tests and small tables."""
    table, latin = spellings(), latin.lower()
    if len(latin) < len(kana):
        return False
    while kana:
        for n in range(4, 0, -1):
            fit = next((s for s in table.get(kana[:n], ()) if len(kana) >= n and latin.startswith(s)), None)
            if fit is not None:
                kana, latin = kana[n:], latin[len(fit) :]
                break
        else:
            return False
    return not latin


def romanisation_sql(kana: str, latin: str) -> str:
    """SQL that tells whether the expression ``latin`` spells the expression ``kana``, as a fold inside the row."""
    table = spellings()
    entries = ", ".join(f"'{k}', array({', '.join(chr(39) + x.replace(chr(39), chr(92) + chr(39)) + chr(39) for x in v)})" for k, v in table.items())
    best = "coalesce(" + ", ".join(f"if(length(s.k) >= {n}, get(transform(slice(filter(try_element_at(spelt, left(s.k, {n})), x -> startswith(s.l, x)), 1, 1), x -> named_struct('k', substring(s.k, {n + 1}), 'l', substring(s.l, length(x) + 1), 'ok', true)), 0), null)" for n in range(4, 0, -1)) + ", named_struct('k', '', 'l', s.l, 'ok', false))"
    fold = f"aggregate(sequence(1, greatest(1, length({kana}))), named_struct('k', {kana}, 'l', lower({latin}), 'ok', length({latin}) >= length({kana})), (s, i) -> if(s.ok and s.k <> '', {best}, s), s -> s.ok and s.k = '' and s.l = '')"
    # the outer lambda names the table, so it is there once
    return f"transform(array(map({entries})), spelt -> {fold})[0]"


def is_romanisation(kana: str, latin: str) -> Column:
    return F.expr(romanisation_sql(kana, latin))


def pairs() -> list[tuple[str, str]]:
    return [(k, s) for k, v in spellings().items() for s in v]


def combinations(kana: str) -> list[str]:
    """All spellings of a short word, piece by piece, for tests."""
    table = spellings()
    return ["".join(x) for x in product(*(table[c] for c in kana))]
