"""Byte-pair merges from a tokenizer file, and the character classes that its splitting patterns use."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np

#: Classes of code points.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point, as the tokenizers library sees it.

    Unicode tables of different ages differ in code points assigned lately; where those of Python and of the
    ``regex`` module differ, the library is asked."""
    import regex
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    table = np.zeros(0x110000, dtype=np.uint8)
    everything = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, everything):
            table[m.start() : m.end()] = kind
    known = {"L": LETTER, "N": NUMBER}
    own = np.fromiter((known.get(unicodedata.category(c)[0], OTHER) for c in everything), dtype=np.uint8, count=len(everything))
    doubtful = np.flatnonzero((table != own) & (table != SPACE))
    asked = "".join(everything[i] for i in doubtful)
    table[doubtful] = OTHER
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        parts = Split(Regex(pattern), behavior="removed", invert=True).pre_tokenize_str(asked)
        for _, (start, end) in parts:
            table[doubtful[start:end]] = kind
    return table


def ranges(kind: int | None) -> str:
    """The code points of a class in the basic plane, or those that Python's tables don't know, as the inside of a pattern's set."""
    chosen = classes()[:0x10000] == kind if kind is not None else np.array([unicodedata.category(chr(i)) == "Cn" for i in range(0x10000)])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], chosen.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in edges)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(0x100 + n)] = b
    return letters


class Merges:
    """Vocabulary and merge ranks over bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model.get("end_of_word_suffix") or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("only plain byte-level merges can be compiled")
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.vocab = {as_bytes(k): v for k, v in model["vocab"].items()}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for n, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.rank[as_bytes(left), as_bytes(right)] = n
        self.special = [t["content"] for t in spec["added_tokens"]]

        self.parts = {a + b: (n, a, b) for (a, b), n in sorted(self.rank.items(), key=lambda x: -x[1])}
        self._spines: dict[tuple[bytes, bool], list[tuple[bytes, int]]] = {}

    def spine(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The pieces at one end of a token while its merges are undone, each with the rank of the merge that uses it up."""
        if (known := self._spines.get((token, right))) is None:
            known, used = [], 1 << 60
            piece = token
            while True:
                known.append((piece, used))
                if piece not in self.parts:
                    break
                used, a, b = self.parts[piece]
                piece = b if right else a
            self._spines[token, right] = known
        return known

    def follows(self, left: bytes, right: bytes) -> bool:
        """Whether the encoding of ``left + right`` is these two tokens: no pair of pieces that meet at the seam
        at the same time has a merge that comes before either piece is used up (at equal ranks the left one goes first)."""
        a, b, i, j, rank = self.spine(left, True), self.spine(right, False), 0, 0, self.rank
        while True:
            (x, x_used), (y, y_used) = a[i], b[j]
            n = rank.get((x, y))
            if n is not None and n < x_used and n <= y_used:
                return False
            x_made = a[i + 1][1] if i + 1 < len(a) else -1
            y_made = b[j + 1][1] if j + 1 < len(b) else -1
            if x_made < 0 and y_made < 0:
                return True
            if x_made >= y_made:
                i += 1
            else:
                j += 1

    def split(self, word: bytes) -> list[bytes]:
        """Merge the lowest-ranked pair, leftmost first, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), 1 << 60), i))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts
