"""Operator 2: token counts by a compiled finite-state tokenizer.

The merges of a byte-level BPE vocabulary are compiled, as texts need them, into a deterministic transducer
over bytes. After a prefix of a word the last token of the prefix's encoding is unique, and a token can follow
exactly if the pair encodes to itself; so a state needs only the longest suffix that begins some token and, for
each place in it where a token could begin, the token that ends there and how many tokens fewer it makes. A
transition carries the change in the token count. The pattern that cuts text into words looks at most at the
neighbouring characters, so its machine is definite: its map over any chunk is a constant, found for all
characters at once from their classes.

A text is cut into chunks, which are words or parts of ``CHUNK`` bytes of a longer word. A chunk's map goes from the
state before it to the state behind it and the tokens emitted. Words start in the start state, so a word of one chunk needs its map
there only. A longer word's chunks are run independently, each from the start state and from the states that the maps before it lead
to, until the maps are closed under composition (a few rounds, as states forget what lies far back); then they are composed by a
parallel prefix scan, in as many rounds as the logarithm of their number.
Arcs and maps at the start state are kept in memory per Python worker, up to ``KEPT_ARCS`` and ``KEPT_WORDS``;
then they are dropped and made anew, so memory is bounded for any input. Nothing is shuffled: the operator is one narrow pass.

Nulls and empty texts have 0 bytes and 0 tokens. A special token's string inside a text is one token, as in the
library. Repeated rows give repeated results. A null doc_id stays null. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexis.llm import bpe
from lexis.llm.common import map_rows, table

CHUNK = 48
KEPT_WORDS, KEPT_ARCS = 400_000, 700_000
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


class Transducer:
    """Deterministic transducer from bytes to changes of the token count, compiled state by state."""

    def __init__(self, merges: bpe.Merges):
        self.merges = merges
        self.begins = {t[:i] for t in merges.vocab for i in range(1, len(t) + 1)}
        self.alone = {t for t in merges.vocab if merges.split(t) == [t]}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [(b"", ((0, b"", 0),))]
        self.number = {self.states[0]: 0}
        self.arcs: dict[int, int] = {}

    def compile(self, state: int, byte: int) -> int:
        seen, places = self.states[state]
        grown, alone, follows = seen + bytes((byte,)), self.alone, self.merges.follows
        size = len(grown)
        ends = [(grown[size - back - 1 :], back, before, less) for back, before, less in places]
        for token, _, before, less in ends:
            if token in alone and (not before or follows(before, token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        change, begins = less + 1, self.begins
        kept = [(back + 1, before, less - change) for end, back, before, less in ends if end in begins]
        target = (grown[size - kept[0][0] :] if kept else b"", (*kept, (0, token, 0)))
        if (n := self.number.get(target)) is None:
            n = self.number[target] = len(self.states)
            self.states.append(target)
        self.arcs[state << 8 | byte] = arc = n << 10 | change + 512
        return arc

    def run(self, state: int, chunk: bytes) -> tuple[int, int]:
        """The value of the chunk's map at a state: the state behind the chunk, and the tokens emitted."""
        emitted, arcs = 0, self.arcs.get
        for byte in chunk:
            arc = arcs(state << 8 | byte) or self.compile(state, byte)
            state = arc >> 10
            emitted += (arc & 1023) - 512
        return state, emitted


def word_starts(text: str) -> np.ndarray:
    """Places where the words of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` begin.

    A word begins where the class changes; the last space of a gap moves to the word behind it; a contraction
    begins and ends a word where its apostrophe opens a run of other characters and no space is in front."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = bpe.classes()[chars]
    start = np.empty(len(chars), dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    gap = kind == bpe.SPACE
    last = np.flatnonzero(gap[:-1] & ~gap[1:])  # the last character of each gap that a word follows
    start[last] = True
    start[last[chars[last] == 0x20] + 1] = False
    quote = np.flatnonzero(chars[:-1] == 0x27)
    quote = quote[start[quote]]
    for a in quote.tolist():
        if m := CONTRACTION(text, a):
            start[m.end() : m.end() + 1] = True
            start[a + 1 : m.end()] = False
    return np.flatnonzero(start)


CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)").match


#: State before a chunk to the state behind it and the tokens emitted.
Map = dict[int, tuple[int, int]]


def composed(first: Map, then: Map) -> Map:
    return {state: (then[behind][0], n + then[behind][1]) for state, (behind, n) in first.items()}


def prefixes(maps: list[Map]) -> list[Map]:
    """The composition of each map with all before it; in each round all positions take in what ends just before their part."""
    reach = 1
    while reach < len(maps):
        maps = maps[:reach] + [composed(maps[i - reach], maps[i]) for i in range(reach, len(maps))]
        reach *= 2
    return maps


class Counter:
    """Token counts of whole texts; the values of maps at the start state are kept by word."""

    def __init__(self, path: str):
        merges = bpe.Merges(path)
        self.machine = Transducer(merges)
        self.special = re.compile("|".join(map(re.escape, merges.special))) if merges.special else None
        counter = self

        class Words(dict):
            def __missing__(self, word: str) -> int:
                n = counter.scan(word.encode("utf-8", "surrogatepass"))
                if len(word) <= CHUNK:
                    self[word] = n
                return n

        self.words = Words()

    def scan(self, word: bytes) -> int:
        """Tokens of a word: the last of the prefix compositions of its chunks' maps, at the start state."""
        if len(word) <= CHUNK:
            return self.machine.run(0, word)[1]
        return prefixes(self.maps([word[a : a + CHUNK] for a in range(0, len(word), CHUNK)]))[-1][0][1]

    def maps(self, chunks: list[bytes]) -> list[Map]:
        """A map for each chunk, with all states that the map before it leads to."""
        maps: list[Map] = [{} for _ in chunks]
        asked = [{0} for _ in chunks]
        while any(asked):
            for own, states, chunk in zip(maps, asked, chunks):
                for state in states:
                    own[state] = self.machine.run(state, chunk)
            asked = [set(), *({behind for behind, _ in before.values()} - own.keys() for before, own in zip(maps, maps[1:]))]
        return maps

    def plain(self, text: str) -> int:
        if not text:
            return 0
        at = word_starts(text).tolist()
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        if len(self.machine.arcs) > KEPT_ARCS:
            self.machine.clear()
        return sum(map(self.words.__getitem__, [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``tokenizer`` is the path of a byte-level BPE file of the ``tokenizers`` library, there on every worker."""

    def make():
        counter = _COUNTERS.get(tokenizer) or _COUNTERS.setdefault(tokenizer, Counter(tokenizer))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_bytes, n_tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                n_tokens.append(counter.count(text))
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return each

    return map_rows(docs, ["doc_id", "text"], make, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
