"""Operator 3: benchmark decontamination by spaced-seed hashing.

A mask is a fixed pattern over a few consecutive tokens of which it looks at some; hashes of the tokens it looks
at are equal whatever stands in the ignored places. Every place of every training text and benchmark item is hashed
under all masks, training hashes are looked up among the benchmark's, and around each hit the texts are laid side by side:
the overlap grows from the hit in both directions while it keeps at least ``ALIKE`` (four of five) of its tokens, so substituted
tokens don't end it. The masks miss no such overlap: wherever the substitutions are, one mask hits at one place. An item is found in a text if such an overlap has ``LEAST`` tokens or more, or has ``ALIKE`` of all the item's
tokens equal, whichever they are. Items of fewer than ``SPAN`` tokens are found where all their tokens stand in order: each of their
lengths has a mask that looks at every place.

Tokens are words of letters and digits in lower case. The join of training and test hashes is a broadcast one, block by block: the
benchmark is taken in blocks of about ``BLOCK`` items and ``BYTES`` bytes at most by the hash of the item, a block's sorted hashes are bounded,
so they go to the tasks, and the training hashes are looked up there as they are made. The training texts are read once a block and nothing
is shuffled; hashes of all their places, twice as many rows as the corpus has words, never leave a task. A hit is kept once for each shift between the texts, so a frequent passage
costs a text one verification a shift. Whole texts are hashed.

Null and empty texts and items overlap with nothing. Repeated items are found each; repeated rows are found each. A null doc_id stays null.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.llm.common import table
from lexis.llm.substring_dedup import HASHES

SPAN = 12
#: Fixed masks: the places that are looked at. One of them hits in any stretch of SPAN tokens or more that is equal in ALIKE of its tokens,
#: whatever the places of the others (tested for up to 39 tokens; a longer stretch has a part of 20 to 39 with the same share).
MASKS = ("111011", "11110001")
LEAST, ALIKE = 20, (4, 5)
#: Items, and bytes of them, that a block has about at most.
BLOCK, BYTES = 4000, 16 << 20
SCHEMA = "doc_id bigint, item_id bigint, start bigint, item_start bigint, length bigint, same bigint"


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the tokens of a text."""
    found = re.findall(r"[^\W_]+", (text or "").lower())
    return HASHES.of([t.encode("utf-8", "surrogatepass") for t in found])


@functools.cache
def _places(mask: str) -> list[int]:
    return [j for j, looked in enumerate(mask) if looked == "1"]


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each place."""
    n = max(len(hashes) - len(mask) + 1, 0)
    out = np.full(n, int("1" + mask, 2), dtype=np.uint64)
    for j in _places(mask):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : j + n]
    return out ^ (out >> np.uint64(31))


class Benchmark:
    """A bounded block of items with their seeds."""

    def __init__(self, items: list[tuple]):
        """``items`` are (key, text) or (key, text, how often it is there)."""
        self.keys = [x[0] for x in items]
        self.copies = [x[2] if len(x) > 2 else 1 for x in items]
        self.tokens = [tokens(x[1]) for x in items]
        self.seeds: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []
        self.filter = np.zeros(1 << 22, dtype=bool)
        short = {len(t) for t in self.tokens if 0 < len(t) < SPAN}
        for mask, size in [(m, 0) for m in MASKS] + [("1" * n, n) for n in sorted(short)]:
            each = [seeds(t if size in (0, len(t)) else t[:0], mask) for t in self.tokens]
            hashes = np.concatenate(each) if each else np.zeros(0, np.uint64)
            item = np.repeat(np.arange(len(each)), [len(x) for x in each])
            place = np.concatenate([np.arange(len(x)) for x in each]) if each else item
            order = np.argsort(hashes, kind="stable")
            self.seeds.append((mask, hashes[order], item[order], place[order]))
            self.filter[(hashes >> np.uint64(42)).astype(np.int64)] = True

    def shifts(self, text: np.ndarray) -> dict[tuple[int, int], int]:
        """The first hit of each item and shift: (item, place in text - place in item) -> place in text."""
        found: dict[tuple[int, int], int] = {}
        for mask, known, item, place in self.seeds:
            hashes = seeds(text, mask)
            at = np.flatnonzero(self.filter[(hashes >> np.uint64(42)).astype(np.int64)])
            low, high = np.searchsorted(known, hashes[at], "left"), np.searchsorted(known, hashes[at], "right")
            for i, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                for n in range(a, b):
                    key = (int(item[n]), i - int(place[n]))
                    if i < found.get(key, 1 << 60):
                        found[key] = i
        return found

    def overlaps(self, text: np.ndarray) -> list[tuple[int | None, int, int, int, int]]:
        """(item, start in text, start in item, length, equal tokens) of the longest verified overlap with each item."""
        best: dict[int, tuple] = {}
        for (item, shift), _ in self.shifts(text).items():
            other = self.tokens[item]
            a, b = max(shift, 0), min(shift + len(other), len(text))
            same = text[a:b] == other[a - shift : b - shift]
            start, length, equal = longest(same)
            part, whole = ALIKE if len(other) >= SPAN else (1, 1)
            if (length >= LEAST or whole * equal >= part * len(other)) and length > best.get(item, (0, 0, 0, 0))[2]:
                best[item] = (a + start, a + start - shift, length, equal)
        return [(self.keys[i], *x) for i, x in sorted(best.items()) for _ in range(self.copies[i])]


def longest(same: np.ndarray) -> tuple[int, int, int]:
    """Start, length and equal places of the longest stretch that begins and ends equal and is equal in ``ALIKE`` of its places."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    # gains: prefix[j] - prefix[i] >= 0 where a stretch i..j has the share
    part, whole = ALIKE
    prefix = np.concatenate([[0], np.cumsum(np.where(same, whole - part, -part))])
    least = np.minimum.accumulate(prefix)
    best = (0, 0, 0)
    for j in (at + 1).tolist():
        i = int(np.searchsorted(-least, -prefix[j], "left"))
        while i < j and not same[i]:
            i += 1
        if j - i > best[1]:
            best = (i, j - i, int(same[i:j].sum()))
    return best


def blocks_of(benchmark: DataFrame, block: int = BLOCK, size: int = BYTES):
    """The distinct items with their numbers, in blocks of bounded size, one after the other."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null").groupBy("item_id", "text").agg(F.count("*").alias("n"))
    n, held = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()
    parts = max(1, -(-2 * n // block), -(-2 * held // size))
    for part in range(parts if n else 0):
        chosen = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield [tuple(r) for r in chosen.collect()]


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) and benchmark item (item_id, text) found in it: the longest overlap, in tokens."""
    rows, found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), None
    for items in blocks_of(benchmark):
        part = rows.mapInArrow(_finder(items), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return rows.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def _finder(items: list[tuple]):
    def run(batches):
        block = Benchmark(items)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                out += [(doc_id.as_py(), *x) for x in block.overlaps(tokens(text.as_py()))]
            columns = list(zip(*out)) or [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def _clean(items: list[tuple], at: int):
    def run(batches):
        block = Benchmark(items)
        for batch in batches:
            keep = [not block.overlaps(tokens(text.as_py())) for text in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns."""
    at = docs.columns.index("text")
    for items in blocks_of(benchmark):
        docs = docs.mapInArrow(_clean(items, at), docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
