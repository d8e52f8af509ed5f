"""Operator 4: packing into near-equal windows by Karmarkar-Karp multiway differencing.

Documents are tokenized and packed in one narrow pass: a task takes its rows in blocks of about ``BLOCK`` tokens
and packs each block by itself, so nothing is shuffled, memory is bounded by a block and a lost task is redone
alone. Each block:

1. Of a document, whole windows are cut off first and fill a sequence each. What is left over is cut into
   pieces of at most ``PIECE`` tokens, so that sums can come out close to each other.
2. Pieces are merged by largest differencing over the least number of windows that can hold them: two partial
   partitions with the largest spread are merged, the fullest window of one with the emptiest of the other.
3. If a window exceeds the capacity, the number of windows rises and step 2 is repeated.
4. Neighbouring pieces of a document that meet in a window are put side by side and joined again.

A text's ids are those of its words, which are kept by word; words are new to the library only once per worker.
A null or empty text is its end token alone. Special tokens' strings inside a text are one id, as in the
library. Repeated rows are packed as often as they come. A null doc_id stays null. Other columns are ignored.
Sequence ids are unique over all tasks: the partition's number above 33 bits of the task's own count.
"""

from __future__ import annotations

import heapq
import re
import struct
import unicodedata
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lexis.llm import bpe
from lexis.llm.common import table

WINDOW = 2048
PIECE = 512
SHRED, SHREDDED = 32, 0.03
BLOCK = 300_000
KEPT = 800_000
END = (1).to_bytes(4, "little")
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Ids:
    """Ids of whole texts as little-endian 32-bit numbers, for a tokenizer whose words are encoded one by one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        self.special = {k.content: v for v, k in tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        letter, number, space = map(bpe.ranges, (bpe.LETTER, bpe.NUMBER, bpe.SPACE))
        self.words = re.compile(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{space}{letter}{number}]+").findall
        self.rare = re.compile(f"[\U00010000-\U0010ffff{bpe.ranges(None)}]").search

        model = tokenizer.model
        byte = [letter for letter, _ in sorted(bpe.byte_letters().items(), key=lambda x: x[1])]

        class Kept(dict):
            def __missing__(self, word: str) -> bytes:
                # the model itself: a word has been normalised and split off by then
                letters = word if word.isascii() and word.isprintable() else "".join(map(byte.__getitem__, word.encode()))
                found = [t.id for t in model.tokenize(letters)]
                made = struct.pack(f"<{len(found)}I", *found)
                if len(word) <= 40:
                    self[word] = made
                return made

        self.kept = Kept()

    def plain(self, text: str) -> bytes:
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        if not text.isascii() and self.rare(text):
            return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        # The library lowers each character by itself, so a sigma has no final form.
        text = text.replace("Σ", "σ").lower()
        if len(self.kept) > KEPT:
            self.kept.clear()
        return b"".join(map(self.kept.__getitem__, self.words(text)))

    def of(self, text: str) -> bytes:
        if not self.cut or "<|" not in text:
            return self.plain(text)
        return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self.plain(x) for x in self.cut.split(text))


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Largest differencing: the indices of ``sizes`` in each of ``windows`` parts with near-equal sums.

    A partial partition holds the sums above its least one, in descending order, with their members; parts at 0
    are not kept, so a merge costs what the two partitions hold."""
    heap = [(-size, n, [(size, [n])], 0) for n, size in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a, _ = heapq.heappop(heap)
        _, _, b, _ = heapq.heappop(heap)
        # the fullest of one meets the emptiest of the other: only where both hold something sums meet
        meet = len(a) + len(b) - windows
        if meet <= 0:
            merged = a + b
        else:
            merged = a[: len(a) - meet] + b[: len(b) - meet]
            for (x, p), (y, q) in zip(a[len(a) - meet :], reversed(b[len(b) - meet :])):
                p.extend(q)
                merged.append((x + y, p))
        merged.sort(key=lambda part: -part[0])
        if len(merged) == windows and (least := merged[-1][0]):
            merged = [(s - least, p) for s, p in merged]
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, made, merged, 0))
        made += 1
    return [p for _, p in heap[0][2]] if heap else []


def pack(lengths: list[int], window: int = WINDOW, piece: int = PIECE, shred: int = SHRED) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold ``lengths`` tokens of each document, none above ``window``."""
    full, rests, items = [], [], []
    for doc, length in enumerate(lengths):
        cut = length - length % window
        full += [[(doc, a, window)] for a in range(0, cut, window)]
        if length > cut:
            rests.append((doc, cut, length - cut))
    # The longest rests are cut finely: as the last to be merged they level the sums.
    fine = SHREDDED * sum(x[2] for x in rests)
    for doc, cut, rest in sorted(rests, key=lambda x: -x[2]):
        parts = -(-rest // (shred if fine > 0 else piece))
        fine -= rest
        edges = [cut + rest * k // parts for k in range(parts + 1)]
        items += [(doc, a, b - a) for a, b in zip(edges, edges[1:])]
    sizes = [x[2] for x in items]
    windows = -(-sum(sizes) // window)
    while items:
        parts = difference(sizes, windows)
        if max(sum(sizes[i] for i in p) for p in parts) <= window:
            break
        windows += 1
    else:
        parts = []
    for p in parts:
        joined: list[tuple[int, int, int]] = []
        for doc, start, length in sorted(items[i] for i in p):
            if joined and joined[-1][0] == doc and joined[-1][1] + joined[-1][2] == start:
                joined[-1] = (doc, joined[-1][1], joined[-1][2] + length)
            else:
                joined.append((doc, start, length))
        full.append(joined)
    return full


_IDS: dict[str, Ids] = {}


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text), as ``SCHEMA`` says; ``offset`` is its place in its sequence."""

    def run(batches):
        ids = _IDS.get(tokenizer) or _IDS.setdefault(tokenizer, Ids(tokenizer))
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        made = 0
        block: list[tuple[int | None, bytes]] = []
        held = 0

        def flush():
            nonlocal made, held
            out: list[tuple] = []
            for sequence in pack([len(b) // 4 for _, b in block], window):
                offset = 0
                for doc, start, length in sequence:
                    doc_id, data = block[doc]
                    out.append((doc_id, start, length, zlib.crc32(memoryview(data)[4 * start : 4 * (start + length)]), len(data) // 4, base + made, offset))
                    offset += length
                made += 1
            block.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], FIELDS)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data = ids.of(text.as_py() or "") + END
                block.append((doc_id.as_py(), data))
                held += len(data) // 4
                if held >= BLOCK:
                    yield flush()
        if block:
            yield flush()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
