"""Operator 9: removal of repeated windows of words, counted by super-k-mers.

1. Per text, every window of ``k`` words has a minimiser: the least hash of the runs of ``m`` words in it. Consecutive
   windows with the same place of minimiser form a super-k-mer. One narrow pass writes (document, start, minimiser).
2. A window that occurs twice has a minimiser that occurs twice, so super-k-mers whose minimiser is found only once
   over all documents are dropped by a count; most of a corpus ends here, having moved a few bytes for some 16 words.
3. The rest travel as one packed string each to the bucket of their minimiser, where the windows are sorted as text
   and equal neighbours are marked; the marks go back as a bit mask per super-k-mer.
4. A minimiser with more than ``HOT`` super-k-mers (a passage that much of the corpus shares) isn't put in one bucket:
   its windows go by 128-bit digests through an aggregation with partial sums and a join that Spark can split.
5. The words under marked windows are removed in a last pass over the documents.

Documents are shuffled once, by their key (steps 3 and 5 read the same columns, so they use one exchange); what is held in memory is a text or a
bucket of at most ``HOT`` strings of at most ``k + 31`` words. Texts are cut for step 1 every 2^20 words.

A row whose doc_id and text are found again is cut once, however often it is there, and loses all its windows.
Windows are judged on the input. Null and empty texts, and texts shorter than a window, lose nothing; without words
the digest is that of the empty string. Repeated rows count as different documents, so what they share is removed
from each. A null doc_id stays null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.llm.common import map_rows, saved, table, words_of

K, M = 35, 6
LONGEST = 32
HOT = 100_000
SALTS = 16
FEW = 64
SEGMENT = 1 << 20
KEPT = 1_000_000
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


class Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        n = xxhash.xxh64_intdigest(word)
        if len(word) <= 40:
            self[word] = n
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


HASHES = Hashes()


def runs_of(hashes: np.ndarray, length: int) -> np.ndarray:
    """Mixed hash of each run of ``length`` words."""
    n = len(hashes) - length + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        for j in range(length):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += hashes[j : j + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def super_kmers(hashes: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and number of windows of each super-k-mer, and its minimiser."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, max(len(hashes) - k + 1, 0), SEGMENT - k):
        piece = hashes[first : first + SEGMENT - 1]
        windows = min(len(piece) - k + 1, SEGMENT - k)
        if windows <= 0:
            break
        g = runs_of(piece, m)
        # the place below the high bits: ties go to the leftmost
        least = (g >> np.uint64(20) << np.uint64(20)) | np.arange(len(g), dtype=np.uint64)
        width, reach = k - m + 1, 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        place = (least[:windows] & np.uint64(SEGMENT - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        parts.append((start + first, np.diff(np.append(start, windows)), g[place[start]].view(np.int64)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def repeats_in(packed: list[bytes], windows: list[int], k: int = K) -> list[int]:
    """For each packed string of a bucket, the mask of its windows that occur elsewhere in the bucket."""
    counts: dict[bytes, int] = {}
    for string in packed:
        counts[string] = counts.get(string, 0) + 1
    masks = {string: 0 for string in counts}
    if len(counts) > 1:
        # Many windows are sorted by 128-bit digests, which a bucket of the largest size has room for; few as they are.
        digests = len(counts) > FEW
        texts: list[bytes] = []
        owner: list[tuple[bytes, int]] = []
        sizes = dict(zip(packed, windows))
        for string in counts:
            at = [0, *(i + 1 for i, c in enumerate(string) if c == 32), len(string) + 1]
            for i in range(sizes[string]):
                text = string[at[i] : at[i + k] - 1]
                texts.append(hashlib.blake2b(text, digest_size=16).digest() if digests else text)
                owner.append((string, i))
        order = sorted(range(len(texts)), key=texts.__getitem__)
        for a, b in zip(order, order[1:]):
            if texts[a] == texts[b]:
                for string, i in (owner[a], owner[b]):
                    masks[string] |= 1 << i
    return [(1 << n) - 1 if counts[string] > 1 else masks[string] for string, n in zip(packed, windows)]


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed and the digest of the words kept."""
    key = ["__d", "__t"]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("__d"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("__t", F.xxhash64("text"))
    # a row that is there more than once loses all its windows, and one copy stands for it in the others' eyes
    again = saved(rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key), "repeated", thin=True)
    once, copies = rows, not again.isEmpty()
    if copies:
        once = rows.join(again, key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates(key))

    def cut():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for d, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = words_of(text.as_py())
                if len(words) >= k:
                    start, n, least = super_kmers(HASHES.of(words), k, m)
                    for column, made in zip(out, (np.full(len(start), d), np.full(len(start), t), start, n, least)):
                        column.append(made)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], ["__d", "__t", "start", "n", "least"])

        return each

    cuts = saved(map_rows(once, [*key, "text"], cut, "__d bigint, __t bigint, start bigint, n bigint, least bigint"), "super-kmers")
    counts = saved(cuts.groupBy("least").agg(F.count("*").alias("all")).filter("all > 1"), "minimisers", thin=True)

    def taken(which: str) -> DataFrame:
        """Documents with those of their super-k-mers whose minimisers are ``which``."""
        shared = cuts.join(counts.filter(which).select("least"), "least").groupBy(*key).agg(F.collect_list(F.struct("start", "n", "least")).alias("cuts"))
        return once.join(shared, key).select(*key, "text", "cuts", "doc_id")

    def pack():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for d, t, words, cuts in _texts(batch):
                for c in cuts:
                    out.append((d, t, c["start"], c["n"], c["least"], b" ".join(words[c["start"] : c["start"] + c["n"] + k - 1])))
            return _rows(out, {"__d": pa.int64(), "__t": pa.int64(), "start": pa.int64(), "n": pa.int64(), "least": pa.int64(), "packed": pa.binary()})

        return each

    def digest():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for d, t, words, cuts in _texts(batch):
                for c in cuts:
                    for i in range(c["start"], c["start"] + c["n"]):
                        out.append((d, t, i, hashlib.blake2b(b" ".join(words[i : i + k]), digest_size=16).digest()))
            return _rows(out, {"__d": pa.int64(), "__t": pa.int64(), "start": pa.int64(), "digest": pa.binary()})

        return each

    def count():
        # A bucket's rows follow each other and may go on in the next batch.
        held: list[tuple] = []

        def flush(out: list[tuple]) -> None:
            if len(held) > 1:
                for row, mask in zip(held, repeats_in([r[4] for r in held], [r[3] for r in held], k)):
                    if mask:
                        out.append((row[0], row[1], row[2], mask))
            held.clear()

        def run(batches):
            least = None
            for batch in batches:
                out: list[tuple] = []
                for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    if row[4] != least:
                        flush(out)
                        least = row[4]
                    held.append((row[0], row[1], row[2], row[3], row[5]))
                yield _masks(out)
            out = []
            flush(out)
            yield _masks(out)

        return run

    packed = map_rows(taken(f"all <= {hot}"), [*key, "text", "cuts", "doc_id"], pack, "__d bigint, __t bigint, start bigint, n bigint, least bigint, packed binary")
    cold = packed.repartition("least").sortWithinPartitions("least")
    marks = cold.mapInArrow(lambda batches: count()(batches), "__d bigint, __t bigint, start bigint, mask bigint")
    if not counts.filter(f"all > {hot}").isEmpty():
        each = saved(map_rows(taken(f"all > {hot}"), [*key, "text", "cuts", "doc_id"], digest, "__d bigint, __t bigint, start bigint, digest binary"), "windows")
        often = each.groupBy("digest").agg(F.count("*").alias("all")).filter("all > 1").select("digest")
        # a digest that much of the corpus shares is dealt to SALTS tasks
        often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = each.withColumn("salt", F.pmod(F.xxhash64(*key, "start"), F.lit(SALTS)).cast("int"))
        marks = marks.unionByName(salted.join(often, ["digest", "salt"]).select(*key, "start", F.lit(1).cast("bigint").alias("mask")))
    marks = marks.groupBy(*key).agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    judged = rows.join(marks, key, "left").withColumn("all", F.lit(False))
    if copies:
        judged = judged.drop("all").join(again.withColumn("all", F.lit(True)), key, "left")

    def remove():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for doc_id, text, marks, all_ in zip(*(batch.column(i) for i in range(4))):
                words = words_of(text.as_py())
                n, removed = len(words), 0
                if all_.as_py() and n >= k:
                    words, removed = [], n
                elif marks.is_valid:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    for mark in marks.as_py():
                        start, mask = mark["start"], mark["mask"]
                        while mask:
                            low = (mask & -mask).bit_length() - 1
                            edge[start + low] += 1
                            edge[start + low + k] -= 1
                            mask &= mask - 1
                    keep = np.cumsum(edge[:n]) == 0
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    removed = n - len(words)
                out.append((doc_id.as_py(), n, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
            return _rows(out, {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()})

        return each

    return map_rows(judged, ["doc_id", "text", "marks", "all"], remove, SCHEMA)


def _rows(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))


def _masks(rows: list[tuple]) -> pa.RecordBatch:
    return _rows(rows, dict.fromkeys(("__d", "__t", "start", "mask"), pa.int64()))


def _texts(batch: pa.RecordBatch):
    """Key, words and super-k-mers of each text."""
    for d, t, text, cuts in zip(*(batch.column(i) for i in range(4))):
        yield d.as_py(), t.as_py(), words_of(text.as_py()), cuts.as_py()


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
