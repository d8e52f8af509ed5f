"""Operator 13: ranked lexical search by MaxScore over shards of documents.

1. The query set is taken in blocks of at most ``BLOCK`` bytes of item text (a longer item is a block of its own). One narrow pass over the documents turns
   each into its length and the frequencies of those terms that the block's items hold; it is written once, and the totals and the
   terms' document frequencies are counted from it.
2. A task reads these rows in shards of ``SHARD`` documents and turns a shard into postings, sorted by term, then document. A posting's
   impact is final there, so a term's upper bound is its weight times the greatest impact in the shard.
3. For each item, terms are ordered by upper bound. Those whose bounds together stay below the item's score to beat are non-essential: a
   document found in no other list can't qualify. Essential lists are added up; non-essential ones are then probed from the greatest bound down, only for documents
   that can still reach the score to beat, which a task carries from shard to shard.
4. A task hands on at most ``k`` documents per item, and the items' ranks are taken from these.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII, with A-Z in lower case. Scores are integers.

Null and empty texts have no terms, and aren't counted in N; items without terms have no rows. A document with the same text as another has the same
score, and ties go by ascending doc_id, a null one last; repeated rows of a document are ranked each. Repeated items, and items of the same id, are ranked each by
itself. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexis.llm.common import discard, map_rows, saved, table

K = 20
SHARD = 4096
BLOCK = 4 << 20
SCHEMA = "item_id bigint, rank int, doc_id bigint, score bigint"

#: Lower-cases A-Z and turns what parts terms into spaces; bytes beyond ASCII belong to terms.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Item(NamedTuple):
    """An item of a block: its distinct terms by number, and how often each occurs in it."""

    item_id: int | None
    terms: np.ndarray
    times: np.ndarray


def blocks(items: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items' ids and terms, in blocks of at most ``size`` bytes of text or of one item."""
    held, used = [], 0
    for row in items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").toLocalIterator():
        terms = terms_of(row.text)
        if held and used + len(row.text or "") > size:
            yield held
            held, used = [], 0
        if terms:
            held.append((row.item_id, terms))
            used += len(row.text)
    if held:
        yield held


def frequencies(docs: DataFrame, vocabulary) -> DataFrame:
    """Per document with a term: doc_id, n (its terms with repeats), and the numbers and frequencies of its terms in the broadcast ``vocabulary``."""

    def make():
        number = vocabulary.value.get

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, lengths, terms, times = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    found = Counter(map(number, words))
                    found.pop(None, None)
                    ids.append(doc_id)
                    lengths.append(len(words))
                    terms.append(np.fromiter(found.keys(), dtype=np.int32, count=len(found)))
                    times.append(np.fromiter(found.values(), dtype=np.int32, count=len(found)))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "times"]
            )

        return each

    return map_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id", "text"], make, "doc_id bigint, n bigint, terms array<int>, times array<int>")


class Best:
    """The best documents of an item so far, and the score to beat."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @property
    def least(self) -> int:
        """Documents below this score can't qualify; one that ties can, by its id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        first = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[first], scores[first]


class Shard:
    """Postings of some documents, by term."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        norm = 75 + (25 * n_docs * lengths.astype(object)) // n_terms  # unlimited integers, one a document
        docs = np.repeat(np.arange(len(ids)), sizes)
        times = times.astype(np.int64)
        impacts = (1_000_000_000 * times) // (1000 * times + 12 * norm.astype(np.int64)[docs])
        order = np.argsort(terms, kind="stable")
        self.docs, self.impacts = docs[order], impacts[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.greatest = np.maximum.reduceat(self.impacts, self.starts) if len(order) else np.zeros(0, dtype=np.int64)

    def search(self, item: Item, weights: np.ndarray, best: Best) -> None:
        place = np.searchsorted(self.terms, item.terms)
        place[place == len(self.terms)] = 0
        held = self.terms[place] == item.terms if len(self.terms) else np.zeros(len(place), dtype=bool)
        place, factor = place[held], (weights[item.terms] * item.times)[held]
        bound = factor * self.greatest[place]
        order = np.argsort(bound, kind="stable")
        place, factor, bound = place[order], factor[order], bound[order]
        below, least = np.cumsum(bound), best.least
        essential = int(np.searchsorted(below, least, side="left"))  # all lists before this one together stay below
        score, seen = np.zeros(len(self.ids), dtype=np.int64), np.zeros(len(self.ids), dtype=bool)
        for p, f in zip(place[essential:].tolist(), factor[essential:].tolist()):
            docs = self.docs[self.starts[p] : self.ends[p]]
            score[docs] += f * self.impacts[self.starts[p] : self.ends[p]]
            seen[docs] = True
        open_ = np.flatnonzero(seen)
        for i in range(essential - 1, -1, -1):
            open_ = open_[score[open_] + below[i] >= least]
            if not len(open_):
                return
            docs = self.docs[self.starts[place[i]] : self.ends[place[i]]]
            at = np.searchsorted(docs, open_)
            at[at == len(docs)] = 0
            found = docs[at] == open_
            score[open_[found]] += factor[i] * self.impacts[self.starts[place[i]] + at[found]]
        open_ = open_[score[open_] >= least]
        if len(open_):
            best.add(self.ids[open_], score[open_])


#: Stands for a null doc_id, which comes last.
NO_ID = np.iinfo(np.int64).max


def ranked(rows: DataFrame, items: list[Item], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The ``k`` best documents of each item among the frequencies ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast((items, weights))

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = [Best(k) for _ in items]
        for batch in batches:
            for first in range(0, batch.num_rows, SHARD):
                part = batch.slice(first, SHARD)
                terms, times = part.column("terms"), part.column("times")
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy()
                sizes = terms.value_lengths().to_numpy()
                shard = Shard(ids, part.column("n").to_numpy(), sizes, terms.flatten().to_numpy(), times.flatten().to_numpy(), n_docs, n_terms)
                for item, own in zip(items, best):
                    shard.search(item, weights, own)
        key = np.repeat(np.arange(len(items)), [len(b.ids) for b in best])
        ids = np.concatenate([b.ids for b in best]) if best else np.zeros(0, dtype=np.int64)
        scores = np.concatenate([b.scores for b in best]) if best else ids
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array([items[i].item_id for i in key], pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())], ["key", "item_id", "doc_id", "score"])

    found = rows.mapInArrow(best_of, "key bigint, item_id bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """The ``k`` best documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    for held in blocks(items, block):
        number = {t: n for n, t in enumerate(dict.fromkeys(t for _, terms in held for t in terms))}
        vocabulary = spark.sparkContext.broadcast(number)
        rows = saved(frequencies(docs, vocabulary), "frequencies")
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        if n_docs:
            weights = np.full(len(number), math.floor(1000 * math.log(2 * n_docs + 2)), dtype=np.int64)
            for term, df in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
                weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            asked = []
            for item_id, terms in held:
                times = Counter(map(number.__getitem__, terms))
                asked.append(Item(item_id, np.array(list(times.keys())), np.array(list(times.values()), dtype=np.int64)))
            out = out.unionByName(saved(ranked(rows, asked, weights, n_docs, n_terms, k), "ranked", thin=True))
        discard(rows)
        vocabulary.destroy()
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
    total AS (SELECT (count(*) FILTER (len(terms) > 0))::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
    posting AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
    weight AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posting, total GROUP BY term),
    asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
    scored AS (SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
        FROM asked JOIN posting USING (term) JOIN weight USING (term), total GROUP BY ALL)
    SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= {K}"""
