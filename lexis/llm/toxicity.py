"""Operator 6: toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding: lower case, look-alike letters of other scripts to Latin, digits and signs that stand for letters inside
words to those letters, and anything but letters to one separator. Lexicon items are whole words and beginnings of words.
A word counts once, with its heaviest item. Exception phrases (a word that a beginning matches but that is
common in clean texts, or a pair of neighbouring words) count as nothing. The sum is normalised by the text's length.

Fitting uses a bounded sample of labelled rows, at most ``SAMPLE`` of either label, in order of a hash of the
doc_id; rows held out (``crc32(doc_id) % FOLDS = 0``) are never among them. The items' weights are log odds, counted by Spark
over one part of the sample, and at most ``ITEMS`` are kept; the score's three coefficients are fitted to the
other part. The model's size has that bound, so it goes to the tasks as it is. Scoring is one narrow pass over
all rows. Only texts are inputs of a score.

Null and empty texts are scored by the prior alone. Repeated rows get repeated scores; a null doc_id is not held
out and stays null; labels that repeat or disagree count as they come; without labelled rows of both kinds every score is the share of toxic ones
(0 without labels). Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.llm.common import map_rows, saved, table

SAMPLE = 4000
ITEMS = 4000
FOLDS = 5
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"

#: Letters of other scripts that look like Latin ones, and digits and signs used for letters.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "ε": "e", "υ": "u", "ı": "i", "ɡ": "g", "ℓ": "l"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "€": "e", "|": "l"}
_TABLE = {ord(k): v for k, v in {**LOOKALIKES, **DIGITS}.items()}
_SIGN = re.compile(r"(?<=[^\W\d_])[@$!€|](?=[^\W\d_])")
_GAP = re.compile(r"[\W\d_]+")
BEGIN = range(4, 10)
MARK = "\x01"


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    text = (text or "").lower()
    if not text.isascii():
        # full-width forms
        text = re.sub("[！-～]", lambda m: chr(ord(m[0]) - 0xFEE0), text)
    text = _SIGN.sub(lambda m: SIGNS[m[0]], text).translate(_TABLE)
    return [w for w in _GAP.split(text) if w]


def items_of(words: list[str]) -> set[str]:
    """Items that occur: words, and beginnings marked by a star."""
    found = set(w for w in words if 2 < len(w) < 40)
    return found | {w[:n] + "*" for w in found for n in BEGIN if n < len(w)}


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    coefficients: tuple[float, float, float] = (-60.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for item, weight in self.weights.items():
            key = MARK + item[:-1] if item.endswith("*") else MARK + item + MARK
            machine.add_word(key, (len(key) - 1, len(item.rstrip("*")), weight))
        if len(machine):
            machine.make_automaton()
        return machine

    def hits(self, words: list[str], machine) -> float:
        if not len(machine) or not words:
            return 0.0
        text = MARK + MARK.join(words) + MARK
        best: dict[int, float] = {}
        for end, (back, _, weight) in machine.iter(text):
            start = end - back
            if weight > best.get(start, 0.0):
                best[start] = weight
        total = 0.0
        for start, weight in best.items():
            end = text.index(MARK, start + 1)
            word = text[start + 1 : end]
            if self.exceptions:
                before = text[text.rfind(MARK, 0, start) + 1 : start] if start else ""
                after = text[end + 1 : (text.find(MARK, end + 1) + 1 or len(text) + 1) - 1]
                if word in self.exceptions or f"{before} {word}" in self.exceptions or f"{word} {after}" in self.exceptions:
                    continue
            total += weight
        return total

    def score(self, hits: float, words: int) -> float:
        a, b, c = self.coefficients
        z = a + b * math.log1p(hits) + c * math.log1p(100 * hits / (words + 50))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _fitted(rows: np.ndarray, share: float, seen: float) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge; ``seen`` and ``share`` are the odds here and over all."""
    hits, words, y = rows.T
    x = np.stack([np.ones(len(y)), np.log1p(hits), np.log1p(100 * hits / (words + 50))], 1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.3, 0.3]), x.T @ (y - p) - np.array([1e-3, 0.3, 0.3]) * w)
        w += np.clip(step, -3, 3)
    return float(w[0] + math.log(share / seen)), float(w[1]), float(w[2])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows of either label that aren't held out."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter((crc % FOLDS != 0) & F.col("toxic").isin(0, 1))
    counts = dict(known.groupBy("toxic").count().collect())
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    if not n_pos or not n_neg:
        return Model(coefficients=(60.0 if n_pos else -60.0, 0.0, 0.0))
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = known.filter("toxic = 1").orderBy(order, "doc_id").limit(sample).unionByName(known.filter("toxic = 0").orderBy(order, "doc_id").limit(sample))

    def folded():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fold(t.as_py()) for t in batch.column(2)], pa.list_(pa.string()))], ["part", "toxic", "words"])

        return each

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(chosen, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(10)).cast("int"))
    rows = saved(map_rows(rows, ["part", "toxic", "text"], folded, "part int, toxic int, words array<string>"), "labelled")

    def items():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = {}
            for toxic, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for item in items_of(words):
                    n = found.setdefault(item, [0, 0])
                    n[toxic] += 1
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array([n[1] for n in found.values()], pa.int64()), pa.array([n[0] for n in found.values()], pa.int64())], ["item", "pos", "neg"])

        return each

    learn, tune = rows.filter("part < 7"), rows.filter("part >= 7")
    totals = dict(learn.groupBy("toxic").count().collect())
    p, n = totals.get(1, 0), totals.get(0, 0)
    if not p or not n:
        return Model(coefficients=(math.log(n_pos / n_neg), 0.0, 0.0))
    counted = map_rows(learn, ["toxic", "words"], items, "item string, pos bigint, neg bigint").groupBy("item").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.1) / (p + 0.2)) - F.log((F.col("neg") + 0.5) / (n + 1.0))
    likely = counted.withColumn("odds", odds).filter((F.col("pos") >= max(2, p // 400)) & (F.col("odds") >= math.log(8)))
    weights = {r.item: float(r.odds) for r in likely.orderBy(F.desc(F.col("odds") * F.log1p("pos")), "item").limit(ITEMS).collect()}
    model = Model(weights)

    def contexts():
        machine = model.automaton()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: dict[str, list[int]] = {}
            for toxic, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                phrases = set()
                for i, word in enumerate(words):
                    if model.hits([word], machine):
                        phrases |= {word, *([f"{words[i - 1]} {word}"] if i else []), *([f"{word} {words[i + 1]}"] if i + 1 < len(words) else [])}
                for x in phrases:
                    found.setdefault(x, [0, 0])[toxic] += 1
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v[1] for v in found.values()], pa.int64()), pa.array([v[0] for v in found.values()], pa.int64())], ["phrase", "pos", "neg"])

        return each

    seen = map_rows(learn, ["toxic", "words"], contexts, "phrase string, pos bigint, neg bigint").groupBy("phrase").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    clean = seen.filter((F.col("neg") >= 2) & (F.col("neg") * p >= F.col("pos") * n)).orderBy(F.desc("neg"), "phrase").limit(ITEMS)
    model.exceptions = frozenset(r.phrase for r in clean.collect())

    def sums():
        machine = model.automaton()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = batch.column(1).to_pylist()
            return pa.RecordBatch.from_arrays([pa.array([model.hits(w, machine) for w in words], pa.float64()), pa.array(map(len, words), pa.float64()), batch.column(0).cast(pa.float64())], ["hits", "words", "toxic"])

        return each

    values = np.array([tuple(r) for r in map_rows(tune, ["toxic", "words"], sums, "hits double, words double, toxic double").collect()]).reshape(-1, 3)
    pos, neg = values[:, 2].sum(), (1 - values[:, 2]).sum()
    model.coefficients = _fitted(values, n_pos / n_neg, pos / neg) if pos and neg else (math.log(n_pos / n_neg), 1.0, 0.0)
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""

    def make():
        machine = model.automaton()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = []
            for text in batch.column(2):
                words = fold(text.as_py())
                scores.append(model.score(model.hits(words, machine), len(words)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

        return each

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), "text")
    return map_rows(rows, ["doc_id", "held_out", "text"], make, SCHEMA)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
