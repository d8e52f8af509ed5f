"""Counting of entries over tokens: frequencies, ranks, phrases and the greedy walk through a sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = 7


def frequencies(tokens: DataFrame, key: str = "w") -> DataFrame:
    return tokens.groupBy(key).agg(F.count("*").alias("n"))


def ranked(counts: DataFrame, key: str = "w", least: int = LEAST) -> DataFrame:
    """Keys seen at least ``least`` times with their rank from 0, by count and then by key.

    A rank is how many keys come before: the number with higher counts, from a histogram of counts, and the place among equal ones."""
    kept = counts.filter(F.col("n") >= least)
    above = kept.groupBy("n").agg(F.count("*").alias("same"))
    above = above.withColumn("before", F.coalesce(F.sum("same").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("n", "before")
    among = kept.withColumn("place", F.row_number().over(Window.partitionBy("n").orderBy(key)) - 1)
    return among.join(above, "n").select(key, "n", (F.col("before") + F.col("place")).alias("rnk"))


def phrase_hits(sentences: DataFrame, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """The longest phrase (phrase, len) at each place of ``sentences`` (keys, words); places from 0.

    N-grams as long as the longest phrase meet the phrases by equality. They are many more than their file's size lets Spark expect, so they are never the side that is broadcast;
    ``phrases`` may be, by a hint, and then no n-gram is shuffled. The ``corpus`` module has a tree for many or long phrases, and for those that aren't valid everywhere."""
    longest = phrases.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    grams = sentences.select(*keys, F.explode(F.expr(f"flatten(transform(sequence(0, greatest(size(words) - 1, 0)), p -> transform(sequence(1, least({longest}, size(words) - p)), k -> named_struct('pos', p, 'gram', array_join(slice(words, p + 1, k), ' '), 'k', k))))")).alias("g")).select(*keys, "g.*")
    hits = grams.hint("merge").join(phrases, F.col("gram") == F.col("phrase"))
    best = Window.partitionBy(*keys, "pos").orderBy(F.desc("k"))
    return hits.withColumn("__n", F.row_number().over(best)).filter("__n = 1").select(*keys, "pos", "phrase", F.col("k").alias("len"))


def greedy(sentences: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """``sentences`` walked from the left: at each place the longest phrase is taken, else one word; (keys, n_tokens, n_phrases).

    The phrases' places are found by joins; the walk is a fold over each sentence's hits in order."""
    places = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "len"))).alias("at"))
    walked = F.expr("aggregate(coalesce(at, array()), named_struct('end', 0, 'n', 0, 'words', 0), (s, x) -> if(x.pos >= s.end, named_struct('end', x.pos + x.len, 'n', s.n + 1, 'words', s.words + x.len), s))")
    sizes = sentences.select(*keys, F.size("words").alias("size"))
    df = sizes.join(places.hint("merge"), keys, "left").withColumn("walk", walked)
    return df.select(*keys, (F.col("size") - F.col("walk.words") + F.col("walk.n")).cast("bigint").alias("n_tokens"), F.col("walk.n").cast("bigint").alias("n_phrases"))


def mapped_counts(tokens: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts per entry of tokens (lemma_id, writing, folded) through ``mapping`` (lemma_id, kind, writing, entry_id).

    ``one`` and ``star`` count all targets; ``writing`` counts those of the written form, or else of the folded one. Equal tokens are counted before they meet the mapping."""
    m = mapping.select(F.col("lemma_id"), "kind", F.col("writing").alias("as"), "entry_id")
    kind = ["lemma_id", "writing", "folded"]
    found = tokens.groupBy(*kind).agg(F.count("*").alias("n")).join(m, "lemma_id")
    found = found.withColumn("form", F.when(F.col("kind").isin("one", "star"), 0).when(F.col("as") == F.col("writing"), 0).when(F.col("as") == F.col("folded"), 1)).filter("form is not null")
    first = F.rank().over(Window.partitionBy(*kind).orderBy("form"))
    return found.withColumn("r", first).filter("r = 1").groupBy("entry_id").agg(F.sum("n").alias("n"))


def phrase_table(parses: DataFrame, known: DataFrame) -> DataFrame:
    """(phrase, entry_id) of entries' parses (entry_id, words) of two words or more, for entries that aren't in ``known`` (entry_id)."""
    some = parses.filter(F.size("words") > 1).join(known, "entry_id", "left_anti")
    return some.select(F.array_join("words", " ").alias("phrase"), "entry_id").distinct()


def ranks_of(words: DataFrame, ranks: DataFrame, key: str = "w") -> DataFrame:
    """``words`` with their ``rnk``, null for unknown ones, and ``order``, for which unknown words come behind all known ones."""
    size = ranks.agg(F.count("*").alias("size")).scalar()
    return words.join(ranks.select(key, "rnk"), key, "left").withColumn("order", F.coalesce("rnk", size))


def name_counts(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(entry_id, n): how often the proper nouns among tokens (surface, pos) stand for a name of ``names`` (key, entry_id)."""
    counts = tokens.filter("pos = 'proper'").groupBy("surface").agg(F.count("*").alias("n"))
    return counts.join(names.select("key", "entry_id").distinct(), F.col("surface") == F.col("key")).groupBy("entry_id").agg(F.sum("n").alias("n"))
