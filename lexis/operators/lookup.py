"""Dictionary look-up: every entry that matches some beginning of an input, directly or through rules; ranked and capped.

All steps are joins on equality and windows over one input's few hits. Inputs are made distinct before beginnings and
candidates are derived, and entries' contents are joined only to what is left after ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexis.functions.kana import QUERY_STEP, folded_with_map
from lexis.operators.inflection import closure
from lexis.steps import Steps

LIMIT = 32
LONGEST_INPUT = 31


def tokens(texts: DataFrame, column: str = "text") -> DataFrame:
    """Words of letters in lower case, one row each, as ``w``; the other columns stay."""
    split = F.explode(F.split(F.lower(F.col(column)), r"[^\p{L}]+")).alias("w")
    return texts.select(*(c for c in texts.columns if c != column), split).filter("w <> ''")


def entry_id(column: str):
    """A key's number: 48 bits of its digest, so that no global numbering is needed."""
    return F.conv(F.substring(F.md5(F.col(column)), 1, 12), 16, 10).cast("bigint")


def prefixes(inputs: DataFrame, longest: int = LONGEST_INPUT) -> DataFrame:
    """``inputs`` (w) with every beginning and its length, the longest first."""
    n = F.explode(F.sequence(F.least(F.length("w"), F.lit(longest)), F.lit(1), F.lit(-1)))
    return inputs.filter("w <> ''").withColumn("n", n).withColumn("prefix", F.expr("left(w, n)"))


def direct_hits(inputs: DataFrame, index: DataFrame, is_name: bool, longest: int = LONGEST_INPUT) -> DataFrame:
    """Hits of beginnings in ``index`` (key, entry_id, pos_mask): no rule, no gate."""
    found = prefixes(inputs, longest).join(index, F.col("prefix") == F.col("key"))
    return found.select("w", "entry_id", F.col("n").alias("match_len"), F.lit(is_name).alias("is_name"), F.lit("").alias("reasons"), F.lit(0).alias("depth"), F.expr("cast(array() as array<int>)").alias("path"), "key")


def derived_hits(inputs: DataFrame, index: DataFrame, rules: list[tuple], depth: int | None = None, kept: Steps | None = None, direct: bool = False, longest: int = LONGEST_INPUT) -> DataFrame:
    """Hits of what rules make of beginnings; an entry must share a part of speech with the candidate. Beginnings are made distinct first.

    Chains of rules go on to their end, or to ``depth`` steps if it is given. With ``direct``, the beginnings' own hits are there too, as
    those of no step, so the index is joined once."""
    begins = prefixes(inputs, longest)
    distinct = begins.select(F.col("prefix").alias("w")).distinct()
    candidates = closure(distinct, rules, depth, kept)
    if direct:
        candidates = candidates.unionByName(distinct.select("w", F.col("w").alias("word"), F.lit(0).alias("mask"), F.lit(0).alias("depth"), F.expr("cast(array() as array<int>)").alias("path"), F.lit("").alias("reasons")))
    hits = candidates.join(index, candidates["word"] == index["key"]).filter((F.col("mask") == 0) | (F.col("mask").bitwiseAND(F.col("pos_mask")) != 0))
    hits = hits.select(F.col("w").alias("prefix"), "entry_id", "reasons", "depth", "path", "key")
    return begins.join(hits, "prefix").select("w", "entry_id", F.col("n").alias("match_len"), F.lit(False).alias("is_name"), "reasons", "depth", "path", "key")


def first_wins(hits: DataFrame) -> DataFrame:
    """One hit for each input and entry: the longest match, then the first found."""
    order = Window.partitionBy("w", "is_name", "entry_id").orderBy(F.desc("match_len"), "depth", "path", "key")
    return hits.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def ranked(hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """At most ``limit`` hits of each input: long matches first, words before names, long chains of rules before short ones."""
    order = Window.partitionBy("w").orderBy(F.desc("match_len"), "is_name", F.desc(F.octet_length("reasons")), "entry_id")
    return hits.withColumn("rnk", F.row_number().over(order)).filter(F.col("rnk") <= limit)


def materialised(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Contents of ``entries`` (entry_id, is_name, ...) for ranked hits."""
    return hits.join(entries, ["entry_id", "is_name"])


def lookup(inputs: DataFrame, words: DataFrame, names: DataFrame | None, rules: list[tuple], depth: int | None = None, limit: int = LIMIT, kept: Steps | None = None, longest: int = LONGEST_INPUT) -> DataFrame:
    """Ranked hits of distinct inputs (w) in words, through rules, and in names."""
    inputs = inputs.select("w").distinct()
    hits = derived_hits(inputs, words, rules, depth, kept, direct=True, longest=longest)
    if names is not None:
        hits = hits.unionByName(direct_hits(inputs, names, True, longest))
    return ranked(first_wins(hits), limit)


def sources(texts: DataFrame, column: str = "text", step: str = QUERY_STEP) -> DataFrame:
    """(text, w, units, chars) of the distinct texts: what is looked up, and for each length of its beginnings how much of the source it took, in UTF-16 units and in characters."""
    distinct = texts.select(F.col(column).alias("text")).filter("text <> ''").distinct()
    both = distinct.withColumn("u", folded_with_map("text", step)).withColumn("c", folded_with_map("text", step, "1"))
    return both.select("text", F.col("u.s").alias("w"), F.col("u.map").alias("units"), F.col("c.map").alias("chars"))


def located(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """``hits`` of folded texts (w, match_len, ...) for each source text, with ``match_units``, the match's length in the source's UTF-16 units, ``match_chars``, the same in characters, and
    ``matched``, the part of the source that was found."""
    rows = sources.join(hits, "w").withColumn("match_units", F.expr("units[match_len]")).withColumn("match_chars", F.expr("chars[match_len]"))
    return rows.withColumn("matched", F.expr("left(text, match_chars)")).drop("units", "chars")
