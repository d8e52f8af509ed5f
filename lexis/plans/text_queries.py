"""Queries on characters and scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from lexis.plans.registry import query, table

_CLASSES = {"n_hiragana": "[^぀-ゟ]", "n_katakana": "[^ァ-ヾ]", "n_kanji": "[^一-龥]", "n_latin": "[^a-zA-Z]"}


@query("SELECT doc_id, " + ", ".join(f"CAST(length(regexp_replace(text, '{p}', '', 'g')) AS BIGINT) AS {n}" for n, p in _CLASSES.items()) + " FROM documents")
def script_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # one search tells most texts apart from those with Japanese letters, of which each class is then counted
    japanese = F.col("text").rlike("[぀-ゟァ-ヾ一-龥]")
    count = lambda p: F.length(F.regexp_replace("text", p, "")).cast("bigint")
    return docs.select("doc_id", *((count(p) if n == "n_latin" else F.when(japanese, count(p)).when(F.col("text").isNotNull(), F.lit(0).cast("bigint"))).alias(n) for n, p in _CLASSES.items()))
