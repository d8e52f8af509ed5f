"""Building steps on dictionary entries: masks, keys, coalescing of names, offsets and length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mask_of(rows: DataFrame, by: str, bit: Column) -> DataFrame:
    """OR of the bits of each group."""
    return rows.groupBy(by).agg(F.bit_or(bit).alias("mask"))


def keys_of(rows: DataFrame, entry: str, text: str) -> DataFrame:
    """Flat index (key, entry_id): distinct words of letters of each entry's text."""
    return rows.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("key"), F.col(entry).alias("entry_id")).filter("key <> ''").distinct()


def coalesced(rows: DataFrame, by: list[str], member: str, order: str) -> DataFrame:
    """Names that agree in ``by`` become one: its first name, its size, and all names in order."""
    members = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(member).alias("m"))))
    return rows.groupBy(*by).agg(members.alias("__m")).select(*by, F.size("__m").cast("bigint").alias("n"), F.col("__m")[0]["m"].alias("first_name"), F.expr("array_join(transform(__m, x -> x.m), ',')").alias("members"))


def offsets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Byte offset of each line in the file that holds the texts in order of ``key``, a newline behind each.

    Sums of ranges of keys come first, so the running sum over all rows is never one task's: ranges are numbered by Spark's range
    partitioning, each is summed, and the ranges' starts are added."""
    from pyspark.sql.functions import spark_partition_id

    dealt = rows.select(F.col(key).alias("k"), (F.octet_length(text) + 1).cast("bigint").alias("n")).repartitionByRange("k").withColumn("part", spark_partition_id())
    sums = dealt.groupBy("part").agg(F.sum("n").alias("all"))
    starts = sums.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("own", own).join(starts, "part").select(F.col("k").alias(key), (F.col("own") + F.col("start")).alias("byte_offset"))


def length_stats(rows: DataFrame, text: str) -> DataFrame:
    """Least, greatest, mean and upper median of the texts' lengths.

    The median comes from a histogram of lengths, so no task holds all rows."""
    sizes = rows.filter(F.col(text).isNotNull()).groupBy(F.length(text).cast("bigint").alias("len")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("len"))
    ranked = sizes.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.agg(F.min("len").alias("min_len"), F.max("len").alias("max_len"), (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("mean_len"), F.min(F.when(F.col("upto") > F.expr("all div 2"), F.col("len"))).alias("upper_median"))


# Codes of the names' types.
TYPE_CODES = {"place": "a", "company": "c", "product": "d", "fem": "f", "given": "g", "masc": "m", "surname": "n", "organization": "o", "person": "p", "station": "s", "unclass": "u", "work": "w"}


def _codes(types: str) -> str:
    codes = ", ".join(f"'{k}', '{v}'" for k, v in TYPE_CODES.items())
    return f"transform({types}, x -> coalesce(try_element_at(map({codes}), x), x))"


def _redundant(glosses: str, readings: str) -> str:
    from lexis.functions.kana import KEY_STEP, folded_sql
    from lexis.functions.romaji import romanisation_sql

    return f"(size({glosses}) = 1 and size({readings}) = 1 and coalesce({romanisation_sql(folded_sql(f'{readings}[0]', KEY_STEP), f'{glosses}[0]')}, false))"


def translation_text(names: DataFrame) -> DataFrame:
    """``names`` (types, glosses, readings: arrays of strings) with ``text``: the types' codes and, behind a semicolon, the glosses.

    The one gloss of a name with one reading is left out if it merely romanises the reading. Types without a code stay as they are."""
    types = f"array_join({_codes('types')}, ',')"
    return names.withColumn("text", F.expr(f"if({_redundant('glosses', 'readings')}, {types}, concat({types}, ';', array_join(glosses, '; ')))"))


def sense_sql(only_kanjis: str, only_readings: str, info: str, glosses: str) -> str:
    only = f"concat(coalesce({only_kanjis}, array()), coalesce({only_readings}, array()))"
    parts = f"if(size({only}) > 0, concat('(only ', array_join({only}, ','), ')'), null), if({info} <> '', concat('(', {info}, ')'), null), array_join(coalesce({glosses}, array()), '; ')"
    return f"concat_ws(' ', {parts})"


def sense_text(senses: DataFrame) -> DataFrame:
    """``senses`` (only_kanjis, only_readings, info, glosses) with ``text``: what the sense is restricted to, its note, and its glosses.

    The restrictions are the kanjis' and readings' texts, null or empty for none."""
    return senses.withColumn("text", F.expr(sense_sql("only_kanjis", "only_readings", "info", "glosses")))


def kana_readings(entries: DataFrame) -> DataFrame:
    """(entry_id, reading) of readings (entry_id, reading, uk, restriction) that some sense says are usually written in kana; a sense without a restriction holds for all readings."""
    return entries.filter(F.col("uk") & (F.col("restriction").isNull() | F.array_contains("restriction", F.col("reading")))).select("entry_id", "reading").distinct()


def bounds(rows: DataFrame, key: str, text: str) -> DataFrame:
    """What a fixed-size reader must know of a table: its least key and its longest line."""
    return rows.agg(F.min(key).alias("min_id"), F.max(F.octet_length(text)).cast("bigint").alias("max_line"))
