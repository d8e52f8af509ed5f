"""Queries on dictionary entries: codec, keys, masks, names, offsets, filters and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from lexis.operators import entries
from lexis.plans.registry import query, table


@query("SELECT DISTINCT w AS key, p_partkey AS entry_id FROM (SELECT p_partkey, unnest(string_split_regex(lower(p_name), '[^\\p{L}]+')) AS w FROM part) WHERE w <> ''")
def key_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.keys_of(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query("SELECT l_orderkey, CAST(bit_or(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END | CASE l_linestatus WHEN 'F' THEN 8 ELSE 16 END) AS BIGINT) AS mask FROM lineitem GROUP BY l_orderkey")
def pos_mask_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = F.expr("cast(case l_returnflag when 'A' then 1 when 'N' then 2 else 4 end | case l_linestatus when 'F' then 8 else 16 end as bigint)")
    return entries.mask_of(table(spark, sf_dir, "lineitem"), "l_orderkey", bit)


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, arg_min(c_name, c_custkey) AS first_name, string_agg(c_name, ',' ORDER BY c_custkey) AS members FROM customer GROUP BY c_mktsegment, c_nationkey")
def name_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.coalesced(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], "c_name", "c_custkey")


@query("SELECT p_partkey, CAST(coalesce(sum(strlen(p_name) + 1) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM part")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.offsets(table(spark, sf_dir, "part"), "p_partkey", "p_name")


@query("SELECT min(n) AS min_len, max(n) AS max_len, CAST(sum(n) AS DOUBLE) / count(*) AS mean_len, (SELECT n FROM (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) - 1 AS r FROM documents WHERE text IS NOT NULL) WHERE r = (SELECT count(text) // 2 FROM documents)) AS upper_median FROM (SELECT length(text) AS n FROM documents WHERE text IS NOT NULL)")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.length_stats(table(spark, sf_dir, "documents"), "text")


@query("SELECT min(p_partkey) AS min_id, CAST(max(strlen(p_name)) AS BIGINT) AS max_line FROM part")
def table_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.bounds(table(spark, sf_dir, "part"), "p_partkey", "p_name")
