"""Queries on prefixes, rules, look-up, ranking, materialisation and review lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from lexis.operators import inflection, lookup, review
from lexis.plans.registry import query, table, values
from lexis.steps import Steps

RULES = inflection.european_rules()
JAPANESE = inflection.japanese_rules()
INFLECTED = [("こき使われて",), ("食べさせられた",), ("行きませんでした",), ("高くない",), ("かけられて",), ("話せば",), ("飲んだり",), ("しなかった",)]
RULE_COLUMNS = "(suffix, new_suffix, source_mask, target_mask, reason, rule_rank)"


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.tokens(table(spark, sf_dir, "benchmark").select("text")).distinct()


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of the documents as dictionary: those of up to four letters are nouns (4), others verbs (2)."""
    keys = lookup.tokens(table(spark, sf_dir, "documents").select("text")).select(F.col("w").alias("key")).distinct()
    return keys.select("key", lookup.entry_id("key").alias("entry_id"), F.when(F.length("key") <= 4, 4).otherwise(2).alias("pos_mask"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the parts' names as a second dictionary."""
    keys = lookup.tokens(table(spark, sf_dir, "part").select(F.col("p_name").alias("text"))).select(F.col("w").alias("key")).distinct()
    return keys.select("key", lookup.entry_id("key").alias("entry_id"), F.lit(0).alias("pos_mask"))


_TOKENS = "SELECT DISTINCT unnest(string_split_regex(lower({}), '[^\\p{{L}}]+')) AS w FROM {}"
_ID = "CAST('0x' || substr(md5(key), 1, 12) AS BIGINT)"
_WITH = f"""WITH RECURSIVE rules{RULE_COLUMNS} AS (VALUES {values(RULES)}),
inp AS (SELECT w FROM ({_TOKENS.format('text', 'benchmark')}) WHERE w <> ''),
voc AS (SELECT w AS key, {_ID.replace('key', 'w')} AS entry_id, CASE WHEN length(w) <= 4 THEN 4 ELSE 2 END AS pos_mask FROM ({_TOKENS.format('text', 'documents')}) WHERE w <> ''),
nam AS (SELECT w AS key, {_ID.replace('key', 'w')} AS entry_id FROM ({_TOKENS.format('p_name', 'part')}) WHERE w <> ''),
pre AS (SELECT w, n, left(w, n) AS prefix FROM (SELECT w, unnest(range(1, least(length(w), 31) + 1)) AS n FROM inp)),
clo(w, word, mask, depth, path, reasons) AS (
  SELECT DISTINCT prefix, prefix, 2147483647, 0, CAST([] AS INTEGER[]), '' FROM pre
  UNION ALL
  SELECT c.w, left(c.word, length(c.word) - length(r.suffix)) || r.new_suffix, r.target_mask, c.depth + 1, list_append(c.path, r.rule_rank), CASE WHEN c.reasons = '' THEN r.reason ELSE c.reasons || ',' || r.reason END
  FROM clo c JOIN rules r ON ends_with(c.word, r.suffix) AND (c.mask & r.source_mask) <> 0 AND left(c.word, length(c.word) - length(r.suffix)) || r.new_suffix <> ''),
hits AS (
  SELECT w, entry_id, n AS match_len, FALSE AS is_name, '' AS reasons, 0 AS depth, CAST([] AS INTEGER[]) AS path, key FROM pre JOIN voc ON prefix = key
  UNION ALL SELECT pre.w, entry_id, n, FALSE, reasons, depth, path, key FROM pre JOIN clo ON clo.w = pre.prefix AND depth > 0 JOIN voc ON word = key AND (mask & pos_mask) <> 0
  UNION ALL SELECT w, entry_id, n, TRUE, '', 0, CAST([] AS INTEGER[]), key FROM pre JOIN nam ON prefix = key),
won AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY w, is_name, entry_id ORDER BY match_len DESC, depth, path, key) = 1),
rnk AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY match_len DESC, is_name, strlen(reasons) DESC, entry_id) AS rnk FROM won QUALIFY rnk <= 32)
"""


@query(_WITH + "SELECT w, prefix, CAST(n AS BIGINT) AS n FROM pre")
def prefix_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.prefixes(_inputs(spark, sf_dir)).select("w", "prefix", F.col("n").cast("bigint").alias("n"))


@query(_WITH + "SELECT w, arg_max(prefix, n) AS best, CAST(max(n) AS BIGINT) AS len FROM pre JOIN voc ON prefix = key AND prefix <> w GROUP BY w")
def prefix_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    begins = lookup.prefixes(_inputs(spark, sf_dir)).filter("prefix <> w")
    # the few beginnings pick their words before the vocabulary is made distinct
    tokens = lookup.tokens(table(spark, sf_dir, "documents").select("text")).select(F.col("w").alias("prefix"))
    found = begins.join(tokens.join(begins.select("prefix"), "prefix", "left_semi").distinct(), "prefix")
    return found.groupBy("w").agg(F.max_by("prefix", "n").alias("best"), F.max("n").cast("bigint").alias("len"))


@query(f"""WITH rules{RULE_COLUMNS} AS (VALUES {values(RULES)}), voc AS (SELECT w FROM ({_TOKENS.format('text', 'documents')}) WHERE w <> '')
SELECT w, left(w, length(w) - length(suffix)) || new_suffix AS cand, reason FROM voc JOIN rules ON ends_with(w, suffix) WHERE left(w, length(w) - length(suffix)) || new_suffix <> ''""")
def suffix_rule_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lookup.tokens(table(spark, sf_dir, "documents").select("text")).distinct()
    return inflection.closure(words, RULES, 1).select("w", F.col("word").alias("cand"), F.col("reasons").alias("reason"))


@query(f"""WITH RECURSIVE rules{RULE_COLUMNS} AS (VALUES {values(RULES)}), inp AS (SELECT w FROM ({_TOKENS.format('text', 'documents')}) WHERE w <> ''),
clo(w, word, mask, depth, path, reasons) AS (SELECT w, w, 2147483647, 0, CAST([] AS INTEGER[]), '' FROM inp UNION ALL
  SELECT c.w, left(c.word, length(c.word) - length(r.suffix)) || r.new_suffix, r.target_mask, c.depth + 1, list_append(c.path, r.rule_rank), CASE WHEN c.reasons = '' THEN r.reason ELSE c.reasons || ',' || r.reason END
  FROM clo c JOIN rules r ON ends_with(c.word, r.suffix) AND (c.mask & r.source_mask) <> 0 AND left(c.word, length(c.word) - length(r.suffix)) || r.new_suffix <> '')
SELECT w, word AS cand, reasons, CAST(depth AS BIGINT) AS depth, CAST(row_number() OVER (PARTITION BY w ORDER BY depth, path) AS BIGINT) AS place FROM clo WHERE depth > 0""")
def suffix_rule_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that chains of rules make of the documents' vocabulary."""
    place = F.row_number().over(Window.partitionBy("w").orderBy("depth", "path"))
    found = inflection.closure(lookup.tokens(table(spark, sf_dir, "documents").select("text")).distinct(), RULES)
    return found.select("w", F.col("word").alias("cand"), "reasons", F.col("depth").cast("bigint").alias("depth"), place.cast("bigint").alias("place"))


@query(_WITH + "SELECT w, entry_id, reasons, CAST(match_len AS BIGINT) AS match_len FROM hits WHERE depth > 0")
def lookup_pos_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lookup.derived_hits(_inputs(spark, sf_dir), _vocabulary(spark, sf_dir), RULES)
    return hits.select("w", "entry_id", "reasons", F.col("match_len").cast("bigint").alias("match_len"))


@query(_WITH + "SELECT w, entry_id, CAST(match_len AS BIGINT) AS match_len, reasons FROM won WHERE NOT is_name")
def lookup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, words = _inputs(spark, sf_dir), _vocabulary(spark, sf_dir)
    won = lookup.first_wins(lookup.derived_hits(inputs, words, RULES, direct=True))
    return won.select("w", "entry_id", F.col("match_len").cast("bigint").alias("match_len"), "reasons")


def ranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark's words, written once; the steps that led to them are deleted."""
    steps = Steps(spark)
    return steps.result(lookup.lookup(_inputs(spark, sf_dir), _vocabulary(spark, sf_dir), _names(spark, sf_dir), RULES, kept=steps))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, is_name, text) of both dictionaries."""
    words, names = _vocabulary(spark, sf_dir), _names(spark, sf_dir)
    return words.select("entry_id", F.lit(False).alias("is_name"), F.col("key").alias("text")).unionByName(names.select("entry_id", F.lit(True).alias("is_name"), F.col("key").alias("text")))


@query(_WITH + "SELECT w, CAST(rnk AS BIGINT) AS rnk, entry_id, is_name FROM rnk")
def lookup_rank_top32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_hits(spark, sf_dir).select("w", F.col("rnk").cast("bigint").alias("rnk"), "entry_id", "is_name")


@query(_WITH + "SELECT rnk.w, CAST(rnk AS BIGINT) AS rnk, e.key AS text FROM rnk JOIN (SELECT entry_id, key, FALSE AS is_name FROM voc UNION ALL SELECT entry_id, key, TRUE FROM nam) e ON e.entry_id = rnk.entry_id AND e.is_name = rnk.is_name")
def late_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ranked_hits(spark, sf_dir).select("w", "rnk", "entry_id", "is_name")
    return lookup.materialised(hits, contents(spark, sf_dir)).select("w", F.col("rnk").cast("bigint").alias("rnk"), "text")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def review_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("id"))
    return review.listed(table(spark, sf_dir, "customer"), "c_custkey", listed).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def review_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return review.unlisted(table(spark, sf_dir, "customer"), "c_custkey", listed).select("c_custkey")


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25)")
def review_anti_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that came back and are on no list of large returns."""
    lines = table(spark, sf_dir, "lineitem")
    listed = lines.filter("l_returnflag = 'R' and l_quantity > 25").select(F.col("l_partkey").alias("id"))
    returned = lines.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return review.unlisted(returned, "p_partkey", listed).select("p_partkey")


@query("""SELECT id, 'add' AS change FROM (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT id, 'remove' FROM (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def review_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ids = lambda status: orders.filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("id"))
    return review.changes(ids("O"), ids("F"))
