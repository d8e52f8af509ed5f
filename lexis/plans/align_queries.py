"""Queries on alignment and counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from lexis.operators import alignment, frequency, lookup
from lexis.plans.registry import inline, query, table, values


@query("SELECT w, min(doc_id) AS doc_id FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS w FROM documents) WHERE w <> '' GROUP BY w HAVING count(DISTINCT doc_id) = 1")
def unique_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that one document alone has."""
    return alignment.unique_links(lookup.tokens(table(spark, sf_dir, "documents").select("doc_id", "text")), "w", "doc_id")


@query("""WITH e AS (SELECT DISTINCT c_custkey, c_nationkey FROM customer UNION SELECT o_custkey, o_orderkey % 40 FROM orders), d AS (SELECT c_nationkey, count(*) AS d FROM e GROUP BY 1)
SELECT c_custkey, CASE WHEN count(*) = 1 THEN 'one' WHEN max(d) = 1 THEN 'star' ELSE 'ambiguous' END AS kind, count(*) AS n FROM e JOIN d USING (c_nationkey) GROUP BY c_custkey""")
def mapping_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("c_nationkey"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 40).alias("c_nationkey"))
    return alignment.link_classes(some.union(orders), "c_custkey", "c_nationkey")


@query("""WITH e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), d AS (SELECT l_suppkey, count(*) AS d FROM e GROUP BY 1)
SELECT l_partkey, CASE WHEN count(*) = 1 THEN 'one' WHEN max(d) = 1 THEN 'star' ELSE 'ambiguous' END AS kind, count(*) AS n FROM e JOIN d USING (l_suppkey) GROUP BY l_partkey""")
def mapping_classes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of lineitem."""
    return alignment.link_classes(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("""WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, l_returnflag AS t FROM lineitem)
SELECT a, b FROM (SELECT a, b, count(DISTINCT t) AS h FROM e GROUP BY a, b) JOIN (SELECT a, count(DISTINCT t) AS n FROM e GROUP BY a) USING (a) WHERE h = n""")
def cover_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("text"))
    return alignment.single_covers(links, "a", "b")


@query("SELECT o_orderstatus, o_orderpriority, min(o_orderkey) AS witness FROM orders GROUP BY o_orderstatus, o_orderpriority")
def pair_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.witnesses(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey")


_DISTINCT = "SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS w FROM %s) WHERE w <> ''"


@query(f"""WITH i AS (SELECT left(w, 5) AS s, min(CAST('0x' || substr(md5(w), 1, 12) AS BIGINT)) AS target FROM ({_DISTINCT % 'documents'}) GROUP BY 1 HAVING count(*) = 1)
SELECT w, target FROM ({_DISTINCT % 'benchmark'}) JOIN i ON left(w, 5) = s WHERE w NOT IN ({_DISTINCT % 'conversations'})""")
def anti_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark that no conversation has get the documents' one word that begins like them."""
    words = lambda name: lookup.tokens(table(spark, sf_dir, name).select("text")).distinct()
    index = words("documents").select(F.left("w", F.lit(5)).alias("surface"), lookup.entry_id("w").alias("target"))
    return alignment.rescued(words("benchmark").withColumn("begin", F.left("w", F.lit(5))), words("conversations"), "w", "begin", index)


@query("""WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, l_returnflag || l_linestatus AS t FROM lineitem), c AS (SELECT a, b FROM (SELECT a, b, count(DISTINCT t) AS h FROM e GROUP BY a, b) JOIN (SELECT a, count(DISTINCT t) AS n FROM e GROUP BY a) USING (a) WHERE h = n),
k AS (SELECT a, min(b) AS keep FROM c GROUP BY a HAVING count(*) = 1)
SELECT e.a, b, t AS text FROM e LEFT JOIN k ON e.a = k.a WHERE keep IS NULL OR keep = b""")
def cover_prune_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round over the links of lineitem: a part that one supplier alone covers keeps only that one."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.concat("l_returnflag", "l_linestatus").alias("text")).distinct()
    return alignment.pruned_once(links, "a", "b")


_TOKENS = "(SELECT w FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS w FROM documents) WHERE w <> '')"


@query(f"SELECT w, count(*) AS n FROM {_TOKENS} GROUP BY w")
def token_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.frequencies(lookup.tokens(table(spark, sf_dir, "documents").select("text")))


@query(f"SELECT w, n, row_number() OVER (ORDER BY n DESC, w) - 1 AS rnk FROM (SELECT w, count(*) AS n FROM {_TOKENS} GROUP BY w) WHERE n >= 7")
def freq_rank_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.ranked(frequency.frequencies(lookup.tokens(table(spark, sf_dir, "documents").select("text"))))


PHRASES = [("of the",), ("the", ), ("in the", ), ("how do", ), ("do i", ), ("how do i",), ("and the",), ("thank you",)]
_SENT = "SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda w: w <> '') AS words FROM conversations WHERE text IS NOT NULL"
_HITS = f"""s AS ({_SENT}), ph(phrase) AS (VALUES {values(PHRASES)}),
g AS (SELECT conv_id, turn, p - 1 AS pos, k, array_to_string(words[p:p + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, least(3, len(words) - p + 1) + 1)) AS k FROM (SELECT *, unnest(range(1, len(words) + 1)) AS p FROM s))),
h AS (SELECT conv_id, turn, pos, gram AS phrase, k AS len FROM g JOIN ph ON gram = phrase QUALIFY row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY k DESC) = 1)"""


def _phrases(spark: SparkSession) -> DataFrame:
    """The few phrases; Spark knows no size of rows made in Python, so it must be told that they are the small side."""
    return F.broadcast(inline(spark, PHRASES, "phrase string"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("text is not null")
    return rows.select("conv_id", "turn", F.expr(r"filter(split(lower(text), '[^\\p{L}]+'), w -> w <> '')").alias("words"))


@query(f"WITH {_HITS} SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, phrase FROM h")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = frequency.phrase_hits(_sentences(spark, sf_dir), _phrases(spark), ["conv_id", "turn"])
    return hits.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "phrase")


@query(f"""WITH RECURSIVE {_HITS}, walk(conv_id, turn, pos, n, ph, size) AS (SELECT conv_id, turn, 0, 0, 0, len(words) FROM s UNION ALL
 SELECT w.conv_id, w.turn, w.pos + coalesce(h.len, 1), w.n + 1, w.ph + CASE WHEN h.len IS NULL THEN 0 ELSE 1 END, w.size FROM walk w LEFT JOIN h ON h.conv_id = w.conv_id AND h.turn = w.turn AND h.pos = w.pos WHERE w.pos < w.size)
SELECT conv_id, turn, CAST(n AS BIGINT) AS n_tokens, CAST(ph AS BIGINT) AS n_phrases FROM walk WHERE pos = size""")
def greedy_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = _sentences(spark, sf_dir), ["conv_id", "turn"]
    return frequency.greedy(rows, frequency.phrase_hits(rows, _phrases(spark), keys), keys)


@query("""SELECT DISTINCT array_to_string(w, ' ') AS phrase, p_partkey AS entry_id FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) WHERE len(w) > 1 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    parses = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), F.split("p_name", " ").alias("words"))
    known = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("entry_id"))
    return frequency.phrase_table(parses, known)


@query("SELECT doc_id FROM documents WHERE doc_id % 100 = 0")
def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic sample of sentences: the sampling operator itself."""
    return table(spark, sf_dir, "documents").filter("doc_id % 100 = 0").select("doc_id")


@query("""WITH o AS (SELECT DISTINCT o_custkey FROM orders) SELECT count(o_custkey) AS mapped, count(*) FILTER (WHERE o_custkey IS NULL AND c_acctbal > 0) AS unmapped_common FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("m")).distinct()
    return table(spark, sf_dir, "customer").join(mapped, "c_custkey", "left").agg(F.count("m").alias("mapped"), F.count_if(F.col("m").isNull() & (F.col("c_acctbal") > 0)).alias("unmapped_common"))


@query("""WITH t AS (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS w FROM documents), n AS (SELECT w, count(*) AS n FROM t WHERE w <> '' GROUP BY w HAVING count(*) >= 7),
r AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) - 1 AS rnk FROM n), b AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS w FROM benchmark)
SELECT b.w, CAST(rnk AS BIGINT) AS rnk, CAST(coalesce(rnk, (SELECT count(*) FROM r)) AS BIGINT) AS "order" FROM b LEFT JOIN r ON b.w = r.w WHERE b.w <> ''""")
def rank_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the benchmark's words by frequency in the documents."""
    ranks = frequency.ranked(frequency.frequencies(lookup.tokens(table(spark, sf_dir, "documents").select("text"))))
    words = lookup.tokens(table(spark, sf_dir, "benchmark").select("text")).distinct()
    return frequency.ranks_of(words, ranks).select("w", F.col("rnk").cast("bigint").alias("rnk"), F.col("order").cast("bigint").alias("order"))
