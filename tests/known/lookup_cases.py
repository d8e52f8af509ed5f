"""Hand-made rows for prefixes, rules, look-up, ranking, materialisation and review lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from lexis.operators import inflection, lookup
from known.cases import case
from lexis.plans.registry import inline, values

JAPANESE = inflection.japanese_rules()
INFLECTED = [("こき使われて",), ("食べさせられた",), ("行きませんでした",), ("高くない",), ("かけられて",), ("話せば",), ("飲んだり",), ("しなかった",)]
KANA_WORDS = [("使う", 0x8000), ("かける", 4), ("食べる", 4), ("高い", 2), ("話す", 0x1000), ("飲む", 0x200000), ("する", 0x400), ("かけ", 0), ("高", 0)]
RULE_COLUMNS = "(suffix, new_suffix, source_mask, target_mask, reason, rule_rank)"


@case(f"""WITH RECURSIVE rules{RULE_COLUMNS} AS (VALUES {values(JAPANESE)}), inp(w) AS (VALUES {values(INFLECTED)}),
clo(w, word, mask, depth, path, reasons) AS (SELECT w, w, 2147483647, 0, CAST([] AS INTEGER[]), '' FROM inp UNION ALL
  SELECT c.w, left(c.word, length(c.word) - length(r.suffix)) || r.new_suffix, r.target_mask, c.depth + 1, list_append(c.path, r.rule_rank), CASE WHEN c.reasons = '' THEN r.reason ELSE c.reasons || ',' || r.reason END
  FROM clo c JOIN rules r ON ends_with(c.word, r.suffix) AND (c.mask & r.source_mask) <> 0)
SELECT w, word AS cand, reasons, CAST(depth AS BIGINT) AS depth, CAST(row_number() OVER (PARTITION BY w ORDER BY depth, path) AS BIGINT) AS place FROM clo WHERE depth > 0""")
def suffix_rule_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    found = inflection.closure(inline(spark, INFLECTED, "w string"), JAPANESE)
    place = F.row_number().over(Window.partitionBy("w").orderBy("depth", "path"))
    return found.select("w", F.col("word").alias("cand"), "reasons", F.col("depth").cast("bigint").alias("depth"), place.cast("bigint").alias("place"))


@case(f"""WITH RECURSIVE rules{RULE_COLUMNS} AS (VALUES {values(JAPANESE)}), inp(w) AS (VALUES {values(INFLECTED)}), voc(key, pos_mask) AS (VALUES {values(KANA_WORDS)}),
pre AS (SELECT w, n, left(w, n) AS prefix FROM (SELECT w, unnest(range(1, length(w) + 1)) AS n FROM inp)),
clo(w, word, mask, depth, reasons) AS (SELECT DISTINCT prefix, prefix, 2147483647, 0, '' FROM pre UNION ALL
  SELECT c.w, left(c.word, length(c.word) - length(r.suffix)) || r.new_suffix, r.target_mask, c.depth + 1, CASE WHEN c.reasons = '' THEN r.reason ELSE c.reasons || ',' || r.reason END
  FROM clo c JOIN rules r ON ends_with(c.word, r.suffix) AND (c.mask & r.source_mask) <> 0)
SELECT pre.w, key, reasons, CAST(n AS BIGINT) AS match_len FROM pre JOIN clo ON clo.w = prefix AND depth > 0 JOIN voc ON word = key AND (mask & pos_mask) <> 0""")
def lookup_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = inline(spark, KANA_WORDS, "key string, pos_mask int").withColumn("entry_id", F.lit(0).cast("bigint"))
    hits = lookup.derived_hits(inline(spark, INFLECTED, "w string"), index, JAPANESE)
    return hits.select("w", "key", "reasons", F.col("match_len").cast("bigint").alias("match_len"))


#: By hand: input, entry, its part of speech, the reasons and the length of the longest match.
KNOWN = [
    ("食べさせられた", "食べる", 4, "past,potential or passive,causative", 7), ("高くなかった", "高い", 2, "past,negative", 6), ("話せば", "話す", 0x1000, "-ba", 3), ("飲んだり", "飲む", 0x200000, "-tari", 4),
    ("こなかった", "くる", 0x10, "past,negative", 5), ("せん", "する", 0x400, "casual negative", 2), ("できた", "する", 0x400, "past,potential", 3), ("行かれた", "行く", 0x200, "past,passive", 4), ("行ったら", "行く", 0x200, "-tara", 4),
]


@case(f"SELECT w, key, reasons, CAST(match_len AS BIGINT) AS match_len FROM (VALUES {values([(a, b, d, e) for a, b, _, d, e in KNOWN])}) t(w, key, reasons, match_len)")
def lookup_japanese_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of known inflected words."""
    index = inline(spark, sorted({x[1:3] for x in KNOWN}), "key string, pos_mask int").withColumn("entry_id", lookup.entry_id("key"))
    won = lookup.first_wins(lookup.derived_hits(inline(spark, [x[:1] for x in KNOWN], "w string"), index, JAPANESE))
    return won.select("w", "key", "reasons", F.col("match_len").cast("bigint").alias("match_len"))


ENDINGS = ("できる", "せん", "せぬ", "さす", "しうる", "でしたら", "ましたり", "これる", "ありません", "かせる", "ったら", "らない", "れば", "来れる", "い", "れ")
#: By hand: all rules of these endings, with what a word must be and what it becomes.
RULES_OF_ENDINGS = [
    ("できる", "する", "v1", "vs-i", "potential"), ("せん", "する", "raw", "vs-i|vs-s", "casual negative"), ("せぬ", "する", "v5s", "vs-i|vs-s", "archaic negative"),
    ("さす", "る", "v5s", "v1|v1-s|vk", "informal causative"), ("さす", "す", "v5s", "v5s", "informal causative"), ("さす", "する", "v5s", "vs-i|vs-s", "informal causative"),
    ("しうる", "する", "v5r", "vs-s", "potential"), ("でしたら", "です", "raw", "desu", "-tara"), ("ましたり", "ます", "raw", "masu", "-tari"), ("これる", "くる", "v1|v1-s", "vk", "potential"),
    ("ありません", "ない", "raw", "adj-i", "polite"), ("かせる", "く", "v1|v1-s", "v5k|v5k-s", "causative"),
    ("ったら", "く", "raw", "v5k-s", "-tara"), ("ったら", "う", "raw", "v5u", "-tara"), ("ったら", "つ", "raw", "v5t", "-tara"), ("ったら", "る", "raw", "v5r|v5r-i|v5aru", "-tara"),
    ("らない", "る", "adj-i", "v5r|v5aru", "negative"), ("れば", "る", "raw", "v1|v1-s|vk|vs-i|vs-s|v5r|v5r-i|v5aru", "-ba"), ("来れる", "来る", "v1|v1-s", "vk", "potential"),
    ("い", "る", "raw", "vk", "imperative"), ("い", "いる", "raw", "v1|v1-s", "masu stem"), ("い", "う", "raw", "v5u|v5u-s|v5aru", "masu stem"),
    ("れ", "る", "raw", "v5r|v5r-i|v5aru", "imperative"), ("れ", "れる", "raw", "v1-s", "imperative"), ("れ", "れる", "raw", "v1|v1-s", "masu stem"),
]


@case(f"SELECT * FROM (VALUES {values(RULES_OF_ENDINGS)}) t(suffix, new_suffix, source, target, reason)")
def rules_of_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(b).alias("b")) for n, b in inflection.BIT.items()))
    named = lambda c: F.expr(f"array_join(transform(filter(array_sort(transform(names, x -> named_struct('place', x.b, 'n', x.n, 'b', x.b))), x -> (x.b & {c}) <> 0), x -> x.n), '|')")
    rules = inflection.rule_table(spark, JAPANESE).filter(F.col("suffix").isin(*ENDINGS)).withColumn("names", names)
    return rules.select("suffix", "new_suffix", named("source_mask").alias("source"), named("target_mask").alias("target"), "reason")
