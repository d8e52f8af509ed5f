"""Queries that read lines, streams and parses made of the given tables, and count through a mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.operators import alignment, entries, frequency
from lexis.plans import corpus_queries as corpus
from lexis.plans.registry import query, table
from lexis.sources import text_files


@query("SELECT CASE WHEN p_size % 4 = 0 THEN '\"' ELSE p_name || ', \"' || p_type || '\"' END AS surface, p_partkey AS lemma_id, p_brand AS pos FROM part")
def csv_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon lines of the parts, whose surfaces hold commas and quotation marks, or are the mark that a file can't write."""
    surface = "if(p_size % 4 = 0, '', concat('\"', p_name, ', \\\\\"', p_type, '\\\\\"', '\"'))"
    lines = table(spark, sf_dir, "part").select(F.expr(f"concat({surface}, ',', p_partkey, ',', p_brand)").alias("value"))
    return text_files.lexicon(lines, "surface string, lemma_id bigint, pos string")


_WORDS = corpus._W.format("text")


@query(f"""WITH w AS (SELECT conv_id * 1000 + turn AS sent, p - 1 AS pos, w[p] AS surface FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS p FROM (SELECT conv_id, turn, {_WORDS} AS w FROM conversations WHERE text IS NOT NULL)))
SELECT sent, pos, surface, length(surface) > 2 AS known, CASE WHEN length(surface) > 2 THEN length(surface) * 7 END AS lemma_id FROM w""")
def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a stream of the conversations' words: long words have all fields and a lemma, short ones are unknown."""
    line = "concat(w, '\\t', if(length(w) > 2, concat(repeat('f,', 28), length(w) * 7), 'noun,1'))"
    rows = table(spark, sf_dir, "conversations").filter("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sent"), F.expr(f"array_join(transform({corpus._words('text')}, w -> {line}), '\\n')").alias("value"))
    return text_files.stream_tokens(rows.filter("value <> ''")).select("sent", "pos", "surface", "known", "lemma_id")


_TURNS = f"SELECT unnest({_WORDS}) AS w FROM conversations WHERE text IS NOT NULL"


@query(f"""WITH voc AS (SELECT lemma, writing, {corpus._SQL_ID.format('writing')} AS entry_id, count(*) OVER (PARTITION BY lemma) AS size FROM (SELECT DISTINCT {corpus._SQL_FOLD.format('w')} AS lemma, lower(w) AS writing FROM (SELECT unnest({_WORDS}) AS w FROM documents) WHERE length(w) > 1)),
t AS (SELECT {corpus._SQL_FOLD.format('w')} AS lemma, lower(w) AS writing, count(*) AS n FROM ({_TURNS}) WHERE length(w) > 1 GROUP BY 1, 2),
f AS (SELECT t.lemma, t.writing, n, entry_id, CASE WHEN size = 1 OR length(t.lemma) <= 3 OR voc.writing = t.writing THEN 0 WHEN voc.writing = t.lemma THEN 1 END AS form FROM t JOIN voc USING (lemma))
SELECT entry_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM f WHERE form IS NOT NULL QUALIFY form = min(form) OVER (PARTITION BY lemma, writing)) GROUP BY entry_id""")
def mapped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the conversations' single words stand for the documents' words."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.expr(corpus._words("text"))).alias("w")).filter("length(w) > 1")
    fold = F.expr(corpus._fold("w"))
    mapping = corpus.word_mapping(table(spark, sf_dir, "documents").select("text")).withColumnRenamed("lemma", "lemma_id")
    return frequency.mapped_counts(words.select(fold.alias("lemma_id"), F.lower("w").alias("writing"), fold.alias("folded")), mapping)


@query(f"""WITH names AS (SELECT DISTINCT w FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) WHERE w <> lower(w))
SELECT {corpus._SQL_ID.format("'name ' || lower(w)")} AS entry_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT w, count(*) AS n FROM ({_TURNS}) WHERE w <> lower(w) GROUP BY w) JOIN names USING (w) GROUP BY 1""")
def name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the conversations' capitalised words are names that the benchmark has."""
    words = lambda name: table(spark, sf_dir, name).select(F.explode(F.expr(corpus._words("text"))).alias("surface"))
    tokens = words("conversations").withColumn("pos", F.expr("if(surface <> lower(surface), 'proper', 'noun')"))
    known = words("benchmark").filter("surface <> lower(surface)").select(F.col("surface").alias("key"), F.expr("cast(conv(substring(md5(concat('name ', lower(surface))), 1, 12), 16, 10) as bigint)").alias("entry_id"))
    return frequency.name_counts(tokens, known)


@query("""SELECT l_partkey AS entry_id, CAST(min(l_linenumber) AS BIGINT) AS variant_ix FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE CASE WHEN l_quantity % 3 = 0 THEN length(p_name) > length(split_part(p_name, ' ', 1)) ELSE l_quantity % 3 = 1 END GROUP BY 1""")
def variant_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a part's lines whose pattern fits the part's name: an open end fits any, a whole name itself, a name with more behind it none."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pattern = "case when l_quantity % 3 = 0 then concat(split(p_name, ' ')[0], '?') when l_quantity % 3 = 1 then p_name else concat(p_name, 'x') end"
    return alignment.first_variants(lines.selectExpr("l_partkey as entry_id", "cast(l_linenumber as bigint) as variant_ix", f"{pattern} as pattern", "p_name as reading"))


@query("SELECT regexp_replace(l, '</?p>', '', 'g') AS value FROM (SELECT unnest(string_split(replace(html, '</p>', '</p>' || chr(10)), chr(10))) AS l FROM pages WHERE html IS NOT NULL) WHERE contains(l, '<p>')")
def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' paragraphs as the sentences of a corpus with tags."""
    lines = table(spark, sf_dir, "pages").select(F.explode(F.split(F.replace("html", F.lit("</p>"), F.lit("</p>\n")), "\n")).alias("value"))
    return text_files.corpus_sentences(lines, "p")


#: Kana that stand for the digits of a part's number in its reading, and their Latin spellings: the usual ones, and others that are as good.
_KANA, _SPELT, _OTHER = "あかさたちつまらふん", ["a", "ka", "sa", "ta", "chi", "tsu", "ma", "ra", "fu", "n"], ["a", "ka", "sa", "ta", "ti", "tu", "ma", "ra", "hu", "m"]
_DIGITS = "string_split(CAST(p_partkey AS VARCHAR), '')"


@query(f"""WITH p AS (SELECT *, array_to_string([{_SPELT}[CAST(x AS INTEGER) + 1] FOR x IN {_DIGITS}], '') AS spelt, array_to_string([{_OTHER}[CAST(x AS INTEGER) + 1] FOR x IN {_DIGITS}], '') AS other FROM part),
t AS (SELECT p_partkey AS entry_id, CASE WHEN p_size % 2 = 0 THEN 'c' ELSE 'd' END || CASE WHEN p_size % 3 = 0 THEN ',' || p_type ELSE '' END AS types,
  CASE p_partkey % 5 WHEN 0 THEN string_split(p_name, ' ') WHEN 1 THEN [spelt] WHEN 2 THEN [upper(other)] WHEN 3 THEN [spelt, p_name] ELSE [p_name] END AS glosses, spelt, other FROM p)
SELECT entry_id, CASE WHEN len(glosses) = 1 AND lower(glosses[1]) IN (spelt, other) THEN types ELSE types || ';' || array_to_string(glosses, '; ') END AS text FROM t""")
def redundant_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and glosses of the parts as names, without a gloss that merely romanises the reading, which spells the part's number in either kana."""
    spelt = lambda to: f"array_join(transform(filter(split(p_partkey, ''), x -> x <> ''), x -> array({', '.join(map(repr, to))})[cast(x as int)]), '')"
    glosses = f"case p_partkey % 5 when 0 then split(p_name, ' ') when 1 then array({spelt(_SPELT)}) when 2 then array(upper({spelt(_OTHER)})) when 3 then array({spelt(_SPELT)}, p_name) else array(p_name) end"
    reading = f"translate(p_partkey, '0123456789', if(p_size % 4 = 0, '{_KANA.translate({ord(h): ord(h) + 0x60 for h in _KANA})}', '{_KANA}'))"
    names = table(spark, sf_dir, "part").selectExpr("p_partkey as entry_id", "if(p_size % 3 = 0, array(if(p_size % 2 = 0, 'company', 'product'), p_type), array(if(p_size % 2 = 0, 'company', 'product'))) as types", f"{glosses} as glosses", f"array({reading}) as readings")
    return entries.translation_text(names).select("entry_id", "text")
