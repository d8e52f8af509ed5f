"""Queries on dictionaries whose entries are made of the parts: XML, lines, index, texts and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.functions import codec
from lexis.operators import build, entries, render
from lexis.plans import lookup_queries
from lexis.plans.registry import dealt, query, table
from lexis.sources import xml_entries as xml


def elements(parts: DataFrame) -> DataFrame:
    """Entry elements (xml) of parts: the brand is a writing, the name's words are readings, type and size are senses; every seventh part is a name."""
    word = "concat('<r_ele><reb>', x, '</reb>', if(i = 1 and p_size % 2 = 0, '<re_nokanji/>', ''), if(i = 0 and p_size > 25, '<re_pri>ichi1</re_pri>', ''), '</r_ele>')"
    readings = f"array_join(transform(split(p_name, ' '), (x, i) -> {word}), '')"
    senses = "concat('<sense><pos>&', if(p_size % 3 = 0, 'v1', 'n'), ';</pos><gloss>', p_type, '</gloss></sense><sense>', if(p_size % 5 = 0, '<misc>&arch;</misc>', ''), '<gloss>size ', p_size, '</gloss></sense>')"
    names = "concat('<trans><name_type>&', if(p_size % 2 = 0, 'company', 'product'), ';</name_type><trans_det>', p_type, '</trans_det></trans>')"
    return parts.select(F.expr(f"concat('<entry><ent_seq>', p_partkey, '</ent_seq><k_ele><keb>', translate(p_brand, '#', '-'), '</keb></k_ele>', {readings}, if(p_partkey % 7 = 0, {names}, {senses}), '</entry>')").alias("xml"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml.parsed(elements(dealt(table(spark, sf_dir, "part"))))


@query("""SELECT p_partkey AS entry_id, 1 AS n_kanji, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 2 END AS n_sense, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS n_groups, p_size > 25 AS common, FALSE AS archaic, p_partkey % 7 = 0 AS is_name FROM part""")
def xml_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry elements parsed; only one of an entry's two senses is archaic, so no entry is."""
    return xml.summary(_parsed(spark, sf_dir))


_BASE62 = f"coalesce(nullif(ltrim(array_to_string([substr('{codec.DIGITS}', CAST((p_partkey // p) % 62 + 1 AS INTEGER), 1) FOR p IN [916132832, 14776336, 238328, 3844, 62, 1]], ''), '0'), ''), '0')"
_LINES = f"""SELECT p_partkey AS entry_id, translate(p_brand, '#', '-') || CASE WHEN p_size % 2 = 0 AND len(w) > 1 THEN '#' || array_to_string(list_filter(range(len(w)), lambda i: i <> 1), ',') ELSE '' END || chr(9) ||
array_to_string([w[i + 1] || CASE WHEN p_size > 25 AND i > 0 THEN 'U' ELSE '' END FOR i IN range(len(w))], ';') || chr(9) || CASE WHEN p_size % 3 = 0 THEN 'v1' ELSE 'n' END || ';' || p_type || '`size ' || p_size || chr(9) || {_BASE62} AS line
FROM (SELECT *, string_split(p_name, ' ') AS w FROM part) WHERE p_partkey % 7 <> 0"""


@query(_LINES)
def entry_line_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' entries as lines: restricted and uncommon readings, senses, and ids in base 62."""
    return codec.encoded(build.words_of(_parsed(spark, sf_dir)))


@query("""SELECT p_partkey AS entry_id, 1::BIGINT AS n_kanji_groups, len(w) AS n_readings, CASE WHEN p_size > 25 THEN len(w) - 1 ELSE 0 END AS n_uncommon, translate(p_brand, '#', '-') AS kanji, array_to_string(w, ',') AS readings, p_type || ',size ' || p_size AS senses,
CASE WHEN p_size % 2 = 0 AND len(w) > 1 THEN array_to_string(list_filter(range(len(w)), lambda i: i <> 1), ',') END AS indices FROM (SELECT *, string_split(p_name, ' ') AS w FROM part) WHERE p_partkey % 7 <> 0""")
def entry_line_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parts' lines hold when they are read again."""
    lines = codec.encoded(build.words_of(_parsed(spark, sf_dir))).select("line")
    big = lambda e: F.expr(f"cast({e} as bigint)")
    return codec.decoded(lines).select(
        "entry_id", big("size(kanji_groups)").alias("n_kanji_groups"), big("size(readings)").alias("n_readings"), big("size(filter(readings, x -> not x.common))").alias("n_uncommon"),
        F.expr("kanji_groups[0].kanjis[0].text").alias("kanji"), F.expr("array_join(transform(readings, r -> r.text), ',')").alias("readings"), F.expr("array_join(groups[0].senses, ',')").alias("senses"), F.expr("array_join(kanji_groups[0].reading_indices, ',')").alias("indices"),
    )


def restricted(parts: DataFrame) -> DataFrame:
    """Entry elements (xml) of parts with three writings, brand, type and size; readings stand without kanji, or hold for some of the writings alone, as the size says."""
    writings = "array(translate(p_brand, '#', '-'), p_type, concat('size-', p_size))"
    only = "concat(if(i = 0 and p_size % 5 = 0, concat('<re_restr>', k[0], '</re_restr>'), ''), if(i = 0 and p_size % 3 = 0, concat('<re_restr>', k[1], '</re_restr>'), ''), if(i = 1 and p_size % 7 = 0, concat('<re_restr>', k[2], '</re_restr>'), ''))"
    readings = f"array_join(transform(split(p_name, ' '), (x, i) -> concat('<r_ele><reb>', x, '</reb>', if(i = 1 and p_size % 2 = 0, '<re_nokanji/>', ''), {only}, '</r_ele>')), '')"
    senses = "if(p_partkey % 7 = 0, '<trans><name_type>&product;</name_type><trans_det>part</trans_det></trans>', '<sense><pos>&n;</pos><gloss>part</gloss></sense>')"
    return parts.withColumn("k", F.expr(writings)).select(F.expr(f"concat('<entry><ent_seq>', p_partkey, '</ent_seq>', array_join(transform(k, x -> concat('<k_ele><keb>', x, '</keb></k_ele>')), ''), {readings}, {senses}, '</entry>')").alias("xml"))


@query("""WITH e AS (SELECT p_partkey AS entry_id, p_size, [translate(p_brand, '#', '-'), p_type, 'size-' || p_size] AS k, len(string_split(p_name, ' ')) AS n FROM part),
x AS (SELECT entry_id, i, k[i] AS k, array_to_string(list_filter(range(n), lambda j: (j <> 0 OR (p_size % 5 <> 0 AND p_size % 3 <> 0) OR (p_size % 5 = 0 AND i = 1) OR (p_size % 3 = 0 AND i = 2)) AND (j <> 1 OR (p_size % 2 <> 0 AND (p_size % 7 <> 0 OR i = 3)))), ',') AS readings FROM (SELECT *, unnest([1, 2, 3]) AS i FROM e))
SELECT entry_id, readings, string_agg(k, ',' ORDER BY i) AS kanjis FROM x GROUP BY entry_id, readings""")
def reading_restriction_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the writings of all parts' entries, words and names, the readings that each can have; writings that can have the same ones stand together."""
    parsed = xml.parsed(restricted(dealt(table(spark, sf_dir, "part"))))
    rows = build.words_of(parsed).unionByName(build.names_of(parsed)).withColumn("ix", F.expr(codec.reading_indices()))
    lists = rows.select("entry_id", "kanjis", "ix", F.explode(F.array_distinct("ix")).alias("l"))
    return lists.select("entry_id", F.array_join("l", ",").alias("readings"), F.expr("array_join(filter(transform(kanjis, (k, i) -> if(ix[i] = l, k.text, null)), k -> k is not null), ',')").alias("kanjis"))


@query("""WITH w AS (SELECT p_partkey, p_size, unnest(list_concat([translate(p_brand, '#', '-')], string_split(p_name, ' '))) AS key FROM part WHERE p_partkey % 7 <> 0)
SELECT DISTINCT key, p_partkey AS entry_id, CASE WHEN p_size % 3 = 0 THEN 4 ELSE 0 END AS pos_mask FROM w""")
def dictionary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed index of the parts' entries: keys of writings and readings, and the mask of their parts of speech."""
    return build.index_of(build.words_of(_parsed(spark, sf_dir)))


@query("""SELECT p_partkey AS entry_id, translate(p_brand, '#', '-') AS kanjis, array_to_string([w[i + 1] || CASE WHEN p_size > 25 AND i > 0 THEN 'U' ELSE '' END FOR i IN range(len(w))], ',') AS readings,
CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'c' ELSE 'd' END || ';' || p_type ELSE CASE WHEN p_size % 3 = 0 THEN 'v1' ELSE 'n' END || ';' || p_type || '`size ' || p_size END AS content FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)""")
def dictionary_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries, words and names, that are built from the parts' elements; uncommon texts are marked."""
    joined = F.expr("array_join(transform(groups, g -> concat(array_join(g.pos, ','), ';', array_join(g.senses, '`'))), '\\\\')")
    texts = [F.expr(f"array_join({codec.marked(c)}, ',')").alias(c) for c in ("kanjis", "readings")]
    parsed = _parsed(spark, sf_dir)
    return build.words_of(parsed).unionByName(build.names_of(parsed)).select("entry_id", *texts, joined.alias("content"))


@query("""SELECT p_partkey AS entry_id, concat_ws(' ', CASE WHEN p_size % 2 = 0 OR p_size % 4 = 1 THEN '(only ' || concat_ws(',', CASE WHEN p_size % 2 = 0 THEN p_brand END, CASE WHEN p_size % 4 = 1 THEN p_name END) || ')' END,
CASE WHEN p_size % 3 = 0 THEN '(' || p_type || ')' END, array_to_string(string_split(p_name, ' '), '; ')) AS text FROM part""")
def sense_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senses of the parts with restrictions, notes and glosses."""
    senses = table(spark, sf_dir, "part").selectExpr("p_partkey as entry_id", "if(p_size % 2 = 0, array(p_brand), null) as only_kanjis", "if(p_size % 4 = 1, array(p_name), array()) as only_readings", "if(p_size % 3 = 0, p_type, '') as info", "split(p_name, ' ') as glosses")
    return entries.sense_text(senses).select("entry_id", "text")


@query("SELECT DISTINCT p_partkey AS entry_id, unnest(list_filter(string_split(p_name, ' '), lambda x, i: p_size % 2 = 0 OR (p_size % 3 = 0 AND i = 1))) AS reading FROM part")
def uk_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the parts that a sense without a restriction, or with one that names them, calls usual."""
    words = table(spark, sf_dir, "part").selectExpr("p_partkey as entry_id", "explode(split(p_name, ' ')) as reading", "p_size % 2 = 0 or p_size % 3 = 0 as uk", "if(p_size % 2 = 0, null, array(split(p_name, ' ')[0])) as restriction")
    return entries.kana_readings(words)


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(lookup_queries._WITH + f""", r AS (SELECT rnk.w, rnk, '<tr' || CASE WHEN rnk > 2 THEN ' class="hidden"' ELSE '' END || '><td><span class="kana">' || {_ESC.format('e.key')} || '</span>' || CASE WHEN reasons <> '' THEN ' (' || {_ESC.format('reasons')} || ')' ELSE '' END || ' <i>' || CASE WHEN rnk.is_name THEN 'name' ELSE 'word' END || '</i> <span>' || match_len || ' &amp; ' || depth || '</span></td></tr>' AS row
FROM rnk JOIN (SELECT entry_id, key, FALSE AS is_name FROM voc UNION ALL SELECT entry_id, key, TRUE FROM nam) e ON e.entry_id = rnk.entry_id AND e.is_name = rnk.is_name)
SELECT w, '<table>' || string_agg(row, '' ORDER BY rnk) || CASE WHEN count(*) > 2 THEN '<tr class="more"></tr>' ELSE '' END || '</table>' AS html FROM r GROUP BY w""")
def render_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the ranked hits of the benchmark's words, their contents joined after ranking."""
    hits = lookup_queries.ranked_hits(spark, sf_dir).join(lookup_queries.contents(spark, sf_dir), ["entry_id", "is_name"])
    shown = hits.select("w", "rnk", F.lit("").alias("kanji"), F.col("text").alias("reading"), "reasons", F.when(F.col("is_name"), "name").otherwise("word").alias("pos"), F.array(F.expr("concat(match_len, ' & ', depth)")).alias("senses"))
    return render.rows_html(shown)
