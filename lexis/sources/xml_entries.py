"""Dictionary XML: elements with entity codes to nested entries.

Files are read as text cut at ``</entry>``, so any size is split among tasks; entity references become their short codes first,
because an XML parser would expand or refuse them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """ent_seq bigint, k_ele array<struct<keb: string, ke_inf: array<string>, ke_pri: array<string>>>,
r_ele array<struct<reb: string, re_nokanji: string, re_restr: array<string>, re_inf: array<string>, re_pri: array<string>>>,
sense array<struct<stagk: array<string>, stagr: array<string>, pos: array<string>, misc: array<string>, lsource: array<string>, dial: array<string>, s_inf: string, gloss: array<string>>>,
trans array<struct<name_type: array<string>, trans_det: array<string>>>"""
SAMPLE = (
    "<entry><ent_seq>1</ent_seq><k_ele><keb>漢字</keb><ke_pri>news1</ke_pri></k_ele><k_ele><keb>感字</keb></k_ele><r_ele><reb>かんじ</reb><re_restr>漢字</re_restr></r_ele><r_ele><reb>カンジ</reb><re_nokanji/></r_ele><sense><pos>&n;</pos><gloss>kanji</gloss></sense><sense><misc>&uk;</misc><gloss>character</gloss></sense><sense><pos>&vs;</pos><gloss>to write</gloss></sense></entry>",
    "<entry><ent_seq>2</ent_seq><r_ele><reb>いい</reb></r_ele><sense><pos>&adj-i;</pos><misc>&arch;</misc><gloss>good</gloss></sense></entry>",
    "<entry><ent_seq>3</ent_seq><k_ele><keb>田中</keb></k_ele><r_ele><reb>たなか</reb></r_ele><trans><name_type>&surname;</name_type><trans_det>Tanaka</trans_det></trans></entry>",
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The entries' elements of a (compressed) file as ``xml``."""
    cut = spark.read.option("lineSep", "</entry>").text(path)
    return cut.select(F.concat(F.regexp_extract("value", r"(?s)(<entry>.*)", 1), F.lit("</entry>")).alias("xml")).filter("xml like '<entry>%'")


def parsed(elements: DataFrame) -> DataFrame:
    """Nested entries: restrictions as places among the kanjis, senses grouped under the last stated parts of speech."""
    coded = F.regexp_replace("xml", r"&(?!(?:lt|gt|amp|quot|apos);)([A-Za-z0-9-]+);", "$1")
    # as a generator's output an element is parsed once, where its row is; a filter on what it holds would parse it again, before the rows are dealt to tasks
    e = elements.select(F.explode(F.array(F.from_xml(coded, SCHEMA, {"mode": "FAILFAST"}))).alias("e")).select("e.*")
    e = e.withColumn("sense", F.expr("coalesce(sense, array())"))
    start = "cast(array() as array<struct<pos: array<string>, senses: array<struct<misc: array<string>, stagk: array<string>, stagr: array<string>, lsource: array<string>, dial: array<string>, s_inf: string, glosses: array<string>>>>>)"
    one = "named_struct('misc', coalesce(s.misc, array()), 'stagk', coalesce(s.stagk, array()), 'stagr', coalesce(s.stagr, array()), 'lsource', coalesce(s.lsource, array()), 'dial', coalesce(s.dial, array()), 's_inf', s.s_inf, 'glosses', s.gloss)"
    grow = f"concat(slice(a, 1, size(a) - 1), array(named_struct('pos', a[size(a) - 1].pos, 'senses', concat(a[size(a) - 1].senses, array({one})))))"
    groups = f"aggregate(sense, {start}, (a, s) -> if(s.pos is null and size(a) > 0, {grow}, concat(a, array(named_struct('pos', coalesce(s.pos, array()), 'senses', array({one}))))))"
    return e.select(
        F.col("ent_seq").alias("entry_id"),
        F.expr("transform(coalesce(k_ele, array()), k -> named_struct('text', k.keb, 'inf', k.ke_inf, 'common', k.ke_pri is not null))").alias("kanjis"),
        F.expr("transform(r_ele, r -> named_struct('text', r.reb, 'nokanji', r.re_nokanji is not null, 'kanji_restriction', transform(r.re_restr, x -> cast(array_position(transform(k_ele, k -> k.keb), x) - 1 as int)), 'common', r.re_pri is not null))").alias("readings"),
        F.expr(groups).alias("sense_groups"),
        F.expr("transform(coalesce(trans, array()), t -> named_struct('types', t.name_type, 'glosses', t.trans_det))").alias("transes"),
        F.expr("trans is not null").alias("is_name"),
    )


def valid(entries: DataFrame) -> DataFrame:
    """``entries`` with ``problem``: what a reader would refuse, or null."""
    return entries.withColumn("problem", F.expr("case when entry_id is null then 'no id' when size(readings) = 0 then 'no reading' when exists(readings, r -> exists(r.kanji_restriction, x -> x < 0)) then 'restriction to an unknown text' when not is_name and size(sense_groups) = 0 then 'no sense' end"))


def summary(entries: DataFrame) -> DataFrame:
    return entries.select(
        "entry_id",
        F.size("kanjis").alias("n_kanji"),
        F.expr("aggregate(sense_groups, 0, (n, g) -> n + size(g.senses))").alias("n_sense"),
        F.size("sense_groups").alias("n_groups"),
        F.expr("exists(kanjis, k -> k.common) or exists(readings, r -> r.common)").alias("common"),
        F.expr("size(sense_groups) > 0 and forall(sense_groups, g -> forall(g.senses, s -> array_contains(s.misc, 'arch')))").alias("archaic"),
        "is_name",
    )
