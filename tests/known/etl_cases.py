"""Hand-made rows for dictionary entries: codec, keys, masks, names, offsets, filters and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from lexis.functions import codec
from lexis.operators import entries, render
from known.cases import case
from lexis.plans.registry import inline, values
from lexis.sources import xml_entries as xml

ENTRIES = [
    (1000000, [("漢字", True), ("感じ", False)], [("かんじ", True, None, False), ("カンジ", False, [0], False)], [(["n"], ["kanji", "Chinese character"]), (["vs"], [])]),
    (1000062, [("明白", True), ("偸閑", False), ("白地", False)], [("めいはく", True, [0], False), ("あからさま", False, None, False)], [(["adj-na", "n"], ["plain; frank"])]),
    (7, [], [("いい", True, None, False), ("ええ", False, None, True)], [(["adj-i"], ["good", "fine", "nice"])]),
    (61, [("a", False), ("b", False)], [("c", False, [1], False), ("d", False, None, True)], [(["exp"], ["letters"])]),
]
LINES = [
    ("a,bU;c#3,2\tx;yU\tn,vs;s1`s2\\adj;s3\\exp\t4C92",),
    ("x\tn;one\t7",),
    ("漢字#0\tかんじ;カンジU\tn;kanji`character\tz",),
]


def _duck(v) -> str:
    """A nested fixture as DuckDB's literals."""
    if isinstance(v, dict):
        return "{" + ", ".join(f"'{k}': {_duck(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ", ".join(map(_duck, v)) + "]"
    return "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"


_NESTED = ", ".join(
    f"({i}, {_duck([{'text': t, 'common': c} for t, c in k])}{'::STRUCT(text VARCHAR, common BOOLEAN)[]' if not k else ''}, {_duck([{'text': t, 'common': c, 'restr': r, 'nokanji': n} for t, c, r, n in rd])}::STRUCT(text VARCHAR, common BOOLEAN, restr INTEGER[], nokanji BOOLEAN)[], {_duck([{'pos': p, 'senses': s} for p, s in g])}::STRUCT(pos VARCHAR[], senses VARCHAR[])[])"
    for i, k, rd, g in ENTRIES
)
_MARK = "list_transform({0}, lambda x: CASE WHEN list_bool_or(list_transform({0}, lambda y: y.common)) AND NOT x.common THEN x.text || 'U' ELSE x.text END)"


@case(f"""WITH RECURSIVE e(entry_id, kanjis, readings, groups) AS (VALUES {_NESTED}),
b(n, m, s) AS (SELECT entry_id, entry_id, '' FROM e UNION ALL SELECT n, m // 62, substr('{codec.DIGITS}', CAST(m % 62 AS INTEGER) + 1, 1) || s FROM b WHERE m > 0),
ix AS (SELECT *, list_transform(kanjis, lambda k, i: list_filter(list_transform(readings, lambda r, j: CASE WHEN NOT r.nokanji AND (r.restr IS NULL OR list_contains(r.restr, i - 1)) THEN j - 1 ELSE -1 END), lambda j: j >= 0)) AS lists, {_MARK.format('kanjis')} AS ks FROM e),
kg AS (SELECT entry_id, lists[p] AS l, min(p) AS o, string_agg(ks[p], ',' ORDER BY p) AS txt, any_value(len(readings)) AS nr FROM (SELECT *, unnest(range(1, len(kanjis) + 1)) AS p FROM ix) GROUP BY entry_id, lists[p]),
kj AS (SELECT entry_id, string_agg(txt || CASE WHEN len(l) = nr THEN '' ELSE '#' || array_to_string(l, ',') END, ';' ORDER BY o) AS k FROM kg GROUP BY entry_id)
SELECT CAST(e.entry_id AS BIGINT) AS entry_id, coalesce(kj.k || chr(9), '') || array_to_string({_MARK.format('readings')}, ';') || chr(9) || array_to_string(list_transform(groups, lambda g: array_to_string(g.pos, ',') || ';' || array_to_string(g.senses, '`')), '\\') || chr(9) || b.s AS line
FROM e LEFT JOIN kj USING (entry_id) JOIN b ON b.n = e.entry_id AND b.m = 0""")
def entry_line_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.encoded(inline(spark, ENTRIES, codec.ENTRY))


@case(f"""WITH RECURSIVE l(line) AS (VALUES {values(LINES)}), p AS (SELECT line, string_split(line, chr(9)) AS p FROM l),
q AS (SELECT line, p, p[len(p)] AS id, CASE WHEN len(p) = 4 THEN string_split(p[1], ';') ELSE [] END AS ks, string_split(p[len(p) - 2], ';') AS rs, string_split(p[len(p) - 1], '\\') AS gs FROM p)
SELECT CAST(list_reduce(list_transform(string_split(id, ''), lambda c: instr('{codec.DIGITS}', c) - 1), lambda a, x: a * 62 + x, 0) AS BIGINT) AS entry_id, len(ks) AS n_kanji_groups, len(rs) AS n_readings, len(list_filter(rs, lambda x: ends_with(x, 'U'))) AS n_uncommon, len(gs) AS n_groups,
  CAST(list_sum(list_transform(gs, lambda g: CASE WHEN instr(g, ';') = 0 OR ends_with(g, ';') THEN 0 ELSE len(string_split(substr(g, instr(g, ';') + 1), '`')) END)) AS BIGINT) AS n_senses FROM q""")
def entry_line_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = codec.decoded(inline(spark, LINES, "line string"))
    big = lambda e: F.expr(f"cast({e} as bigint)")
    return df.select("entry_id", big("size(kanji_groups)").alias("n_kanji_groups"), big("size(readings)").alias("n_readings"), big("size(filter(readings, x -> not x.common))").alias("n_uncommon"), big("size(groups)").alias("n_groups"), big("aggregate(groups, 0, (n, g) -> n + size(g.senses))").alias("n_senses"))


@case(f"""WITH e(entry_id, kanjis, readings, groups) AS (VALUES {_NESTED}),
x AS (SELECT entry_id, kanjis[i].text AS k, i, array_to_string(list_filter(list_transform(readings, lambda r, j: CASE WHEN NOT r.nokanji AND (r.restr IS NULL OR list_contains(r.restr, i - 1)) THEN j - 1 ELSE -1 END), lambda j: j >= 0), ',') AS readings FROM (SELECT *, unnest(range(1, len(kanjis) + 1)) AS i FROM e))
SELECT CAST(entry_id AS BIGINT) AS entry_id, readings, string_agg(k, ',' ORDER BY i) AS kanjis FROM x GROUP BY entry_id, readings""")
def reading_restriction_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inline(spark, ENTRIES, codec.ENTRY).withColumn("ix", F.expr(codec.reading_indices()))
    rows = df.select("entry_id", F.posexplode(F.expr("zip_with(kanjis, ix, (k, j) -> named_struct('text', k.text, 'ix', j))")).alias("i", "x")).select("entry_id", "i", F.col("x.text").alias("k"), F.expr("array_join(x.ix, ',')").alias("readings"))
    return rows.groupBy("entry_id", "readings").agg(F.expr("array_join(transform(array_sort(collect_list(struct(i, k))), x -> x.k), ',')").alias("kanjis"))


#: By hand: codes and texts; the last two are unknown.
CODES = [("a", "place"), ("c", "company"), ("d", "product"), ("f", "female given name or forename"), ("m", "male given name or forename"), ("n", "family or surname"), ("o", "organization"), ("p", "full name of a particular person"), ("s", "railway station"), ("u", "unclassified name"), ("x", "x"), ("", "")]


@case(f"SELECT * FROM (VALUES {values(CODES)}) t(code, text)")
def name_type_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inline(spark, [x[:1] for x in CODES], "code string").select("code", render.name_type("code").alias("text"))


SHOWN = [(1, "かんじ", "かんじ", False, ["漢字", "感じ"], ["かんじ", "カンジ", "べつ"]), (2, "漢字", "漢字", False, ["漢字", "感じ"], ["かんじ"]), (3, "たなか", "たなか", True, ["田中"], ["たなか"]), (4, "不明", "不明", False, ["明白"], ["めいはく"])]
_SHOWN = ", ".join(f"({i}, '{m}', '{k}', {n}, {_duck(ks)}, {_duck(rs)})" for i, m, k, n, ks, rs in SHOWN)


def _key_fold(c: str) -> str:
    from lexis.functions.kana import KEY_STEP, folded_duckdb

    return folded_duckdb(c, KEY_STEP)


@case(f"""WITH e(entry_id, matched, key, is_name, kanjis, readings) AS (VALUES {_SHOWN}), h AS (SELECT *, regexp_matches(matched, '^[ぁ-ゖ]*$') AS hira FROM e),
f AS (SELECT *, list_transform(readings, lambda x: {_key_fold('x')} = key) AS rm, list_transform(kanjis, lambda x: {_key_fold('x')} = key) AS km FROM h)
SELECT CAST(entry_id AS BIGINT) AS entry_id, array_to_string(CASE WHEN hira THEN list_filter(readings, lambda x, i: rm[i]) ELSE readings END, ',') AS readings,
 array_to_string(CASE WHEN hira AND is_name THEN [] WHEN hira OR NOT list_bool_or(km) THEN kanjis ELSE list_filter(kanjis, lambda x, i: km[i]) END, ',') AS kanjis FROM f""")
def filter_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.visible_readings(inline(spark, SHOWN, "entry_id bigint, matched string, key string, is_name boolean, kanjis array<string>, readings array<string>"))


HITS = [("w1", 1, "漢字", "かんじ", "", "n", ["a<b", "c"]), ("w1", 2, "", "かん", "past", "v1", ["one"]), ("w1", 3, "幹", "かん", "", "n", []), ("w2", 1, "", "x&y", "", "exp", ["z"])]
_HITS = ", ".join(f"('{w}', {r}, '{k}', '{rd}', '{rs}', '{p}', {_duck(s)}{'::VARCHAR[]' if not s else ''})" for w, r, k, rd, rs, p, s in HITS)
_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@case(f"""WITH h(w, rnk, kanji, reading, reasons, pos, senses) AS (VALUES {_HITS}),
r AS (SELECT w, rnk, '<tr' || CASE WHEN rnk > 2 THEN ' class="hidden"' ELSE '' END || '><td>' || CASE WHEN kanji <> '' THEN '<span class="kanji">' || {_ESC.format('kanji')} || '</span> ' ELSE '' END || '<span class="kana">' || {_ESC.format('reading')} || '</span>' || CASE WHEN reasons <> '' THEN ' (' || {_ESC.format('reasons')} || ')' ELSE '' END || ' <i>' || {_ESC.format('pos')} || '</i>' ||
 CASE len(senses) WHEN 0 THEN '' WHEN 1 THEN ' <span>' || {_ESC.format('senses[1]')} || '</span>' ELSE '<ol>' || array_to_string(list_transform(senses, lambda s: '<li>' || {_ESC.format('s')} || '</li>'), '') || '</ol>' END || '</td></tr>' AS row FROM h)
SELECT w, '<table>' || string_agg(row, '' ORDER BY rnk) || CASE WHEN count(*) > 2 THEN '<tr class="more"></tr>' ELSE '' END || '</table>' AS html FROM r GROUP BY w""")
def render_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.rows_html(inline(spark, HITS, "w string, rnk int, kanji string, reading string, reasons string, pos string, senses array<string>"))


#: By hand: types, glosses, readings and the text.
GLOSSES = [
    (1, ["surname"], ["Tanaka"], ["たなか"], "n"),
    (2, ["place"], ["Tokyo Tower"], ["とうきょう"], "a;Tokyo Tower"),
    (3, ["fem", "given"], ["Miharu"], ["みはる"], "f,g"),
    (4, ["fem"], ["Miharu", "Spring"], ["みはる"], "f;Miharu; Spring"),
    (5, ["surname"], ["Kato"], ["かとう", "カトー"], "n;Kato"),
    (6, ["place"], ["Ōsaka"], ["おおさか"], "a"),
    (7, ["station"], ["Cheko"], ["チェコ"], "s"),
    (8, ["unclass"], ["Tana-ka"], ["たなか"], "u;Tana-ka"),
    (9, ["person", "place"], ["Kato"], ["かとう"], "p,a;Kato"),
]
_GLOSSES = ", ".join(f"({i}, {_duck(t)}, {_duck(g)}, {_duck(r)}, '{x}')" for i, t, g, r, x in GLOSSES)


@case(f"SELECT CAST(e AS BIGINT) AS entry_id, x AS text FROM (VALUES {_GLOSSES}) t(e, t, g, r, x)")
def redundant_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = inline(spark, [x[:4] for x in GLOSSES], "entry_id bigint, types array<string>, glosses array<string>, readings array<string>")
    return entries.translation_text(names).select("entry_id", "text")


#: By hand: restrictions, note, glosses and the text.
SENSES = [
    (1, [], [], None, ["plain", "frank"], "plain; frank"),
    (2, ["明白"], [], None, ["plain"], "(only 明白) plain"),
    (3, ["漢字", "感じ"], ["かんじ"], "note", ["a", "b"], "(only 漢字,感じ,かんじ) (note) a; b"),
    (4, None, ["かんじ"], "", ["a"], "(only かんじ) a"),
    (5, None, None, "often neg.", ["a"], "(often neg.) a"),
]


@case(f"SELECT CAST(e AS BIGINT) AS entry_id, x AS text FROM (VALUES {values([(x[0], x[5]) for x in SENSES])}) t(e, x)")
def sense_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    senses = inline(spark, [x[:5] for x in SENSES], "entry_id bigint, only_kanjis array<string>, only_readings array<string>, info string, glosses array<string>")
    return entries.sense_text(senses).select("entry_id", "text")


USUAL = [(1, "かんじ", True, None), (1, "カンジ", True, ["かんじ"]), (2, "いい", False, None), (3, "この", True, ["この", "こ"])]


@case(f"SELECT DISTINCT CAST(e AS BIGINT) AS entry_id, r AS reading FROM (VALUES {', '.join(f'({e}, {_duck(r)}, {u}, {_duck(x)}::VARCHAR[])' for e, r, u, x in USUAL)}) t(e, r, u, x) WHERE u AND (x IS NULL OR list_contains(x, r))")
def uk_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.kana_readings(inline(spark, USUAL, "entry_id bigint, reading string, uk boolean, restriction array<string>"))


#: By hand: what the sample's entries hold.
XML = [(1, 2, 3, 2, True, False, False), (2, 0, 1, 1, False, True, False), (3, 1, 0, 0, False, False, True)]


@case(f"SELECT CAST(entry_id AS BIGINT) AS entry_id, n_kanji, n_sense, n_groups, common, archaic, is_name FROM (VALUES {values(XML)}) t(entry_id, n_kanji, n_sense, n_groups, common, archaic, is_name)")
def xml_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml.summary(xml.parsed(inline(spark, [(x,) for x in xml.SAMPLE], "xml string")))


#: Elements of a small dictionary of words and names.
ELEMENTS = [
    ("<entry><ent_seq>10</ent_seq><k_ele><keb>食べる</keb><ke_pri>news1</ke_pri></k_ele><k_ele><keb>喰べる</keb></k_ele><r_ele><reb>たべる</reb><re_pri>news1</re_pri></r_ele><sense><pos>&v1;</pos><pos>&vt;</pos><gloss>to eat</gloss></sense><sense><stagk>喰べる</stagk><s_inf>rough</s_inf><gloss>to live on</gloss><gloss>to bite</gloss></sense></entry>",),
    ("<entry><ent_seq>11</ent_seq><r_ele><reb>いい</reb></r_ele><sense><pos>&adj-i;</pos><gloss>good</gloss></sense><sense><pos>&n;</pos><gloss>a &lt; b</gloss></sense></entry>",),
    ("<entry><ent_seq>12</ent_seq><k_ele><keb>取引</keb></k_ele><k_ele><keb>取り引き</keb></k_ele><r_ele><reb>とりひき</reb></r_ele><sense><pos>&n;</pos><pos>&vs-i;</pos><gloss>dealings</gloss></sense></entry>",),
    ("<entry><ent_seq>20</ent_seq><k_ele><keb>田中</keb></k_ele><r_ele><reb>たなか</reb></r_ele><trans><name_type>&surname;</name_type><trans_det>Tanaka</trans_det></trans></entry>",),
    ("<entry><ent_seq>21</ent_seq><k_ele><keb>田仲</keb></k_ele><r_ele><reb>たなか</reb></r_ele><trans><name_type>&surname;</name_type><trans_det>Tanaka</trans_det></trans></entry>",),
    ("<entry><ent_seq>22</ent_seq><k_ele><keb>田中</keb></k_ele><r_ele><reb>たなか</reb></r_ele><trans><name_type>&place;</name_type><trans_det>Tanaka</trans_det></trans></entry>",),
    ("<entry><ent_seq>23</ent_seq><r_ele><reb>スピーカ</reb></r_ele><trans><name_type>&company;</name_type><trans_det>Speaker</trans_det><trans_det>Spica</trans_det></trans></entry>",),
]
#: By hand: the index of the words, whose masks are v1, adj-i and vs-i, and of the names; 21 is part of 20.
KEYS = [
    ("食べる", 10, 4, False), ("喰べる", 10, 4, False), ("たべる", 10, 4, False), ("いい", 11, 2, False), ("取引", 12, 1024, False), ("取り引き", 12, 1024, False), ("とりひき", 12, 1024, False),
    ("とり引き", 12, 1024, False), ("取りひき", 12, 1024, False), ("取引き", 12, 1024, False),
    ("田中", 20, 0, True), ("田仲", 20, 0, True), ("たなか", 20, 0, True), ("田中", 22, 0, True), ("たなか", 22, 0, True), ("すぴいか", 23, 0, True),
]
#: By hand: entry, its kanjis, readings, and groups as parts of speech and senses.
CONTENTS = [
    (10, "食べる,喰べるU", "たべる", "v1,vt;to eat`(only 喰べる) (rough) to live on; to bite"), (11, "", "いい", "adj-i;good\\n;a < b"), (12, "取引,取り引き", "とりひき", "n,vs-i;dealings"),
    (20, "田中,田仲", "たなか", "n;"), (22, "田中", "たなか", "a;"), (23, "", "スピーカ", "c;Speaker; Spica"),
]
#: By hand: what is typed and the rows of its table. 20 is before 22 by id; entry 10 is under review.
TABLES = [
    ("食べた", '<table><tr><td class="word reviewed" data-entry="10"><span class="kanji">食べる</span> <span class="readings hidden"><span class="kana">たべる</span></span> <span class="chain">(past)</span><br><div><span class="pos">v1, vt</span>; <ul class="senses hidden"><li>to eat</li><li>(only 喰べる) (rough) to live on; to bite</li></ul></div></td></tr></table>'),
    ("いい", '<table><tr><td class="word" data-entry="11"><span class="readings"><span class="kana">いい</span></span><br><div><span class="pos">adj-i</span>; <span class="sense">good</span><br><span class="pos">n</span>; <span class="sense">a &lt; b</span></div></td></tr></table>'),
    ("田中", '<table><tr><td class="name" data-entry="20"><span class="kanji">田中</span> <span class="readings"><span class="kana">たなか</span></span><br><div><span class="pos">family or surname</span></div></td></tr><tr><td class="name" data-entry="22"><span class="kanji">田中</span> <span class="readings"><span class="kana">たなか</span></span><br><div><span class="pos">place</span></div></td></tr></table>'),
]


def _dictionary(spark: SparkSession):
    from lexis.api import Dictionary
    from lexis.functions.variations import SAMPLE_READINGS
    from lexis.operators.inflection import japanese_rules

    return Dictionary.build(inline(spark, ELEMENTS, "xml string"), japanese_rules(), known=SAMPLE_READINGS)


@case(f"SELECT key, CAST(entry_id AS BIGINT) AS entry_id, pos_mask, is_name FROM (VALUES {values(KEYS)}) t(key, entry_id, pos_mask, is_name)")
def dictionary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed index that is built from XML elements."""
    d = _dictionary(spark)
    return d.words.withColumn("is_name", F.lit(False)).unionByName(d.names.withColumn("is_name", F.lit(True))).select("key", "entry_id", "pos_mask", "is_name")


@case(f"SELECT CAST(entry_id AS BIGINT) AS entry_id, kanjis, readings, content FROM (VALUES {values(CONTENTS)}) t(entry_id, kanjis, readings, content)")
def dictionary_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that are built from XML elements."""
    joined = F.expr("array_join(transform(groups, g -> concat(array_join(g.pos, ','), ';', array_join(g.senses, '`'))), '\\\\')")
    texts = [F.expr(f"array_join({codec.marked(c)}, ',')").alias(c) for c in ("kanjis", "readings")]
    return _dictionary(spark).entries.select("entry_id", *texts, joined.alias("content"))


@case(f"SELECT * FROM (VALUES {values(TABLES)}) t(w, html)")
def dictionary_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From what is typed to tables, by a dictionary that is built from XML elements."""
    d = _dictionary(spark)
    hits = d.lookup(inline(spark, [x[:1] for x in TABLES], "text string"))
    return d.render(hits, inline(spark, [(10,), (99,)], "id bigint"))
