"""Hand-made rows for alignment and counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from lexis.operators import alignment, frequency
from known.cases import case
from lexis.plans.registry import inline, values

LINKS = [(1, 10, "a"), (1, 10, "b"), (1, 11, "a"), (2, 11, "c"), (2, 12, "c"), (2, 12, "d"), (3, 13, "e"), (3, 14, "e"), (4, 14, "f")]


@case("SELECT * FROM (VALUES (5::BIGINT, 15::BIGINT), (6, 15)) t(a, b)")
def unique_mapping_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made links, of which the given tables have none: only 5 and 6 have one target."""
    links = inline(spark, [x[:2] for x in LINKS] + [(5, 15), (5, 15), (6, 15), (4, 13)], "a bigint, b bigint")
    return alignment.unique_links(links, "a", "b").orderBy("a")


@case("SELECT * FROM (VALUES (2::BIGINT, 7::BIGINT), (5, 9)) t(id, target)")
def anti_rescue_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made: 1 is linked already, 3 has two targets, 4 has no target in the index."""
    rows = inline(spark, [(1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, "v"), (6, None)], "id bigint, surface_text string")
    index = inline(spark, [("x", 7), ("x", 7), ("y", 1), ("y", 2), ("v", 9), (None, 3)], "surface string, target bigint")
    return alignment.rescued(rows, inline(spark, [(1,)], "id bigint"), "id", "surface_text", index)


@case(f"""WITH e(a, b, t) AS (VALUES {values(LINKS)}), c AS (SELECT a, b FROM (SELECT a, b, count(DISTINCT t) AS h FROM e GROUP BY a, b) JOIN (SELECT a, count(DISTINCT t) AS n FROM e GROUP BY a) USING (a) WHERE h = n),
k AS (SELECT a, min(b) AS keep FROM c GROUP BY a HAVING count(*) = 1)
SELECT CAST(e.a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, t AS text FROM e LEFT JOIN k ON e.a = k.a WHERE keep IS NULL OR keep = b""")
def cover_prune_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.pruned_once(inline(spark, LINKS, "a bigint, b bigint, text string"), "a", "b")


VARIANTS = [(1, 0, "かん", "かんじ"), (1, 1, "かんじ", "かんじ"), (1, 2, "かんじ", "かんじ"), (2, 0, "?の", "やまの"), (3, 0, "x", "y")]


@case(f"SELECT CAST(e AS BIGINT) AS entry_id, CAST(min(v) AS BIGINT) AS variant_ix FROM (VALUES {values(VARIANTS)}) t(e, v, p, r) WHERE regexp_full_match(r, replace(p, '?', '.+')) GROUP BY e")
def variant_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.first_variants(inline(spark, VARIANTS, "entry_id bigint, variant_ix bigint, pattern string, reading string"))


TOKENS = [(1, "a", "a"), (1, "b", "a"), (2, "x", "y"), (2, "y", "y"), (2, "z", "z"), (3, "q", "q"), (4, "q", "q")]
MAPPING = [(1, "one", None, 100), (2, "writing", "x", 200), (2, "writing", "y", 201), (3, "star", None, 300), (3, "star", None, 301)]


@case(f"""WITH t(lemma_id, writing, folded) AS (VALUES {values(TOKENS)}), n AS (SELECT *, row_number() OVER () AS t FROM t), m(lemma_id, kind, as_, entry_id) AS (VALUES {values(MAPPING)}),
f AS (SELECT t, entry_id, CASE WHEN kind IN ('one', 'star') THEN 0 WHEN as_ = writing THEN 0 WHEN as_ = folded THEN 1 END AS form FROM n JOIN m USING (lemma_id))
SELECT CAST(entry_id AS BIGINT) AS entry_id, count(*) AS n FROM (SELECT * FROM f WHERE form IS NOT NULL QUALIFY rank() OVER (PARTITION BY t ORDER BY form) = 1) GROUP BY entry_id""")
def mapped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.mapped_counts(inline(spark, TOKENS, "lemma_id bigint, writing string, folded string"), inline(spark, MAPPING, "lemma_id bigint, kind string, writing string, entry_id bigint"))


#: Two small lexicons: matches with their writing, texts of both sides, parts of speech, and an index of surfaces.
MATCHES = [
    (1, 10, "取る"), (1, 11, "とる"), (2, 11, "撮る"), (1, 99, "取る"), (8, 16, "空"), (8, 17, "空"), (7, 14, "行く"), (7, 14, "往く"), (7, 15, "行く"), (6, 14, "行く"), (6, 15, "行く"),
    (20, 12, "橋"), (20, 12, "はし"), (20, 13, "はし"), (21, 13, "箸"), (21, 13, "はし"), (21, 12, "はし"),
]
LEMMA_TEXTS = {1: "取る とる", 2: "撮る", 6: "行く ゆく", 7: "行く 往く", 8: "空", 9: "駆ける", 20: "はし 橋 端", 21: "はし 箸 筷"}
ENTRY_TEXTS = {10: "取る とる", 11: "撮る とる", 12: "橋 はし ばし", 13: "箸 はし ばし", 14: "行く 往く いく", 15: "行く ゆく", 16: "空 そら", 17: "空 から", 18: "駆けろ", 19: "はしれ", 99: "取る者"}
SURFACES = [("駆けろ", 9), ("駆けろ", 9), ("はしれ", 8), ("はしれ", 9), ("取る", 1)]
VERBS = (1, 2, 6, 7, 9)
#: By hand. 99 has the wrong part of speech; 10 covers 1, and 15 is covered by 6, which leaves 14 to 7; 16 and 17 are only 8's; 18 is rescued,
#: 19 has two lemmas; 橋 and 箸 pin an entry where nothing covers.
FINAL = [(1, None, 10, "one"), (2, None, 11, "one"), (6, None, 15, "one"), (7, None, 14, "one"), (8, None, 16, "star"), (8, None, 17, "star"), (9, None, 18, "one"), (20, "橋", 12, "ambiguous"), (21, "箸", 13, "ambiguous")]


def _mapping(spark: SparkSession) -> DataFrame:
    texts = lambda given, name: inline(spark, [(k, t) for k, v in given.items() for t in v.split()], f"{name} bigint, text string")
    lemma_pos = inline(spark, [(k, "verb" if k in VERBS else "noun") for k in LEMMA_TEXTS], "lemma_id bigint, pos string")
    entry_pos = inline(spark, [(k, "v5r" if k in (10, 11, 14, 15, 18) else "n") for k in ENTRY_TEXTS], "entry_id bigint, entry_pos string")
    pairs = inline(spark, [("verb", "v5r"), ("verb", "v5r"), ("noun", "n")], "pos string, entry_pos string")
    matches = alignment.pos_matches(inline(spark, MATCHES, "lemma_id bigint, entry_id bigint, writing string"), lemma_pos, entry_pos, pairs)
    return alignment.aligned(matches, texts(LEMMA_TEXTS, "lemma_id"), texts(ENTRY_TEXTS, "entry_id"), inline(spark, SURFACES, "surface string, lemma_id bigint"))


NAMED = [("田中", "proper"), ("田中", "proper"), ("田中", "noun"), ("東京", "proper"), ("猫", "noun"), ("京", "proper")]
NAMES = [("田中", 1), ("田中", 2), ("田中", 2), ("東京", 3), ("猫", 4)]


@case("SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT), (2, 2), (3, 1)) t(entry_id, n)")
def name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.name_counts(inline(spark, NAMED, "surface string, pos string"), inline(spark, NAMES, "key string, entry_id bigint"))


SPOKEN = [
    (1, "行く", "行く", "いく", "いく", False, ["行く"], [("ゆく", False, False)]), (2, "x", "行く", "いく", "いく", False, ["往く", "行く"], []), (3, "x", "x", "いく", "x", False, ["往く"], [("いく", False, False)]),
    (4, "x", "x", "いく", "x", False, ["往く"], [("いく", True, False)]), (5, "x", "x", "x", "いく", False, ["往く"], [("いく", False, True)]), (6, "x", "x", "いく", "x", False, [], [("いく", False, False)]),
    (7, "x", "x", "い.", "x", True, [], [("いく", False, False)]), (8, "x", "x", "い", "x", True, [], [("いく", False, False)]),
]


@case("SELECT CAST(id AS BIGINT) AS id, fits FROM (VALUES (1, true), (2, true), (3, false), (4, true), (5, true), (6, true), (7, true), (8, false)) t(id, fits)")
def phrase_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made: by writing, by reading where kana is possible, and by patterns that must match whole readings."""
    schema = "id bigint, orth string, orth_base string, pron string, pron_base string, is_pattern boolean, kanji_keys array<string>, readings array<struct<key: string, nokanji: boolean, uk: boolean>>"
    return alignment.phrase_fits(inline(spark, SPOKEN, schema)).select("id", "fits")


LEXEMES = [(1, "noun", "漢字", "漢字", "かんじ"), (2, "noun", "感じ", "感じ", "かんじ"), (3, "proper", "田中", "田中", "たなか"), (4, "noun", "いい", "いい", "いい"), (5, "noun", "この", "この", "この"), (6, "proper", "山", "山", "やま"), (7, "noun", "漢字", "漢字", "べつ")]
ENTRIES = [(10, True, True, False, False, False, "漢字", "かんじ", "漢字"), (11, True, True, False, False, False, "感じ", "かんじ", "感じ"), (12, True, True, False, False, False, "田中", "たなか", "田中"), (13, False, False, False, False, False, "いい", "いい", "いい"), (14, False, True, False, True, False, "この", "この", "この"), (15, True, True, False, False, False, "山", "やま", "山"), (16, True, True, False, False, False, "山", "さん", "山")]
_LEX, _ENT = "lemma_id, pos, orth, orth_key, pron_key", "entry_id, is_noun, has_kanji, nokanji, uk, archaic, text, reading_key, text_key"
_MATCH = f"WITH l({_LEX}) AS (VALUES {values(LEXEMES)}), e({_ENT}) AS (VALUES {values(ENTRIES)})"


@case(f"""{_MATCH}, j AS (SELECT * FROM l JOIN e ON orth_key = text_key), ne AS (SELECT lemma_id, orth, count(DISTINCT entry_id) AS n_entries, count(DISTINCT CASE WHEN is_noun THEN entry_id END) AS n_nouns FROM j GROUP BY 1, 2), nl AS (SELECT orth_key, pos, count(DISTINCT lemma_id) AS n_lemmas FROM j GROUP BY 1, 2)
SELECT DISTINCT CAST(j.lemma_id AS BIGINT) AS lemma_id, CAST(entry_id AS BIGINT) AS entry_id, j.orth AS writing FROM j JOIN ne ON j.lemma_id = ne.lemma_id AND j.orth = ne.orth JOIN nl ON j.orth_key = nl.orth_key AND j.pos = nl.pos
WHERE (j.pos <> 'proper' OR (n_nouns <= 1 AND n_lemmas <= 1 AND is_noun)) AND CASE WHEN regexp_matches(j.orth, '^[ぁ-ヿ]*$') THEN text = j.orth AND (NOT has_kanji OR nokanji OR (uk AND NOT archaic AND n_entries = 1)) ELSE reading_key = pron_key END""")
def multi_cond_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexemes = inline(spark, LEXEMES, "lemma_id bigint, pos string, orth string, orth_key string, pron_key string")
    entries = inline(spark, ENTRIES, "entry_id bigint, is_noun boolean, has_kanji boolean, nokanji boolean, uk boolean, archaic boolean, text string, reading_key string, text_key string")
    return alignment.simple_matches(lexemes, entries)


@case(f"{_MATCH} SELECT DISTINCT CAST(lemma_id AS BIGINT) AS lemma_id, CAST(entry_id AS BIGINT) AS entry_id FROM l JOIN e ON orth_key = text_key AND pron_key = reading_key WHERE pos = 'proper'")
def names_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexemes = inline(spark, LEXEMES, "lemma_id bigint, pos string, orth string, orth_key string, pron_key string")
    names = inline(spark, ENTRIES, "entry_id bigint, is_noun boolean, has_kanji boolean, nokanji boolean, uk boolean, archaic boolean, text string, reading_key string, text_key string")
    return alignment.name_matches(lexemes, names)


@case(f"SELECT CAST(lemma_id AS BIGINT) AS lemma_id, writing, CAST(entry_id AS BIGINT) AS entry_id, kind FROM (VALUES {values(FINAL)}) t(lemma_id, writing, entry_id, kind)")
def align_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From matches to the final mapping: parts of speech, rescue, covers from both sides, classes."""
    return _mapping(spark)


@case(f"SELECT DISTINCT CAST(entry_id AS BIGINT) AS entry_id FROM (VALUES {values(FINAL)}) t(lemma_id, writing, entry_id, kind)")
def mapped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.mapped_entries(_mapping(spark))
