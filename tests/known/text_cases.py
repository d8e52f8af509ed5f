"""Hand-made rows for characters and scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from lexis.functions import kana, romaji, scripts
from known.cases import case
from lexis.plans.registry import inline, values

WORDS = [("ｽﾋﾟｰｶ",), ("開発センター",), ("ぶっとおし",), ("カタカナ",), ("ｶﾞｷﾞｸﾞ",), ("ﾊﾟﾝ",), ("オオカミ",), ("づつを",), ("こおりー",), ("セーラー",), ("ー",), ("ﾞ",), ("𠮟る",), ("abcｱ",), ("",)]
PAIRS = [("スピーカ", "すぴいか"), ("ひらがな", "ヒラガナ"), ("センター", "せんたあ"), ("あ", "い"), ("ｶﾞ", "が")]
#: By hand: kana, Latin, and whether it is accepted.
LATIN = [
    ("みはる", "Miharu", True), ("しんじゅく", "shinjuku", True), ("っか", "kka", True), ("みはる", "mihari", False), ("けいこ", "keiko", True), ("けいこ", "kēko", False), ("えいこ", "ēko", True),
    ("ちば", "tiba", True), ("きゃく", "kyaku", True), ("ぎゅうにゅう", "gyuunyuu", True), ("か", "k", False), ("まっちゃ", "maccha", True), ("まっちゃ", "mattya", True), ("まっちゃ", "matcha", False),
    ("おおさか", "ōsaka", True), ("おおさか", "oosaka", True), ("おおさか", "osaka", False), ("とうきょう", "toukyou", True), ("とうきょう", "tōkyō", False), ("しぇり", "sheri", True), ("ちぇこ", "cheko", True), ("ふぁん", "fan", True),
    ("らーめん", "raamen", True), ("らーめん", "ramen", False), ("しんばし", "shimbashi", True), ("ゐど", "ido", True), ("ゐど", "wido", True), ("じゃ", "ja", True), ("づつ", "dzutsu", True), ("は", "wa", False),
]
#: By hand: words and their folds.
FOLDED = [("ヰー", "ゐい"), ("ヱー", "ゑい"), ("スピーカ", "すぴいか"), ("センター", "せんたあ"), ("セーラー", "せいらあ"), ("ｶﾞｷﾞｸﾞ", "がぎぐ"), ("ﾊﾟﾝ", "ぱん"), ("コーヒー", "こうひい"), ("ｺｰﾋｰ", "こうひい"), ("ァー", "ぁー"), ("ンー", "んー"), ("ー", "ー"), ("ｳﾞ", "ゔ"), ("abc", "abc")]


@case(f"""SELECT w AS word, {kana.folded_duckdb('w')} AS folded, CAST(list_sum(list_transform(string_split(w || 'x', ''), lambda c: CASE WHEN unicode(c) > 65535 THEN 2 ELSE 1 END)) - 1 AS BIGINT) AS n_units FROM (VALUES {values(WORDS)}) t(w)""")
def fold_kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inline(spark, WORDS, "w string")
    return df.select(F.col("w").alias("word"), kana.folded("w").alias("folded"), kana.utf16_length("w").alias("n_units"))


@case(f"SELECT w AS word, {kana.folded_duckdb('w', kana.LOOSE_STEP)} AS folded, {kana.folded_duckdb('w', kana.KEY_STEP)} AS key FROM (VALUES {values(WORDS)}) t(w)")
def fold_kana_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inline(spark, WORDS, "w string")
    return df.select(F.col("w").alias("word"), kana.folded("w", kana.LOOSE_STEP).alias("folded"), kana.folded("w", kana.KEY_STEP).alias("key"))


@case(f"SELECT a, b, {kana.folded_duckdb('a')} = {kana.folded_duckdb('b')} AS is_eq FROM (VALUES {values(PAIRS)}) t(a, b)")
def fold_equal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inline(spark, PAIRS, "a string, b string").select("a", "b", (kana.folded("a") == kana.folded("b")).alias("is_eq"))


@case(f"SELECT w AS word, regexp_matches(w, '{scripts.HIRAGANA_WORD}') AS is_hiragana, regexp_matches(w, '{scripts.GATE}') AS passes FROM (VALUES {values(WORDS + [(' か',), ('  か',), ('latin',)])}) t(w)")
def search_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inline(spark, WORDS + [(" か",), ("  か",), ("latin",)], "w string")
    return df.select(F.col("w").alias("word"), F.col("w").rlike(scripts.HIRAGANA_WORD).alias("is_hiragana"), F.col("w").rlike(scripts.GATE).alias("passes"))


@case(f"""SELECT w, CAST(length(w) AS BIGINT) AS n_cp, CAST(list_sum(list_transform(string_split(w || 'x', ''), lambda c: CASE WHEN unicode(c) > 65535 THEN 2 ELSE 1 END)) - 1 AS BIGINT) AS n_u16,
  CASE WHEN length(w) > 0 THEN substring(w, 1, length(w) - 1) ELSE '' END AS drop_last, CAST(row_number() OVER (ORDER BY w) AS BIGINT) AS place FROM (VALUES {values(WORDS)}) t(w)""")
def codepoint_vs_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    df = inline(spark, WORDS, "w string")
    return df.select("w", F.length("w").cast("bigint").alias("n_cp"), kana.utf16_length("w").alias("n_u16"), F.expr("if(length(w) > 0, substring(w, 1, length(w) - 1), '')").alias("drop_last"), F.row_number().over(Window.orderBy("w")).cast("bigint").alias("place"))


@case(f"SELECT * FROM (VALUES {values(LATIN)}) t(kana, latin, ok)")
def romaji_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = inline(spark, [x[:2] for x in LATIN], "kana string, latin string")
    return given.select("kana", "latin", romaji.is_romanisation("kana", "latin").alias("ok"))


@case(f"SELECT * FROM (VALUES {values(FOLDED)}) t(word, folded)")
def fold_kana_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inline(spark, [x[:1] for x in FOLDED], "word string").select("word", kana.folded("word").alias("folded"))
