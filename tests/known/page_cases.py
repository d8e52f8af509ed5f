"""Hand-made rows for pages, corpora in pairs, lexicon files and token streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from lexis.sources import html_text, text_files
from known.cases import case
from lexis.plans.registry import inline, values

#: By hand: text, place, what is clipped before and behind it, and the context.
CLIPS = [
    ("abc 日本語です x", 6, " 日本", "語です ", "日本語です"), ("日本語", 0, "", "日本語", "日本語"), ("日本語", 3, "日本語", "", "日本語"), ("ab", 1, "", "", ""), ("", 0, "", "", ""),
    ("ああああああああああああああい", 14, "あ" * 13, "い", "あ" * 13 + "い"), ("日本 語", 3, "日本 ", "語", "語"), ("日本 語 ", 2, "日本", " 語 ", "日本語"),
]


@case(f"SELECT * FROM (VALUES {values(CLIPS)}) t(text, start, head, tail, context)")
def clip_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inline(spark, [x[:2] for x in CLIPS], "text string, start int")
    letters = "ぁ-ゖァ-ヺー一-龥 "
    rows = html_text.around(rows, letters)
    return rows.select("text", "start", html_text.clip_at("text", "start", letters, forward=False).alias("head"), html_text.clip_at("text", "start", letters).alias("tail"), "context")


@case("SELECT CAST(n AS BIGINT) AS n, CAST(power(2, ceil(log2(n))) AS BIGINT) AS p FROM range(1, 1500) t(n)")
def powers_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexis.functions import codec

    return spark.range(1, 1500).select(F.col("id").alias("n"), codec.power_of_two("id").alias("p"))


PAIRS = [("A: 彼は行った。\tHe went.#ID=1_2", "B: 彼(かれ)[01] は 行く{行った}"), ("A: 山が高い\tThe mountain is high.#ID=2_3", "B: 山(やま) が 高い[1]{高い}~")]
_PAIR_SQL = f"""WITH RECURSIVE p(a, b) AS (VALUES {values(PAIRS)}),
s AS (SELECT regexp_extract(a, '#ID=([0-9_]+)', 1) AS sent_id, regexp_extract(a, '^A: ([^' || chr(9) || ']*)', 1) AS text, string_split(substr(b, 4), ' ') AS ws FROM p),
w AS (SELECT sent_id, text, ws, 1 AS i, 0 AS upto, '' AS form, CAST(NULL AS BIGINT) AS start FROM s
 UNION ALL SELECT sent_id, text, ws, i + 1, CASE WHEN pl > 0 THEN upto + pl - 1 + length(f) ELSE upto END, f, CASE WHEN pl > 0 THEN CAST(upto + pl - 1 AS BIGINT) END FROM (
  SELECT *, instr(substr(text, upto + 1), f) AS pl FROM (SELECT sent_id, text, ws, i, upto, coalesce(nullif(regexp_extract(ws[i], '\\{{([^}}]*)\\}}', 1), ''), regexp_extract(ws[i], '^([^(\\[{{|~]*)', 1)) AS f FROM w WHERE i <= len(ws))))
"""


@case(_PAIR_SQL + "SELECT sent_id, CAST(i - 2 AS INTEGER) AS word_ix, form, start FROM w WHERE i > 1")
def parallel_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_files.placed_words(text_files.sentence_pairs(inline(spark, PAIRS, "a string, b string")))


ROWS = [("食べる,動詞,1",), (",記号,2",), ('"a,b",名詞,3',)]


@case("SELECT 1::BIGINT AS lemma_id, '食べる' AS surface, '動詞' AS pos UNION ALL SELECT 2, '\"', '記号' UNION ALL SELECT 3, 'a,b', '名詞'")
def csv_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_files.lexicon(inline(spark, ROWS, "value string"), "surface string, pos string, lemma_id bigint")


STREAM = [(0, "猫\t名詞,ネコ,1"), (1, "が\t助詞,ガ,2"), (2, "EOS"), (3, "EOS"), (4, "noise"), (5, "走る\t動詞,ハシル,3"), (6, "EOS")]


@case(f"""WITH t(n, line) AS (VALUES {values(STREAM)}), s AS (SELECT *, coalesce(count(*) FILTER (WHERE line = 'EOS') OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM t)
SELECT CAST(sent AS BIGINT) AS sent, CAST(row_number() OVER (PARTITION BY sent ORDER BY n) - 1 AS BIGINT) AS pos, string_split(line, chr(9))[1] AS surface, string_split(string_split(line, chr(9))[2], ',')[-1] AS lemma FROM s WHERE contains(line, chr(9))""")
def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = "".join(line + "\n" for _, line in STREAM)
    sentences = inline(spark, [(n, x) for n, x in enumerate(joined.split("EOS\n")) if x], "sent bigint, value string")
    return text_files.stream_tokens(sentences).select("sent", "pos", "surface", F.element_at("feats", -1).alias("lemma"))


#: By hand: section, writing, reading and sense.
WIKI = [("名詞", "漢字", "かんじ", "文字。"), ("名詞", "漢字", "かんじ", "字。"), ("動詞", "走る", "はしる", "駆ける。")]
#: By hand: a word of kanjis with kana behind them, and its variations; 漢字 has no kana.
VARIED = [("取り引き", "とり引き"), ("取り引き", "取りひき"), ("取り引き", "取引き"), ("引き取り", "ひき取り"), ("引き取り", "引きとり"), ("引き取り", "引取り"), ("受け付け", "うけ付け"), ("受け付け", "受けつけ"), ("受け付け", "受付け")]


@case(f"SELECT * FROM (VALUES {values(WIKI)}) t(section, writing, reading, sense)")
def tag_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_files.wiki_senses(inline(spark, [(x,) for x in text_files.WIKI_SAMPLE], "wiki string"))


@case(f"SELECT * FROM (VALUES {values(VARIED)}) t(word, variation)")
def variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexis.functions import variations as v

    rows = inline(spark, [("取り引き", "とりひき"), ("引き取り", "ひきとり"), ("漢字", "かんじ"), ("受け付け", "うけつけ")], "word string, reading string")
    return v.variations(rows, v.SAMPLE_READINGS)


#: Page elements, of which two are of the main namespace; and lines of two kinds of corpora.
PAGES = [("<page><title>犬</title><ns>0</ns><revision><text>==日本語== &lt;b&gt;</text></revision></page>",), ("<page><title>利用者:x</title><ns>2</ns><revision><text>x</text></revision></page>",), ("<page><title>空</title><ns>0</ns><revision><text></text></revision></page>",)]
LINES = [("<j>犬が走る。</j>",), ("<e>A dog runs.</e>",), ("<doc id=1>",), ("猫 <j>が</j> 走る",), ("本文",)]
TEMPLATES = [(1, "inf-ja-adj", ["形容詞"]), (2, "inf-ja-adj", ["ダ"]), (3, "inf-ja-adj", ["タルト"]), (4, "inf-ja", ["か", "カ", "五"]), (5, "inf-ja", ["み", "マ", "上一"]), (6, "inf-ja", ["", "サ", "変"]), (7, "inf-ja", ["", "カ", "変"]), (8, "inf-ja", ["わ", "ア", "五"]), (9, "inf-ja", ["x"])]


@case("SELECT * FROM (VALUES ('犬', '==日本語== <b>'), ('空', NULL)) t(title, wiki)")
def wiki_page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_files.wiki_pages(inline(spark, PAGES, "xml string")).select("title", F.nullif("wiki", F.lit("")).alias("wiki"))


@case("SELECT * FROM (VALUES ('tagged', '犬が走る。'), ('tagged', '猫 が 走る'), ('plain', '猫 <j>が</j> 走る'), ('plain', '本文')) t(kind, value)")
def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inline(spark, LINES, "value string")
    return text_files.corpus_sentences(lines, "j").select(F.lit("tagged").alias("kind"), "value").unionByName(text_files.corpus_sentences(lines).select(F.lit("plain").alias("kind"), "value"))


@case("SELECT CAST(id AS BIGINT) AS id, pos FROM (VALUES (1, 'adj-i'), (2, 'adj-na'), (3, 'adj-t'), (4, 'v5k'), (5, 'v1'), (6, 'vs'), (7, 'vk'), (8, 'v5u'), (9, NULL)) t(id, pos)")
def template_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexis.operators import inflection

    return inline(spark, TEMPLATES, "id bigint, name string, params array<string>").select("id", F.expr(inflection.pos_of_template("name", "params")).alias("pos"))
