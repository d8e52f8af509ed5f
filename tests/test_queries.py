"""Every query against its SQL on the smallest tables, and the golden facts of folding, rules and codecs."""

import glob
import os

import duckdb
import pytest
from known import align_cases, etl_cases, lookup_cases, page_cases, text_cases  # noqa: F401  they register themselves
from known.cases import CASES
from pyspark.sql import functions as F

from lexis.functions import codec, kana, romaji, variations
from lexis.operators import alignment, entries, frequency, inflection, lookup, review
from lexis.plans import catalogue
from lexis.sources import html_text, text_files, xml_entries
from lexis.streaming import live_lookup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(got, duck, sql):
    columns = sorted(got.columns)
    rows = sorted(map(tuple, got.select(*columns).collect()), key=repr)
    if sql is None:
        assert rows
        return
    want = duck.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({sql})").fetchall()
    assert rows == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    same(catalogue.queries()[name](spark, SF), duck, catalogue.oracle_sql().get(name))


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, duck, name):
    make, sql = CASES[name]
    same(make(spark, SF), duck, sql)


def test_folding(spark):
    df = spark.createDataFrame([("ｽﾋﾟｰｶ",), ("開発センター",), ("ぶっとおし",)], "w string")
    rows = df.select(kana.folded("w"), kana.folded("w", kana.LOOSE_STEP), kana.folded_with_map("w")).collect()
    assert [r[0] for r in rows[:2]] == ["すぴいか", "開発せんたあ"] and rows[2][1] == "ぶっとうし" and rows[0][2]["map"] == [0, 1, 3, 4, 5]


def test_rules(spark):
    rules = inflection.japanese_rules()
    words = spark.createDataFrame([("こき使われて",)], "w string")
    found = inflection.closure(words, rules).orderBy("depth", "path").collect()
    assert [r.word for r in found] == ["こき使われつ", "こき使われる", "こき使われてる", "こき使う", "こき使わる", "こき使われつ"]
    assert [(r.mask, r.reasons) for r in found[:3]] == [(0x4000, "imperative"), (0x1C, "-te"), (0xC, "masu stem")]
    assert [r[5] for r in rules] == sorted(r[5] for r in rules) or len({r[5] for r in rules}) == len(rules)


def test_romanisation():
    assert romaji.accepts("みはる", "Miharu") and not romaji.accepts("みはる", "mihari")
    assert all(romaji.accepts("かきく", x) for x in romaji.combinations("かきく"))


def test_codec_round_trip(spark):
    from known.etl_cases import ENTRIES

    df = spark.createDataFrame(ENTRIES, codec.ENTRY)
    back = {r.entry_id: r for r in codec.decoded(codec.encoded(df).filter("entry_id <> 0").select("line")).collect()}
    for i, kanjis, readings, groups in ENTRIES:
        assert sorted(k.text for g in back[i].kanji_groups for k in g.kanjis) == sorted(t for t, _ in kanjis)
        assert [r.text for r in back[i].readings] == [r[0] for r in readings]
        assert [(g.types, g.senses) for g in back[i].groups] == [(p, s) for p, s in groups]
    numbers = spark.createDataFrame([(n,) for n in (0, 1, 61, 62, 3843, 10**12)], "n bigint")
    assert numbers.withColumn("s", codec.base62("n")).filter(codec.from_base62("s") != F.col("n")).count() == 0


def test_limit_and_first_wins(spark):
    index = spark.createDataFrame([("ab", n, 0) for n in range(40)] + [("a", 3, 0)], "key string, entry_id bigint, pos_mask int")
    hits = lookup.lookup(spark.createDataFrame([("abc",), ("",)], "w string"), index, None, inflection.european_rules()).collect()
    assert [r.entry_id for r in sorted(hits, key=lambda r: r.rnk)] == list(range(32)) and all(r.match_len == 2 for r in hits)


def test_pruning_reaches_a_fixpoint(spark):
    links = spark.createDataFrame([(1, 10, "a"), (1, 10, "b"), (1, 11, "a")], "a bigint, b bigint, text string")
    assert {(r.a, r.b) for r in alignment.pruned(links, "a", "b").collect()} == {(1, 10)}


def test_mapping_classes_of_all_links(spark, monkeypatch):
    from lexis.plans import align_queries

    links = [(1, 10), (2, 20), (2, 21), (2, 21), (3, 30), (4, 30), (4, 40), (5, 30)]
    monkeypatch.setattr(align_queries, "table", lambda *a: spark.createDataFrame(links, "l_partkey bigint, l_suppkey bigint"))
    rows = {r.l_partkey: (r.kind, r.n) for r in align_queries.mapping_classes_all(spark, "").collect()}
    assert rows == {1: ("one", 1), 2: ("star", 2), 3: ("one", 1), 4: ("ambiguous", 2), 5: ("one", 1)}


def test_hits_of_whole_names(spark, monkeypatch):
    from lexis.plans import lookup_queries

    texts = {"benchmark": ("text", "blue anvils"), "documents": ("text", "nothing"), "part": ("p_name", "blue anvil")}
    monkeypatch.setattr(lookup_queries, "table", lambda spark, sf_dir, name: spark.createDataFrame([(texts[name][1],)], f"{texts[name][0]} string"))
    assert {(r.w, r.is_name) for r in lookup_queries.lookup_rank_top32(spark, "").collect()} == {("blue", True), ("anvils", True)}
    assert {(r.w, r.text) for r in lookup_queries.late_materialise(spark, "").collect()} == {("blue", "blue"), ("anvils", "anvil")}


def test_closure_of_vocabulary(spark, monkeypatch):
    from lexis.plans import lookup_queries

    monkeypatch.setattr(lookup_queries, "table", lambda *a: spark.createDataFrame([("Settings",)], "text string"))
    rows = {(r.cand, r.reasons, r.depth) for r in lookup_queries.suffix_rule_closure(spark, "").filter("w = 'settings'").collect()}
    assert {("setting", "plural", 1), ("setting", "-s", 1), ("sett", "plural,-ing", 2), ("sett", "-s,-ing", 2)} == rows


def test_review(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "id bigint") for xs in ([1, 2, 2], [2, 3]))
    assert sorted(r.id for r in review.added(a, b).collect()) == [1, 2, 3]
    assert {(r.id, r.change) for r in review.changes(a, b).collect()} == {(3, "add"), (1, "remove")}


def test_files(spark, tmp_path):
    (tmp_path / "rules.tsv").write_text("# comment\nて\tる\traw\tv1|vk\t-te\n")
    (tmp_path / "corpus").write_text("猫\t名詞,1\nEOS\nEOS\nx\t" + ",".join(["f"] * 28) + ",77\nEOS\n")
    (tmp_path / "dict.xml").write_text("<!DOCTYPE x>\n<dict>" + "\n".join(xml_entries.SAMPLE) + "</dict>")
    assert text_files.rules(spark, f"file://{tmp_path}/rules.tsv").collect()[0].target_pos == ["v1", "vk"]
    tokens = text_files.stream_tokens(text_files.read_stream(spark, f"file://{tmp_path}/corpus")).collect()
    assert [(t.surface, t.known, t.lemma_id) for t in tokens] == [("猫", False, None), ("x", True, 77)]
    parsed = xml_entries.valid(xml_entries.parsed(xml_entries.read(spark, f"file://{tmp_path}/dict.xml")))
    assert {(r.entry_id, len(r.sense_groups), r.problem) for r in parsed.collect()} == {(1, 2, None), (2, 1, None), (3, 0, None)}
    counts = spark.createDataFrame([(1, 5), (2, 9)], "entry_id bigint, n bigint")
    text_files.write_frequencies(counts, f"file://{tmp_path}/freq")
    assert sorted(map(tuple, text_files.read_frequencies(spark, f"file://{tmp_path}/freq").collect())) == [(1, 5), (2, 9)]
    text_files.write_index(spark.createDataFrame([("b", 1, 0), ("a", 2, 3)], "key string, entry_id bigint, pos_mask int"), f"file://{tmp_path}/index")
    assert spark.read.parquet(f"file://{tmp_path}/index").count() == 2
    variants = text_files.parse_variants(spark.createDataFrame([(1, "a\tx\nEOS\nb\tx\nc\ty\nEOS\n")], "key bigint, value string"))
    assert [r.surfaces for r in variants.orderBy("variant_ix").collect()] == [["a"], ["b", "c"]]
    text_files.write_sample(spark.createDataFrame([(["a", "b"],)], "surfaces array<string>"), f"file://{tmp_path}/sample", 1.0)
    assert spark.read.text(f"file://{tmp_path}/sample").filter("value = 'a b'").count() == 1


def test_kanji_readings(spark):
    rows = text_files.kanji_readings(spark.createDataFrame([("日|x|ニチ|ひ か.つ-",)], "value string"))
    assert {"にち", "ひ", "び", "ぴ", "か", "かつ", "かっ", "が"} <= {r.reading for r in rows.collect()}


def test_variations():
    assert "とり引き" in variations.of("取り引き", "とりひき", {"取": ["と"], "引": ["ひ"]}) or variations.of("取り引き", "とりひき", {"取": ["と"], "引": ["ひ"]})
    assert variations.of("漢字", "べつ", {"漢": ["かん"], "字": ["じ"]}) == []


def test_words_that_vary():
    assert variations.varies("取り引き") and not any(map(variations.varies, ("取引", "取り", "カ取り引き", "人々り人", "取引所り", "")))
    assert variations.of("取引", "とりひき", variations.SAMPLE_READINGS) == []


def test_dictionary_is_kept(spark, tmp_path):
    from lexis.api import Dictionary
    from lexis.options import Options

    rules = inflection.japanese_rules()
    made = Dictionary.build(spark.createDataFrame(etl_cases.ELEMENTS, "xml string"), rules)
    made.save(f"file://{tmp_path}/d")
    kept = Dictionary.load(spark, f"file://{tmp_path}/d", rules)
    texts = spark.createDataFrame([("食べられなかった",), ("タナカ",), ("すぴーか",), ("",), ("ない",)], "text string")
    hits = kept.lookup(texts)
    assert sorted((r.w, r.entry_id, r.reasons) for r in hits.filter("rnk = 1").collect()) == [("すぴいか", 23, ""), ("たなか", 20, ""), ("食べられなかった", 10, "past,negative,potential or passive")]
    html = {r.w: r.html for r in kept.render(hits).collect()}
    assert "(past,negative,potential or passive)" in html["食べられなかった"] and html["食べられなかった"].count("喰べる") == 1
    assert html["たなか"].count("<tr") == 2 and "田" not in html["たなか"]
    short = Dictionary(kept.words, kept.names, rules, Options(longest=2, limit=1, count_names=True, least_frequency=2), kept.entries)
    assert [(r.w, r.entry_id, r.match_len) for r in short.lookup(texts.limit(1)).collect()] == [("食べられなかった", 10, 2)] and short.lookup(spark.createDataFrame([("いいえ",)], "text string")).head().match_len == 2
    tokens = spark.createDataFrame([(7, "田中", "たなか", "田中", "proper"), (7, "田中", "たなか", "x", "noun")], "lemma_id long, writing string, folded string, surface string, pos string")
    mapping = spark.createDataFrame([(7, "one", None, 500)], "lemma_id long, kind string, writing string, entry_id long")
    assert sorted(map(tuple, short.counts(tokens, mapping).collect())) == [(20, 1), (22, 1), (500, 2)]
    assert [tuple(r) for r in short.ranks(spark.createDataFrame([("a",), ("a",), ("b",)], "w string")).collect()] == [("a", 2, 0)]
    empty = Dictionary.build(spark.createDataFrame([], "xml string"), rules)
    assert empty.entries.count() == 0 and empty.lookup(texts).count() == 0


def test_rules_close_to_the_end(spark):
    words = spark.createDataFrame([("ing" * 9,), ("られ" * 8 + "る",)], "w string")
    deepest = lambda rules: inflection.closure(words, rules).agg(F.max("depth")).head()[0]
    assert deepest([("ing", "", 3, 2, "-ing", 0)]) == 8 and deepest(inflection.japanese_rules()) >= 8


def test_html(spark):
    page = spark.createDataFrame([(1, "<p>a<b>b</b><!-- c --><ruby>漢<rt>かん</rt></ruby> d</p><div>e</div><script>x</script>"), (2, None)], "page_id bigint, html string")
    assert [r.text for r in html_text.segments(page).orderBy("seg_ix").collect()] == ["ab漢 d", "e"]


def test_statistics(spark):
    assert tuple(entries.length_stats(spark.createDataFrame([("a",), ("bbb",), ("cc",), (None,)], "t string"), "t").head())[:2] == (1, 3)
    counts = spark.createDataFrame([("a", 9), ("b", 9), ("c", 7), ("d", 1)], "w string, n bigint")
    assert {r.w: r.rnk for r in frequency.ranked(counts).collect()} == {"a": 0, "b": 1, "c": 2}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("abc\n")
    index = spark.createDataFrame([("ab", 1, 0)], "key string, entry_id bigint, pos_mask int")
    got = []
    query = live_lookup.start(spark.readStream.schema("text string").text(f"file://{tmp_path}/in"), index, None, inflection.european_rules(), lambda df, n: got.extend(df.collect()), f"file://{tmp_path}/cp")
    query.awaitTermination(120)
    assert [(r.w, r.entry_id) for r in got] == [("abc", 1)]
