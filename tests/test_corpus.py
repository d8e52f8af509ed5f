"""Counting over a corpus, text nodes, source positions, candidates and brackets, against rows written by hand."""

import pytest
from pyspark.sql import functions as F

from lexis.functions.kana import folded_with_map
from lexis.operators import candidates, corpus, inflection, lookup
from lexis.sources import html_text
from lexis.steps import Steps

TOKEN = "sent string, copies bigint, tokens array<struct<key: string, surface: string, orth: string, orth_base: string, folded: string, pron: string, pron_base: string, known: boolean, lemma: string, proper: boolean>>"
FORM = "entry_id bigint, kanji_keys array<string>, readings array<struct<key: string, nokanji: boolean, uk: boolean>>"


def token(word):
    """Capitals are proper nouns; a word with ? is unknown; marks are written but not spoken."""
    plain = word.replace("*", "").lower()
    known = "?" not in word
    return (plain if known else word, word, word.lower(), word.lower(), plain, plain if known else ".+", plain if known else ".+", known, plain, word[0].isupper())


def sentences(spark, texts):
    return spark.createDataFrame([(name, copies, [token(w) for w in text.split()]) for name, copies, text in texts], TOKEN)


def test_phrases_of_any_length_and_validity_at_each_end(spark):
    rows = sentences(spark, [("a", 1, "x one two three four five six y"), ("b", 2, "one two three four five"), ("c", 1, "go* home now go home now"), ("d", 1, "old? home"), ("e", 5, ""), ("f", 1, "one one two")])
    phrases = [(["one", "two", "three", "four", "five", "six"], 1), (["one", "two"], 2), (["two", "three"], 3), (["go", "home"], 4), (["go", "home"], 5), (["go", "home", "now"], 6), (["go", "home", "now"], 7), (["old?", "home"], 8), (["old?", "home"], 9), ([], 99)]
    forms = [(4, ["go*home"], []), (5, [], [("gohome", False, False)]), (6, ["nowhere"], []), (7, ["elsewhere"], []), (8, ["newhome"], []), (9, [], [("anyhome", False, False)])]
    steps = Steps(spark)
    phrases = spark.createDataFrame(phrases, "words array<string>, entry_id bigint")
    hits = corpus.hits(rows, phrases, spark.createDataFrame(forms, FORM), steps)
    walk = corpus.walked(rows, hits)
    got = {r.sent: ([tuple(x) for x in r.taken], r.single) for r in walk.collect()}
    # the longest end that is valid counts: 6 and 7 fit nowhere, 4 by its writing, 5 by its sound as that place reads as it is written
    assert got == {
        "a": ([(1, 6, 1)], [0, 7]), "b": ([(0, 2, 2)], [2, 3, 4]), "c": ([(0, 2, 4), (3, 2, 5)], [2, 5]), "d": ([(0, 2, 9)], []), "e": ([], []), "f": ([(1, 2, 2)], [0]),
    }
    text = {r.sent: r.text for r in corpus.split_text(walk).collect()}
    assert text["a"] == "x onetwothreefourfivesix y" and text["c"] == "go*home now gohome now" and text["e"] == ""
    mapping = spark.createDataFrame([("x", "one", None, 50), ("three", "star", None, 51), ("three", "star", None, 52), ("four", "writing", "fo*ur", 53), ("now", "writing", "now", 54), ("now", "writing", "no*w", 55)], "lemma string, kind string, writing string, entry_id bigint")
    names = spark.createDataFrame([("five", 60), ("x", 61)], "lemma string, entry_id bigint")
    counts = {r.entry_id: r.n for r in corpus.counted(rows, phrases, spark.createDataFrame(forms, FORM), mapping, names).collect()}
    assert counts == {1: 1, 2: 3, 4: 1, 5: 1, 9: 1, 50: 1, 51: 2, 52: 2, 54: 2}
    steps.discard()


def test_phrases_of_one_key_and_tokens_made_of_texts(spark):
    texts = spark.createDataFrame([("a", 1, "x y z"), ("b", 2, "y"), ("c", 1, ""), ("d", 1, "w x"), ("e", 1, "z y z w")], "sent string, copies bigint, text string")
    made = "transform(filter(split(text, ' '), w -> w <> ''), w -> named_struct('key', w, 'surface', w, 'orth', w, 'orth_base', w, 'folded', w, 'pron', w, 'pron_base', w, 'known', true, 'lemma', w, 'proper', false))"
    phrases = spark.createDataFrame([(["y"], 1), (["x", "y", "q"], 2), (["z", "w"], 3), (["x"], 4), (["x"], 5), (["q"], 6)], "words array<string>, entry_id bigint")
    forms = spark.createDataFrame([(4, ["other"], []), (5, ["x"], [])], FORM)
    steps = Steps(spark)
    for rows, tokens in ((texts, made), (texts.select("sent", "copies", F.expr(made).alias("tokens")), None)):
        walk = corpus.walked(rows, corpus.hits(rows, phrases, forms, steps, tokens), tokens)
        assert {r.sent: ([tuple(x) for x in r.taken], r.single) for r in walk.collect()} == {
            "a": ([(0, 1, 5), (1, 1, 1)], [2]), "b": ([(0, 1, 1)], []), "c": ([], []), "d": ([(1, 1, 5)], [0]), "e": ([(1, 1, 1), (2, 2, 3)], [0]),
        }
        assert {r.sent: r.text for r in corpus.split_text(walk, tokens).collect()}["e"] == "z y zw"
    left = corpus.met(phrases, texts, made).select("entry_id").collect()
    assert sorted(r.entry_id for r in left) == [1, 2, 3, 4, 5]  # 2 isn't found, but x leads as far as its second key
    steps.discard()


def test_names_count_where_nothing_is_mapped(spark):
    rows = sentences(spark, [("a", 3, "Five X five no*w Now")])
    none = spark.createDataFrame([], "words array<string>, entry_id bigint")
    mapping = spark.createDataFrame([("x", "one", None, 50), ("now", "writing", "now", 54)], "lemma string, kind string, writing string, entry_id bigint")
    names = spark.createDataFrame([("five", 60), ("five", 62), ("x", 61)], "lemma string, entry_id bigint")
    counts = {r.entry_id: r.n for r in corpus.counted(rows, none, spark.createDataFrame([], FORM), mapping, names).collect()}
    assert counts == {50: 3, 54: 6, 60: 3, 62: 3}  # no*w counts by its folded form


def test_sampling_by_key_is_stable(spark):
    rows = spark.range(4000).select((F.col("id") % 2000).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 2000).alias("b"))
    some = corpus.sampled(rows, ["a", "b"], 0.1, 3)
    assert sorted(map(tuple, some.collect()), key=repr) == sorted(map(tuple, corpus.sampled(rows.repartition(7).orderBy("b"), ["a", "b"], 0.1, 3).collect()), key=repr)
    assert 250 < some.count() < 550 and corpus.sampled(rows, ["a"], 0.1, 4).subtract(corpus.sampled(rows, ["a"], 0.1, 3)).count() > 0


HTML = "<div>One <b>two</b>. Thr<i>ee f</i>our<!-- x --> <ruby>kan<rt>read</rt>ji</ruby>, five! Six</div><p> seven</p>"


def test_nodes_and_sentences_across_them(spark):
    nodes = html_text.nodes(spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id bigint, html string"))
    rows = nodes.orderBy("seg_ix", "node_ix").collect()
    assert [(r.text, r.start, r.ruby) for r in rows] == [("One ", 0, False), ("two", 4, False), (". Thr", 7, False), ("ee f", 12, False), ("our ", 16, False), ("kan", 20, False), ("read", 23, True), ("ji", 23, False), (", five! Six", 25, False), (" seven", 0, False)]
    found = html_text.sentence_at(nodes)
    found = html_text.nodes_at(html_text.nodes_at(found, nodes, "head", "from"), nodes, "tail", "to", end=True)
    by = {r.start if r.seg_ix == rows[0].seg_ix else -1: r for r in found.collect()}
    assert len(by) == 9  # none in ruby
    assert by[4].context == "two" and by[12].context == "Three four kanji, five" and by[20].context == "kanji, five"
    at = {(r.text, r.start): r.node_ix for r in rows if not r.ruby}
    assert (by[12].from_node, by[12].from_offset, by[12].to_node, by[12].to_offset) == (at[". Thr", 7], 1, at[", five! Six", 25], 6)
    assert (by[4].from_node, by[4].to_node, by[4].to_offset) == (at["One ", 0], at["two", 4], 3) and by[-1].context == "seven"


def test_matches_in_the_source(spark):
    texts = spark.createDataFrame([("ｶﾞｷﾞs",), ("𠮟るx",), ("",), (None,)], "text string")
    sources = lookup.sources(texts)
    index = spark.createDataFrame([("がぎ", 1, 0), ("が", 2, 0), ("𠮟る", 3, 0)], "key string, entry_id bigint, pos_mask int")
    hits = lookup.located(lookup.lookup(sources, index, None, inflection.european_rules()), sources)
    assert {(r.text, r.entry_id, r.match_units, r.match_chars, r.matched) for r in hits.collect()} == {("ｶﾞｷﾞs", 1, 4, 4, "ｶﾞｷﾞ"), ("ｶﾞｷﾞs", 2, 2, 2, "ｶﾞ"), ("𠮟るx", 3, 3, 2, "𠮟る")}
    two = spark.createDataFrame([("aßb",)], "w string").select(folded_with_map("w", "concat(acc, replace(lower(c), 'ß', 'ss'))").alias("f")).first().f
    assert (two.s, two["map"]) == ("assb", [0, 1, 2, 2, 3])


def test_cascade(spark):
    rows = [("a", 1, ["v5aru"], ["x"]), ("a", 2, ["n"], ["y"]), ("a", 3, ["v5r"], ["y"]), ("b", 4, ["n"], ["x"]), (None, 5, None, ["y"]), (None, 6, ["v5r"], None)]
    frame = spark.createDataFrame(rows, "g string, id int, pos array<string>, forms array<string>").withColumn("asked", F.array(F.lit("v5r")))
    got = candidates.cascade(frame, ["g"], {"pos": candidates.has_pos("pos", "asked"), "form": candidates.has_form("forms", "'y'")})
    assert {(r.g, r.id, tuple(r.skipped)) for r in got.collect()} == {("a", 3, ()), ("b", 4, ("pos", "form")), (None, 6, ("form",))}
    sets = spark.createDataFrame([(1, ["k"], ["r"], ["k"], ["r"]), (2, ["k"], ["r"], [], ["r"]), (3, [], ["r"], [], ["r"]), (4, [], [], [], [])], "id int, a array<string>, b array<string>, c array<string>, d array<string>")
    assert [r.ok for r in sets.orderBy("id").select(candidates.shares_forms("a", "b", "c", "d").alias("ok")).collect()] == [True, False, True, True]


@pytest.mark.parametrize(
    "text,parts,open_,problem",
    [
        ("とる【取る（一般), 録る】後", ["とる", "【", "取る（一般"], "【（", "crossed"),
        ("とる【取る（一般）, 録る】後", ["とる", "【", "取る（一般, 録る", "】", "後"], "", None),
        ("a(b)", ["a", "(", "b", ")"], "", None), ("a)b", ["a"], "", "unopened"), ("(a", ["", "(", "a"], "(", None), ("", [], "", None), ("a[b(c)", ["a", "[", "b(c"], "[", None),
    ],
)
def test_brackets(spark, text, parts, open_, problem):
    row = candidates.bracketed(spark.createDataFrame([(text,), (None,)], "text string")).orderBy(F.col("text").asc_nulls_last()).first()
    assert (row.parts, row.open, row.problem) == (parts, open_, problem)


def test_elements(spark):
    rows = candidates.bracketed(spark.createDataFrame([("覆水（ふくすい）盆（ぼん）【x】に",), ("色",)], "text string"))
    got = {r.text: [tuple(x) for x in r.e] for r in rows.select("text", candidates.elements().alias("e")).collect()}
    assert got["色"] == [("色", None, None)] and [x for x in got["覆水（ふくすい）盆（ぼん）【x】に"] if x[0]] == [("覆水", "ふくすい", None), ("盆", "ぼん", None), ("に", None, None)]
