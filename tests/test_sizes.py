"""What crosses the driver, what is shuffled, and that queries do their whole job."""

import pytest
from pyspark.sql import functions as F

from lexis.operators import corpus, frequency
from lexis.plans import catalogue
from lexis.steps import Steps

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["phrase_hits", "greedy_tokenise"])
def test_grams_are_not_broadcast(spark, name):
    text = plan(catalogue.queries()[name](spark, SF))
    assert text.count("BroadcastExchange") == 1 and "BuildLeft" not in text and "BuildRight" in text
    assert "Exchange hashpartitioning(gram" not in text


def test_grams_are_not_broadcast_for_phrases_of_unknown_size(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", F.split("text", " ").alias("words"))
    assert "BroadcastExchange" not in plan(frequency.phrase_hits(rows, spark.createDataFrame([("of the",)], "phrase string"), ["conv_id", "turn"]))


PARTS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def result(spark, monkeypatch, module, name, **tables):
    """The rows of a query over hand-made tables (rows, schema)."""
    monkeypatch.setattr(module, "table", lambda s, d, t: s.createDataFrame(*tables[t]))
    return sorted(map(tuple, catalogue.queries()[name](spark, "").collect()))


def test_any_order_lists_a_customer(spark, monkeypatch):
    from lexis.plans import lookup_queries

    orders = ([(1, 5.0), (1, 400000.0), (2, 5.0)], "o_custkey long, o_totalprice double")
    assert result(spark, monkeypatch, lookup_queries, "review_anti", customer=([(1,), (2,), (3,)], "c_custkey long"), orders=orders) == [(3,)]


def test_readings_of_all_writings_of_words_and_names(spark, monkeypatch):
    from lexis.plans import dictionary_queries

    parts = [(1, "old ring", "Brand#1", "LARGE", 5), (7, "hot bolt", "Brand#2", "SMALL", 7), (8, "new gear", "Brand#3", "SMALL", 30)]
    rows = result(spark, monkeypatch, dictionary_queries, "reading_restriction_inversion", part=(parts, PARTS))
    assert rows == [(1, "0,1", "Brand-1"), (1, "1", "LARGE,size-5"), (7, "0", "Brand-2,SMALL"), (7, "0,1", "size-7"), (8, "", "size-30"), (8, "0", "Brand-3,SMALL")]


def test_contents_have_names_and_marks(spark, monkeypatch):
    from lexis.plans import dictionary_queries

    parts = [(1, "old ring", "Brand#1", "LARGE", 26), (7, "hot bolt", "Brand#2", "SMALL", 8)]
    rows = result(spark, monkeypatch, dictionary_queries, "dictionary_contents", part=(parts, PARTS))
    assert rows == [(1, "Brand-1", "old,ringU", "n;LARGE`size 26"), (7, "Brand-2", "hot,bolt", "c;SMALL")]


def test_glosses_that_romanise_are_left_out(spark, monkeypatch):
    from lexis.plans import source_queries

    parts = [(k, "old ring", "Brand#1", "LARGE", s) for k, s in ((41, 2), (47, 4), (43, 3), (44, 1), (45, 1))]
    rows = result(spark, monkeypatch, source_queries, "redundant_gloss", part=(parts, PARTS))
    assert rows == [(41, "c"), (43, "d,LARGE;chita; old ring"), (44, "d;old ring"), (45, "d;old; ring"), (47, "c")]


@pytest.mark.parametrize("name", ["xml_entries", "entry_line_encode", "entry_line_decode", "dictionary_index", "dictionary_contents", "reading_restriction_inversion"])
def test_elements_of_a_small_file_are_many_tasks(spark, name):
    below = [x.split("\n")[1] for x in plan(catalogue.queries()[name](spark, SF)).split("RoundRobinPartitioning(16)")[1:]]
    assert below and all("Scan" in x or "ColumnarToRow" in x for x in below)


def test_each_edge_is_moved_once(spark, monkeypatch):
    """The rows of edges that the levels' joins take are, but for copies of the root's, as many as there are edges."""
    texts = spark.createDataFrame([("a b c d x a b y a",), ("b c d",)], "text string")
    token = "named_struct('key', w, 'surface', w)"
    sentences = corpus.distinct_sentences(texts).select("sent", "copies", F.expr(f"transform(split(text, ' '), w -> {token})").alias("tokens"))
    edges = corpus.trie(spark.createDataFrame([(["a", "b", "c", "d"], 1), (["a", "b"], 2), (["b", "c"], 3), (["x"], 4)], "words array<string>, entry_id long")).cache()
    taken, join = [], type(edges).join
    monkeypatch.setattr(type(edges), "join", lambda self, other, *a, **k: taken.append(other.count()) or join(self, other, *a, **k))
    steps = Steps(spark)
    found = sorted((len(r.node), r.n, r["first"]) for r in corpus.descents(sentences, edges, 4, steps).collect())
    steps.discard()
    assert found == [(1, 0, None)] * 6 + [(1, 1, 4)] + [(2, 1, 2)] * 2 + [(2, 1, 3)] * 2 + [(3, 0, None), (4, 1, 1)]
    assert sum(taken) == corpus.SALTS * 3 + edges.count() - 3


@pytest.mark.parametrize("name", ["learned_pos", "mapped_ids", "align_lexicons", "multi_cond_match", "names_match"])
def test_texts_are_cut_into_words_once(spark, monkeypatch, name):
    from lexis.plans import corpus_queries

    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda text: read.add(1) or text).asNondeterministic()
    texts = {"documents": ["The big rings turned", "old bolts, éclair", None], "conversations": ["an old ring, a Bolt", "quickly turned eclair"]}
    monkeypatch.setattr(corpus_queries, "table", lambda s, d, t: s.createDataFrame([(x,) for x in texts[t]], "text string").select(seen("text").alias("text")))
    catalogue.queries()[name](spark, "").collect()
    assert read.value == 5


WALK = {"documents": ["Big rings turn. old bolts turned, never met", "big rings turn", "big rings, gone away, the big bolts", None], "conversations": ["The big rings turn old bolts turned", "Big bolts", "", None], "benchmark": ["The one"]}


@pytest.mark.parametrize("name", ["corpus_counts", "split_corpus"])
def test_only_phrases_that_can_be_met_and_no_tokens_are_kept(spark, monkeypatch, name):
    from lexis.plans import corpus_queries

    kept, saved = [], Steps.saved
    monkeypatch.setattr(corpus_queries, "table", lambda s, d, t: s.createDataFrame([(x,) for x in WALK[t]], "text string"))
    monkeypatch.setattr(Steps, "saved", lambda self, df: kept.append((df.columns, saved(self, df), df.columns == ["part"] and {r.part for r in df.collect()})) or kept[-1][1])
    rows = [tuple(r) for r in catalogue.queries()[name](spark, "").collect()]
    if name == "split_corpus":
        assert {text for _, text in rows} == {"The bigringsturn oldboltsturned", "Big bolts", ""}
    else:
        assert len(rows) == 5 and {n for _, n in rows} == {1}  # two phrases, big and bolts, and the name
    assert not any("tokens" in columns for columns, _, _ in kept)
    assert [parts for _, _, parts in kept if parts] == [{"big rings turn", "big rings", "old bolts turned"}]
