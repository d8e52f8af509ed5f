"""Hard cases of single operators and of the pipeline: ties, repeats, odd white space, planted groups, and brute force over all pairs."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexis.llm import common, decontamination, line_dedup, near_dedup, quality, secrets, substring_dedup, token_counts, toxicity

from test_operators import ODD, brute_lines, brute_near, brute_repeats, docs, rows_of

P = pytest.importorskip("public_tokenizers")


# 2


def test_long_words_through_composed_maps():
    counter, r = token_counts.Counter(P.path("byte_bpe_50k.json")), random.Random(4)
    words = ["a" * 3000, "ab" * 700, "the" * 900, "日本語" * 400, "".join(r.choice("abcdeéfgh") for _ in range(5000))]
    for word in (w.encode() for w in words):
        assert counter.scan(word) == counter.machine.run(0, word)[1]
        chunks = [word[a : a + token_counts.CHUNK] for a in range(0, len(word), token_counts.CHUNK)]
        maps = counter.maps(chunks)
        upto = token_counts.prefixes(maps)
        state = total = 0
        for chunk, own, prefix in zip(chunks, maps, upto):
            assert own[state] == counter.machine.run(state, chunk)
            state, n = own[state]
            total += n
            assert prefix[0] == (state, total)


# 3


def brute_overlaps(text, item):
    """Whether the item is found in the text: all shifts, all stretches."""
    best = 0
    for shift in range(-len(item) + 1, len(text)):
        a, b = max(shift, 0), min(shift + len(item), len(text))
        same = [text[i] == item[i - shift] for i in range(a, b)]
        share = (4, 5) if len(item) >= decontamination.SPAN else (1, 1)
        for i in range(len(same)):
            equal = 0
            for j in range(i, len(same)):
                equal += same[j]
                n = j + 1 - i
                if same[i] and same[j] and 5 * equal >= 4 * n and (n >= decontamination.LEAST or share[1] * equal >= share[0] * len(item)):
                    best = max(best, n)
        if share[1] * sum(same) >= share[0] * len(item):
            best = max(best, 1)
    return best > 0


def test_overlaps_by_brute_force(spark):
    r = random.Random(11)
    items = [(n, [f"w{r.randint(0, 60)}" for _ in range(size)]) for n, size in enumerate((3, 8, 11, 12, 14, 19, 20, 21, 25, 33, 40, 20))]
    items[-1] = (11, items[6][1])
    texts = []
    for d in range(60):
        w = [f"w{r.randint(0, 60)}" for _ in range(r.randint(0, 40))]
        if d % 6:
            part = list(r.choice(items)[1])
            for _ in range(r.randint(0, 1 + len(part) // 4)):
                part[r.randrange(len(part))] = f"z{r.randint(0, 9)}"
            cut = r.randint(0, 6) if r.random() < 0.4 else 0
            at = r.randint(0, len(w))
            w[at:at] = part[cut:]
        texts.append((d, " ".join(w)))
    texts += [texts[1], texts[1], (None, texts[2][1]), (99, None), (98, "")]
    want = collections.Counter((d, n) for d, t in texts for n, item in items if brute_overlaps((t or "").split(), item))
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items] + [(50, None), (51, "")], "item_id long, text string")
    found = decontamination.find_overlaps(docs(spark, texts), bench)
    assert collections.Counter((x.doc_id, x.item_id) for x in found.collect()) == want and len(want) > 30
    twice = bench.unionByName(bench)
    assert decontamination.find_overlaps(docs(spark, texts), twice).count() == 2 * found.count()
    kept = decontamination.without_leaks(docs(spark, texts), twice)
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(d for d, _ in texts if d is not None and not any(k[0] == d for k in want))


def test_blocks_are_bounded(spark):
    bench = spark.createDataFrame([(n, f"item {n} " * 20) for n in range(300)] * 3, "item_id long, text string")
    for blocks in (list(decontamination.blocks_of(bench, block=60)), list(decontamination.blocks_of(bench, size=4000))):
        assert len(blocks) > 8 and sorted(x[0] for b in blocks for x in b) == list(range(300)) and all(x[2] == 3 for b in blocks for x in b)


def test_overlap_of_a_very_long_text():
    item = [f"w{i}" for i in range(30)]
    block = decontamination.Benchmark([(1, " ".join(item))])
    text = decontamination.tokens(" ".join([*("noise" for _ in range(200_000)), *item]))
    assert block.overlaps(text) == [(1, 200_000, 0, 30, 30)]


# 5


def test_form_feeds_and_letters_f(spark):
    texts = [(1, "fff if of\f\x0bf"), (2, "f"), (3, "\f f \f")]
    got = {x.doc_id: (x.n_words, x.word_chars) for x in quality.measured(docs(spark, texts)).collect()}
    assert got == {1: (4, 8), 2: (1, 1), 3: (1, 1)}


def test_cascade_skips_what_is_not_asked(spark):
    df = docs(spark, [(1, "short"), (2, " ".join(f"w{i}" for i in range(80)))])
    rules = list(quality.RULES)
    lazy = {x.doc_id: x for x in quality.cascade(df, rules).collect()}
    assert lazy[1]["__q_failed"] == "too_short" and lazy[1]["__q_n_upper"] is None and lazy[2]["__q_n_upper"] == 0
    some = {x.doc_id: x for x in quality.cascade(df, rules, quality.REPORTED).collect()}
    assert some[1]["__q_n_repeat_words"] == 0 and some[1]["__q_n_upper"] is None
    order = [r.name for r, _, _ in quality.ordered(df)]
    assert sorted(order) == sorted(r.name for r in rules) and order[0] == "too_short"


# 6


def test_toxicity_of_repeats_and_ties(spark):
    rows = [(i, ("grumbler " if i % 2 else "lovely ") + f"w{i % 7} stands here") for i in range(120)]
    rows += rows[:4] + [(500, "lovely " * 30000), (501, "grumbler"), (501, "grumbler")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    df = docs(spark, rows)
    got = toxicity.score_toxicity(df, toxicity.fit(df, labels)).collect()
    assert len(got) == len(rows)
    scores = collections.defaultdict(set)
    for x in got:
        scores[x.doc_id].add((x.score, x.predicted))
    assert all(len(v) == 1 for v in scores.values()) and [x.predicted for x in got if x.doc_id in (500, 501)] == [0, 1, 1]


# 7


def test_recall_on_planted_groups(spark):
    """With the parameters of production: near copies of all similarities around the threshold, and large groups."""
    r, rows = random.Random(12), []
    for g in range(60):
        base = [f"g{g}w{r.randint(0, 3000)}" for _ in range(r.randint(40, 90))]
        for _ in range(700 if g == 0 else 12):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"z{r.randint(0, 5000)}"
            rows.append((len(rows), " ".join(w)))
    want = {(d, c) for d, _, c, _ in brute_near_grouped(rows)}
    got = {(x.doc_id, x.component_id) for x in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert len(got & want) / len(want) >= 0.99


def brute_near_grouped(rows):
    """Brute force, group by group: texts of different groups share no words but changed ones."""
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[collections.Counter(w.split("w")[0] for w in t.split()).most_common(1)[0][0]].append((d, t))
    return [x for held in groups.values() for x in brute_near(held)]


# 8


def test_planted_random_strings(spark):
    r, rows, planted, plain = random.Random(13), [], 0, 0
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names = ["Response", "Customer", "Request", "Handler", "Version", "Report", "Address", "Manager", "Builder", "Counter"]
    for d in range(200):
        if d % 2:
            rows.append((d, "here is " + "".join(r.choice(alphabet) for _ in range(r.randint(28, 44))) + " and more"))
            planted += 1
        else:
            rows.append((d, "see " + "".join(r.choice(names) for _ in range(4)) + str(r.randint(1, 99)) + " or 2024-01-" + "0" * 14 + " or www/reports/index" + str(d) + "/annual-report"))
            plain += 1
    got = {x.doc_id: x.n_random for x in secrets.find_secrets(docs(spark, rows)).collect()}
    found = sum(got[d] > 0 for d, _ in rows if d % 2)
    false = sum(got[d] > 0 for d, _ in rows if not d % 2)
    assert found / planted >= 0.85 and false / plain <= 0.1, (found, planted, false, plain)


# 9


def test_a_thousand_equal_rows(spark):
    r = random.Random(14)
    same, other = [f"w{r.randint(0, 999)}" for _ in range(200)], [f"x{r.randint(0, 999)}" for _ in range(60)]
    rows = [(7, " ".join(same))] * 1000 + [(8, " ".join(other + same[20:70] + other)), (9, " ".join(other[:34])), (9, " ".join(other[:34])), (10, " ".join(other[:30]))] + ODD
    assert rows_of(substring_dedup.remove_repeats(docs(spark, rows))) == brute_repeats(rows, 35)


# 10


def test_lines_of_odd_white_space(spark, monkeypatch):
    w = [f"w{i}" for i in range(12)]
    texts = [" ".join(w), "\t".join(w) + " ", "  " + "  ".join(w[:6]) + "\r" + "\f".join(w[6:]) + "\n \n x", " x\n\x0b", "x \n y", "f", " f", "of"]
    rows = list(enumerate(texts)) + [(None, "same line stands here"), (0, "same line stands here"), (None, "same line stands here"), (None, "z"), (0, "x\ty")]
    df = docs(spark, rows)
    monkeypatch.setattr(line_dedup, "table", lambda *a: df)
    order = sorted(set(rows), key=lambda x: x[0] or 0)
    ranked = {row: n for n, row in enumerate(order)}
    got = {(x.doc_id, x.n_lines, x.n_removed) for x in line_dedup.op10_line_dedup(spark, "").collect()}
    assert {(1, 1, 1), (2, 3, 1), (4, 2, 1), (6, 1, 1), (7, 1, 0), (5, 1, 0)} <= got and len(ranked) == len(set(rows))
    # one of the two documents of the same text keeps its line: ids of null and 0 don't make them one
    same = [x for x in line_dedup.op10_line_dedup(spark, "").collect() if x.kept_sha256 == hashlib.sha256(b"same line stands here").hexdigest()]
    assert {x.doc_id for x in same} in ({None}, {0})


def test_buckets_change_nothing(spark, monkeypatch):
    r = random.Random(15)
    rows = [(d, "\n".join(" ".join(f"w{r.randint(0, 30)}" for _ in range(12)) for _ in range(8))) for d in range(40)]
    df = docs(spark, rows)
    monkeypatch.setattr(line_dedup, "table", lambda *a: df)
    want = brute_lines(rows)
    for buckets in ((2, 2), (1 << 10, 1 << 10), (1 << 17, 1 << 17)):
        monkeypatch.setattr(line_dedup, "BUCKETS", buckets)
        assert rows_of(line_dedup.op10_line_dedup(spark, "")) == want


# pipeline and helpers


def test_pipeline_on_odd_tables(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(16)
    long = lambda: " ".join(f"w{r.randint(0, 50000)}" for _ in range(120))
    good = long()
    rows = [*ODD, (50, good), (50, good), (51, good), (None, long()), (52, long() + "\n" + long()), (53, " ".join(f"w{r.randint(0, 9999)}" for _ in range(30000)))]
    names = "doc_id long, text string, lang string, source string, n_chars long, key int, start string, __d long, root string"
    df = spark.createDataFrame([(d, t, "en", None, None, 1, "s", 3, "r") for d, t in rows], names)
    for given in (df, df.limit(0)):
        held = given
        for name, stage in pipeline.STAGES[:-1]:
            out = common.saved(stage(spark, held, "/root/testdata/sf0.001"), "stage")
            assert out.columns == given.columns, name
            held = out
        pieces = pipeline.STAGES[-1][1](spark, held, "/root/testdata/sf0.001")
        kept = [x.doc_id for x in held.collect()]
        assert sorted({x.doc_id for x in pieces.collect()}, key=repr) == sorted(set(kept), key=repr)
        assert not kept or (collections.Counter(kept)[50] == 1 and {52, 53, None} <= set(kept) and not {1, 2, 3, 4, 6, 51} & set(kept))


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        sparkContext = Context()

    with pytest.raises(RuntimeError):
        common.checkpoint_root(Session())
    step = common.saved(spark.range(3), "step")
    assert step.count() == 3
    common.discard(step, None, spark.range(2))
    with pytest.raises(Exception):
        spark.read.parquet(step.saved_path).count()


def test_among_keeps_all_that_match(spark):
    rows = spark.range(5000).select(F.col("id").alias("d"), (F.col("id") * 7).alias("t"))
    places = rows.filter("d % 50 = 0")
    for bits in (64, 1 << 12, 1 << 20):
        kept = common.among(rows, places, ["d", "t"], bits)
        assert kept.join(places, ["d", "t"]).count() == 100 and (bits < 1 << 20 or kept.count() < 200)
    assert common.among(rows, places.limit(0), ["d", "t"]).count() == 0
