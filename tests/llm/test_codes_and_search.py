"""Operators 11 to 13: brute force, libraries, and odd rows."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexis.llm import byte_pairs, lexical_search, vector_codes

from test_operators import ODD

P = pytest.importorskip("public_tokenizers")

# 11


def brute_codes(rows, parts, entries, rounds):
    """Plain Python over unlimited integers: code, error and label error of each kept row in order of (id, components), and the codebooks."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = len(kept[0][2]) // parts if kept else 0
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        members = {}
        for _, _, v in kept:
            for p in range(parts):
                members.setdefault((p, near(v, p)[1]), []).append(cut(v, p))
        for (p, e), of in members.items():
            books[p][e] = [sum(x) // len(of) for x in zip(*of)]
    found = [(i, label, [near(v, p) for p in range(parts)]) for i, label, v in kept]
    per = Counter()
    for _, label, best in found:
        per[label] += sum(d for d, _ in best)
    return sorted(((i, label, [e for _, e in best], sum(d for d, _ in best), per[label]) for i, label, best in found), key=repr), books


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("codes", F.lit("x")).withColumn("vector", F.lit(1)).repartition(3)


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_codes_by_brute_force(spark, scale):
    r = random.Random(5)
    value = lambda: float(np.float32(r.choice([-1, 1]) * r.random() * scale))
    rows = [(n, [value() for _ in range(8)], r.choice([0, 0, 0, 1, None])) for n in range(60)]
    rows += [rows[3], rows[3], (None, [value() for _ in range(8)], 1), (70, None, 0), (71, [None] * 8, 0), (72, [float("nan")] * 8, 0), (73, [float("inf")] + [0.0] * 7, 1), (74, [], 0), (75, [1.0], 0), (-1, rows[5][1], 2), (-1, rows[6][1], 2)]
    coded, books = vector_codes.compress(vectors(spark, rows), 4, 16, 3)
    got = sorted(map(tuple, vector_codes.with_label_errors(coded).select("vec_id", "label", "codes", "error", "label_error").collect()), key=repr)
    want, brute = brute_codes(rows, 4, 16, 3)
    assert got == want and [b.tolist() for b in books] == brute


def test_codes_of_huge_components_and_few_rows(spark):
    rows = [(1, [1e12, 0.0], 0), (2, [1e12, 1024.0], 0), (3, [-1e11, 5.0], None)]
    coded, _ = vector_codes.compress(vectors(spark, rows), 2, 2, 2)
    want, _ = brute_codes([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows], 2, 2, 2)
    if all(w[3] < 1 << 63 for w in want):
        assert sorted(map(tuple, vector_codes.with_label_errors(coded).select("vec_id", "label", "codes", "error", "label_error").collect()), key=repr) == want
    else:
        with pytest.raises(Exception, match="(?i)overflow|too large|out of|int"):
            coded.collect()
    assert vector_codes.compress(vectors(spark, []), 4, 16, 2)[0].collect() == []
    empty, _ = vector_codes.compress(vectors(spark, [(1, [], 3)]), 4, 16, 2)
    assert [tuple(x) for x in empty.select("vec_id", "codes", "error").collect()] == [(1, [0, 0, 0, 0], 0)]
    with pytest.raises(ValueError):
        vector_codes.compress(vectors(spark, [(1, [1.0, 2.0, 3.0], 0)]), 2)


# 12


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_pairs.ranks_of(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


@pytest.mark.parametrize("common", [1 << 18, 3])
def test_bytes_as_the_library(spark, library, common):
    path, r = P.path("byte_bpe_multi_50k.tiktoken"), random.Random(8)
    texts = [t and t[:4000] if t != ODD[6][1] else t[:300] for _, t in ODD] + ["", "!", "!!!! !", "\0a\0", "a  b c \r\n\t x", "we'll they've I'm 's 'S x't", "日本語 ひらがな 𠮟る 👍🏽 é", "ࡰ࢏ Ɤ \U00010d40\U00010d49 \U0001e5f1", "<|endoftext|> x", "a" * 700, "".join(r.choice("abcdefghéß") for _ in range(900)), " " * 90 + "x", "12345678901234567890"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x300), r.randrange(0x3040, 0x30FF), r.randrange(0x10000, 0x1FFFF)])) for _ in range(60)) for _ in range(40)]
    texts += [texts[0], None]
    rows = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id bigint, text string, ids string").repartition(3)
    coded = byte_pairs.decode(byte_pairs.encode(rows, path, P.PATTERN, common), path)
    got = coded.select("doc_id", byte_pairs.ids(F.col("signs"), path).alias("own"), byte_pairs.number_bytes(F.col("signs"), path).alias("numbers"), "decoded").collect()
    assert len(got) == len(texts)
    for row in got:
        want = library.encode_ordinary(texts[row.doc_id] or "")
        assert row.own == want and bytes(row.numbers) == struct.pack(f"<{len(want)}I", *want) and bytes(row.decoded) == (texts[row.doc_id] or "").encode()
    assert byte_pairs.encode(rows.limit(0), path, P.PATTERN).collect() == []


@pytest.mark.parametrize("common", [0, byte_pairs.COMMON])
def test_round_trip_by_words(spark, library, common):
    """Numbers and bytes of common and of other words."""
    path, own = P.path("byte_bpe_multi_50k.tiktoken"), library
    texts = ["", None, "naïve naïve! 12\0", "!!! \r\n  x", "日本 \U0001f600 \u00ff"]
    got = byte_pairs.round_trip(spark.createDataFrame(enumerate(texts), "doc_id bigint, text string"), path, P.PATTERN, common).collect()
    for row in got:
        ids = own.encode_ordinary(texts[row.doc_id] or "")
        assert bytes(row.numbers) == struct.pack(f"<{len(ids)}I", *ids) and bytes(row.decoded) == own.decode_bytes(ids)
    assert len(got) == len(texts)


def test_literals_of_pairs_and_words(spark):
    """Each pair's result is found in the small texts, a pair that makes nothing isn't, and in a small map the more frequent words come first."""
    ranks = {bytes((b,)): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"aa": 259, b"aaa": 260}
    pairs = spark.range(1).select(byte_pairs.pairs_literal(spark, ranks).alias("texts")).first().texts
    at = "".join(pairs)
    assert len(pairs) == byte_pairs.BUCKETS and all(text.startswith(byte_pairs.NONE) for text in pairs)
    assert {at.split(byte_pairs.NONE + pair)[1][0] for pair, _ in byte_pairs.pairs_of(ranks)} == {chr(n) for n in range(256, 261)}
    words = ["abc", "aaaa", "cab", "x", "aab", "abca", "aa"]
    rows = spark.createDataFrame(enumerate(words), "n int, word string")
    folded = rows.withColumn("p", byte_pairs.pairs_literal(spark, ranks)).select("word", byte_pairs.bound(F.col("p"), lambda p: byte_pairs.fold(byte_pairs.as_letters(F.col("word")), p, ranks)).alias("signs"))
    assert {r.word: list(map(ord, r.signs)) for r in folded.collect()} == {"abc": [257], "aaaa": [259, 259], "cab": [99, 256], "x": [120], "aab": [97, 256], "abca": [257, 97], "aa": [259]}
    known = spark.range(1 << 18).selectExpr("cast(id as string) as word", "'x' as made", "cast(-(id % 1000) as int) as place")
    maps = spark.range(1).withColumn("m", byte_pairs.map_literal(known, "word", "made", "place")).select(F.slice("m", 1, 300).alias("m")).select(F.transform("m", F.map_keys).alias("words")).first().words
    places = [[-(int(word) % 1000) for word in words or []] for words in maps]
    assert places == list(map(sorted, places)) and max(map(len, places)) > 2


def test_pieces_that_no_merges_make_and_ranks_beyond_surrogates(spark, tmp_path):
    import base64

    import tiktoken

    for shift in (0, 60_000):
        ranks = {bytes((b,)): b for b in range(256)} | {b"ab": 300 + shift, b"xyz": 301 + shift, b"abc": 302 + shift, b"ca": 299 + shift}
        path = tmp_path / f"{shift}.tiktoken"
        path.write_text("".join(f"{base64.b64encode(k).decode()} {v}\n" for k, v in ranks.items()))
        texts = ["xyz", "xyzx abc abcab", "cabcabc xyz ab"]
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        rows = byte_pairs.encode(spark.createDataFrame(enumerate(texts), "doc_id bigint, text string"), str(path), P.PATTERN)
        for row in rows.select("doc_id", byte_pairs.ids(F.col("signs"), str(path)).alias("own"), byte_pairs.number_bytes(F.col("signs"), str(path)).alias("numbers")).collect():
            want = library.encode_ordinary(texts[row.doc_id])
            assert row.own == want and bytes(row.numbers) == struct.pack(f"<{len(want)}I", *want)


# 13


def brute_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item_id, text in items:
        found = []
        for i, counts, n in own:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m)) for t in terms(text) if t in counts)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item_id, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("shard,block", [(4096, 1 << 20), (7, 40)])
def test_search_by_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(lexical_search, "SHARD", shard)
    r = random.Random(3)
    words = ["the", "of", "Été", "été", "x1", "naïve", "a-b", "C"] + [f"w{n}" for n in range(40)]
    text = lambda n: " ".join(r.choices(words, weights=[30, 20, 9, 9, 5, 5, 4, 4] + [1] * 40, k=n))
    docs = [(n, text(r.randint(0, 30))) for n in range(150)] + list(ODD)
    docs += [docs[3], docs[3], (None, docs[4][1]), (900, docs[3][1].upper()), (901, None), (902, " ,;\n")]
    items = [(n, text(r.randint(1, 12))) for n in range(8)] + [(3, "the the of"), (None, "w1 w2"), (20, None), (21, "--"), (22, "absent"), (3, "the the of")]
    frame = spark.createDataFrame([(i, t, 0, "y") for i, t in docs], "doc_id bigint, text string, score int, terms string").repartition(3)
    asked = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, rank string")
    for k in (3, 20):
        assert Counter(map(tuple, lexical_search.search(frame, asked, k, block).collect())) == brute_search(docs, items, k)
    assert lexical_search.search(frame.limit(0), asked).collect() == [] and lexical_search.search(frame, asked.limit(0)).collect() == []


def test_bounds_skip_no_document():
    """The shards' bounded search against all scores, with a score to beat from the start."""
    r = np.random.default_rng(2)
    sizes = r.integers(1, 12, 300)
    terms = np.concatenate([r.choice(40, s, replace=False) for s in sizes]).astype(np.int32)
    times = r.integers(1, 5, len(terms)).astype(np.int32)
    lengths = r.integers(12, 60, 300)
    shard = lexical_search.Shard(np.arange(300), lengths, sizes, terms, times, 300, int(lengths.sum()))
    weights = r.integers(1, 6000, 40)
    scores = np.zeros(300, dtype=np.int64)
    item = lexical_search.Item(0, np.arange(0, 40, 3), np.ones(14, dtype=np.int64))
    for t in item.terms:
        for d, i in zip(shard.docs[terms[np.argsort(terms, kind="stable")] == t], shard.impacts[terms[np.argsort(terms, kind="stable")] == t]):
            scores[d] += weights[t] * i
    order = np.lexsort((np.arange(300), -scores))[:5]
    for known in (order[:0], order[:5], order[2:]):  # documents of other shards with these scores
        best = lexical_search.Best(5)
        best.add(known + 1000, scores[known])
        shard.search(item, weights, best)
        ids, all_ = np.concatenate([np.arange(300), known + 1000]), np.concatenate([scores, scores[known]])
        want = np.lexsort((ids, -all_))[:5]
        assert best.ids.tolist() == ids[want].tolist() and best.scores.tolist() == all_[want].tolist()
