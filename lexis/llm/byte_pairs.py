"""Operator 12: byte-level BPE encoding and decoding with Spark's higher-order functions.

A piece of text that the pattern matches is a word. A word's bytes, each written as the letter of its number (U+0000 to U+00FF), are an array of
parts, each known by its rank. A fold merges, step by step, the neighbours whose concatenation has the least rank, the leftmost at a tie, until none
has a rank. What pairs make comes from a literal array of small texts by hash, so that a look-up reads little.

1. Words are counted over all texts, with partial counts by task. The most frequent ones, at most ``COMMON`` of them of ``COMMON_BYTES`` together, are folded once and
   become a second literal map, from word to ids. How many there are is found from a histogram of the counts, so no task sorts the words.
2. One narrow pass cuts each text into words, takes the ids of common words from that map and folds the others in place.
   Nothing but counts is shuffled, and no word is too frequent for a task.
3. Decoding looks each id up in a literal array of pieces and concatenates them. What a text's ids stand for is its words' ids' pieces one behind the other, so
   ``round_trip`` decodes a common word's ids once, from the ids, and keeps numbers and pieces in the map of common words.

Null and empty texts have no ids, and decode to nothing. There are no special tokens: their strings are text. Repeated rows give repeated results. A null doc_id
stays null. Other columns are ignored. A word of n bytes takes up to n steps over what is left of it, so very long words (none of a text's words in the test tables
has over 30 characters) cost the square of their length.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import numpy as np
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.llm.common import discard, saved, table, text_or_empty

COMMON, COMMON_BYTES = 1 << 19, 8 << 20
#: Small maps that a literal map is laid out in.
BUCKETS = 1 << 16
#: Stands behind all parts.
NONE = chr(0x10FFFF)


def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file; every single byte has one."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    if any(bytes((b,)) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks a byte")
    if max(ranks.values()) >= 0x100000:
        raise ValueError("the vocabulary has too many pieces")
    return ranks


def letters(piece: bytes) -> str:
    return piece.decode("iso-8859-1")


def buckets_literal(rows: DataFrame, key: str, bucket: Column, otherwise: Column | None = None) -> Column:
    """An array of what the aggregate ``bucket`` makes of the rows of each of ``BUCKETS`` hashes of ``key``; a scalar subquery, so tasks get it as one flat literal."""
    buckets = rows.groupBy(F.hash(key).bitwiseAND(BUCKETS - 1).alias("id")).agg(bucket.alias("m"))
    all_ = rows.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("id")).join(buckets, "id", "left")
    all_ = all_ if otherwise is None else all_.withColumn("m", F.coalesce("m", otherwise))
    return all_.agg(F.expr("transform(array_sort(collect_list(struct(id, m)), (a, b) -> a.id - b.id), x -> x.m)")).scalar()


def map_literal(rows: DataFrame, key: str, value: str, order: str) -> Column:
    """A map from ``rows`` as an array of small maps by the keys' hash. A look-up reads a small map's keys one after the other, so those that come first by ``order`` cost least."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col(key).alias("key"), F.col(value).alias("value"))))
    return buckets_literal(rows, key, F.map_from_entries(F.transform(entries, lambda x: F.struct(x["key"], x["value"]))))


def pairs_literal(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """What two neighbours make, as texts by hash: a ``NONE`` before each pair, behind which its result stands. They are a fourth of the size of maps, and so mostly in the cores' caches."""
    rows = spark.createDataFrame([(NONE + pair, made) for pair, made in pairs_of(ranks)], "pair string, made string")
    return buckets_literal(rows, "pair", F.array_join(F.collect_list(F.concat("pair", "made")), ""), F.lit(NONE))


def array_literal(spark: SparkSession, values: dict[int, str]) -> Column:
    """An array of texts by number, from 0 on without gaps; a scalar subquery."""
    rows = spark.createDataFrame([(n, values.get(n, "")) for n in range(max(values) + 1)], "n int, value string")
    return rows.agg(F.expr("transform(array_sort(collect_list(struct(n, value))), x -> x.value)")).scalar()


def looked_up(literal: Column, key: Column) -> Column:
    return F.try_element_at(F.get(literal, F.hash(key).bitwiseAND(BUCKETS - 1)), key)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: the end of a fold over nothing, which copies neither the value nor what is made of it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda value, _: value, body)


def base_of(ranks: dict[bytes, int]) -> int:
    """A part is one character, so that an array of parts is a text, and texts of two characters are pairs: its rank, plus a base that keeps clear of surrogates if need be."""
    return 0 if max(ranks.values()) < 0xD800 else 0x10000


def pairs_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """What two neighbours make, by the two."""
    base, out = base_of(ranks), []
    sign = lambda rank: chr(base + rank)
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                out.append((sign(left) + sign(right), sign(rank)))
    return out


def fold(word: Column, pairs: Column, ranks: dict[bytes, int]) -> Column:
    """The parts of a word (its bytes as letters) when ranked merges are folded over them, one character each.

    The state holds the parts and, for each two neighbours, the part that they would make; what makes nothing is ``NONE``, which comes behind all
    parts, as do the ends that stand on both sides. The least of what can be made is both the merge to do and its result. Its place is kept too: the first two neighbours, one of which
    is an end, make nothing, so a least at the first place says that the word is done."""

    none = F.lit(NONE)

    def made(pair: Column) -> Column:
        # what stands behind the pair, or the whole text, which begins with NONE
        return F.substring(F.call_function("substring_index", F.get(pairs, F.hash(pair).bitwiseAND(BUCKETS - 1)), pair, F.lit(-1)), 1, 1)

    def state_of(parts: Column, makes: Column) -> Column:
        return bound(makes, lambda makes: F.struct(parts.alias("parts"), makes.alias("makes"), F.position(F.array_min(F.split(makes, "")), makes).alias("at")))

    def merged(state: Column) -> Column:
        parts, makes, at = state["parts"], state["makes"], state["at"]

        def made_of(new: Column) -> Column:
            beside = F.array(F.concat(none, F.substring(parts, at - 1, 1), new), F.concat(none, new, F.substring(parts, at + 2, 1)))
            return state_of(F.overlay(parts, new, at, F.lit(2)), F.overlay(makes, F.array_join(F.transform(beside, made), ""), at - 1, F.lit(3)))

        return F.when(at == 1, state).otherwise(bound(F.substring(makes, at, 1), made_of))

    base = base_of(ranks)
    single = F.array(*(F.lit(chr(base + ranks[bytes((b,))])) for b in range(256)))
    signs = F.array_join(F.transform(F.split(word, ""), lambda c: F.get(single, F.ascii(c))), "")

    def start(parts: Column) -> Column:
        inner = F.slice(F.sequence(F.lit(1), F.length(parts)), F.lit(2), F.length(parts) - 3)
        two = F.transform(inner, lambda i: F.concat(none, F.substring(parts, i, 2)))
        return state_of(parts, F.concat(none, F.array_join(F.transform(two, made), ""), none))

    start = bound(F.concat(none, signs, none), start)
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, lambda state, _: merged(state), lambda state: F.substring(state["parts"], F.lit(2), F.length(state["parts"]) - 2))


CLASSES = (r"\p{L}", r"\p{N}", r"\s")


@functools.cache
def _classes() -> dict[str, set[int]]:
    """The code points of the classes in the pattern as the tiktoken library sees them."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes((b,)): b for b in range(256)}
    found = {}
    for kind in CLASSES:
        own = tiktoken.Encoding("class", pat_str=f"{kind}+", mergeable_ranks=single, special_tokens={})
        found[kind] = set(map(ord, own.encode_to_numpy(everything).astype(np.uint8).tobytes().decode()))
    return found


_JAVA_CLASSES: dict[str, set[int]] = {}


def _java_classes(spark: SparkSession) -> dict[str, set[int]]:
    """The same as Spark's regular expressions see them; asked once."""
    if not _JAVA_CLASSES:
        chars = spark.range(0x110000).filter("id < 55296 or id >= 57344").withColumn("c", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"))
        row = chars.agg(*(F.collect_list(F.when(F.col("c").rlike(rf"(?U)\A{kind}\z"), F.col("id").cast("int"))).alias(kind) for kind in CLASSES)).first()
        _JAVA_CLASSES.update((kind, set(row[kind])) for kind in CLASSES)
    return _JAVA_CLASSES


def java_pattern(spark: SparkSession, pattern: str) -> str:
    """``pattern`` for Spark's regular expressions, which know the Unicode tables of another year: its classes are mended by what the library holds besides."""
    classes = {}
    for kind, wanted in _classes().items():
        own = _java_classes(spark)[kind]
        more = wanted - own
        # the usual characters don't pass through the list of the others
        classes[kind] = _ranges(wanted) if own - wanted else f"{kind}[\\x{{{min(more):X}}}-\\x{{10FFFF}}&&[{_ranges(more)}]]" if more else kind
    one = lambda m: classes.get(m[0], m[0])
    inside = lambda m: regex.sub(r"\\p\{.\}|\\s", one, m[0]) if m[0][0] == "[" else f"[{one(m)}]" if m[0] in classes else m[0]
    return "(?U)" + regex.sub(r"\[[^\]]*\]|\\p\{.\}|\\s", inside, pattern)


def _ranges(chars: set[int]) -> str:
    """Code points as the inside of a set in a pattern."""
    starts = sorted(c for c in chars if c - 1 not in chars)
    ends = sorted(c for c in chars if c + 1 not in chars)
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends))


def words_in(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def common_words(docs: DataFrame, pattern: str, most: int = COMMON, size: int = COMMON_BYTES) -> DataFrame:
    """The most frequent words of all texts (word, level; higher for more frequent ones), at most ``most`` of them and ``size`` bytes together; words of nearly equal counts go or stay together."""
    counts = docs.select(F.explode(words_in(text_or_empty(), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = saved(counts.select("word", F.floor(8 * F.log2("n")).alias("level")), "words", thin=True)
    levels = counts.groupBy("level").agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes")).collect()
    words = used = 0
    least = 1 << 20
    for row in sorted(levels, key=lambda row: -row.level):
        words, used = words + row.words, used + row.bytes
        if words > most or used > size:
            break
        least = row.level
    return counts.filter(F.col("level") >= least)


def as_letters(word: Column) -> Column:
    return F.decode(word.cast("binary"), "ISO-8859-1")


def by_words(docs: DataFrame, path: str, pattern: str, common: int, makes: Callable[[Column, Column], Column], joined: Callable[[Column], Column]) -> DataFrame:
    """``docs`` with ``__made``, which is ``joined`` of the array of what ``makes`` (from a word's signs and the literal array of pieces) gives for each word of the text; once for a common word."""
    spark, pattern, ranks = docs.sparkSession, java_pattern(docs.sparkSession, pattern), ranks_of(path)
    base, pairs = base_of(ranks), pairs_literal(spark, ranks)
    pieces = array_literal(spark, {rank: letters(piece) for piece, rank in ranks.items()})

    def folded(rows: DataFrame, column: str) -> DataFrame:
        # a subquery can't stand inside a higher-order function, but the optimizer merges a column that is used once into the function's argument
        return rows.withColumn("__pairs", pairs).select(*rows.columns, bound(F.col("__pairs"), lambda pairs: fold(F.col(column), pairs, ranks)).alias("signs"))

    # the library takes a word that is a piece itself as such, even if no merges lead to it
    alone = spark.createDataFrame([(letters(piece), chr(base + rank)) for piece, rank in ranks.items()], "piece string, sign string")
    whole = folded(alone, "piece").filter(F.length("signs") > 1).select(F.encode("piece", "ISO-8859-1").cast("string").alias("word"), F.col("sign").alias("signs"), F.lit(0).alias("place"))
    whole = saved(whole, "whole", thin=True)
    words = common_words(docs, pattern, common)
    known = folded(words.join(whole, "word", "left_anti").withColumn("letters", as_letters(F.col("word"))), "letters").select("word", "signs", (-F.col("level")).cast("int").alias("place"))
    known = known.unionByName(whole).withColumn("__pieces", pieces).select("word", "place", bound(F.col("__pieces"), lambda pieces: bound(F.col("signs"), lambda signs: makes(signs, pieces))).alias("made"))
    known = saved(known, "folded", thin=True)
    discard(words)

    def each(pairs: Column, known: Column, pieces: Column) -> Column:
        other = lambda word: bound(fold(as_letters(word), pairs, ranks), lambda signs: makes(signs, pieces))
        return F.transform(words_in(text_or_empty(), pattern), lambda word: F.coalesce(looked_up(known, word), other(word)))

    out = bound(F.col("__pairs"), lambda pairs: bound(F.col("__known"), lambda known: bound(F.col("__pieces"), lambda pieces: bound(each(pairs, known, pieces), joined))))
    return docs.withColumns({"__pairs": pairs, "__known": map_literal(known, "word", "made", "place"), "__pieces": pieces}).select(*docs.columns, out.alias("__made"))


def encode(docs: DataFrame, path: str, pattern: str, common: int = COMMON) -> DataFrame:
    """``docs`` (text and any other columns) with ``signs``, the ids of the whole text by the ranks of the file at ``path``, one character each; ``ids`` makes numbers of them."""
    return by_words(docs, path, pattern, common, lambda signs, pieces: signs, lambda words: F.array_join(words, "")).withColumnRenamed("__made", "signs")


def round_trip(docs: DataFrame, path: str, pattern: str, common: int = COMMON) -> DataFrame:
    """``docs`` (text and any other columns) with ``numbers``, the ids of the whole text as ``number_bytes``, and ``decoded``, the bytes that the ids stand for."""
    base, charset = base_of(ranks_of(path)), number_text(F.lit(""), path)[1]

    def makes(signs: Column, pieces: Column) -> Column:
        return F.struct(number_text(signs, path)[0].alias("numbers"), pieces_of(signs, pieces, base).alias("decoded"))

    def joined(words: Column) -> Column:
        return F.struct(*(F.array_join(words[part], "").alias(part) for part in ("numbers", "decoded")))

    made = by_words(docs, path, pattern, common, makes, joined)
    return made.select(*docs.columns, F.encode("__made.numbers", charset).alias("numbers"), F.encode("__made.decoded", "ISO-8859-1").alias("decoded"))


def ids(signs: Column, path: str) -> Column:
    """The ids of a text of signs as an array of numbers."""
    base = base_of(ranks_of(path))
    return F.transform(F.filter(F.split(signs, ""), lambda c: c != ""), lambda c: F.ascii(c) - base)


def number_text(signs: Column, path: str) -> tuple[Column, str]:
    """A text, and the charset in which it is the ids as little-endian unsigned 32-bit integers. Texts put one behind the other are the ids one behind the other."""
    if base_of(ranks_of(path)):
        halves = lambda n: F.concat(*(F.lpad(F.hex(F.shiftright(n, shift).bitwiseAND(255)), 2, "0") for shift in (0, 8, 16, 24)))
        return F.decode(F.unhex(F.array_join(F.transform(ids(signs, path), halves), "")), "ISO-8859-1"), "ISO-8859-1"
    # signs whose code is the id are numbers of 16 bits, behind each of which come two bytes of zero
    return F.when(signs != "", F.concat(F.array_join(F.split(signs, ""), "\0"), F.lit("\0"))).otherwise(F.lit("")), "UTF-16LE"


def number_bytes(signs: Column, path: str) -> Column:
    """The ids as little-endian unsigned 32-bit integers."""
    return F.encode(*number_text(signs, path))


def pieces_of(signs: Column, pieces: Column, base: int) -> Column:
    """The pieces, as letters, that one sign or more stand for."""
    return F.array_join(F.transform(F.split(signs, ""), lambda c: F.get(pieces, F.ascii(c) - base)), "")


def decode(docs: DataFrame, path: str, out: str = "decoded") -> DataFrame:
    """``docs`` (signs and any other columns) with the bytes that they stand for: the pieces one behind the other."""
    ranks = ranks_of(path)
    base, pieces = base_of(ranks), array_literal(docs.sparkSession, {rank: letters(piece) for piece, rank in ranks.items()})
    text = bound(F.col("__pieces"), lambda pieces: pieces_of(F.col("signs"), pieces, base))
    return docs.withColumn("__pieces", pieces).select(*docs.columns, F.encode(F.when(F.col("signs") != "", text).otherwise(F.lit("")), "ISO-8859-1").alias(out))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    coded = round_trip(docs, path, public_tokenizers.PATTERN).select("doc_id", "numbers", "decoded")
    tokens = (F.octet_length("numbers") / 4).cast("bigint")
    return coded.select("doc_id", tokens.alias("n_tokens"), F.sha2("numbers", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
