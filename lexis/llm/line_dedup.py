"""Operator 10 (native): near-equal lines by an exact set-similarity join.

A line's set holds its distinct words. Words are ordered by rarity: occurrences are counted over all documents in
buckets of word hashes, and a word's key is the level of its bucket's count (``STEPS`` for each doubling) above 56 bits of its hash,
so the order of keys goes from rare to frequent. Lines of at least one word take part. Equal sets become one record at their first
line, by grouping alone. Only sets that are large enough to match another one (nine words at 90 percent) are joined: sets with a
Jaccard similarity of ``PERCENT`` or more share a key among the first ``size - ceil(PERCENT * size / 100) + 1`` of both (prefix
filter); their sizes are alike (length filter), and the places of the shared key leave room for the overlap (positional filter), and
so do bitmaps of their keys (bits of odd counts), which differ in no more bits than the sets differ in words. Pairs that pass are
verified on the whole sets, and a line that matches any earlier line, in order of doc_id, text hash and place, is removed.

Rows of prefixes are counted in buckets of keys. A bucket of at most ``HOT`` rows has no key with more sets, so its sets are joined as
they are, in one exchange of thin rows. Keys of other buckets are counted themselves. Only whether an earlier match exists is asked, so
a key that more than ``HOT`` sets share
in their prefixes (copies of one line with small changes) is taken in two steps: all are compared with its ``LEADERS`` first sets, and
only what found no match there is compared with all earlier ones. Pairs within such a group are never all made.

Everything is Spark SQL: no Python. What every text is joined with is thin: the places of lines that are asked for, then of those
that go. Both are written first, so Spark sees their size and shuffles the texts only where it is too large to be sent to all.

Words are compared by 56-bit and equal sets by 128-bit hashes. Null and empty texts have no lines to remove and stay as they are, as do
lines without words. Rows that repeat a doc_id and text are one document and get one result each; a null doc_id comes as 0 in the
order, but its rows are documents of their own. Further columns pass ``without_repeats`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexis.llm.common import among, bitmap, is_set, saved, table

PERCENT = 90
#: Input bytes for each bucket of word hashes, and the least and most buckets, powers of two: a corpus with more words gets more buckets,
#: whatever their number the result is the same.
SHARE, BUCKETS = 1 << 13, (1 << 16, 1 << 22)
#: Levels for each doubling of a bucket's count; 3 * 42 levels fit in seven bits.
STEPS = 3
HOT, LEADERS = 512, 16


def _plain(text: str, trimmed: bool = True) -> Column:
    """``text`` with blanks for the other white space in lines; if ``trimmed``, single ones, and none at the ends of lines."""
    odd = [f"contains({text}, '{c}')" for c in (r"\t", r"\u000b", r"\u000c", r"\r")]
    if not trimmed:
        return F.expr(f"if({' or '.join(odd)}, translate({text}, '\\t\\u000b\\u000c\\r', '    '), {text})")
    odd += [f"contains({text}, '{c}')" for c in ("  ", r" \n", r"\n ")] + [f"{text} like ' %'", f"{text} like '% '"]
    single = f"regexp_replace({text}, '[ \\t\\u000b\\u000c\\r]+', ' ')"
    return F.expr(f"if({' or '.join(odd)}, btrim(regexp_replace({single}, ' ?\\n ?', '\\n'), ' '), {text})")


def _bucket(h: str, buckets: int) -> str:
    return f"cast(shiftrightunsigned({h}, {65 - buckets.bit_length()}) as int)"


def _buckets(rows: DataFrame) -> int:
    """By Spark's own estimate of the input's bytes, which comes from its files."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(1 << (size // SHARE).bit_length() - 1 if size >= SHARE else 1, BUCKETS[0]), BUCKETS[1])


def rarity(rows: DataFrame) -> tuple[Column, int]:
    """An array with a level for each bucket of word hashes, by occurrences over all of ``rows`` (text), and the number of buckets.

    It is bounded, so a scalar subquery."""
    buckets = _buckets(rows)
    words = rows.select(F.explode(F.split(F.replace(_plain("text", False), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counted = saved(words.filter("w <> ''").groupBy(F.expr(_bucket("xxhash64(w)", buckets)).alias("b")).agg(F.count("*").alias("n")), "rarity", thin=True)
    all_ = counted.sparkSession.range(buckets).join(counted, F.col("id") == F.col("b"), "left")
    levels = all_.select("id", F.expr(f"cast(coalesce({STEPS} * log2(n), 0) as tinyint)").alias("level"))
    return levels.agg(F.expr("transform(sort_array(collect_list(struct(id, level))), x -> x.level)")).scalar(), buckets


def _keys(lines: DataFrame, rarities: tuple[Column, int]) -> DataFrame:
    """``lines`` (line, trimmed) with ``keys``, the sorted keys of their distinct words."""
    levels, buckets = rarities
    words = "if(line = '', cast(array() as array<string>), split(line, ' '))"
    key = f"shiftleft(cast(levels[{_bucket('h', buckets)}] as bigint), 56) | shiftrightunsigned(h, 8)"
    # named once, so the optimizer puts the array where it is used and no row carries it
    keys = F.expr(f"sort_array(transform(array_distinct(transform({words}, w -> xxhash64(w))), h -> {key}))")
    return lines.withColumn("levels", levels).withColumn("keys", keys).drop("levels", "line")


def lines_of(rows: DataFrame, rarities: tuple[Column, int]) -> DataFrame:
    """Lines of ``rows`` (d, t, text): (d, t, i, keys)."""
    return _keys(rows.select("d", "t", F.posexplode(F.split(_plain("text"), "\n", -1)).alias("i", "line")), rarities)


def _prefix(size: str) -> str:
    return f"cast({size} - (({PERCENT} * {size} + 99) div 100) + 1 as int)"


def _similar(a: str, b: str) -> str:
    common = f"size(array_intersect({a}, {b}))"
    return f"100 * {common} >= {PERCENT} * (size({a}) + size({b}) - {common})"


def repeats(rows: DataFrame) -> DataFrame:
    """(d, t, gone): the places of the lines to be removed from each document of ``rows`` (d, t, text)."""
    rarities = rarity(rows)
    at = ["d", "t", "i"]
    lines = lines_of(rows, rarities)
    lines = lines.select(
        *at,
        F.xxhash64(F.lit(1), "keys").alias("h"),
        F.xxhash64(F.lit(2), "keys").alias("g"),
        F.size("keys").alias("size"),
        F.expr("aggregate(keys, 0L, (s, k) -> s ^ shiftleft(1L, cast(k & 63 as int)))").alias("bits"),
        # a smaller set matches none but its equals, not even with one word more
        F.expr(f"if(100 * size(keys) >= {PERCENT} * (size(keys) + 1), slice(keys, 1, {_prefix('size(keys)')}), cast(array() as array<bigint>))").alias("prefix"),
    )
    lines = saved(lines, "lines").filter("size > 0")
    sets = lines.groupBy("h", "g").agg(F.min(F.struct(*at)).alias("at"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    sets = saved(sets.select("h", "g", "at.*", "n", "size", "bits", "prefix"), "sets")
    parts = sets.filter("size(prefix) > 0").select(*at, "size", "bits", F.posexplode("prefix").alias("place", "key"))
    # keys by their low bits; a bucket holds at least as many rows as any of its keys
    bits = 4 * rarities[1]
    bucket = f"(key & {bits - 1}L)"
    crowds = saved(parts.groupBy(F.expr(f"cast({bucket} as int)").alias("b")).agg(F.count("*").alias("n")).filter(f"n > {HOT}").select(F.col("b").cast("bigint").alias("b")), "crowds", thin=True)
    crowded = is_set(bitmap(crowds, "b", bits), bucket)

    def pairs(early: DataFrame, late: DataFrame) -> DataFrame:
        a, b = (df.select("key", *(F.col(c).alias(f"{x}_{c}") for c in (*at, "size", "place", "bits"))) for x, df in (("a", early), ("b", late)))
        fits = (
            "(a_d < b_d or (a_d = b_d and (a_t < b_t or (a_t = b_t and a_i < b_i))))",
            f"100 * least(a_size, b_size) >= {PERCENT} * greatest(a_size, b_size)",
            f"{100 + PERCENT} * (1 + least(a_size - a_place - 1, b_size - b_place - 1)) >= {PERCENT} * (a_size + b_size)",
            f"{100 + PERCENT} * bit_count(a_bits ^ b_bits) <= {100 - PERCENT} * (a_size + b_size)",
        )
        found = a.join(b, "key").filter(" and ".join(fits))
        early, late = (F.struct(*(F.col(f"{x}_{c}").alias(c) for c in at)).alias(name) for x, name in (("a", "early"), ("b", "late")))
        return saved(found.select(early, late).distinct(), "pairs", thin=True)

    def verified(found: DataFrame) -> DataFrame:
        """``late`` of the pairs whose whole sets match."""
        asked = found.select(F.explode(F.array("early", "late")).alias("at")).groupBy("at.d", "at.t").agg(F.collect_set("at.i").alias("asked"))
        asked = saved(asked, "asked", thin=True)
        texts = among(rows, asked, ["d", "t"]).join(asked, ["d", "t"])
        # the outer lambda names the lines, so a text is split once
        lines = texts.select("d", "t", "asked", F.split(_plain("text"), "\n", -1).alias("lines"))
        chosen = F.expr("transform(array(lines), all -> transform(asked, i -> struct(i, all[i] as line)))[0]")
        keyed = _keys(lines.select("d", "t", F.inline(chosen)), rarities)
        keyed = saved(keyed.select(F.struct(*at).alias("at"), "keys"), "keys", thin=True).dropDuplicates(["at"])
        both = found.join(keyed.select(F.col("at").alias("early"), F.col("keys").alias("x")), "early").join(keyed.select(F.col("at").alias("late"), F.col("keys").alias("y")), "late")
        return both.filter(F.expr(_similar("x", "y"))).select("late").distinct()

    # the few crowded rows are read again and again, so they are written
    cool, warm = parts.filter(~crowded), saved(parts.filter(crowded), "warm", thin=True)
    often = saved(warm.groupBy("key").agg(F.count("*").alias("sets")).filter("sets > 1"), "keys", thin=True)
    mild = warm.join(often.filter(f"sets <= {HOT}").select("key"), "key")
    found = pairs(cool, cool).unionByName(pairs(mild, mild))
    hot = often.filter(f"sets > {HOT}").select("key")
    if hot.isEmpty():
        late = verified(found)
    else:
        hot = saved(warm.join(hot, "key"), "hot", thin=True)
        rank = F.row_number().over(Window.partitionBy("key").orderBy(*at))
        leaders = hot.withColumn("rank", rank).filter(f"rank <= {LEADERS}").drop("rank")
        late = saved(verified(found.unionByName(pairs(leaders, hot)).distinct()), "late", thin=True)
        open_ = hot.join(late.select("late.*"), at, "left_anti")
        late = late.unionByName(verified(pairs(hot, open_))).distinct()
    near = sets.join(late.select("late.*").distinct(), at, "left_semi").select("h", "g", F.lit(True).alias("near"))
    doubtful = sets.filter("n > 1").select("h", "g", F.struct(*at).alias("at")).join(near, ["h", "g"], "full")
    gone = lines.select(*at, "h", "g").join(doubtful, ["h", "g"]).filter(F.col("near") | (F.struct(*at) > F.col("at")))
    return saved(gone.groupBy("d", "t").agg(F.collect_set("i").alias("gone")), "gone", thin=True)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__d", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))).withColumn("__t", F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()))


def _with_kept(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__lines``, all lines, and ``__kept``, those that stay."""
    keyed = _keyed(docs)
    rows = keyed.select(F.col("__d").alias("d"), F.col("__t").alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    gone = repeats(rows).select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("gone").alias("__gone"))
    df = keyed.join(gone, ["__d", "__t"], "left").withColumn("__lines", F.split("text", "\n", -1))
    kept = F.expr("if(size(__gone) > 0, transform(array_except(sequence(0, size(__lines) - 1), __gone), i -> __lines[i]), __lines)")
    return df.withColumn("__kept", kept)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that match an earlier one; documents that lose all their words go. ``n_chars``, if there, follows."""
    df = _with_kept(docs).withColumn("__text", F.when(F.size("__gone") > 0, F.array_join("__kept", "\n")).otherwise(F.col("text")))
    df = df.filter(F.expr("not coalesce(size(__gone) > 0, false) or __text rlike '[^\\\\x20\\\\x09-\\\\x0D]'"))
    made = {"text": F.col("__text"), "n_chars": F.char_length("__text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return df.select(*(made[c].alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _with_kept(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines, kept = F.coalesce(F.size("__lines"), F.lit(0)), F.coalesce(F.size("__kept"), F.lit(0))
    removed = F.when(F.size("__gone") > 0, lines - kept).otherwise(0)
    return df.select("doc_id", lines.cast("bigint").alias("n_lines"), removed.cast("bigint").alias("n_removed"), F.sha2(F.coalesce(F.array_join("__kept", "\n"), F.lit("")), 256).alias("kept_sha256"))
