"""Entries as delimited lines, and numbers in base 62.

word  := [kanjis TAB] readings TAB groups TAB id      name := [kanjis TAB] readings TAB groups
A kanji group may list reading indices behind ``#``; a trailing ``U`` marks a text that is uncommon among its siblings;
sense groups are parted by a backslash, senses by a backtick, and the first ``;`` of a group ends its parts of speech.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ENTRY = "entry_id bigint, kanjis array<struct<text: string, common: boolean>>, readings array<struct<text: string, common: boolean, restr: array<int>, nokanji: boolean>>, groups array<struct<pos: array<string>, senses: array<string>>>"


def base62(column: str) -> Column:
    """A non-negative number's digits, the most significant first."""
    return F.expr(f"if({column} = 0, '0', aggregate(sequence(1, 11), named_struct('n', {column}, 's', ''), (a, i) -> if(a.n > 0, named_struct('n', a.n div 62, 's', concat(substring('{DIGITS}', cast(a.n % 62 as int) + 1, 1), a.s)), a), a -> a.s))")


def from_base62(column: str) -> Column:
    return F.expr(f"aggregate(filter(split({column}, ''), c -> c <> ''), 0L, (n, c) -> n * 62 + locate(c, '{DIGITS}') - 1)")


def power_of_two(column: str) -> Column:
    """The least power of two that isn't below a number from 1 on."""
    return F.expr(f"shiftleft(1L, if({column} <= 1, 0, length(bin({column} - 1))))")


def marked(items: str) -> str:
    """Texts of siblings, with U on those that are uncommon while another is common."""
    return f"transform({items}, x -> if(exists({items}, y -> y.common) and not x.common, concat(x.text, 'U'), x.text))"


def reading_indices(kanjis: str = "kanjis", readings: str = "readings") -> str:
    """For each kanji text, the indices of the readings that apply: those without a restriction or with one that names it."""
    return f"transform({kanjis}, (k, i) -> filter(transform({readings}, (r, j) -> if(not r.nokanji and (r.restr is null or array_contains(r.restr, i)), j, -1)), j -> j >= 0))"


def encoded(entries: DataFrame) -> DataFrame:
    """(entry_id, line) of entries with the columns of ``ENTRY``."""
    df = entries.withColumn("__ix", F.expr(reading_indices())).withColumn("__k", F.expr(marked("kanjis"))).withColumn("__lists", F.expr("array_distinct(__ix)"))
    own = "filter(transform(__k, (k, i) -> if(__ix[i] = l, k, null)), k -> k is not null)"
    group = f"concat(array_join({own}, ','), if(size(l) = size(readings), '', concat('#', array_join(l, ','))))"
    df = df.withColumn("__kanjis", F.expr(f"array_join(transform(__lists, l -> {group}), ';')"))
    senses = "array_join(transform(groups, g -> concat(array_join(g.pos, ','), ';', array_join(g.senses, '`'))), '\\\\')"
    parts = F.array(F.when(F.size("kanjis") > 0, F.col("__kanjis")), F.expr(f"array_join({marked('readings')}, ';')"), F.expr(senses), base62("entry_id"))
    return df.select("entry_id", F.array_join(parts, "\t").alias("line"))


def decoded(lines: DataFrame) -> DataFrame:
    """``lines`` (line) of words as entry_id, kanji_groups, readings and groups."""
    df = lines.withColumn("p", F.split("line", "\t")).withColumn("n", F.size("p"))
    text = "named_struct('text', regexp_replace(x, 'U$', ''), 'common', not x rlike 'U$')"
    kanji = f"transform(split(if(n = 4, p[0], ''), ';'), g -> named_struct('kanjis', transform(split(split(g, '#')[0], ','), x -> {text}), 'reading_indices', if(instr(g, '#') > 0, filter(transform(split(split(g, '#')[1], ','), x -> try_cast(x as int)), x -> x is not null), null)))"
    group = "named_struct('types', split(split(g, ';', 2)[0], ','), 'senses', if(instr(g, ';') > 0 and split(g, ';', 2)[1] <> '', split(split(g, ';', 2)[1], '`'), cast(array() as array<string>)))"
    return df.select(
        from_base62("p[n - 1]").alias("entry_id"),
        F.expr(f"if(n = 4, {kanji}, slice({kanji}, 1, 0))").alias("kanji_groups"),
        F.expr(f"transform(split(p[n - 3], ';'), x -> {text})").alias("readings"),
        F.expr(f"transform(split(p[n - 2], '\\\\\\\\'), g -> {group})").alias("groups"),
    )
