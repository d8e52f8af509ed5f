"""Ranked entries as HTML rows. Texts are escaped unless told otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The codes of name types and their texts.
NAME_TYPES = {
    "a": "place",
    "c": "company",
    "d": "product",
    "f": "female given name or forename",
    "g": "given name or forename, gender not specified",
    "m": "male given name or forename",
    "n": "family or surname",
    "o": "organization",
    "p": "full name of a particular person",
    "s": "railway station",
    "u": "unclassified name",
    "w": "work of art, literature, music, etc. name",
}
VISIBLE = 2


def name_type(column: str):
    """Text of a name type's code; unknown codes stay as they are."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in NAME_TYPES.items())
    return F.expr(f"coalesce(try_element_at(map({pairs}), {column}), {column})")


def escaped(column: str) -> str:
    return f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def rows_html(hits: DataFrame, escape: bool = True) -> DataFrame:
    """One table per input of ranked hits (w, rnk, kanji, reading, reasons, pos, senses array): rows behind the second are hidden at first."""
    text = escaped if escape else lambda c: c
    word = f"concat(if(kanji <> '', concat('<span class=\"kanji\">', {text('kanji')}, '</span> '), ''), '<span class=\"kana\">', {text('reading')}, '</span>', if(reasons <> '', concat(' (', {text('reasons')}, ')'), ''))"
    senses = f"case size(senses) when 0 then '' when 1 then concat(' <span>', {text('senses[0]')}, '</span>') else concat('<ol>', array_join(transform(senses, s -> concat('<li>', {text('s')}, '</li>')), ''), '</ol>') end"
    row = F.expr(f"concat('<tr', if(rnk > {VISIBLE}, ' class=\"hidden\"', ''), '><td>', {word}, ' <i>', {text('pos')}, '</i>', {senses}, '</td></tr>')")
    lines = hits.withColumn("row", row).groupBy("w").agg(F.array_sort(F.collect_list(F.struct("rnk", "row"))).alias("rows"))
    return lines.select("w", F.expr(f"concat('<table>', array_join(transform(rows, r -> r.row), ''), if(size(rows) > {VISIBLE}, '<tr class=\"more\"></tr>', ''), '</table>')").alias("html"))


def visible_readings(entries: DataFrame) -> DataFrame:
    """Which readings and kanjis of an entry (matched, key, is_name, kanjis, readings) a hit shows.

    A hiragana input shows only readings that fold to the key, none if none does; any other input hides kanjis that don't match, if some kanji does.
    A name that was found by hiragana loses its kanjis."""
    from lexis.functions.kana import KEY_STEP
    from lexis.functions.scripts import HIRAGANA_WORD

    fold = lambda c: f"aggregate(filter(split({c}, ''), q -> q <> ''), '', (acc, c) -> {KEY_STEP})"
    hira = f"matched rlike '{HIRAGANA_WORD}'"
    return entries.select(
        "entry_id",
        F.expr(f"array_join(if({hira}, filter(readings, x -> {fold('x')} = key), readings), ',')").alias("readings"),
        F.expr(f"array_join(case when {hira} and is_name then array() when {hira} or not exists(kanjis, x -> {fold('x')} = key) then kanjis else filter(kanjis, x -> {fold('x')} = key) end, ',')").alias("kanjis"),
    )


def entries_html(hits: DataFrame, reviewed: DataFrame | None = None, escape: bool = True, visible: int = VISIBLE) -> DataFrame:
    """One table per input of ranked hits with their entries (w, rnk, key, entry_id, is_name, match_len, reasons, kanjis, readings, groups).

    A row shows the kanjis in groups that share their readings, each group with these readings; uncommon texts among common siblings are
    marked, the chain of rules stands behind the first group, and an entry without kanjis shows its readings alone. What doesn't fit what was
    typed is left out as ``visible_readings`` says. Entries under review are marked, and hide their readings and senses at first. Name types are spelled out."""
    from lexis.functions.codec import reading_indices
    from lexis.functions.kana import KEY_STEP, folded_sql
    from lexis.functions.scripts import HIRAGANA_WORD

    text = escaped if escape else lambda c: c
    listed = F.lit(False) if reviewed is None else F.coalesce("__listed", F.lit(False))
    rows = hits if reviewed is None else hits.join(reviewed.select(F.col("id").alias("entry_id"), F.lit(True).alias("__listed")).distinct(), "entry_id", "left")
    rows = rows.withColumn("listed", listed & ~F.col("is_name"))
    fold = lambda c: folded_sql(c, KEY_STEP)
    typed = "left(w, match_len)"
    hira = f"{typed} rlike '{HIRAGANA_WORD}'"
    shown = f"transform(readings, r -> if({hira} and {fold('r.text')} <> key, null, r))"
    some = f"exists(kanjis, k -> {fold('k.text')} = key)"
    kept = f"case when {hira} and is_name then transform(kanjis, k -> null) when {hira} or not {some} then kanjis else transform(kanjis, k -> if({fold('k.text')} = key, k, null)) end"
    span = lambda kind, item, items: f"concat('<span class=\"{kind}', if(exists({items}, y -> y.common) and not {item}.common, ' uncommon', ''), '\">', {text(item + '.text')}, '</span>')"
    rows = rows.withColumn("__ix", F.expr(reading_indices())).withColumn("__lists", F.expr("array_distinct(__ix)"))
    rows = rows.withColumn("__readings", F.expr(f"transform({shown}, r -> if(r is null, null, {span('kana', 'r', 'readings')}))"))
    rows = rows.withColumn("__kanjis", F.expr(f"transform({kept}, k -> if(k is null, null, {span('kanji', 'k', 'kanjis')}))"))
    hidden = "if(listed, ' hidden', '')"
    own = "filter(transform(__kanjis, (k, i) -> if(__ix[i] = l, k, null)), k -> k is not null)"
    theirs = "filter(transform(__readings, (r, j) -> if(array_contains(l, j), r, null)), r -> r is not null)"
    chain = f"if(reasons <> '', concat(' <span class=\"chain\">(', {text('reasons')}, ')</span>'), '')"
    group = f"if(size({own}) = 0, '', concat(array_join({own}, '、'), ' <span class=\"readings', {hidden}, '\">', array_join({theirs}, '、'), '</span>', if(n = 0, {chain}, ''), '<br>'))"
    alone = f"concat('<span class=\"readings\">', array_join(filter(__readings, r -> r is not null), '、'), '</span>', {chain}, '<br>')"
    head = f"if(size(kanjis) > 0, array_join(transform(__lists, (l, n) -> {group}), ''), {alone})"
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in NAME_TYPES.items())
    kind = f"if(is_name, coalesce(try_element_at(map({pairs}), p), p), p)"
    pos = f"concat('<span class=\"pos\">', array_join(transform(g.pos, p -> {text(kind)}), ', '), '</span>')"
    senses = f"case size(g.senses) when 0 then '' when 1 then concat('; <span class=\"sense', {hidden}, '\">', {text('g.senses[0]')}, '</span>') else concat('; <ul class=\"senses', {hidden}, '\">', array_join(transform(g.senses, s -> concat('<li>', {text('s')}, '</li>')), ''), '</ul>') end"
    body = f"concat('<div>', array_join(transform(groups, g -> concat({pos}, {senses})), '<br>'), '</div>')"
    cell = "concat('<td class=\"', if(is_name, 'name', concat('word', if(listed, ' reviewed', ''))), '\" data-entry=\"', entry_id, '\">')"
    row = F.expr(f"concat('<tr', if(rnk > {visible}, ' class=\"hidden\"', ''), '>', {cell}, {head}, {body}, '</td></tr>')")
    lines = rows.withColumn("row", row).groupBy("w").agg(F.array_sort(F.collect_list(F.struct("rnk", "row"))).alias("rows"))
    return lines.select("w", F.expr("concat('<table>', array_join(transform(rows, r -> r.row), ''), '</table>')").alias("html"))
