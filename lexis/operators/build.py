"""From parsed dictionary entries to what look-up needs: entries with their texts, and the typed index of keys.

Words keep an entry each. Names with one reading, one translation and one gloss that agree in reading and types become one entry with all
their kanjis, in order of ids. Keys are the folded texts of kanjis and readings, and spelling variations of words where the kanjis' readings
are given; a word's mask is the OR of its parts of speech that rules know, 0 if there are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.functions import variations
from lexis.functions.kana import KEY_STEP, folded
from lexis.operators.entries import _codes, _redundant, sense_sql
from lexis.operators.inflection import BIT

_TEXTS = "entry_id", "kanjis", "readings", "groups"


def words_of(parsed: DataFrame) -> DataFrame:
    """(entry_id, kanjis, readings, groups) of the words among parsed entries; a sense is one text with its restrictions and note."""
    sense = sense_sql("s.stagk", "s.stagr", "s.s_inf", "s.glosses")
    return _entries(parsed.filter("not is_name"), f"transform(sense_groups, g -> named_struct('pos', g.pos, 'senses', transform(g.senses, s -> {sense})))")


def names_of(parsed: DataFrame) -> DataFrame:
    """The same of the names; types come as codes, a sense only where it says more than the reading."""
    glosses = f"if({_redundant('t.glosses', 'transform(readings, r -> r.text)')}, cast(array() as array<string>), array(array_join(t.glosses, '; ')))"
    groups = f"transform(transes, t -> named_struct('pos', {_codes('t.types')}, 'senses', {glosses}))"
    names = parsed.filter("is_name")
    simple = "size(readings) = 1 and size(transes) = 1 and size(transes[0].glosses) = 1"
    plain = names.filter(simple)
    # an entry's members are what it shows, so they are gathered; order and choice go by id
    same = plain.groupBy(F.expr("readings[0].text").alias("__reading"), F.expr("array_join(transes[0].types, ',')").alias("__types"))
    first = same.agg(F.min_by(F.struct(*(c for c in plain.columns if c != "kanjis")), "entry_id").alias("first"), F.expr("flatten(transform(array_sort(collect_list(struct(entry_id, kanjis))), x -> x.kanjis))").alias("kanjis"))
    merged = first.select("first.*", "kanjis").select(*names.columns)
    return _entries(names.filter(f"not ({simple})").unionByName(merged), groups)


def _entries(parsed: DataFrame, groups: str) -> DataFrame:
    kanjis = "transform(kanjis, k -> named_struct('text', k.text, 'common', k.common))"
    readings = "transform(readings, r -> named_struct('text', r.text, 'common', r.common, 'restr', if(size(r.kanji_restriction) > 0, r.kanji_restriction, null), 'nokanji', r.nokanji))"
    return parsed.select("entry_id", F.expr(kanjis).alias("kanjis"), F.expr(readings).alias("readings"), F.expr(groups).alias("groups"))


def index_of(entries: DataFrame, bits: dict[str, int] | None = None, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, entry_id, pos_mask), distinct. ``known`` gives kanjis' readings; with it, words get keys for their spelling variations."""
    bits = BIT if bits is None else bits
    table = ", ".join(f"'{name}', {bit}" for name, bit in bits.items())
    mask = f"aggregate(flatten(transform(groups, g -> g.pos)), 0, (m, p) -> m | coalesce(try_element_at(map({table}), p), 0))"
    texts = entries.select("entry_id", F.expr(mask).alias("pos_mask"), F.explode(F.expr("concat(transform(kanjis, k -> k.text), transform(readings, r -> r.text))")).alias("text"))
    keys = texts.select(folded("text", KEY_STEP).alias("key"), "entry_id", "pos_mask")
    if known:
        pairs = entries.select("entry_id", F.expr(mask).alias("pos_mask"), F.col("kanjis").alias("ks"), F.explode("readings").alias("r"))
        pairs = pairs.select("entry_id", "pos_mask", F.col("r.text").alias("reading"), F.explode(F.expr("filter(transform(ks, (k, i) -> if(r.restr is null or array_contains(r.restr, i), k.text, null)), x -> x is not null)")).alias("word"))
        made = variations.variations(pairs.select("word", "reading").distinct(), known)
        keys = keys.unionByName(pairs.join(made.distinct(), "word").select(F.col("variation").alias("key"), "entry_id", "pos_mask"))
    return keys.distinct()
