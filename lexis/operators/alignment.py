"""Alignment of two lexicons: matching, and what the resulting bipartite links say. All of it is joins and aggregates of degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexis.steps import Steps

#: Writings in kana alone.
KANA = "^[ぁ-ヿ]*$"


def unique_links(links: DataFrame, left: str, right: str) -> DataFrame:
    """Links of left nodes that have exactly one right node."""
    only = links.groupBy(left).agg(F.min(right).alias("r"), F.max(right).alias("s")).filter("r = s")
    return only.select(left, F.col("r").alias(right))


def link_classes(links: DataFrame, left: str, right: str) -> DataFrame:
    """Kind of each left node: ``one`` target, a ``star`` whose targets have no other node, or ``ambiguous``; with its degree."""
    links = links.select(left, right).distinct()
    right_degree = links.groupBy(right).agg(F.count("*").alias("d"))
    per = links.join(right_degree, right).groupBy(left).agg(F.count("*").cast("bigint").alias("n"), F.max("d").alias("m"))
    return per.select(left, F.when(F.col("n") == 1, "one").when(F.col("m") == 1, "star").otherwise("ambiguous").alias("kind"), "n")


def single_covers(links: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right) where the right node alone has all texts of the left one; ``links`` are (left, right, text)."""
    has = links.select(left, right, "text").distinct()
    need = has.groupBy(left).agg(F.count_distinct("text").alias("need"))
    have = has.groupBy(left, right).agg(F.count_distinct("text").alias("have"))
    return have.join(need, left).filter("have = need").select(left, right)


def pruned_once(links: DataFrame, left: str, right: str) -> DataFrame:
    """One round: a left node that exactly one right node covers keeps only that link. Decisions rest on the state before the round."""
    covers = single_covers(links, left, right)
    alone = covers.groupBy(left).agg(F.min(right).alias("keep"), F.count("*").alias("n")).filter("n = 1").select(left, "keep")
    return links.join(alone, left, "left").filter(F.col("keep").isNull() | (F.col("keep") == F.col(right))).drop("keep")


def pruned(links: DataFrame, left: str, right: str, rounds: int = 2) -> DataFrame:
    """``rounds`` rounds, each from the left and then from the right."""
    for _ in range(rounds):
        links = pruned_once(pruned_once(links, left, right), right, left)
    return links


def covered(links: DataFrame, left: str, right: str, left_texts: DataFrame, right_texts: DataFrame) -> DataFrame:
    """``links`` (left, right, distinct) without those that a single cover makes superfluous.

    Where exactly one of a left node's right nodes has all its texts, the node keeps that link alone. Nodes with one link, and those whose
    right nodes have no other, stay as they are. All nodes are judged on the links as they come in. Texts are (left or right, text).
    Texts may be far more than links and may repeat: each side's are moved once, the left ones to the open nodes, the right ones to what these ask for."""
    degree = links.groupBy(right).agg(F.count("*").alias("d"))
    open_ = links.join(degree, right).groupBy(left).agg(F.count("*").alias("n"), F.max("d").alias("m")).filter("n > 1 and m > 1").select(left)
    asked = links.join(open_, left).join(left_texts.select(left, "text"), left)
    had = asked.join(right_texts.select(right, "text", F.lit(True).alias("has")), [right, "text"], "left")
    covers = had.groupBy(left, right).agg(F.count_if(F.col("has").isNull()).alias("missing")).filter("missing = 0")
    alone = covers.groupBy(left).agg(F.min(right).alias("keep"), F.count("*").alias("covers")).filter("covers = 1").select(left, "keep")
    return links.join(alone, left, "left").filter(F.col("keep").isNull() | (F.col("keep") == F.col(right))).select(left, right)


def pos_matches(matches: DataFrame, lemma_pos: DataFrame, entry_pos: DataFrame, pairs: DataFrame) -> DataFrame:
    """``matches`` (lemma_id, entry_id, ...) whose parts of speech make a learned pair.

    ``lemma_pos`` is (lemma_id, pos), ``entry_pos`` (entry_id, entry_pos) of senses that aren't archaic, ``pairs`` (pos, entry_pos)."""
    allowed = lemma_pos.join(pairs.select("pos", "entry_pos").distinct(), "pos").select("lemma_id", "entry_pos").distinct()
    fits = matches.select("lemma_id", "entry_id").distinct().join(entry_pos.select("entry_id", "entry_pos").distinct(), "entry_id")
    return matches.join(fits.join(allowed, ["lemma_id", "entry_pos"], "left_semi"), ["lemma_id", "entry_id"], "left_semi")


def rescued_entries(entry_texts: DataFrame, matches: DataFrame, index: DataFrame) -> DataFrame:
    """(lemma_id, entry_id, writing) of entries without a match that have a text which ``index`` (surface, lemma_id) gives one lemma for."""
    rest = entry_texts.join(matches.select("entry_id"), "entry_id", "left_anti")
    asked = index.join(rest, F.col("surface") == F.col("text"), "left_semi")
    alone = asked.groupBy("surface").agg(F.min("lemma_id").alias("lemma_id"), F.max("lemma_id").alias("last")).filter("lemma_id = last")
    return rest.join(alone, F.col("text") == F.col("surface")).select("lemma_id", "entry_id", F.col("text").alias("writing")).distinct()


def resolved(links: DataFrame, matches: DataFrame) -> DataFrame:
    """(lemma_id, writing, entry_id, kind) of links (lemma_id, entry_id): a lemma's one entry, or the star of entries that are only its own,
    for all writings (null); else, from all ``matches``, the writings that pin a single entry."""
    classes = link_classes(links, "lemma_id", "entry_id").select("lemma_id", "kind")
    sure = links.join(classes.filter("kind <> 'ambiguous'"), "lemma_id").select("lemma_id", F.lit(None).cast("string").alias("writing"), "entry_id", "kind")
    pinned = matches.groupBy("lemma_id", "writing").agg(F.min("entry_id").alias("entry_id"), F.max("entry_id").alias("last")).filter("entry_id = last")
    return sure.unionByName(pinned.drop("last").join(classes.filter("kind = 'ambiguous'"), "lemma_id").select("lemma_id", "writing", "entry_id", "kind"))


def aligned(matches: DataFrame, lemma_texts: DataFrame, entry_texts: DataFrame, index: DataFrame, rescue_texts: DataFrame | None = None, steps: Steps | None = None) -> DataFrame:
    """The mapping that ``resolved`` gives for ``matches`` (lemma_id, entry_id, writing) after rescuing unmatched entries and pruning by
    covers from the entries' side, then from the lemmas'. Texts are (lemma_id or entry_id, text), ``index`` is (surface, lemma_id); ``rescue_texts`` are
    entries' texts as the index writes them, if it folds them. ``steps`` keep what is read more than once."""
    saved = steps.saved if steps else lambda df: df
    rescued_ = rescued_entries(entry_texts if rescue_texts is None else rescue_texts, matches, index)
    matches = saved(matches.select("lemma_id", "entry_id", "writing").unionByName(rescued_).distinct())
    links = saved(matches.select("lemma_id", "entry_id").distinct())
    links = saved(covered(links, "entry_id", "lemma_id", entry_texts, lemma_texts).select("lemma_id", "entry_id"))
    return resolved(saved(covered(links, "lemma_id", "entry_id", lemma_texts, entry_texts)), matches)


def learned_pairs(matches: DataFrame, lexemes: DataFrame, groups: DataFrame) -> DataFrame:
    """(pos, entry_pos, lemma_id, entry_id): parts of speech that go together, each pair with its first witness.

    Only what leaves no doubt teaches: a lemma that all its ``matches`` lead to one entry, whose ``groups`` (entry_id, archaic, pos array) have one that
    isn't archaic, with one part of speech, ``exp`` aside, which says none. The lemma's first lexeme speaks for it. Proper nouns go with nouns only."""
    only = unique_links(matches, "lemma_id", "entry_id")
    one = groups.filter("not archaic").groupBy("entry_id").agg(F.count("*").alias("n"), F.first("pos").alias("pos")).filter(F.expr("n = 1 and (size(pos) = 1 or array_contains(pos, 'exp'))"))
    tags = one.select("entry_id", F.explode("pos").alias("entry_pos")).filter("entry_pos <> 'exp'")
    # few lemmas have a match, so lexemes meet those before they are grouped
    spoken = lexemes.select("lemma_id", "orth", "pos").join(only, "lemma_id").groupBy("lemma_id", "entry_id").agg(F.min(F.struct("orth", "pos")).alias("x")).select("lemma_id", "entry_id", "x.pos")
    pairs = spoken.join(tags, "entry_id").filter(F.expr("pos <> 'proper' or entry_pos like 'n%'"))
    return pairs.groupBy("pos", "entry_pos").agg(F.min(F.struct("lemma_id", "entry_id")).alias("w")).select("pos", "entry_pos", "w.lemma_id", "w.entry_id")


def gated(matches: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """``matches`` (lemma_id, entry_id, writing, pos) whose lexeme's part of speech goes with one of the entry's that isn't archaic, by learned ``pairs``."""
    tags = groups.filter("not archaic").select("entry_id", F.explode("pos").alias("entry_pos")).distinct()
    allowed = tags.join(pairs.select("pos", "entry_pos").distinct(), "entry_pos").select("entry_id", "pos").distinct()
    return matches.join(allowed, ["entry_id", "pos"], "left_semi").select("lemma_id", "entry_id", "writing").distinct()


def align(lexemes: DataFrame, entries: DataFrame, groups: DataFrame, index: DataFrame, plain: str = KANA) -> DataFrame:
    """The mapping (lemma_id, writing, entry_id, kind) of two lexicons, as ``aligned_steps`` gives it; the steps are deleted at the end."""
    steps = Steps(lexemes.sparkSession)
    lexemes, entries, groups = steps.saved(lexemes), steps.saved(entries), steps.saved(groups)
    return steps.result(aligned_steps(lexemes, entries, groups, index, plain, steps))


def aligned_steps(lexemes: DataFrame, entries: DataFrame, groups: DataFrame, index: DataFrame, plain: str, steps: Steps) -> DataFrame:
    """The mapping (lemma_id, writing, entry_id, kind) of two lexicons: match, learn parts of speech from what is unique, keep the matches that they allow, rescue,
    prune by covers from both sides, and classify.

    ``lexemes`` are (lemma_id, pos, orth, orth_key, pron_key), ``entries`` as for ``simple_matches``, ``groups`` (entry_id, archaic, pos array), ``index`` (surface,
    lemma_id) of folded surfaces. All are read several times, so they should be tables; what is made of them and read more than once is written to ``steps``."""
    matches = steps.saved(simple_matches(lexemes, entries, plain, with_pos=True, steps=steps))
    allowed = steps.saved(gated(matches, groups, learned_pairs(matches, lexemes, groups)))
    texts = entries.select("entry_id", "text")
    rescue = entries.select("entry_id", F.col("text_key").alias("text"))
    return aligned(allowed, lexemes.select("lemma_id", F.col("orth").alias("text")), texts, index, rescue, steps)


def mapped_entries(mapping: DataFrame) -> DataFrame:
    return mapping.select("entry_id").distinct()


def witnesses(pairs: DataFrame, keys: list[str], witness: str) -> DataFrame:
    """Distinct pairs of classes with the first witness."""
    return pairs.groupBy(*keys).agg(F.min(witness).alias("witness"))


def rescued(rows: DataFrame, mapped: DataFrame, key: str, surface: str, index: DataFrame) -> DataFrame:
    """Rows without a link get the target of their surface in ``index`` (surface, target), if that is unique."""
    alone = index.groupBy("surface").agg(F.min("target").alias("target"), F.count_distinct("target").alias("n")).filter("n = 1")
    return rows.join(mapped, key, "left_anti").join(alone, F.col(surface) == F.col("surface")).select(key, "target")


def simple_matches(lexemes: DataFrame, entries: DataFrame, plain: str = KANA, with_pos: bool = False, steps: Steps | None = None) -> DataFrame:
    """(lemma_id, entry_id, writing; also pos if asked) of lexemes (lemma_id, pos, orth, orth_key, pron_key) and entries (entry_id, is_noun, has_kanji, nokanji, uk, archaic, text, reading_key, text_key).

    They meet on the folded writing. A proper noun needs at most one noun entry and one lemma there; a kana lexeme needs an entry that can be
    written in kana: without kanji, with a reading that has none, or usually so and alone; any other lexeme needs an equal reading.
    ``plain`` is the pattern of writings in kana. With ``steps``, the lexicons meet once, and the counts are made of what has met."""
    joined = lexemes.join(entries, F.col("orth_key") == F.col("text_key"))
    joined = steps.saved(joined) if steps else joined
    per_writing = joined.groupBy("lemma_id", "orth").agg(F.count_distinct("entry_id").alias("n_entries"), F.count_distinct(F.when(F.col("is_noun"), F.col("entry_id"))).alias("n_nouns"))
    per_key = joined.groupBy("orth_key", "pos").agg(F.count_distinct("lemma_id").alias("n_lemmas"))
    joined = joined.join(per_writing, ["lemma_id", "orth"]).join(per_key, ["orth_key", "pos"])
    kana = F.col("orth").rlike(plain)
    kana_ok = (F.col("text") == F.col("orth")) & (~F.col("has_kanji") | F.col("nokanji") | (F.col("uk") & ~F.col("archaic") & (F.col("n_entries") == 1)))
    proper = F.col("pos") == "proper"
    ok = F.when(proper, (F.col("n_nouns") <= 1) & (F.col("n_lemmas") <= 1) & F.col("is_noun")).otherwise(True) & F.when(kana, kana_ok).otherwise(F.col("reading_key") == F.col("pron_key"))
    return joined.filter(ok).select("lemma_id", "entry_id", F.col("orth").alias("writing"), *(["pos"] if with_pos else [])).distinct()


def phrase_fits(hits: DataFrame, by_sound: Column | None = None) -> DataFrame:
    """``hits`` with ``fits``: whether an entry's folded kanjis (kanji_keys) have the phrase's writing (orth, orth_base), or one of its readings
    (key, nokanji, uk) its sound (pron, pron_base; patterns if is_pattern). A reading counts if the entry can be written in kana: it has no
    kanjis, the reading stands without them, or a sense says it is usually so. With ``by_sound``, sounds count only where it holds."""
    sound = "if(is_pattern, r.key rlike concat('^(?:', p, ')$'), r.key = p)"
    reading = f"exists(readings, r -> (size(kanji_keys) = 0 or r.nokanji or r.uk) and exists(array(pron, pron_base), p -> {sound}))"
    sounds = F.expr(reading) if by_sound is None else by_sound & F.expr(reading)
    return hits.withColumn("fits", F.expr("exists(kanji_keys, k -> k in (orth, orth_base))") | sounds)


def name_matches(lexemes: DataFrame, names: DataFrame) -> DataFrame:
    """(lemma_id, entry_id) of proper nouns by folded writing and reading."""
    same = (F.col("orth_key") == F.col("text_key")) & (F.col("pron_key") == F.col("reading_key"))
    return lexemes.filter("pos = 'proper'").join(names, same).select("lemma_id", "entry_id").distinct()


def first_variants(variants: DataFrame) -> DataFrame:
    """(entry_id, variant_ix): the first parse of an entry whose reading fits; an unknown token reads as anything."""
    fits = variants.filter(F.expr("reading rlike concat('^', replace(pattern, '?', '.+'), '$')"))
    return fits.groupBy("entry_id").agg(F.min("variant_ix").alias("variant_ix"))
