"""Counting entries over a corpus: a trie of phrases, one walk through each sentence, and what the walk records.

Sentences are (sent, copies, tokens): ``sent`` names a text, ``copies`` says how often the corpus has it, so a repeated sentence is walked once. A
token is a struct (key, surface, orth, orth_base, folded, pron, pron_base, known, lemma, proper); ``key`` is the lemma of a known token and the surface
of another. Phrases are (words, entry_id), words being keys.

Where an operator takes ``tokens``, sentences may have other columns instead, of which this SQL makes their tokens: a text is a small part of the size of its
tokens, so it is what should be kept and moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexis.operators.alignment import phrase_fits
from lexis.steps import Steps

#: Copies of each edge from the trie's root, among which the places that wait for it are dealt: no word is too frequent for a task. Deeper edges, which wait for
#: several words in a row, have no copies.
SALTS = 8


def distinct_sentences(texts: DataFrame, column: str = "text") -> DataFrame:
    """(sent, copies, text) of the texts that aren't null."""
    return texts.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("text")).agg(F.count("*").alias("copies")).select(F.md5("text").alias("sent"), "copies", "text")


def trie(phrases: DataFrame) -> DataFrame:
    """Edges (parent, key, node, n, first) of the tree of ``phrases`` (words, entry_id).

    A node is the beginning of a phrase, as an array; ``n`` entries end there, the least of which is ``first``."""
    begins = phrases.filter(F.size("words") > 0).distinct().withColumn("d", F.explode(F.sequence(F.lit(1), F.size("words"))))
    begins = begins.select(F.expr("slice(words, 1, d)").alias("node"), F.when(F.col("d") == F.size("words"), F.col("entry_id")).alias("entry_id"))
    nodes = begins.groupBy("node").agg(F.count("entry_id").alias("n"), F.min("entry_id").alias("first"))
    return nodes.select(F.expr("slice(node, 1, size(node) - 1)").alias("parent"), F.expr("node[size(node) - 1]").alias("key"), "node", "n", "first")


def descents(sentences: DataFrame, edges: DataFrame, longest: int, steps: Steps) -> DataFrame:
    """(sent, start, depth, node, n, first) of all nodes that the tokens from each place on lead to; ``longest`` only bounds how far a place looks ahead."""
    keys = sentences.select("sent", F.expr("transform(tokens, t -> t.key)").alias("keys"))
    return _descended(keys.select("sent", "keys", F.posexplode("keys").alias("start", "key")), edges, 1, longest, steps)


def _descended(places: DataFrame, edges: DataFrame, least: int, longest: int, steps: Steps) -> DataFrame:
    """``descents`` from ``places`` (sent, start, keys) to the nodes of ``least`` keys and more.

    Each level joins the places that are left with that level's edges by the node that their next token leads to, until no place is left, so each edge is moved once."""
    ahead, node = F.expr(f"slice(keys, start + {least + 1}, {longest - least})"), F.expr(f"slice(keys, start + 1, {least})")
    waiting = places.filter(f"start + {least} <= size(keys)").select("sent", "start", ahead.alias("ahead"), node.alias("node"), F.pmod(F.hash("sent", "start"), F.lit(SALTS)).alias("salt"))
    nodes = edges.select("node", "n", "first")
    below, by = nodes.filter(F.size("node") == least), ["node"]
    if least == 1:
        below, by = below.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["node", "salt"]
    found, depth = None, least
    while True:
        level = steps.saved(waiting.join(below, by).select("sent", "start", "ahead", F.lit(depth).alias("depth"), "node", "n", "first"))
        ends = level.drop("ahead")
        found = ends if found is None else found.unionByName(ends)
        if depth == longest or level.isEmpty():
            return found
        waiting = level.filter(F.size("ahead") > 0).select("sent", "start", F.expr("slice(ahead, 2, size(ahead))").alias("ahead"), F.expr("concat(node, array(ahead[0]))").alias("node"))
        depth += 1
        below, by = nodes.filter(F.size("node") == depth), ["node"]


def _made(expr: str, tokens: str | None) -> Column:
    """``expr``, in which ``tokens`` are a column, or are made once for a row by the SQL that is given."""
    return F.expr(expr if tokens is None else f"transform(array({tokens}), tokens -> {expr})[0]")


#: Keys as numbers of 64 bits, which are moved instead of them.
_NUMBERS = "transform({}, x -> xxhash64(x))"
#: Places meet phrases by so many keys before they meet their tree.
HEAD = 3


def _heads(size: int) -> str:
    """What ``size`` keys from each place on, or those that are left, are known by; keys are numbers."""
    return f"transform(keys, (x, i) -> xxhash64(slice(keys, i + 1, {size})))"


def met(phrases: DataFrame, sentences: DataFrame, tokens: str | None = None, least: int = 1) -> DataFrame:
    """``phrases``, with ``begin``, without most of those that can't be found: their first ``least`` + 1 keys, or all they have, must follow each other somewhere in the sentences.

    No phrase may have fewer than ``least`` keys; what is left out then leads no place further than a phrase that ends there. It goes by 64-bit hashes, so a few others stay; that costs
    their edges and changes no result. To make what is left distinct by ``begin`` and more moves nothing."""
    keys = sentences.select(_made(_NUMBERS.format("transform(tokens, t -> t.key)"), tokens).alias("keys"))
    grams = keys.select(F.explode(F.expr(f"array_distinct(concat({_heads(least)}, {_heads(least + 1)}))")).alias("begin")).distinct()
    return phrases.withColumn("begin", F.expr(f"xxhash64({_NUMBERS.format(f'slice(words, 1, {least + 1})')})")).join(grams, "begin", "left_semi")


def _places(keyed: DataFrame, phrases: DataFrame, sizes: list[int]) -> DataFrame:
    """(sent, start, keys) of the places in ``keyed`` (sent, keys) where the first three keys of a phrase stand, or all of a shorter one; ``sizes`` of phrases' heads occur."""
    begins = phrases.select(F.expr(f"xxhash64(slice(words, 1, {HEAD}))").alias("begin")).distinct()
    at = keyed.select("sent", F.posexplode(F.expr(f"arrays_zip({', '.join(_heads(k) for k in sizes)})")).alias("start", "begins"))
    at = at.select("sent", "start", F.explode(F.array_distinct(F.array("begins.*"))).alias("begin"))
    starts = at.join(begins, "begin", "left_semi").groupBy("sent").agg(F.collect_set("start").alias("starts"))
    return keyed.join(starts, "sent").select("sent", "keys", F.explode("starts").alias("start"))


def _joined(field: str, depth: str) -> str:
    return f"array_join(transform(slice(tokens, start + 1, {depth}), t -> t.{field}), '')"


def hits(sentences: DataFrame, phrases: DataFrame, forms: DataFrame, steps: Steps, tokens: str | None = None) -> DataFrame:
    """(sent, start, len, entry_id): at each place the longest phrase that is valid there.

    Where one entry ends, nothing needs asking. Where several do, an entry of ``forms`` (entry_id, kanji_keys, readings) needs the place's writing, or, if the
    place reads as it is written as far as the tree goes, or holds an unknown token, its sound; the least such entry is taken. Keys and sentences are moved as
    numbers, with the keys ahead only from where a phrase can begin; ``met`` leaves out phrases beforehand."""
    keyed = sentences.select("sent", F.monotonically_increasing_id().alias("number"), _made(_NUMBERS.format("transform(tokens, t -> t.key)"), tokens).alias("keys"))
    keyed = steps.saved(keyed)
    phrases = phrases.filter(F.size("words") > 0).select(F.expr(_NUMBERS.format("words")).alias("words"), "entry_id")
    edges = steps.saved(trie(phrases).select("node", "n", "first"))
    size = F.size("node")
    longest, sizes = edges.filter("n > 0").agg(F.max(size), F.sort_array(F.collect_set(F.least(size, F.lit(HEAD))))).first()
    if longest is None:
        return sentences.select("sent", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(0).cast("bigint").alias("entry_id")).limit(0)
    places = _places(keyed.select(F.col("number").alias("sent"), "keys"), phrases, sizes)
    found = _descended(places, edges, sizes[0], longest, steps).withColumnRenamed("sent", "number")
    one = F.when(F.col("n") == 1, F.col("depth"))
    ends = found.groupBy("number", "start").agg(F.max("depth").alias("deepest"), F.max(one).alias("len"), F.max_by("first", one).alias("entry_id"), F.max("n").alias("most"))
    ends = steps.saved(ends.filter("most > 0"))
    sure = ends.filter("len is not null").select("number", "start", "len", "entry_id")
    asked = found.filter("n > 1").select("number", "start", "depth", "node").join(ends.filter("most > 1").select("number", "start", "deepest"), ["number", "start"])
    asked = steps.saved(asked)  # few, as a rule: what these join need not be moved then
    spoken = asked.join(keyed.select("number", "sent"), "number").join(sentences.drop("copies"), "sent")
    fields = ", ".join(f"'{name}', {_joined(name, 'depth')}" for name in ("orth", "orth_base", "pron", "pron_base"))
    pattern, written = "exists(slice(tokens, start + 1, depth), t -> not t.known)", f"{_joined('orth', 'deepest')} = {_joined('pron', 'deepest')}"
    spoken = spoken.select("number", "start", "depth", "node", _made(f"named_struct({fields}, 'is_pattern', {pattern}, 'as_written', {written})", tokens).alias("x")).select("number", "start", "depth", "node", "x.*")
    several = phrases.select(F.col("words").alias("node"), "entry_id").join(asked.select("node").distinct(), "node", "left_semi").distinct()
    several = steps.saved(several).join(forms, "entry_id")
    fits = phrase_fits(spoken.join(several, "node"), F.col("as_written") | F.col("is_pattern")).filter("fits")
    checked = fits.groupBy("number", "start", "depth").agg(F.min("entry_id").alias("entry_id")).select("number", "start", F.col("depth").alias("len"), "entry_id")
    best = sure.unionByName(checked).groupBy("number", "start").agg(F.max_by("entry_id", "len").alias("entry_id"), F.max("len").alias("len"))
    return best.join(keyed.select("number", "sent"), "number").select("sent", "start", "len", "entry_id")


def walked(sentences: DataFrame, hits: DataFrame, tokens: str | None = None) -> DataFrame:
    """``sentences`` walked from the left with ``taken``, the phrases (start, len, entry_id) that were recorded, and ``single``, the places of the tokens between them.

    A phrase skips the places that it covers, so what a place finds counts only if the walk comes there."""
    at = hits.groupBy("sent").agg(F.array_sort(F.collect_list(F.struct("start", "len", "entry_id"))).alias("at"))
    taken = "aggregate(at, named_struct('end', 0, 'out', slice(at, 1, 0)), (s, x) -> if(x.start >= s.end, named_struct('end', x.start + x.len, 'out', concat(s.out, array(x))), s), s -> s.out)"
    rows = sentences.join(at, "sent", "left").withColumn("taken", F.coalesce(F.expr(taken), F.expr("cast(array() as array<struct<start: int, len: int, entry_id: bigint>>)"))).drop("at")
    covered = "flatten(transform(taken, x -> sequence(x.start, x.start + x.len - 1)))"
    return rows.withColumn("single", _made(f"if(size(tokens) = 0, cast(array() as array<int>), array_except(sequence(0, size(tokens) - 1), {covered}))", tokens))


def recorded(walked: DataFrame, mapping: DataFrame, names: DataFrame, tokens: str | None = None) -> DataFrame:
    """(entry_id, n) of all that a walk records: its phrases, and of single known tokens the entries that ``mapping`` (lemma, kind, writing, entry_id) gives, or
    else, of proper nouns, the ``names`` (lemma, entry_id).

    Equal tokens are counted before they are joined. ``one`` and ``star`` count all targets; ``writing`` those of the base form, or else of the folded one."""
    phrases = walked.select("copies", F.explode("taken").alias("x")).groupBy("x.entry_id").agg(F.sum("copies").alias("n"))
    singles = walked.select("copies", F.explode(_made("transform(single, i -> tokens[i])", tokens)).alias("t")).filter("t.known")
    kinds = singles.groupBy("t.lemma", "t.orth_base", "t.folded", "t.proper").agg(F.sum("copies").alias("n"))
    targets = mapping.select("lemma", F.when(F.col("kind").isin("one", "star"), F.lit(None)).otherwise(F.col("writing")).alias("as"), F.col("kind").isin("one", "star").alias("all"), "entry_id")
    form = F.when(F.col("all") | (F.col("as") == F.col("orth_base")), 0).when(F.col("as") == F.col("folded"), 1)
    first = Window.partitionBy("lemma", "orth_base", "folded", "proper")
    mapped = kinds.join(targets, "lemma").withColumn("form", form).filter("form is not null").withColumn("first", F.min("form").over(first)).filter("form = first")
    done = mapped.select("lemma", "orth_base", "folded", "proper").distinct()
    rest = kinds.filter("proper").join(done, ["lemma", "orth_base", "folded", "proper"], "left_anti")
    named = rest.join(names.select("lemma", "entry_id").distinct(), "lemma")
    all_ = phrases.unionByName(mapped.select("entry_id", "n")).unionByName(named.select("entry_id", "n"))
    return all_.groupBy("entry_id").agg(F.sum("n").alias("n"))


def counted(sentences: DataFrame, phrases: DataFrame, forms: DataFrame, mapping: DataFrame, names: DataFrame, tokens: str | None = None) -> DataFrame:
    """(entry_id, n): how often each entry stands in the corpus of ``sentences``."""
    steps = Steps(sentences.sparkSession)
    sentences = steps.saved(sentences)
    walk = steps.saved(walked(sentences, hits(sentences, phrases, forms, steps, tokens), tokens))
    return steps.result(recorded(walk, mapping, names, tokens))


def split_text(walked: DataFrame, tokens: str | None = None) -> DataFrame:
    """(sent, text) of walked sentences: phrases and single tokens as the walk cut them, a blank between them."""
    units = "array_sort(concat(transform(taken, x -> named_struct('start', x.start, 'len', x.len)), transform(single, i -> named_struct('start', i, 'len', 1))))"
    text = f"array_join(transform({units}, u -> array_join(transform(slice(tokens, u.start + 1, u.len), t -> t.surface), '')), ' ')"
    return walked.select("sent", _made(text, tokens).alias("text"))


def sampled(rows: DataFrame, keys: list[str], fraction: float, seed: int = 0) -> DataFrame:
    """About ``fraction`` of ``rows``, chosen by a seeded digest of their keys: the same rows, however they are partitioned or ordered.

    Rows of equal keys, nulls included, stay or go together."""
    parts = F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("\x1e")) for k in keys))
    return rows.filter(F.conv(F.substring(F.md5(parts), 1, 12), 16, 10).cast("bigint") < int(fraction * (1 << 48)))
