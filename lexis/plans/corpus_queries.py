"""Queries that count entries over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexis.operators import alignment, candidates, corpus, lookup
from lexis.plans.registry import query, table
from lexis.steps import Steps

#: Letters with marks and the letters that stand for them in keys, as kana of two kinds do in Japanese.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: A phrase is a part of a sentence of so many words.
LEAST, MOST = 2, 8


def _fold(word: str) -> str:
    return f"translate(lower({word}), '{MARKED}', '{PLAIN}')"


def _key(word: str) -> str:
    """The lemma of a known word (of two letters or more), the surface of another."""
    return f"if(length({word}) > 1, {_fold(word)}, lower({word}))"


def _words(text: str) -> str:
    return f"filter(split({text}, '[^\\\\p{{L}}]+'), w -> w <> '')"


#: The tokens of a text.
_TOKENS = f"""transform({_words('text')}, w -> named_struct('key', {_key('w')}, 'surface', w, 'orth', lower(w), 'orth_base', lower(w), 'folded', {_fold('w')}, 'pron', if(length(w) > 1, {_fold('w')}, '.+'),
    'pron_base', if(length(w) > 1, {_fold('w')}, '.+'), 'known', length(w) > 1, 'lemma', {_fold('w')}, 'proper', w <> lower(w)))"""


def phrase_entries(texts: DataFrame, corpus_: DataFrame, steps: Steps) -> DataFrame:
    """Entries (entry_id, words, kanji_keys, readings) of the parts of sentences in texts (text) whose beginnings ``corpus_`` has; those in plain letters have a reading, others a writing.

    Parts are moved and kept as texts, and made distinct where they meet the corpus."""
    parts = f"filter(transform(split(text, '[.,!?|\\\\n]+'), part -> transform({_words('part')}, w -> lower(w))), w -> size(w) between {LEAST} and {MOST})"
    parts = texts.select(F.explode(F.expr(f"array_distinct(transform({parts}, w -> array_join(w, ' ')))")).alias("part"))
    words = F.expr(f"transform(split(part, ' '), x -> {_key('x')})").alias("words")
    parts = steps.saved(corpus.met(parts.select("part", words), corpus_, _TOKENS, LEAST).select("begin", "part").distinct().select("part"))
    plain, writing = "part rlike '^[a-z ]+$'", "replace(part, ' ', '')"
    return parts.select(
        F.expr("cast(conv(substring(md5(part), 1, 12), 16, 10) as bigint)").alias("entry_id"),
        words,
        F.expr(f"if({plain}, cast(array() as array<string>), array({writing}))").alias("kanji_keys"),
        F.expr(f"if({plain}, array(named_struct('key', {writing}, 'nokanji', false, 'uk', false)), cast(array() as array<struct<key: string, nokanji: boolean, uk: boolean>>))").alias("readings"),
    )


def word_mapping(texts: DataFrame) -> DataFrame:
    """(lemma, kind, writing, entry_id) of the known words of texts: a lemma's one word, all words of a short lemma, or of a longer one those in the same writing."""
    words = texts.select(F.explode(F.expr(f"transform({_words('text')}, w -> lower(w))")).alias("w")).filter("length(w) > 1").distinct()
    words = words.select(F.expr(_fold("w")).alias("lemma"), F.col("w").alias("writing"), lookup.entry_id("w").alias("entry_id"))
    return words.withColumn("size", F.count("*").over(Window.partitionBy("lemma"))).select("lemma", F.when(F.col("size") == 1, "one").when(F.length("lemma") <= 3, "star").otherwise("writing").alias("kind"), "writing", "entry_id")


def names(texts: DataFrame) -> DataFrame:
    """(lemma, entry_id) of capitalised words of texts."""
    words = texts.select(F.explode(F.expr(_words("text"))).alias("w")).filter("w <> lower(w)")
    return words.select(F.expr(_fold("w")).alias("lemma"), F.expr("cast(conv(substring(md5(concat('name ', lower(w))), 1, 12), 16, 10) as bigint)").alias("entry_id")).distinct()


def _lexicon(spark: SparkSession, sf_dir: str, steps: Steps) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The conversations' texts, and the phrases and forms of the documents' entries that they may have."""
    corpus_ = steps.saved(corpus.distinct_sentences(table(spark, sf_dir, "conversations")))
    entries = phrase_entries(table(spark, sf_dir, "documents").select("text"), corpus_, steps)
    return corpus_, entries.select("words", "entry_id"), entries.select("entry_id", "kanji_keys", "readings")


_W = r"list_filter(string_split_regex({}, '[^\p{{L}}]+'), lambda w: w <> '')"
_SQL_KEY = "CASE WHEN length({0}) > 1 THEN translate(lower({0}), '%s', '%s') ELSE lower({0}) END" % (MARKED, PLAIN)
_SQL_FOLD = "translate(lower({0}), '%s', '%s')" % (MARKED, PLAIN)
_SQL_ID = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT)"
_WALK = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT md5(text) AS sent, count(*) AS copies, any_value({_W.format('text')}) AS w FROM conversations WHERE text IS NOT NULL GROUP BY text),
t AS MATERIALIZED (SELECT sent, copies, w, len(w) AS size, [{_SQL_KEY.format('x')} FOR x IN w] AS keys, [lower(x) FOR x IN w] AS orth, [CASE WHEN length(x) > 1 THEN {_SQL_FOLD.format('x')} ELSE '.+' END FOR x IN w] AS pron FROM s),
parts AS MATERIALIZED (SELECT DISTINCT w FROM (SELECT [lower(x) FOR x IN {_W.format('part')}] AS w FROM (SELECT unnest(string_split_regex(text, '[.,!?|\\n]+')) AS part FROM documents WHERE text IS NOT NULL)) WHERE len(w) BETWEEN {LEAST} AND {MOST}),
phr AS MATERIALIZED (SELECT {_SQL_ID.format("array_to_string(w, ' ')")} AS entry_id, [{_SQL_KEY.format('x')} FOR x IN w] AS keys, array_to_string(w, '') AS writing, regexp_matches(array_to_string(w, ''), '^[a-z]+$') AS plain FROM parts),
ends AS MATERIALIZED (SELECT keys AS node, count(DISTINCT entry_id) AS n, min(entry_id) AS first FROM phr GROUP BY keys),
begins AS MATERIALIZED (SELECT DISTINCT keys[1:d] AS node FROM (SELECT keys, unnest(range(1, len(keys) + 1)) AS d FROM phr)),
grams AS MATERIALIZED (SELECT sent, p, k, keys[p:p + k - 1] AS node, array_to_string(orth[p:p + k - 1], '') AS o, array_to_string(pron[p:p + k - 1], '') AS s FROM (SELECT *, unnest(range(1, least({MOST}, size - p + 1) + 1)) AS k FROM (SELECT *, unnest(range(1, size + 1)) AS p FROM t))),
deep AS MATERIALIZED (SELECT sent, p, arg_max(o = s, k) AS as_written FROM grams JOIN begins USING (node) GROUP BY sent, p),
valid AS MATERIALIZED (SELECT sent, p, k, first AS entry_id FROM grams JOIN ends USING (node) WHERE n = 1 UNION ALL
  SELECT g.sent, g.p, g.k, min(e.entry_id) FROM grams g JOIN ends USING (node) JOIN deep d ON d.sent = g.sent AND d.p = g.p JOIN phr e ON e.keys = g.node
  WHERE n > 1 AND ((NOT e.plain AND e.writing = g.o) OR (e.plain AND (as_written OR contains(s, '.+')) AND CASE WHEN contains(s, '.+') THEN regexp_full_match(e.writing, s) ELSE e.writing = s END)) GROUP BY g.sent, g.p, g.k),
h AS MATERIALIZED (SELECT sent, p, max(k) AS k, arg_max(entry_id, k) AS entry_id FROM valid GROUP BY sent, p),
walk(sent, copies, size, pos, p, k, entry_id) AS (SELECT sent, copies, size, 1, 0, 0, CAST(NULL AS BIGINT) FROM t UNION ALL
  SELECT w.sent, w.copies, w.size, w.pos + coalesce(h.k, 1), w.pos, coalesce(h.k, 1), h.entry_id FROM walk w LEFT JOIN h ON h.sent = w.sent AND h.p = w.pos WHERE w.pos <= w.size)
"""


@query(
    _WALK
    + f""", voc AS (SELECT lemma, writing, {_SQL_ID.format('writing')} AS entry_id, count(*) OVER (PARTITION BY lemma) AS size FROM (SELECT DISTINCT {_SQL_FOLD.format('w')} AS lemma, lower(w) AS writing FROM (SELECT unnest({_W.format('text')}) AS w FROM documents) WHERE length(w) > 1)),
names AS (SELECT DISTINCT {_SQL_FOLD.format('w')} AS lemma, {_SQL_ID.format("'name ' || lower(w)")} AS entry_id FROM (SELECT unnest({_W.format('text')}) AS w FROM benchmark) WHERE w <> lower(w)),
single AS (SELECT {_SQL_FOLD.format('x')} AS lemma, lower(x) AS writing, x <> lower(x) AS proper, sum(copies) AS n FROM (SELECT walk.copies, t.w[walk.p] AS x FROM walk JOIN t USING (sent) WHERE p > 0 AND entry_id IS NULL) WHERE length(x) > 1 GROUP BY ALL),
found AS (SELECT s.lemma, s.writing, proper, n, v.entry_id, CASE WHEN size = 1 OR length(s.lemma) <= 3 OR v.writing = s.writing THEN 0 WHEN v.writing = s.lemma THEN 1 END AS form FROM single s JOIN voc v ON v.lemma = s.lemma),
mapped AS (SELECT * FROM found WHERE form IS NOT NULL QUALIFY form = min(form) OVER (PARTITION BY lemma, writing, proper)),
every AS (SELECT entry_id, copies AS n FROM walk WHERE entry_id IS NOT NULL UNION ALL SELECT entry_id, n FROM mapped UNION ALL
  SELECT entry_id, n FROM single s JOIN names USING (lemma) WHERE proper AND NOT EXISTS (SELECT 1 FROM mapped m WHERE m.lemma = s.lemma AND m.writing = s.writing AND m.proper))
SELECT entry_id, CAST(sum(n) AS BIGINT) AS n FROM every GROUP BY entry_id"""
)
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the documents' phrases and words and the benchmark's names stand in the conversations."""
    steps = Steps(spark)
    corpus_, phrases, forms = _lexicon(spark, sf_dir, steps)
    documents = table(spark, sf_dir, "documents").select("text")
    counts = corpus.counted(corpus_, phrases, forms, word_mapping(documents), names(table(spark, sf_dir, "benchmark").select("text")), _TOKENS)
    steps.discard()
    return counts


@query(_WALK + ", u AS (SELECT sent, p, array_to_string(w[p:p + k - 1], '') AS unit FROM walk JOIN t USING (sent) WHERE p > 0) SELECT sent, string_agg(unit, ' ' ORDER BY p) AS text FROM u GROUP BY sent UNION ALL SELECT sent, '' FROM t WHERE size = 0")
def split_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as the walk cut them: phrases without blanks, blanks between phrases and single words."""
    steps = Steps(spark)
    corpus_, phrases, forms = _lexicon(spark, sf_dir, steps)
    return steps.result(corpus.split_text(corpus.walked(corpus_, corpus.hits(corpus_, phrases, forms, steps, _TOKENS), _TOKENS), _TOKENS))


@query("SELECT conv_id, turn FROM conversations WHERE CAST('0x' || substr(md5('7' || chr(31) || coalesce(CAST(conv_id AS VARCHAR), chr(30)) || chr(31) || coalesce(CAST(turn AS VARCHAR), chr(30))), 1, 12) AS BIGINT) < CAST(0.1 * 281474976710656 AS BIGINT)")
def sample_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the turns by a seeded digest of their keys: the sampling operator itself."""
    return corpus.sampled(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], 0.1, 7).select("conv_id", "turn")


#: Endings that tell parts of speech here, and the entries' tags for them.
_VERB, _ADVERB = "(ed|ing|en|er)$", "ly$"


def lexicons(lexemes: DataFrame, entries: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Two lexicons of the words of texts (text): lexemes, entries, the entries' groups, and the index of surfaces, as ``alignment.align`` takes them.

    A lemma has the words that agree without marks and plural; an entry those whose first six plain letters agree. Texts are cut into words once: all four
    tables are of ``steps``. Words are made distinct as they stand before letters are changed, which is then done for each of them once."""
    fold, ident = _fold, lambda x: f"cast(conv(substring(md5({x}), 1, 12), 16, 10) as bigint)"
    cut = lambda texts: texts.select(F.explode(F.split("text", r"[^\p{L}]+")).alias("w")).filter("length(w) > 1").distinct()
    words = cut(lexemes).groupBy(F.lower("w").alias("orth")).agg(F.every(F.expr("w <> lower(w)")).alias("proper"))
    words = words.withColumn("orth_key", F.expr(fold("orth"))).withColumn("lemma", F.expr("if(length(orth_key) > 3, regexp_replace(orth_key, 's$', ''), orth_key)"))
    left = words.selectExpr(f"{ident('lemma')} as lemma_id", f"case when proper then 'proper' when orth rlike '{_VERB}' then 'verb' when orth rlike '{_ADVERB}' then 'adverb' else 'noun' end as pos", "orth", "orth_key")
    left = steps.saved(left).withColumn("pron_key", F.col("orth_key"))
    texts = cut(entries).select(F.lower("w").alias("text")).distinct().withColumn("text_key", F.expr(fold("text")))
    texts = texts.withColumn("head", F.expr("left(text_key, 6)")).withColumn("tag", F.expr(f"case when text rlike '{_VERB}' then 'v5' when text rlike '{_ADVERB}' then 'adv' else 'n' end"))
    texts = steps.saved(texts.withColumn("entry_id", F.expr(ident("concat('entry ', head)"))))
    heads = texts.groupBy("entry_id").agg(F.bool_or(F.expr("tag = 'n'")).alias("is_noun"), F.bool_or(F.expr("text <> text_key")).alias("has_kanji"))
    right = texts.join(heads, "entry_id").selectExpr("entry_id", "is_noun", "has_kanji", "length(text) % 7 = 0 as nokanji", "length(head) % 2 = 0 as uk", "false as archaic", "text", "text_key as reading_key", "text_key")
    groups = texts.groupBy("entry_id", "tag").agg(F.bool_or(F.expr("text <> text_key")).alias("marked")).selectExpr("entry_id", "tag = 'adv' as archaic", "if(marked, array(tag, 'exp'), array(tag)) as pos")
    return left, steps.saved(right), steps.saved(groups), left.select(F.col("orth_key").alias("surface"), "lemma_id")


def _covered(name: str, links: str, left: str, right: str, left_texts: str, right_texts: str) -> str:
    return f"""{name}_deg AS (SELECT {right}, count(*) AS d FROM {links} GROUP BY 1),
{name}_open AS (SELECT {left} FROM {links} JOIN {name}_deg USING ({right}) GROUP BY 1 HAVING count(*) > 1 AND max(d) > 1),
{name}_keep AS (SELECT {left}, min({right}) AS keep FROM (
  SELECT l.{left}, l.{right} FROM {links} l JOIN {name}_open USING ({left}) WHERE NOT EXISTS (SELECT 1 FROM {left_texts} t WHERE t.{left} = l.{left} AND NOT EXISTS (SELECT 1 FROM {right_texts} r WHERE r.{right} = l.{right} AND r.text = t.text))) GROUP BY 1 HAVING count(*) = 1),
{name} AS MATERIALIZED (SELECT l.lemma_id, l.entry_id FROM {links} l LEFT JOIN {name}_keep k ON l.{left} = k.{left} WHERE keep IS NULL OR keep = l.{right})"""


_ALIGN = f"""WITH w AS (SELECT lower(w) AS orth, bool_and(w <> lower(w)) AS proper, {_SQL_FOLD.format('lower(w)')} AS k FROM (SELECT unnest({_W.format('text')}) AS w FROM documents) WHERE length(w) > 1 GROUP BY lower(w)),
lx AS MATERIALIZED (SELECT {_SQL_ID.format("CASE WHEN length(k) > 3 THEN regexp_replace(k, 's$', '') ELSE k END")} AS lemma_id, CASE WHEN proper THEN 'proper' WHEN regexp_matches(orth, '{_VERB}') THEN 'verb' WHEN regexp_matches(orth, '{_ADVERB}') THEN 'adverb' ELSE 'noun' END AS pos, orth, k FROM w),
c AS (SELECT DISTINCT lower(w) AS text, {_SQL_FOLD.format('lower(w)')} AS k FROM (SELECT unnest({_W.format('text')}) AS w FROM conversations) WHERE length(w) > 1),
en AS MATERIALIZED (SELECT {_SQL_ID.format("'entry ' || left(k, 6)")} AS entry_id, text, k, length(left(k, 6)) % 2 = 0 AS uk, CASE WHEN regexp_matches(text, '{_VERB}') THEN 'v5' WHEN regexp_matches(text, '{_ADVERB}') THEN 'adv' ELSE 'n' END AS tag FROM c),
heads AS (SELECT entry_id, bool_or(tag = 'n') AS is_noun, bool_or(text <> k) AS has_kanji FROM en GROUP BY 1),
j AS (SELECT lx.*, en.entry_id, en.text, uk, length(text) % 7 = 0 AS nokanji, is_noun, has_kanji FROM lx JOIN en USING (k) JOIN heads USING (entry_id)),
ne AS (SELECT lemma_id, orth, count(DISTINCT entry_id) AS n_entries, count(DISTINCT CASE WHEN is_noun THEN entry_id END) AS n_nouns FROM j GROUP BY 1, 2), nl AS (SELECT k, pos, count(DISTINCT lemma_id) AS n_lemmas FROM j GROUP BY 1, 2),
m AS MATERIALIZED (SELECT DISTINCT lemma_id, entry_id, orth AS writing, pos FROM j JOIN ne USING (lemma_id, orth) JOIN nl USING (k, pos)
  WHERE (pos <> 'proper' OR (n_nouns <= 1 AND n_lemmas <= 1 AND is_noun)) AND CASE WHEN regexp_matches(orth, '^[a-z]*$') THEN text = orth AND (NOT has_kanji OR nokanji OR (uk AND n_entries = 1)) ELSE TRUE END),
g AS (SELECT entry_id, tag FROM en WHERE tag <> 'adv' GROUP BY 1, 2),
pairs AS MATERIALIZED (SELECT DISTINCT pos, tag FROM (SELECT lemma_id, min(entry_id) AS entry_id FROM m GROUP BY 1 HAVING count(DISTINCT entry_id) = 1)
  JOIN (SELECT lemma_id, arg_min(pos, orth) AS pos FROM lx GROUP BY 1) USING (lemma_id) JOIN (SELECT entry_id, min(tag) AS tag FROM g GROUP BY 1 HAVING count(*) = 1) USING (entry_id) WHERE pos <> 'proper' OR tag = 'n'),
ok AS MATERIALIZED (SELECT DISTINCT lemma_id, entry_id, writing FROM m WHERE EXISTS (SELECT 1 FROM g JOIN pairs p ON p.tag = g.tag WHERE g.entry_id = m.entry_id AND p.pos = m.pos)),
one AS (SELECT k, min(lemma_id) AS lemma_id FROM lx GROUP BY k HAVING count(DISTINCT lemma_id) = 1),
every AS MATERIALIZED (SELECT * FROM ok UNION SELECT one.lemma_id, en.entry_id, en.k FROM en JOIN one USING (k) WHERE en.entry_id NOT IN (SELECT entry_id FROM ok)),
links AS MATERIALIZED (SELECT DISTINCT lemma_id, entry_id FROM every), lt AS (SELECT lemma_id, orth AS text FROM lx), et AS (SELECT entry_id, text FROM en),
{_covered('byentry', 'links', 'entry_id', 'lemma_id', 'et', 'lt')},
{_covered('bylemma', 'byentry', 'lemma_id', 'entry_id', 'lt', 'et')},
kinds AS (SELECT lemma_id, CASE WHEN count(*) = 1 THEN 'one' WHEN max(d) = 1 THEN 'star' ELSE 'ambiguous' END AS kind FROM bylemma JOIN (SELECT entry_id, count(*) AS d FROM bylemma GROUP BY 1) USING (entry_id) GROUP BY 1)
"""
_MAPPED = "SELECT lemma_id, CAST(NULL AS VARCHAR) AS writing, entry_id, kind FROM bylemma JOIN kinds USING (lemma_id) WHERE kind <> 'ambiguous' UNION ALL SELECT lemma_id, writing, min(entry_id), 'ambiguous' FROM every JOIN kinds USING (lemma_id) WHERE kind = 'ambiguous' GROUP BY 1, 2 HAVING count(DISTINCT entry_id) = 1"


#: Writings that count as kana here.
_PLAIN = "^[a-z]*$"


def _lexicons(spark: SparkSession, sf_dir: str, steps: Steps) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return lexicons(table(spark, sf_dir, "documents").select("text"), table(spark, sf_dir, "conversations").select("text"), steps)


@query(_ALIGN + _MAPPED)
def align_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon of the documents aligned with the dictionary of the conversations, from raw words to the final mapping."""
    steps = Steps(spark)
    return steps.result(alignment.aligned_steps(*_lexicons(spark, sf_dir, steps), _PLAIN, steps))


@query(_ALIGN + f"SELECT DISTINCT entry_id FROM ({_MAPPED})")
def mapped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Steps(spark)
    return steps.result(alignment.mapped_entries(alignment.aligned_steps(*_lexicons(spark, sf_dir, steps), _PLAIN, steps)))


@query(_ALIGN + "SELECT pos, tag AS entry_pos FROM pairs")
def learned_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of parts of speech that unique matches of the two lexicons teach."""
    steps = Steps(spark)
    lexemes, entries, groups, _ = _lexicons(spark, sf_dir, steps)
    matches = alignment.simple_matches(lexemes, entries, _PLAIN, steps=steps)
    return steps.result(alignment.learned_pairs(matches, lexemes, groups).select("pos", "entry_pos"))


@query(_ALIGN + "SELECT DISTINCT lemma_id, entry_id, writing FROM m")
def multi_cond_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Steps(spark)
    lexemes, entries, _, _ = _lexicons(spark, sf_dir, steps)
    return steps.result(alignment.simple_matches(lexemes, entries, _PLAIN, steps=steps))


@query(_ALIGN + "SELECT DISTINCT lemma_id, entry_id FROM lx JOIN en USING (k) WHERE pos = 'proper'")
def names_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = Steps(spark)
    lexemes, entries, _, _ = _lexicons(spark, sf_dir, steps)
    return steps.result(alignment.name_matches(lexemes, entries))


#: What tells a word's part of speech in this query, and the classes that stand for others there.
_CLASSES = {"verb": ("v5",), "adverb": ("adv",), "noun": ("n",)}


@query(
    _ALIGN.split(",\nj AS", 1)[0]
    + f""", ask AS (SELECT DISTINCT lower(w) AS w, {_SQL_FOLD.format('lower(w)')} AS k FROM (SELECT unnest({_W.format('text')}) AS w FROM benchmark) WHERE length(w) > 3),
e AS (SELECT entry_id, left(min(k), 4) AS head, list(DISTINCT tag) AS tags, list(text) FILTER (text <> k) AS kanjis, list(k) AS readings FROM en GROUP BY entry_id),
f0 AS (SELECT ask.*, e.*, CASE WHEN regexp_matches(w, '{_VERB}') THEN 'v5' WHEN regexp_matches(w, '{_ADVERB}') THEN 'adv' ELSE 'n' END AS tag FROM ask JOIN e ON left(ask.k, 4) = e.head),
p1 AS (SELECT *, list_contains(tags, tag) AS ok FROM f0), f1 AS (SELECT * FROM p1 QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY w)),
p2 AS (SELECT * EXCLUDE (ok), list_contains(readings, k) AS ok FROM f1), f2 AS (SELECT * FROM p2 QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY w)),
p3 AS (SELECT * EXCLUDE (ok), (kanjis IS NULL AND w = k OR w <> k AND list_contains(coalesce(kanjis, []), w)) AND list_contains(readings, k) AS ok FROM f2), f3 AS (SELECT * FROM p3 QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY w)),
s AS (SELECT w, bool_or(list_contains(tags, tag)) AS a FROM f0 GROUP BY w), t AS (SELECT w, bool_or(ok) AS b FROM p2 GROUP BY w), u AS (SELECT w, bool_or(ok) AS c FROM p3 GROUP BY w)
SELECT w, entry_id, concat_ws(',', CASE WHEN NOT a THEN 'pos' END, CASE WHEN NOT b THEN 'form' END, CASE WHEN NOT c THEN 'forms' END) AS skipped FROM f3 JOIN s USING (w) JOIN t USING (w) JOIN u USING (w)"""
)
def candidate_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the conversations' dictionary that are left for the benchmark's words after filters by part of speech, form, and shared writings and readings."""
    steps = Steps(spark)
    _, texts, groups, _ = _lexicons(spark, sf_dir, steps)
    tags = groups.groupBy("entry_id").agg(F.flatten(F.collect_set("pos")).alias("tags"))
    own = texts.groupBy("entry_id").agg(F.left(F.min("text_key"), F.lit(4)).alias("head"), F.collect_set(F.when(F.col("text") != F.col("text_key"), F.col("text"))).alias("kanjis"), F.collect_set("text_key").alias("readings"))
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.expr(_words("text"))).alias("w")).filter("length(w) > 3").select(F.lower("w").alias("w")).distinct().withColumn("k", F.expr(_fold("w")))
    words = words.withColumn("asked", F.expr(f"array(case when w rlike '{_VERB}' then 'verb' when w rlike '{_ADVERB}' then 'adverb' else 'noun' end)"))
    words = words.withColumn("writings", F.expr("if(w <> k, array(w), cast(array() as array<string>))")).withColumn("sounds", F.array("k"))
    pairs = words.join(own, F.left("k", F.lit(4)) == F.col("head")).join(tags, "entry_id")
    filters = {"pos": candidates.has_pos("tags", "asked", _CLASSES), "form": candidates.has_form("readings", "k"), "forms": candidates.shares_forms("kanjis", "readings", "writings", "sounds")}
    return steps.result(candidates.cascade(pairs, ["w"], filters).select("w", "entry_id", F.array_join("skipped", ",").alias("skipped")))


@query(
    """WITH RECURSIVE l AS (SELECT doc_id, i - 1 AS line_ix, x[i] AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE regexp_matches(x[i], '[()<>|]')),
d AS (SELECT DISTINCT line FROM l),
f(line, p, parts, stack, problem) AS (SELECT line, 1, [''], '', CAST(NULL AS VARCHAR) FROM d UNION ALL
  SELECT line, p + 1, CASE WHEN problem IS NOT NULL THEN parts WHEN c IN ('(', '<') THEN CASE WHEN stack = '' THEN list_concat(parts, [c, '']) ELSE list_append(parts[1:-2], parts[-1] || c) END
    WHEN c NOT IN (')', '>') THEN list_append(parts[1:-2], parts[-1] || c) WHEN stack = '' OR right(stack, 1) <> CASE c WHEN ')' THEN '(' ELSE '<' END THEN parts WHEN length(stack) = 1 THEN list_concat(parts, [c, '']) ELSE parts END,
   CASE WHEN problem IS NOT NULL THEN stack WHEN c IN ('(', '<') THEN stack || c WHEN c IN (')', '>') AND right(stack, 1) = CASE c WHEN ')' THEN '(' ELSE '<' END THEN left(stack, length(stack) - 1) ELSE stack END,
   CASE WHEN problem IS NOT NULL THEN problem WHEN c IN (')', '>') AND stack = '' THEN 'unopened' WHEN c IN (')', '>') AND right(stack, 1) <> CASE c WHEN ')' THEN '(' ELSE '<' END THEN 'crossed' END
  FROM (SELECT *, substr(line, p, 1) AS c FROM f WHERE p <= length(line))),
z AS (SELECT line, CASE WHEN parts[-1] = '' THEN parts[1:-2] ELSE parts END AS parts, stack, problem FROM f WHERE p = length(line) + 1)
SELECT doc_id, CAST(line_ix AS INTEGER) AS line_ix, array_to_string(parts, chr(31)) AS parts, stack AS "open", problem FROM l JOIN z USING (line)"""
)
def bracket_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines with brackets, cut at the outer ones, with what is left open and what is wrong."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_ix", "text")).filter(F.col("text").rlike("[()<>|]"))
    return candidates.bracketed(lines, brackets={"(": ")", "<": ">"}).select("doc_id", "line_ix", F.array_join("parts", "\x1f").alias("parts"), "open", "problem")
