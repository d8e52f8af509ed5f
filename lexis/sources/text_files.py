"""Text sources and sinks: lexicon CSV, rule tables, token streams, n-best parses, sentence pairs, frequencies, wiki pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lexicon(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of quoted CSV lines (value); an empty surface stands for a quotation mark that the file can't write."""
    df = lines.select(F.from_csv("value", schema, {"quote": '"', "mode": "FAILFAST"}).alias("r")).select("r.*")
    return df.withColumn("surface", F.when(F.coalesce(F.col("surface"), F.lit("")) == "", F.lit('"')).otherwise(F.col("surface")))


def rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table: tabs between fields, bars inside lists, comments behind #."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="suffix string, new_suffix string, source string, target string, reason string")
    return raw.select(F.coalesce("suffix", F.lit("")).alias("suffix"), F.coalesce("new_suffix", F.lit("")).alias("new_suffix"), F.split("source", r"\|").alias("source_pos"), F.split("target", r"\|").alias("target_pos"), "reason")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Sentences (sent, value) of a token stream; ``sent`` grows with the place but has gaps."""
    return spark.read.option("lineSep", "EOS\n").text(path).select(F.monotonically_increasing_id().alias("sent"), "value").filter("value <> ''")


def stream_tokens(sentences: DataFrame) -> DataFrame:
    """(sent, pos, surface, feats, known, lemma_id) of the lines that have a tab; a token with 29 fields or more is known, and its lemma is the last."""
    lines = F.expr("filter(split(value, '\\n'), x -> instr(x, '\\t') > 0)")
    rows = sentences.select("sent", F.posexplode(lines).alias("pos", "line"))
    feats = F.split(F.element_at(F.split("line", "\t"), 2), ",")
    rows = rows.select("sent", F.col("pos").cast("bigint").alias("pos"), F.element_at(F.split("line", "\t"), 1).alias("surface"), feats.alias("feats"))
    return rows.withColumn("known", F.size("feats") >= 29).withColumn("lemma_id", F.when(F.col("known"), F.expr("try_cast(element_at(feats, -1) as bigint)")))


def parse_variants(parses: DataFrame, one: bool = False) -> DataFrame:
    """(key, variant_ix, surfaces) of n-best parses (key, value), whose variants end in EOS."""
    some = F.expr("filter(split(value, 'EOS\\n?'), x -> x <> '')")
    rows = parses.select("key", F.posexplode(F.slice(some, 1, 1) if one else some).alias("variant_ix", "v"))
    return rows.select("key", "variant_ix", F.expr("transform(filter(split(v, '\\n'), x -> instr(x, '\\t') > 0), x -> split(x, '\\t')[0])").alias("surfaces"))


def sentence_pairs(pairs: DataFrame) -> DataFrame:
    """(sent_id, text, words) of pairs of an A line, with the text, and a B line, with its words. Full-width digits and letters become ASCII."""
    wide = "".join(map(chr, range(0xFF10, 0xFF3B)))
    narrow = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    text, words = F.translate("a", wide, narrow), F.translate("b", wide, narrow)
    return pairs.select(F.regexp_extract(text, "#ID=([0-9_]+)", 1).alias("sent_id"), F.regexp_extract(text, "^A: ([^\t]*)", 1).alias("text"), F.split(F.substring(words, 4, 1 << 20), " ").alias("words"))


def placed_words(sentences: DataFrame) -> DataFrame:
    """(sent_id, word_ix, form, start) of each word: the form in braces or else the head, found in the text behind the word before; null if absent."""
    form = r"coalesce(nullif(regexp_extract(w, '\\{([^}]*)\\}', 1), ''), regexp_extract(w, '^([^(\\[{|~]*)', 1))"
    step = f"named_struct('upto', if(locate({form}, text, s.upto + 1) > 0, locate({form}, text, s.upto + 1) - 1 + length({form}), s.upto), 'out', concat(s.out, array(named_struct('form', {form}, 'start', if(locate({form}, text, s.upto + 1) > 0, cast(locate({form}, text, s.upto + 1) - 1 as bigint), null)))))"
    fold = f"aggregate(words, named_struct('upto', 0, 'out', cast(array() as array<struct<form: string, start: bigint>>)), (s, w) -> {step}, s -> s.out)"
    return sentences.select("sent_id", F.posexplode(F.expr(fold)).alias("word_ix", "w")).select("sent_id", "word_ix", "w.form", "w.start")


def write_frequencies(counts: DataFrame, path: str) -> None:
    counts.select("entry_id", "n").write.csv(path, sep="\t")


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="entry_id bigint, n bigint", mode="FAILFAST")


def write_sample(sentences: DataFrame, path: str, fraction: float = 0.001, seed: int = 0) -> None:
    """A seeded sample of sentences (surfaces array), their words joined by blanks, an empty line behind each."""
    sentences.sample(fraction, seed).select(F.concat(F.array_join("surfaces", " "), F.lit("\n")).alias("value")).write.text(path)


def write_index(index: DataFrame, path: str) -> None:
    """The key index as LZ4 Parquet in order of keys, so that files and row groups can be skipped by their statistics."""
    index.repartitionByRange("key").sortWithinPartitions("key").write.option("compression", "lz4").parquet(path)


def kanji_readings(rows: DataFrame) -> DataFrame:
    """(kanji, reading) of bar-separated rows (value): columns 0, and blank-separated readings in 2 and 3, with their variants.

    Hyphens go, katakana becomes hiragana; of a reading with a dot all shorter forms down to the stem count; a final つ may double
    and the first sound may be voiced."""
    from lexis.functions.kana import HIRAGANA, KATAKANA

    p = F.split("value", r"\|")
    raw = F.explode(F.split(F.concat_ws(" ", F.get(p, F.lit(2)), F.get(p, F.lit(3))), " "))
    df = rows.select(F.get(p, F.lit(0)).alias("kanji"), raw.alias("r")).filter("r <> ''")
    df = df.withColumn("r", F.translate(F.translate("r", "-", ""), KATAKANA, HIRAGANA))
    stems = F.expr("if(instr(r, '.') > 0, transform(sequence(0, length(r) - instr(r, '.')), n -> concat(substring_index(r, '.', 1), left(substring_index(r, '.', -1), n))), array(r))")
    df = df.select("kanji", F.explode(stems).alias("r"))
    voiced = "translate(left(r, 1), 'かきくけこさしすせそたちつてとはひふへほ', 'がぎぐげござじずぜぞだぢづでどばびぶべぼ')"
    half = "translate(left(r, 1), 'はひふへほ', 'ぱぴぷぺぽ')"
    forms = F.expr(f"array_distinct(array(r, if(r like '%つ', concat(left(r, length(r) - 1), 'っ'), r), concat({voiced}, substring(r, 2)), concat({half}, substring(r, 2))))")
    return df.select("kanji", F.explode(forms).alias("reading")).distinct()


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """The page elements of a (compressed) wiki dump as ``xml``; the file is read as text cut at ``</page>``, so any size is split among tasks."""
    cut = spark.read.option("lineSep", "</page>").text(path)
    return cut.select(F.concat(F.regexp_extract("value", r"(?s)(<page>.*)", 1), F.lit("</page>")).alias("xml")).filter("xml like '<page>%'")


def wiki_pages(elements: DataFrame) -> DataFrame:
    """(title, wiki) of page elements (xml) of the main namespace."""
    page = F.from_xml("xml", "title string, ns string, revision struct<text: string>", {"mode": "FAILFAST"})
    return elements.select(page.alias("p")).filter("p.ns = '0'").select("p.title", F.col("p.revision.text").alias("wiki"))


def corpus_sentences(lines: DataFrame, tag: str | None = None) -> DataFrame:
    """Sentences (value) of a corpus' lines (value): with a ``tag``, the lines that hold it, without its marks; else those that don't begin with an element."""
    if tag is None:
        return lines.filter(~F.startswith("value", F.lit("<")))
    return lines.filter(F.contains("value", F.lit(f"<{tag}>"))).select(F.regexp_replace("value", f"</?{tag}>", "").alias("value"))


WIKI_SAMPLE = ("==日本語==\n===名詞===\n'''漢字'''（かんじ）\n#文字。\n#*例文。\n#字。\n===動詞===\n'''走る'''（はしる）\n#駆ける。", "==英語==\n===名詞===\n# word", "==日本語==\n本文")


def wiki_senses(pages: DataFrame) -> DataFrame:
    """(section, writing, reading, sense) of pages (wiki) with a Japanese heading: sections by part of speech, senses by numbered lines without examples."""
    ja = F.regexp_extract("wiki", r"(?s)(?:^|\n)==\s*日本語\s*==\n(.*?)(?:\n==[^=]|$)", 1)
    parts = pages.select(F.explode(F.expr("filter(split(concat('\n', j), '\n==='), (x, i) -> i > 0)")).alias("s")) if "j" in pages.columns else pages.withColumn("j", ja).select(F.explode(F.expr("filter(split(concat('\n', j), '\n==='), (x, i) -> i > 0)")).alias("s"))
    sections = parts.select(F.regexp_extract("s", "^([^=]+)===", 1).alias("section"), F.regexp_extract("s", "'''([^']+)'''", 1).alias("writing"), F.regexp_extract("s", "（([^）]+)）", 1).alias("reading"), F.expr("filter(split(s, '\n'), x -> x rlike '^#[^*#:]')").alias("lines"))
    return sections.select("section", "writing", "reading", F.explode(F.expr("transform(lines, x -> trim(substring(x, 2)))")).alias("sense"))
