"""A dictionary with its rules: build once, look up and render."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.functions.kana import KEY_STEP, QUERY_STEP, folded
from lexis.operators import build, frequency, lookup, render
from lexis.options import Options
from lexis.sources import xml_entries
from lexis.steps import Steps


@dataclass
class Dictionary:
    """``words`` and ``names`` are indexes (key, entry_id, pos_mask); ``rules`` a bounded list as the inflection module makes it;
    ``entries`` the contents (entry_id, is_name, kanjis, readings, groups), for rendering."""

    words: DataFrame
    names: DataFrame | None
    rules: list[tuple]
    options: Options = Options()
    entries: DataFrame | None = None

    @staticmethod
    def build(elements: DataFrame, rules: list[tuple], options: Options = Options(), known: dict[str, list[str]] | None = None) -> Dictionary:
        """A dictionary from entry elements (xml), words and names; ``known`` gives kanjis' readings for spelling variations."""
        parsed = xml_entries.parsed(elements)
        words, names = build.words_of(parsed), build.names_of(parsed)
        entries = words.withColumn("is_name", F.lit(False)).unionByName(names.withColumn("is_name", F.lit(True)))
        return Dictionary(build.index_of(words, known=known), build.index_of(names), rules, options, entries)

    def save(self, path: str) -> None:
        """What ``load`` reads."""
        for name in ("words", "names", "entries"):
            getattr(self, name).write.mode("overwrite").option("compression", "lz4_raw").parquet(f"{path}/{name}")

    @staticmethod
    def index(texts: DataFrame) -> DataFrame:
        """Index of ``texts`` (text, entry_id, pos_mask): keys are folded once, so look-up is by equality."""
        return texts.select(folded("text", KEY_STEP).alias("key"), "entry_id", "pos_mask").distinct()

    @staticmethod
    def load(spark: SparkSession, path: str, rules: list[tuple], options: Options = Options()) -> Dictionary:
        return Dictionary(spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/names"), rules, options, spark.read.parquet(f"{path}/entries"))

    def lookup(self, texts: DataFrame) -> DataFrame:
        """Ranked hits of the folded ``texts`` (text), written to the shared folder; what led to them is deleted."""
        inputs = texts.select(folded("text", QUERY_STEP).alias("w")).distinct()
        names = self.names if self.options.use_names else None
        steps = Steps(texts.sparkSession)
        return steps.result(lookup.lookup(inputs, self.words, names, self.rules, self.options.depth, self.options.limit, steps, self.options.longest))

    def ranks(self, tokens: DataFrame) -> DataFrame:
        """(w, n, rnk) of the words of tokens (w) that are frequent enough."""
        return frequency.ranked(frequency.frequencies(tokens), least=self.options.least_frequency)

    def counts(self, tokens: DataFrame, mapping: DataFrame) -> DataFrame:
        """(entry_id, n) of tokens (lemma_id, writing, folded, surface, pos) through ``mapping``; with ``count_names``, names count too."""
        found = frequency.mapped_counts(tokens, mapping)
        return found.unionByName(frequency.name_counts(tokens, self.names)) if self.options.count_names else found

    def render(self, hits: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
        """(w, html) of ranked hits: their entries' contents, joined after ranking; ``reviewed`` lists ids (id) of entries under review."""
        return render.entries_html(lookup.materialised(hits, self.entries), reviewed, self.options.escape, self.options.visible)
