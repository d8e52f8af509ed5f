"""Suffix-rewrite rules with part-of-speech gates: a table made by rule, one step, and the closure.

A rule turns a word that ends in ``suffix`` into a candidate that ends in ``new_suffix``. It applies if the word's mask shares a bit with
``source_mask``, and the candidate has ``target_mask``. Every rule applies to the input itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.steps import Steps

# Parts of speech in the order of their bits, and endings of the five-step verbs by row.
POS = ("raw", "adj-i", "v1", "v1-s", "vk", "masu", "desu", "v5k", "v5g", "v5k-s", "vs-i", "vs-s", "v5s", "v5r", "v5t", "v5u", "v5u-s", "v5r-i", "v5aru", "v5n", "v5b", "v5m")
BIT = {name: 1 << n for n, name in enumerate(POS)}
ANY = (1 << len(POS)) - 1
#: row: (dictionary, a-row, i-row, e-row, o-row endings, classes)
GODAN = (
    ("う", "わ", "い", "え", "お", ("v5u", "v5u-s")),
    ("く", "か", "き", "け", "こ", ("v5k", "v5k-s")),
    ("ぐ", "が", "ぎ", "げ", "ご", ("v5g",)),
    ("す", "さ", "し", "せ", "そ", ("v5s",)),
    ("つ", "た", "ち", "て", "と", ("v5t",)),
    ("ぬ", "な", "に", "ね", "の", ("v5n",)),
    ("ぶ", "ば", "び", "べ", "ぼ", ("v5b",)),
    ("む", "ま", "み", "め", "も", ("v5m",)),
    ("る", "ら", "り", "れ", "ろ", ("v5r", "v5r-i", "v5aru")),
)
#: The form before -te and -ta, which differs from class to class: (dictionary ending, joined form, classes)
JOINED = (
    ("う", "って", ("v5u",)), ("う", "うて", ("v5u-s",)), ("く", "いて", ("v5k",)), ("く", "って", ("v5k-s",)), ("ぐ", "いで", ("v5g",)), ("す", "して", ("v5s",)),
    ("つ", "って", ("v5t",)), ("ぬ", "んで", ("v5n",)), ("ぶ", "んで", ("v5b",)), ("む", "んで", ("v5m",)), ("る", "って", ("v5r", "v5r-i", "v5aru")),
)
#: Classes that some forms leave out or add.
NEGATIVE_OF_RU, STEM_OF_RU, STEM_OF_U = ("v5r", "v5aru"), ("v5r", "v5r-i"), ("v5u", "v5u-s", "v5aru")
STEMS = "いえきぎけげじせぜちてでにねひびへべみめりれ"
SCHEMA = "suffix string, new_suffix string, source_mask int, target_mask int, reason string, rule_rank int"


def _mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


def japanese_rules() -> list[tuple[str, str, int, int, str, int]]:
    """Rules of Japanese from the paradigms of verbs and adjectives, ranked by length of suffix, suffix, and order here.

    The source names what a word must be to be undone further; an input itself is taken by every rule."""
    raw: list[tuple[str, str, int, int, str]] = []

    def rules(new: str, classes: tuple[str, ...], *forms: tuple[str, tuple[str, ...], str]) -> None:
        for suffix, sources, reason in forms:
            raw.append((suffix, new, _mask(*sources), _mask(*classes), reason))

    r, one, adjective, causing = ("raw",), ("v1", "v1-s"), ("adj-i",), ("v5s",)
    rules("ない", adjective, ("ありません", r, "polite"))
    rules("ます", ("masu",), ("ましたり", r, "-tari"), ("ましょう", r, "volitional"), ("ました", r, "past"), ("ません", r, "negative"))
    rules("です", ("desu",), ("でしたら", r, "-tara"), ("でしたり", r, "-tari"), ("でした", r, "past"))
    for u, te, own in JOINED:
        ta = te[:-1] + {"て": "た", "で": "だ"}[te[-1]]
        rules(u, own, (te, r, "-te"), (ta, r, "past"), (ta + "ら", r, "-tara"), (ta + "り", r, "-tari"))
    for u, a, i, e, o, own in GODAN:
        negative, stem = (NEGATIVE_OF_RU, STEM_OF_RU) if u == "る" else (own, STEM_OF_U if u == "う" else own)
        rules(u, own, (a + "せる", one, "causative"), (a + "れる", one, "passive"), (a + "す", causing, "informal causative"))
        rules(u, own, (a + "ず", r, "-zu"), (a + "ぬ", r, "archaic negative"), (o + "う", r, "volitional"), (e, r, "imperative"))
        rules(u, negative, (a + "ない", adjective, "negative"), (a + "ん", r, "casual negative"))
        rules(u, stem, (i, r, "masu stem"))
        if u != "る":
            rules(u, own, (e + "ば", r, "-ba"), (e + "る", one, "potential"))
    every = (*one, "vk")
    rules("る", ("v1", "v1-s", "v5r", "v5r-i", "v5aru", "vk", "vs-i", "vs-s"), ("れば", r, "-ba"))
    rules("る", ("v1", "v1-s", "v5r", "v5r-i", "v5aru"), ("れる", one, "potential"))
    rules("る", every, ("たら", r, "-tara"), ("たり", r, "-tari"), ("た", r, "past"), ("て", r, "-te"), ("ない", adjective, "negative"), ("よう", r, "volitional"), ("ず", r, "-zu"), ("ん", r, "casual negative"))
    rules("る", every, ("ぬ", r, "archaic negative"), ("させる", one, "causative"), ("られる", one, "potential or passive"), ("さす", causing, "informal causative"))
    rules("る", ("vk",), ("い", r, "imperative"))
    rules("る", one, ("よ", r, "imperative"))
    rules("る", ("v1",), ("ろ", r, "imperative"))
    rules("れる", ("v1-s",), ("れ", r, "imperative"))
    for stem in STEMS:
        rules(stem + "る", one, (stem, r, "masu stem"))
    suru = ("vs-i", "vs-s")
    rules("する", suru, ("した", r, "past"), ("して", r, "-te"), ("したら", r, "-tara"), ("したり", r, "-tari"), ("しない", adjective, "negative"), ("しろ", r, "imperative"), ("せよ", r, "imperative"))
    rules("する", suru, ("しよう", r, "volitional"), ("せず", r, "-zu"), ("せぬ", causing, "archaic negative"), ("せん", r, "casual negative"), ("し", r, "masu stem"))
    rules("する", suru, ("される", one, "passive"), ("させる", one, "causative"), ("さす", causing, "informal causative"))
    rules("する", ("vs-s",), ("さない", adjective, "negative"), ("しえる", ("v1",), "potential"), ("しうる", ("v5r",), "potential"))
    rules("する", ("vs-i",), ("できる", ("v1",), "potential"))
    rules("くる", ("vk",), ("きた", r, "past"), ("きて", r, "-te"), ("きたら", r, "-tara"), ("きたり", r, "-tari"), ("こない", adjective, "negative"), ("こい", r, "imperative"), ("こよう", r, "volitional"))
    rules("くる", ("vk",), ("こず", r, "-zu"), ("き", r, "masu stem"), ("これる", one, "potential"), ("こられる", one, "potential or passive"), ("こさせる", one, "causative"))
    rules("来る", ("vk",), ("来れる", one, "potential"), ("来", r, "masu stem"))
    rules("い", adjective, ("かった", r, "past"), ("くて", r, "-te"), ("かったら", r, "-tara"), ("かったり", r, "-tari"), ("くない", adjective, "negative"), ("ければ", r, "-ba"), ("く", r, "adv"), ("さ", r, "noun"))
    rules("ある", ("v5r-i",), ("ない", adjective, "negative"))
    order = sorted(range(len(raw)), key=lambda n: (-len(raw[n][0]), raw[n][0], n))
    return [(*raw[n], rank) for rank, n in enumerate(order)]


#: Rows of five-step verbs in a template, and the letter of their class.
TEMPLATE_ROWS = {"バ": "b", "ガ": "g", "カ": "k", "マ": "m", "ナ": "n", "ラ": "r", "サ": "s", "タ": "t", "ア": "u"}


def pos_of_template(name: str, params: str) -> str:
    """SQL for the part of speech of an inflection template (its name and array of parameters), null if it is unknown."""
    rows = ", ".join(f"'{k}', '{v}'" for k, v in TEMPLATE_ROWS.items())
    adjective = f"case {params}[0] when 'タルト' then 'adj-t' when '形容詞' then 'adj-i' when 'ダ' then 'adj-na' end"
    verb = f"case when get({params}, 2) in ('上一', '下一') then 'v1' when get({params}, 2) = '五' then concat('v5', try_element_at(map({rows}), {params}[1])) when get({params}, 2) = '変' then case {params}[1] when 'サ' then 'vs' when 'カ' then 'vk' end end"
    return f"case when {name} = 'inf-ja-adj' then {adjective} else {verb} end"


def european_rules() -> list[tuple[str, str, int, int, str, int]]:
    """A few endings that the driver's texts have, with two parts of speech: 1 for surface forms, 2 for verbs, 4 for nouns."""
    raw = [("ings", "ing", 1, 4, "plural"), ("ing", "", 7, 2, "-ing"), ("ed", "", 3, 2, "past"), ("es", "", 1, 6, "-s"), ("s", "", 1, 6, "-s"), ("ly", "", 1, 4, "adverb"), ("er", "", 5, 2, "agent")]
    order = sorted(range(len(raw)), key=lambda n: (-len(raw[n][0]), raw[n][0], n))
    return [(*raw[n], rank) for rank, n in enumerate(order)]


def rules_of(rows: DataFrame, bits: dict[str, int] | None = None) -> list[tuple[str, str, int, int, str, int]]:
    """The rules of a table (suffix, new_suffix, source_pos, target_pos, reason), as a rule file has them, ranked like those made here; parts of speech become masks.

    A part of speech that isn't among ``bits`` is refused with a ValueError, as is a rule without an ending or without parts of speech. A rule file is a bounded list."""
    bits = BIT if bits is None else bits
    raw = rows.select("suffix", "new_suffix", "source_pos", "target_pos", "reason").collect()
    unknown = sorted({p for r in raw for p in (*(r.source_pos or ()), *(r.target_pos or ()))} - bits.keys())
    if unknown:
        raise ValueError(f"unknown parts of speech in rules: {', '.join(unknown)}")
    if bad := [r.suffix for r in raw if not r.suffix or not r.source_pos or not r.target_pos]:
        raise ValueError(f"rules without an ending or parts of speech: {bad}")
    made = [(r.suffix, r.new_suffix or "", sum({bits[p] for p in r.source_pos}), sum({bits[p] for p in r.target_pos}), r.reason) for r in raw]
    order = sorted(range(len(made)), key=lambda n: (-len(made[n][0]), made[n][0], n))
    return [(*made[n], rank) for rank, n in enumerate(order)]


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, SCHEMA)


def one_step(words: DataFrame, rules: list[tuple]) -> DataFrame:
    """Candidates of ``words`` (w, word, mask, depth, path, reasons): every rule that applies, by an equality join on the ending.

    The rules are a bounded list and go to every task; the words are not shuffled."""
    table = rule_table(words.sparkSession, rules)
    longest = max(len(x[0]) for x in rules)
    ends = words.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest)))))
    ends = ends.withColumn("suffix", F.expr("right(word, k)"))
    joined = ends.join(F.broadcast(table), "suffix").filter(F.col("mask").bitwiseAND(F.col("source_mask")) != 0)
    return joined.select(
        "w",
        F.expr("concat(left(word, length(word) - k), new_suffix)").alias("word"),
        F.col("target_mask").alias("mask"),
        (F.col("depth") + 1).alias("depth"),
        F.concat("path", F.array("rule_rank")).alias("path"),
        F.when(F.col("reasons") == "", F.col("reason")).otherwise(F.concat_ws(",", "reasons", "reason")).alias("reasons"),
    ).filter("word <> ''")


def closure(words: DataFrame, rules: list[tuple], depth: int | None = None, kept: Steps | None = None) -> DataFrame:
    """All candidates of ``words`` (w) that chains of rules reach, duplicates kept; ``path`` gives the order of discovery.

    Without ``depth``, steps go on until one finds nothing: each is written to the shared folder while the next is made of it, so a step is computed
    once and nothing stays in memory; ``kept`` names the place, for callers that delete it. Rules must not undo each other without end (the tables here take at least a letter, or lead to a mask that no rule takes).
    With ``depth``, the plan is lazy and has that many steps. Only rules whose source meets a candidate's mask go on, so each step is
    smaller than the one before."""
    start = words.select("w", F.col("w").alias("word"), F.lit((1 << 31) - 1).alias("mask"), F.lit(0).alias("depth"), F.expr("cast(array() as array<int>)").alias("path"), F.lit("").alias("reasons"))
    live = 0
    for rule in rules:
        live |= rule[2]
    kept = kept or Steps(words.sparkSession)
    step = one_step(start, rules)
    if depth is None:
        step = kept.saved(step)
    found, steps = step, 1
    while steps != depth:
        step = one_step(step.filter(F.col("mask").bitwiseAND(F.lit(live)) != 0), rules)
        if depth is None:
            step = kept.saved(step)
            if step.isEmpty():
                break
        found, steps = found.unionByName(step), steps + 1
    return found
