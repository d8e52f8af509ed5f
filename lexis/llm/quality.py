"""Operator 5 (native): quality rules as a short-circuit cascade.

A rule rejects a document by measures of its whole text. Cost and selectivity of each rule are estimated on a
bounded sample (``SAMPLE`` rows at most: each rule is timed and its rejections are counted there), and the rules
are put in order of rejections per cost. In the cascade a measure is evaluated only for documents that no earlier
rule has rejected. The order changes which rule is named and what the cascade costs, never the verdict.

Everything is Spark SQL in one narrow pass over the rows: no shuffle, no Python. Repeated windows of three words
are found within the row from 64-bit hashes of the windows (a false repeat has a chance of 2^-64 a pair).

Null texts count as empty: no words, so they are rejected as too short. Ties in rejections per cost go by the
rule's name. Repeated rows get repeated verdicts; a null doc_id stays null; further columns pass ``keep`` unchanged.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.llm.common import table

SAMPLE = 500
#: Runs of the timing of a rule, of which the shortest counts.
RUNS = 2


def _words(p: str) -> list[tuple[str, Column]]:
    bare = F.expr(f"btrim({p}text, ' \\t\\n\\u000b\\u000c\\r')")
    return [(f"{p}words", F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))]


def _repeats(p: str) -> list[tuple[str, Column]]:
    """Words in windows of three words that are found twice or more."""
    w, h, s, d, at = (f"{p}{x}" for x in ("words", "windows", "sorted", "repeated", "starts"))
    few = f"filter(sequence(0, size({h}) - 1), i -> array_contains({d}, {h}[i]))"
    many = f"array_sort(flatten(transform({p}placed, (x, i) -> if((i > 0 and x.h = {p}placed[i - 1].h) or (i + 1 < size({p}placed) and x.h = {p}placed[i + 1].h), array(x.i), cast(array() as array<int>)))))"
    return [
        (h, F.expr(f"if(size({w}) < 3, cast(array() as array<bigint>), transform(slice({w}, 1, greatest(size({w}) - 2, 0)), (x, i) -> xxhash64(x, {w}[i + 1], {w}[i + 2])))")),
        (s, F.expr(f"sort_array({h})")),
        (d, F.expr(f"array_distinct(filter({s}, (x, i) -> i > 0 and x = {s}[i - 1]))")),
        (f"{p}placed", F.expr(f"if(size({d}) > 32, sort_array(transform({h}, (x, i) -> named_struct('h', x, 'i', i))), null)")),
        (at, F.expr(f"case when size({d}) = 0 then cast(array() as array<int>) when size({d}) <= 32 then {few} else {many} end")),
        (f"{p}n_repeat_words", F.expr(f"aggregate({at}, named_struct('e', 0, 't', 0L), (a, x) -> named_struct('e', x + 3, 't', a.t + least(3, x + 3 - a.e)), a -> a.t)")),
    ]


def _lines(p: str) -> list[tuple[str, Column]]:
    return [
        (f"{p}lines", F.expr(rf"filter(split({p}text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')")),
        (f"{p}n_lines", F.expr(f"cast(size({p}lines) as bigint)")),
        (f"{p}n_dup_lines", F.expr(f"cast(size({p}lines) - size(array_distinct({p}lines)) as bigint)")),
    ]


#: How each measure is made, as columns to be added one after the other; all need the words.
MEASURES = {
    "n_words": lambda p: [(f"{p}n_words", F.expr(f"cast(size({p}words) as bigint)"))],
    "word_chars": lambda p: [(f"{p}word_chars", F.expr(f"cast(char_length(array_join({p}words, '')) as bigint)"))],
    "n_symbols": lambda p: [(f"{p}n_symbols", F.expr(f"cast(regexp_count({p}text, '[#*$%&|<>]') as bigint)"))],
    "n_upper": lambda p: [(f"{p}n_upper", F.expr(f"cast(regexp_count({p}text, '[A-Z]') as bigint)"))],
    "n_dup_lines": _lines,
    "n_repeat_words": _repeats,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the measures named in ``needs``; ``base`` rules make up base_failed."""

    name: str
    needs: tuple[str, ...]
    rejects: str
    base: bool = False


RULES = (
    Rule("too_short", ("n_words",), "n_words < 50", base=True),
    Rule("repeats_itself", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 50 * n_words", base=True),
    Rule("symbols", ("word_chars", "n_symbols"), "100 * n_symbols > 5 * word_chars"),
    Rule("shouts", ("word_chars", "n_upper"), "100 * n_upper > 50 * word_chars"),
    Rule("repeated_lines", ("n_dup_lines",), "100 * n_dup_lines > 40 * n_lines"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words or word_chars > 25 * n_words"),
)
_P = "__q_"


def _prefixed(sql: str) -> str:
    for name in (*MEASURES, "n_lines"):
        sql = sql.replace(f"{name} ", f"{_P}{name} ") if sql.startswith(f"{name} ") else sql.replace(f" {name}", f" {_P}{name}")
    return sql


def _rejects(rule: Rule) -> Column:
    return F.coalesce(F.expr(_prefixed(rule.rejects)), F.lit(False))


def _with(df: DataFrame, name: str, alive: Column | None) -> DataFrame:
    for column, made in MEASURES[name](_P):
        df = df.withColumn(column, made if alive is None else F.when(alive, made))
    return df


def _start(docs: DataFrame) -> DataFrame:
    return _with_words(docs.withColumn(f"{_P}text", F.coalesce(F.col("text"), F.lit(""))))


def _with_words(df: DataFrame) -> DataFrame:
    for column, made in _words(_P):
        df = df.withColumn(column, made)
    return df


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per second on a bounded sample, with both estimates.

    A rule's cost is the shortest of ``RUNS`` runs of its measures less that of a run which only cuts the words, so what planning
    and starting a job takes, and what all rules share, doesn't count. The first runs of all come before anything is timed."""
    rows = docs.select("text").limit(sample).cache()

    def timed(df: DataFrame, rejects: Column) -> tuple[float, int]:
        began = time.perf_counter()
        rejected = df.agg(F.count_if(rejects)).head()[0]
        return time.perf_counter() - began, rejected

    try:
        n = max(1, rows.count())
        plans = [(_start(rows), F.size(f"{_P}words") < 0)]
        for rule in rules:
            df = _start(rows)
            for need in rule.needs:
                df = _with(df, need, None)
            plans.append((df, _rejects(rule)))
        runs = [[timed(*plan) for plan in plans] for _ in range(RUNS + 1)][1:]
    finally:
        rows.unpersist()
    least = [min(run[i][0] for run in runs) for i in range(len(plans))]
    found = [(rule, max(least[i] - least[0], 1e-3), runs[0][i][1] / n) for i, rule in enumerate(rules, 1)]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(docs: DataFrame, rules: list[Rule], always: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with measures (prefixed) and ``__q_failed``, the first rule that rejects, or null.

    A measure is null where no rule that needs it was reached, but for those in ``always``."""
    df, made = _start(docs), set()
    df = df.withColumn(f"{_P}failed", F.lit(None).cast("string"))
    for rule in rules:
        alive = F.col(f"{_P}failed").isNull()
        for need in rule.needs:
            if need not in made:
                df = _with(df, need, None if need in always else alive)
                made.add(need)
        df = df.withColumn(f"{_P}failed", F.when(alive & _rejects(rule), F.lit(rule.name)).otherwise(F.col(f"{_P}failed")))
    for need in always:
        if need not in made:
            df = _with(df, need, None)
    return df


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns of ``docs``."""
    best = [r for r, _, _ in ordered(docs, rules)]
    # a row number keeps the optimizer from pushing the filter, with all that it stands for, below the cascade
    judged = cascade(docs, best).withColumn(f"{_P}row", F.monotonically_increasing_id())
    return judged.filter(F.col(f"{_P}failed").isNull() & (F.col(f"{_P}row") >= 0)).select(*(f"`{c}`" for c in docs.columns))


#: What is reported of every document; other measures, here that of capitals, only come up in the cascade.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The reported measures of every row and the cascade's verdict."""
    best = [r for r, _, _ in ordered(docs, rules)]
    df = cascade(docs.select("doc_id", "text"), best, REPORTED)
    base = F.lit(False)
    for rule in rules:
        if rule.base:
            base = base | _rejects(rule)
    return df.select("doc_id", *(F.col(_P + n).alias(n) for n in REPORTED), base.alias("base_failed"), F.col(f"{_P}failed").isNull().alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents"))


#: The same by SQL, for DuckDB; each line and window is compared as text.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, t) > 1),
c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper,
        len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 5 * word_chars OR 100 * n_upper > 50 * word_chars
    OR 100 * n_dup_lines > 40 * n_lines OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM m
"""
