r"""Operator 8 (native): secrets by fixed patterns and a battery of randomness tests.

Fixed kinds, leftmost and non-overlapping each: ``assign`` (a name such as password, ``:`` or ``=``, and a value
of 12 characters or more), ``access`` and ``hex``. A span is the whole match, in code points, end exclusive.

Battery: every run of 20 or more of ``[A-Za-z0-9+/_=-]`` outside the fixed spans is a candidate. Its encoding is
inferred (hex, base 32, or base 64 for a mix of digits and letters; anything else is no candidate), its
characters become numbers of that alphabet, and three tests ask whether it can be random: chi-squared of the
characters' counts against uniformity, the number of runs above and below the middle, and the correlation of
neighbours. Their p-values are combined by Fisher's method, and a candidate below ``ALPHA`` isn't random. The others may still be
text that looks even by chance. Under that null hypothesis the chi-squared value isn't central: its mean grows by ``EXCESS`` of the
alphabet for each character, so its lower tail is a p-value that falls with length. Benjamini and Hochberg's step-up procedure
over these p-values of all candidates of a document (1 for those that the battery rejects) holds the share of such false
discoveries to ``FDR``. Those that remain are spans of the kind ``random``.

Everything is Spark SQL in one narrow pass: no shuffle, no Python. Matches' places come from the lengths of the
gaps and matches before them, summed in two levels so that many matches cost little.

Null and empty texts have no spans: counts of 0, empty ``spans`` and the digest of the empty string. Repeated
rows give repeated results; a null doc_id stays null; other columns are ignored. Ties at one start go by kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.llm.common import table

#: The patterns of the kinds, the group whose length counts, and its least length. A run of hex
#: digits holds at most one match either way, so its least length is part of the pattern.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHA, FDR = 0.001, 0.05
#: What text adds to chi-squared for each character, by size of alphabet: size times the chance that two characters are equal, less 1,
#: for digits, for capitals with digits, and for mixed names and numbers.
EXCESS = {16: 0.6, 32: 1.1, 64: 2.0}
BLOCK = 64
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(df: DataFrame, name: str, pattern: str, group: int) -> DataFrame:
    """Adds ``name``: array of (start, end, whole, part) of each match."""
    p, t = _literal(pattern), "__text"
    some, gaps, whole, part, each, blocks, before = (f"__{name}_{x}" for x in ("some", "gaps", "whole", "part", "each", "blocks", "before"))
    df = df.withColumn(some, F.expr(f"{t} rlike {p}"))
    df = df.withColumns({
        gaps: F.expr(f"if({some}, split({t}, {p}, -1), null)"),
        whole: F.expr(f"if({some}, regexp_extract_all({t}, {p}, 0), null)"),
        part: F.expr(f"if({some}, regexp_extract_all({t}, {p}, {group}), null)"),
    })
    df = df.withColumn(each, F.expr(f"transform({whole}, (x, i) -> cast(char_length({gaps}[i]) + char_length(x) as bigint))"))
    df = df.withColumn(blocks, F.expr(f"transform(sequence(0, (size({each}) - 1) div {BLOCK}), b -> aggregate(slice({each}, cast(b * {BLOCK} + 1 as int), {BLOCK}), 0L, (a, x) -> a + x))"))
    df = df.withColumn(before, F.expr(f"transform({blocks}, (x, b) -> aggregate(slice({blocks}, 1, b), 0L, (a, y) -> a + y))"))
    end = f"{before}[cast(i div {BLOCK} as int)] + aggregate(slice({each}, cast(i div {BLOCK} as int) * {BLOCK} + 1, i % {BLOCK} + 1), 0L, (a, y) -> a + y)"
    df = df.withColumn(f"__{name}_ends", F.expr(f"transform({each}, (x, i) -> {end})"))
    made = f"transform({whole}, (x, i) -> named_struct('start', __{name}_ends[i] - char_length(x), 'end', __{name}_ends[i], 'whole', x, 'part', {part}[i]))"
    none = "cast(array() as array<struct<start: bigint, end: bigint, whole: string, part: string>>)"
    df = df.withColumn(f"__{name}", F.expr(f"coalesce({made}, {none})"))
    return df.drop(some, gaps, whole, part, each, blocks, before, f"__{name}_ends")


def _sf(z: str) -> str:
    """Upper tail of the normal distribution, by a logistic approximation within 2e-4."""
    return f"(1 / (1 + exp(least(700, greatest(-700, 1.5976 * {z} + 0.070566 * {z} * {z} * {z})))))"


def _battery(df: DataFrame) -> DataFrame:
    """Adds ``__random``: (start, end) of candidates that pass."""
    free = "filter(__candidate, c -> not exists(__base, b -> b.start < c.end and c.start < b.end))"
    kind = """case when x.bare rlike '^[0-9a-f]+$' or x.bare rlike '^[0-9A-F]+$' then 'hex'
                   when x.bare rlike '^[A-Z2-7]+$' then 'base32' else 'base64' end"""
    mixed = "x.bare rlike '[0-9]' and x.bare rlike '[A-Za-z]' and char_length(x.bare) >= 20"
    df = df.withColumn("__c", F.expr(f"transform({free}, c -> named_struct('start', c.start, 'end', c.end, 'bare', translate(c.whole, '-_=', '+/')))"))
    df = df.withColumn("__c", F.expr(f"transform(filter(__c, x -> {mixed}), x -> named_struct('start', x.start, 'end', x.end, 'bare', x.bare, 'kind', {kind}))"))
    excess = "case x.a " + " ".join(f"when {a} then {v}D" for a, v in EXCESS.items()) + " end"
    alphabet = "case x.kind when 'hex' then '" + ALPHABETS["hex"] + "' when 'base32' then '" + ALPHABETS["base32"] + "' else '" + ALPHABETS["base64"] + "' end"
    df = df.withColumn("__c", F.expr(f"""transform(__c, x -> named_struct('start', x.start, 'end', x.end,
        'a', cast(case x.kind when 'hex' then 16 when 'base32' then 32 else 64 end as double),
        'v', transform(split(if(x.kind = 'hex', lower(x.bare), x.bare), ''), y -> cast(locate(y, {alphabet}) - 1 as double))))"""))
    df = df.withColumn("__c", F.expr("""transform(__c, x -> named_struct('start', x.start, 'end', x.end, 'a', x.a, 'n', cast(size(x.v) as double), 'v', x.v,
        'mean', aggregate(x.v, 0D, (s, y) -> s + y) / size(x.v),
        'high', aggregate(x.v, 0D, (s, y) -> s + if(y >= x.a / 2, 1, 0)),
        'squares', aggregate(sequence(0, cast(x.a as int) - 1), 0D, (s, k) -> s + pow(size(filter(x.v, y -> y = k)), 2))))"""))
    df = df.withColumn("__c", F.expr("""transform(__c, x -> named_struct('start', x.start, 'end', x.end, 'n', x.n, 'a', x.a, 'excess', """ + excess + """,
        'chi', x.a / x.n * x.squares - x.n,
        'runs', 1 + aggregate(sequence(1, size(x.v) - 1), 0D, (s, i) -> s + if((x.v[i] >= x.a / 2) != (x.v[i - 1] >= x.a / 2), 1, 0)),
        'expected', 1 + 2 * x.high * (x.n - x.high) / x.n,
        'serial', aggregate(sequence(1, size(x.v) - 1), 0D, (s, i) -> s + (x.v[i] - x.mean) * (x.v[i - 1] - x.mean)) / greatest(1e-9, aggregate(x.v, 0D, (s, y) -> s + (y - x.mean) * (y - x.mean)))))"""))
    df = df.withColumn("__c", F.expr("""transform(__c, x -> named_struct('start', x.start, 'end', x.end, 'n', x.n,
        'z1', (pow(x.chi / (x.a - 1), 1 / 3D) - (1 - 2 / (9 * (x.a - 1)))) / sqrt(2 / (9 * (x.a - 1))),
        'z2', abs(x.runs - x.expected) / sqrt(greatest(1e-9, (x.expected - 1) * (x.expected - 2) / (x.n - 1))),
        'z3', abs(x.serial) * sqrt(x.n),
        'z4', (x.a - 1 + x.n * x.excess - x.chi) / sqrt(2 * (x.a - 1) + 4 * x.n * x.excess)))"""))
    df = df.withColumn("__c", F.expr(f"""transform(__c, x -> named_struct('start', x.start, 'end', x.end, 'even', {_sf('x.z4')},
        'h', -ln(greatest(1e-300, {_sf('x.z1')})) - ln(greatest(1e-300, 2 * {_sf('x.z2')})) - ln(greatest(1e-300, 2 * {_sf('x.z3')}))))"""))
    # Fisher: twice the sum of three logarithms has a chi-squared distribution of six degrees, whose tail is closed
    df = df.withColumn("__c", F.expr("""array_sort(transform(__c, x -> named_struct(
        'q', if(exp(-greatest(0D, x.h)) * (1 + greatest(0D, x.h) + pow(greatest(0D, x.h), 2) / 2) >= """ + str(ALPHA) + """, x.even, 1D),
        'start', x.start, 'end', x.end)))"""))
    df = df.withColumn("__last", F.expr(f"aggregate(sequence(1, size(__c)), 0, (k, i) -> if(size(__c) > 0 and i >= 1 and __c[i - 1].q <= {FDR} * i / size(__c), i, k))"))
    return df.withColumn("__random", F.expr("if(__last > 0, slice(__c, 1, __last), cast(array() as array<struct<q: double, start: bigint, end: bigint>>))"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    for kind, (pattern, group, least) in KINDS.items():
        df = _matches(df, kind, pattern, group)
        df = df.withColumn(f"__{kind}", F.expr(f"filter(__{kind}, x -> char_length(x.part) >= {least})"))
    each = ", ".join(f"transform(__{kind}, x -> named_struct('start', x.start, 'rank', {n}, 'end', x.end, 'kind', '{kind}'))" for n, kind in enumerate(KINDS))
    df = df.withColumn("__base", F.expr(f"array_sort(concat({each}))"))
    df = _battery(_matches(df, "candidate", CANDIDATE, 0))
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    df = df.withColumn("__all", F.expr(f"array_sort(concat(__base, transform(__random, x -> named_struct('start', x.start, 'rank', {len(KINDS)}, 'end', x.end, 'kind', 'random'))))"))
    return df.select(
        "doc_id",
        *(F.size(f"__{kind}").cast("bigint").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(F.expr(joined.format("__base")), 256).alias("base_sha256"),
        F.expr(joined.format("__all")).alias("spans"),
        F.size("__random").cast("bigint").alias("n_random"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
