"""Choosing among candidates by filters that go one after the other, each only as far as it leaves something; and texts cut at brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of speech that stand for others, too.
SUPER_CLASSES = {"v5r": ("v5aru", "v5r-i"), "v5u": ("v5u-s",), "v5k": ("v5k-s",), "vs": ("vs-s", "vs-i")}


def has_pos(own: str, asked: str, classes: dict[str, tuple[str, ...]] = SUPER_CLASSES) -> Column:
    """Whether the array ``own`` has one of the parts of speech ``asked``, or one that an asked one stands for."""
    wider = ", ".join(f"'{name}', array({', '.join(repr(x) for x in also)})" for name, also in classes.items())
    return F.expr(f"arrays_overlap({own}, concat({asked}, flatten(transform({asked}, x -> coalesce(try_element_at(map({wider}), x), array())))))")


def has_form(own: str, form: str) -> Column:
    """Whether the folded texts ``own`` have the folded ``form``."""
    return F.expr(f"array_contains({own}, {form})")


def shares_forms(kanjis: str, readings: str, writings: str, sounds: str) -> Column:
    """Whether an entry shares a writing and a reading with those that were found so far: asked of either side as soon as one of them, or a found writing, is there."""
    return F.expr(f"(size({kanjis}) + size({writings}) = 0 or arrays_overlap({kanjis}, {writings})) and (size({readings}) + size({writings}) = 0 or arrays_overlap({readings}, {sounds}))")


def cascade(candidates: DataFrame, group: list[str], filters: dict[str, Column]) -> DataFrame:
    """``candidates`` that survive the ``filters`` in their order, with ``skipped``, the names of those filters that their group ignored.

    Within a group a filter holds only if a candidate that is left passes it; one that would leave nothing is skipped. What a candidate passes is a number of
    as many bits as there are filters, so a group is judged by its distinct numbers, at most two to the power of the filters, however many candidates it has.
    An unknown answer is a no."""
    names = list(filters)
    passes = sum((F.when(f, F.lit(1 << n)).otherwise(F.lit(0)) for n, f in enumerate(filters.values())), F.lit(0))
    rows = candidates.withColumn("__passes", passes.cast("int"))
    sets = rows.groupBy(*group).agg(F.collect_set("__passes").alias("__left"))
    step = "if(exists(s.left, x -> (x & bit) <> 0), named_struct('left', filter(s.left, x -> (x & bit) <> 0), 'must', s.must | bit), s)"
    bits = ", ".join(str(1 << n) for n in range(len(names)))
    must = F.expr(f"aggregate(cast(array({bits}) as array<int>), named_struct('left', __left, 'must', 0), (s, bit) -> {step}, s -> s.must)")
    skipped = F.array_compact(F.array(*(F.when(F.col("__must").bitwiseAND(1 << n) == 0, F.lit(name)) for n, name in enumerate(names))))
    judged = sets.select(*(F.col(g).alias(f"__{g}") for g in group), must.alias("__must"))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    kept = rows.join(judged, same).filter(F.col("__passes").bitwiseAND(F.col("__must")) == F.col("__must"))
    return kept.withColumn("skipped", skipped).drop("__passes", "__must", *(f"__{g}" for g in group))


BRACKETS = {"[": "]", "【": "】", "(": ")", "（": "）"}


def bracketed(rows: DataFrame, text: str = "text", brackets: dict[str, str] = BRACKETS) -> DataFrame:
    """``rows`` with ``parts``, ``open`` and ``problem`` of a text: a stack is folded over its brackets and what lies between them.

    The parts are what is outside, each outer bracket, and what is inside it, where inner brackets keep their openings only. ``open`` are brackets that aren't closed.
    ``problem`` is null, ``unopened`` for a closing without an opening, or ``crossed`` for one of another kind; what follows it isn't cut. A null text has no parts."""
    opening, closing = "".join(brackets), "".join(brackets.values())
    inside = "".join("\\\\" + c if c in "[]^-\\" else c for c in opening + closing)
    tokens = f"regexp_extract_all({text}, '[{inside}]|[^{inside}]+', 0)"
    grown = "concat(slice(s.parts, 1, size(s.parts) - 1), array(concat(s.parts[size(s.parts) - 1], t)))"
    cut = "concat(s.parts, array(t, ''))"
    state = "named_struct('parts', {}, 'open', {}, 'problem', {})"
    step = f"""case when s.problem is not null then s
        when instr('{opening}', t) > 0 then {state.format(f"if(s.open = '', {cut}, {grown})", "concat(s.open, t)", "cast(null as string)")}
        when instr('{closing}', t) = 0 then {state.format(grown, "s.open", "cast(null as string)")}
        when s.open = '' then {state.format("s.parts", "s.open", "'unopened'")}
        when translate(t, '{closing}', '{opening}') <> right(s.open, 1) then {state.format("s.parts", "s.open", "'crossed'")}
        else {state.format(f"if(length(s.open) = 1, {cut}, s.parts)", "left(s.open, length(s.open) - 1)", "cast(null as string)")} end"""
    fold = f"aggregate({tokens}, named_struct('parts', array(''), 'open', '', 'problem', cast(null as string)), (s, t) -> {step})"
    df = rows.withColumn("__b", F.expr(fold))
    parts = F.expr("if(__b.parts[size(__b.parts) - 1] = '', slice(__b.parts, 1, size(__b.parts) - 1), __b.parts)")
    return df.withColumn("parts", parts).withColumn("open", F.col("__b.open")).withColumn("problem", F.col("__b.problem")).drop("__b")


def elements(parts: str = "parts", round_: str = "(（") -> Column:
    """(base, sound, writing) of each text outside of brackets and what stands in round and in other brackets behind it, the last of each kind."""
    start = "cast(array() as array<struct<base: string, sound: string, writing: string>>)"
    last = "s.out[size(s.out) - 1]"
    keep = "slice(s.out, 1, size(s.out) - 1)"
    inner = f"if(instr('{round_}', s.kind) > 0, named_struct('base', {last}.base, 'sound', p, 'writing', {last}.writing), named_struct('base', {last}.base, 'sound', {last}.sound, 'writing', p))"
    # a bracket, its inside and its closing come in threes: kind holds the bracket whose inside is next, and x that a closing is next
    step = f"""case when s.kind = '' and instr('{"".join(BRACKETS)}', p) > 0 and p <> '' then named_struct('out', s.out, 'kind', p)
        when s.kind = 'x' then named_struct('out', s.out, 'kind', '')
        when s.kind <> '' then named_struct('out', if(size(s.out) = 0, s.out, concat({keep}, array({inner}))), 'kind', 'x')
        else named_struct('out', concat(s.out, array(named_struct('base', btrim(p), 'sound', cast(null as string), 'writing', cast(null as string)))), 'kind', '') end"""
    return F.expr(f"aggregate({parts}, named_struct('out', {start}, 'kind', ''), (s, p) -> {step}, s -> s.out)")
