"""Folding of kana, as expressions that Spark and DuckDB both evaluate.

A fold goes over a word's characters from left to right and looks at the last character made so far. The step is
one SQL expression over ``acc`` and ``c``; ``folded`` and ``folded_duckdb`` wrap it for either engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kana in the order of the syllabary.
HALF_WIDTH = "をぁぃぅぇぉゃゅょっーあいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわん"
A_ROW = "あかがさざただなはばぱまやゃらわ"
I_ROW = "いきぎしじちぢにひびぴみりゐ"
U_ROW = "うくぐすずつづぬふぶぷむゆゅる"
E_ROW = "えけげせぜてでねへべぺめれゑ"
O_ROW = "おこごそぞとどのほぼぽもよょろ"
VOICED = ("うかきくけこさしすせそたちつてとはひふへほ", "ゔがぎぐげござじずぜぞだぢづでどばびぶべぼ")
HALF_VOICED = ("はひふへほ", "ぱぴぷぺぽ")

KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
HALF = "".join(map(chr, range(0xFF66, 0xFF9E)))
_ALL = "".join(map(chr, range(0x3041, 0x3095)))


def _lengthened(c: str) -> str:
    """What a long mark stands for behind a character."""
    return "あ" if c in A_ROW else "い" if c in I_ROW + E_ROW else "う" if c in U_ROW + O_ROW else "ー"


LONG = (_ALL, "".join(map(_lengthened, _ALL)))

_LAST = "right(acc, 1)"
_HEAD = "substring(acc, 1, length(acc) - 1)"
_IN_LONG = f"length(acc) > 0 AND {_LAST} BETWEEN 'ぁ' AND 'ゔ'"
#: Folding of what is looked up: full and half width, long marks, and voice marks that replace the character before.
QUERY_STEP = f"""CASE
  WHEN c IN ('ー', 'ｰ') AND {_IN_LONG} THEN concat(acc, translate({_LAST}, '{LONG[0]}', '{LONG[1]}'))
  WHEN c IN ('ー', 'ｰ') THEN concat(acc, c)
  WHEN c = 'ﾞ' AND length(acc) > 0 AND {_LAST} BETWEEN 'う' AND 'ほ' THEN concat({_HEAD}, translate({_LAST}, '{VOICED[0]}', '{VOICED[1]}'))
  WHEN c = 'ﾟ' AND length(acc) > 0 AND {_LAST} BETWEEN 'は' AND 'ほ' THEN concat({_HEAD}, translate({_LAST}, '{HALF_VOICED[0]}', '{HALF_VOICED[1]}'))
  ELSE concat(acc, translate(c, '{KATAKANA}{HALF}', '{HIRAGANA}{HALF_WIDTH}')) END"""
#: Folding of dictionary keys: full-width katakana and long marks only.
_PLAIN = f"CASE WHEN c = 'ー' AND {_IN_LONG} THEN translate({_LAST}, '{LONG[0]}', '{LONG[1]}') ELSE translate(c, '{KATAKANA}', '{HIRAGANA}') END"
KEY_STEP = f"concat(acc, {_PLAIN})"
_MERGED = f"translate({_PLAIN}, 'をづは', 'おずわ')"
#: Folding for alignment: sounds that are spelled in two ways become one.
LOOSE_STEP = f"""concat(acc, CASE
  WHEN {_MERGED} = 'お' AND length(acc) > 0 AND instr('{O_ROW}', {_LAST}) > 0 THEN 'う'
  WHEN {_MERGED} = 'え' AND length(acc) > 0 AND instr('{E_ROW}', {_LAST}) > 0 THEN 'い'
  ELSE {_MERGED} END)"""


def folded_sql(column: str, step: str = QUERY_STEP) -> str:
    return f"aggregate(filter(split({column}, ''), c -> c <> ''), '', (acc, c) -> {step})"


def folded(column: str, step: str = QUERY_STEP) -> Column:
    return F.expr(folded_sql(column, step))


def folded_duckdb(column: str, step: str = QUERY_STEP) -> str:
    return f"list_reduce(list_filter(string_split({column}, ''), lambda c: c <> ''), lambda acc, c: {step}, '')"


def folded_with_map(column: str, step: str = QUERY_STEP, units: str = "if(ascii(c) > 65535, 2, 1)") -> Column:
    """(s, map): the folded text, and for each length of its beginnings the ``units`` of the source they took, UTF-16 units unless told otherwise.

    A character that folds to several is taken by the first of them; one that changes the character before it belongs to that."""
    step = step.replace("acc", "acc.s")
    grown = f"array_repeat(acc.used + {units}, length({step}) - length(acc.s))"
    map_ = f"if(length({step}) > length(acc.s), concat(acc.map, {grown}), if(size(acc.map) = 1, acc.map, concat(slice(acc.map, 1, size(acc.map) - 1), array(acc.used + {units}))))"
    start = "named_struct('s', '', 'used', 0, 'map', array(0))"
    return F.expr(f"aggregate(filter(split({column}, ''), c -> c <> ''), {start}, (acc, c) -> named_struct('s', {step}, 'used', acc.used + {units}, 'map', {map_}), acc -> named_struct('s', acc.s, 'map', acc.map))")


def utf16_length(column: str) -> Column:
    return (F.octet_length(F.encode(F.col(column), "UTF-16BE")) / 2).cast("bigint")
