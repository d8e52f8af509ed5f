"""Text of HTML pages: segments of inline text between block boundaries, clipping, and ranges of a match in its segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements that don't interrupt a line of text.
INLINE = "a abbr acronym b basefont bdi bdo big cite code data del dfn em font i ins kbd label mark q rb ruby s samp small span strike strong sub sup time tt u var wbr"
#: (pattern, replacement) in order; all of them mean the same to Java and RE2.
STEPS = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "\x01"),
    (r"(?is)<(rt|rp)\b[^>]*>.*?</(rt|rp)>", ""),
    (r"(?i)</?(?:" + "|".join(INLINE.split()) + r")(?:\s[^>]*)?/?>", ""),
    (r"<[^>]*>", "\x01"),
    (r"[ \t\r\n\f]+", " "),
]
SPLIT = "\x01"
CLIP = 13


def segments(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, seg_ix, text) of the texts between block boundaries that hold more than blanks, numbered from 0 with the empty ones."""
    text = F.coalesce(F.col(html), F.lit(""))
    for pattern, to in STEPS:
        text = F.regexp_replace(text, pattern, to)
    rows = pages.select(key, F.posexplode(F.split(text, SPLIT, -1)).alias("seg_ix", "text"))
    return rows.withColumn("text", F.btrim("text", F.lit(" "))).filter("text <> ''")


def clipped(rows: DataFrame, characters: str = r"\p{L}", most: int = CLIP) -> DataFrame:
    """``clip``: what a text begins with of the characters' class after one leading space, at most ``most``; null if nothing."""
    found = F.regexp_extract("text", f"^ ?({characters}+)", 1)
    return rows.withColumn("clip", F.nullif(F.left(found, F.lit(most)), F.lit("")))


def clip_at(text: str, start: str, characters: str, most: int = CLIP, forward: bool = True) -> Column:
    """The run of ``characters`` (the inside of a set) that begins at ``start``, or ends before it, of at most ``most`` characters."""
    if forward:
        return F.expr(f"regexp_extract(substring({text}, {start} + 1, {most}), '^[{characters}]*', 0)")
    return F.expr(f"regexp_extract(substring({text}, greatest({start} - {most}, 0) + 1, least({start}, {most})), '[{characters}]*$', 0)")


def around(rows: DataFrame, characters: str, before: int = CLIP, behind: int = 100) -> DataFrame:
    """``context`` of ``rows`` (text, start): the run of characters around the place, without blanks at its ends. A part before the place
    that ends in a blank doesn't belong to it."""
    head, tail = clip_at("text", "start", characters, before, False), clip_at("text", "start", characters, behind)
    rows = rows.withColumn("__head", head).withColumn("__tail", tail)
    return rows.withColumn("context", F.expr("concat(if(endswith(__head, btrim(__head)), btrim(__head), ''), btrim(__tail))")).drop("__head", "__tail")


def ranges(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Where each segment starts and ends in the page's joined text."""
    before = Window.partitionBy(key).orderBy("seg_ix").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("bigint")
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def context(text: str, start: str, length: str) -> Column:
    """The sentence around a match, without its end marks."""
    return F.expr(f"concat(regexp_extract(left({text}, {start}), '[^.!?。！？]*$', 0), regexp_extract(substring({text}, {start} + 1), '^[^.!?。！？]*', 0))")


#: Between the texts of a block that inline elements part, and before those that only say how others are read.
NODE, RUBY = "\x02", "\x03"
NODE_STEPS = [
    STEPS[0],
    STEPS[1],
    (r"(?is)<(?:rt|rp)\b[^>]*>(.*?)</(?:rt|rp)>", f"{NODE}{RUBY}$1{NODE}"),
    (STEPS[3][0], NODE),
    STEPS[4],
    STEPS[5],
]


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, seg_ix, block, node_ix, text, ruby, start) of the texts between tags; ``block`` is all the text of a node's line, and ``start`` its place there.

    Ruby texts stand beside the line: they have no part in the block, and nothing starts in them."""
    text = F.coalesce(F.col(html), F.lit(""))
    for pattern, to in NODE_STEPS:
        text = F.regexp_replace(text, pattern, to)
    blocks = pages.select(key, F.posexplode(F.split(text, SPLIT, -1)).alias("seg_ix", "line"))
    blocks = blocks.withColumn("parts", F.split("line", NODE, -1))
    blocks = blocks.withColumn("block", F.expr(f"array_join(filter(parts, x -> not startswith(x, '{RUBY}')), '')")).filter("line <> ''")
    rows = blocks.select(key, "seg_ix", "block", F.posexplode("parts").alias("node_ix", "text")).withColumn("ruby", F.startswith("text", F.lit(RUBY)))
    rows = rows.withColumn("text", F.translate("text", RUBY, "")).filter("text <> ''")
    before = Window.partitionBy(key, "seg_ix").orderBy("node_ix").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.when(~F.col("ruby"), F.length("text")).otherwise(0)).over(before), F.lit(0)).cast("int"))


def sentence_at(places: DataFrame, marks: str = ".!?。！？", before: int = 1024, behind: int = 100) -> DataFrame:
    """``places`` (block, start, ruby) with ``context``, the sentence around a place, which may go over many nodes, and where it begins and ends in the block (``head``, ``tail``).

    It goes back and forth to the next of ``marks``, and no farther than ``before`` and ``behind`` characters. Blanks at its ends go; a part before the place that ends in a blank
    doesn't belong to it. A place in ruby has none."""
    rows = places.filter("not ruby").withColumn("__head", clip_at("block", "start", f"^{marks}", before, False)).withColumn("__tail", clip_at("block", "start", f"^{marks}", behind))
    rows = rows.withColumn("context", F.expr("concat(if(endswith(__head, btrim(__head)), btrim(__head), ''), btrim(__tail))"))
    return rows.withColumn("head", F.expr("start - length(__head)")).withColumn("tail", F.expr("start + length(__tail)")).drop("__head", "__tail")


def nodes_at(rows: DataFrame, nodes: DataFrame, position: str, out: str, key: str = "page_id", end: bool = False) -> DataFrame:
    """``rows`` (key, seg_ix, ...) with ``out``_node and ``out``_offset: the node that holds a position of the block, or, if it is the ``end`` of a range, the character before it.

    Positions and nodes are merged in order within a block, so a block of many nodes costs no pairs."""
    at = F.col(position) - 1 if end else F.col(position)
    marks = nodes.filter("not ruby").select(key, "seg_ix", F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.col("node_ix").alias("__node"), F.col("start").alias("__start"))
    merged = rows.withColumn("__at", F.greatest(at, F.lit(0))).withColumn("__kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy(key, "seg_ix").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn(f"{out}_node", F.last("__node", True).over(upto)).withColumn("__start", F.last("__start", True).over(upto)).filter("__kind = 1")
    return merged.withColumn(f"{out}_offset", F.col(position) - F.col("__start")).drop("__at", "__kind", "__node", "__start")
