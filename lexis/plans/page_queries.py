"""Queries on the text of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.operators import lookup
from lexis.plans import lookup_queries
from lexis.plans.corpus_queries import MARKED, PLAIN
from lexis.plans.registry import query, table
from lexis.sources import html_text


def _stripped() -> str:
    text = "coalesce(html, '')"
    for pattern, to in html_text.STEPS:
        quoted = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{quoted}', {'chr(1)' if to == html_text.SPLIT else repr(to)}, 'g')"
    return text


_SEGMENTS = f"seg AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS seg_ix, trim(parts[i], ' ') AS text FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT page_id, string_split({_stripped()}, chr(1)) AS parts FROM pages)) WHERE trim(parts[i], ' ') <> '')"


@query(f"WITH {_SEGMENTS} SELECT page_id, seg_ix, text FROM seg")
def inline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.segments(table(spark, sf_dir, "pages"))


@query(f"WITH {_SEGMENTS} SELECT page_id, seg_ix, nullif(left(regexp_extract(text, '^ ?(\\p{{L}}+)', 1), 13), '') AS clip FROM seg")
def clip_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.clipped(html_text.segments(table(spark, sf_dir, "pages"))).select("page_id", "seg_ix", "clip")


@query(f"""WITH {_SEGMENTS}, o AS (SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY page_id ORDER BY seg_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM seg) SELECT page_id, seg_ix, start, start + length(text) AS "end" FROM o""")
def match_to_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.ranges(html_text.segments(table(spark, sf_dir, "pages"))).select("page_id", "seg_ix", "start", "end")


_BLANK = r"[ \t\r\n\f]+"
_INLINE = "|".join(html_text.INLINE.split())
#: Nodes by hand: what is cut before tags go, block ends as 1, inline tags as 2, ruby behind 3.
_NODES = rf"""raw AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', chr(1), 'g'),
'(?is)<(?:rt|rp)\b[^>]*>(.*?)</(?:rt|rp)>', chr(2) || chr(3) || '\1' || chr(2), 'g'), '(?i)</?(?:{_INLINE})(?:\s[^>]*)?/?>', chr(2), 'g'), '<[^>]*>', chr(1), 'g'), '{_BLANK}', ' ', 'g') AS t FROM pages),
line AS (SELECT page_id, i - 1 AS seg_ix, string_split(l[i], chr(2)) AS parts FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, string_split(t, chr(1)) AS l FROM raw)) WHERE l[i] <> ''),
node AS MATERIALIZED (SELECT page_id, CAST(seg_ix AS INTEGER) AS seg_ix, CAST(i - 1 AS INTEGER) AS node_ix, array_to_string(list_filter(parts, lambda x: NOT starts_with(x, chr(3))), '') AS block, parts[i] AS text, CAST(length(array_to_string(list_filter(parts[1:i - 1], lambda x: NOT starts_with(x, chr(3))), '')) AS INTEGER) AS start
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM line) WHERE parts[i] <> '' AND NOT starts_with(parts[i], chr(3)))"""


@query(rf"""WITH {_NODES}, c AS (SELECT *, regexp_extract(right(left(block, start), 1024), '[^.!?。！？]*$') AS h, regexp_extract(substr(block, start + 1, 100), '^[^.!?。！？]*') AS t FROM node),
r AS (SELECT *, start - length(h) AS a, start + length(t) AS z, CASE WHEN ends_with(h, trim(h, ' ')) THEN trim(h, ' ') ELSE '' END || trim(t, ' ') AS context FROM c)
SELECT r.page_id, r.seg_ix, r.node_ix, context, CAST(f.node_ix AS INTEGER) AS from_node, CAST(a - f.start AS INTEGER) AS from_offset, CAST(e.node_ix AS INTEGER) AS to_node, CAST(z - e.start AS INTEGER) AS to_offset FROM r
JOIN node f ON f.page_id = r.page_id AND f.seg_ix = r.seg_ix AND f.start <= a AND a < f.start + length(f.text)
JOIN node e ON e.page_id = r.page_id AND e.seg_ix = r.seg_ix AND e.start <= greatest(z - 1, 0) AND greatest(z - 1, 0) < e.start + length(e.text)""")
def page_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence around the beginning of each text node, over as many nodes as it takes, and the nodes where it begins and ends."""
    nodes = html_text.nodes(table(spark, sf_dir, "pages"))
    rows = html_text.sentence_at(nodes).select("page_id", "seg_ix", "node_ix", "context", "head", "tail")
    rows = html_text.nodes_at(html_text.nodes_at(rows, nodes, "head", "from"), nodes, "tail", "to", end=True)
    return rows.select("page_id", "seg_ix", "node_ix", "context", "from_node", "from_offset", "to_node", "to_offset")


#: Folding here: no marks, and one letter that becomes two.
LATIN_STEP = f"concat(acc, replace(translate(lower(c), '{MARKED}', '{PLAIN}'), 'ß', 'ss'))"
_LATIN = f"replace(translate(lower({{}}), '{MARKED}', '{PLAIN}'), 'ß', 'ss')"
_TOKENS = lookup_queries._TOKENS
_PAGE_WITH = (
    lookup_queries._WITH.replace(f"inp AS (SELECT w FROM ({_TOKENS.format('text', 'benchmark')}) WHERE w <> '')", f"{_NODES}, src AS MATERIALIZED (SELECT page_id, seg_ix, node_ix, block, start, regexp_extract(substr(block, start + 1, 13), '^[\\p{{L}}]*') AS text FROM node),\ninp AS (SELECT DISTINCT {_LATIN.format('text')} AS w FROM src WHERE text <> '')")
    .replace(f"FROM ({_TOKENS.format('text', 'documents')}) WHERE w <> '')", f"FROM (SELECT DISTINCT {_LATIN.format('w')} AS w FROM ({_TOKENS.format('text', 'documents')}) WHERE w <> ''))")
    .replace(f"FROM ({_TOKENS.format('p_name', 'part')}) WHERE w <> '')", f"FROM ({_TOKENS.format('p_name', 'part')}) WHERE w IS NULL)")
)


@query(
    _PAGE_WITH
    + f""", len AS (SELECT text, {_LATIN.format('text')} AS w, m, length({_LATIN.format('left(text, m)')}) AS upto FROM (SELECT text, unnest(range(1, length(text) + 1)) AS m FROM (SELECT DISTINCT text FROM src WHERE text <> ''))),
hit AS (SELECT len.text, rnk, entry_id, CAST(min(m) AS INTEGER) AS match_units FROM rnk JOIN len ON len.w = rnk.w AND upto >= match_len GROUP BY ALL)
SELECT s.page_id, s.seg_ix, s.node_ix, CAST(rnk AS BIGINT) AS rnk, entry_id, match_units, left(s.text, match_units) AS matched, CAST(e.node_ix AS INTEGER) AS to_node, CAST(s.start + match_units - e.start AS INTEGER) AS to_offset
FROM src s JOIN hit ON hit.text = s.text JOIN node e ON e.page_id = s.page_id AND e.seg_ix = s.seg_ix AND e.start < s.start + match_units AND s.start + match_units <= e.start + length(e.text)"""
)
def page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents' vocabulary has for the letters from the beginning of each text node on, across nodes: the match in the page's own letters, and the node where it ends."""
    nodes = html_text.nodes(table(spark, sf_dir, "pages"))
    places = nodes.filter("not ruby").withColumn("text", html_text.clip_at("block", "start", r"\\p{L}")).select("page_id", "seg_ix", "node_ix", "start", "text")
    fold = f"replace(translate(lower(key), '{MARKED}', '{PLAIN}'), 'ß', 'ss')"
    words = lookup.tokens(table(spark, sf_dir, "documents").select("text")).select(F.col("w").alias("key")).select(F.expr(fold).alias("key")).distinct()
    words = words.select("key", lookup.entry_id("key").alias("entry_id"), F.when(F.length("key") <= 4, 4).otherwise(2).alias("pos_mask"))
    sources = lookup.sources(places, step=LATIN_STEP)
    hits = lookup.located(lookup.lookup(sources, words, None, lookup_queries.RULES), sources)
    rows = places.join(hits, "text").withColumn("end", F.col("start") + F.col("match_chars"))
    rows = html_text.nodes_at(rows, nodes, "end", "to", end=True)
    return rows.select("page_id", "seg_ix", "node_ix", F.col("rnk").cast("bigint").alias("rnk"), "entry_id", "match_units", "matched", "to_node", "to_offset")
