"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexis.llm.common import discard, saved


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b), root being the least id of its component.

    Each round moves every id's neighbours to the least of them, first the larger ones, then the smaller ones and the id
    itself, until only stars are left; rounds grow as the logarithm of the longest path.
    Links are never gathered by id: an id's least neighbour is an aggregate, which is joined back."""
    edges = saved(links.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "links", thin=True)
    while not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() or not edges.groupBy("a").count().filter("count > 1").isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before, edges = edges, saved(small.filter("a <> b").distinct(), "links", thin=True)
        discard(before)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
