"""Review lists: sets of entry ids, as one-column tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listed(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids, rows[key] == ids["id"], "left_semi")


def unlisted(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids, rows[key] == ids["id"], "left_anti")


def added(ids: DataFrame, more: DataFrame) -> DataFrame:
    return ids.union(more).distinct()


def removed(ids: DataFrame, less: DataFrame) -> DataFrame:
    return ids.join(less, "id", "left_anti")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change) that turn the old list into the new one."""
    old, new = old.distinct(), new.distinct()
    return removed(new, old).withColumn("change", F.lit("add")).unionByName(removed(old, new).withColumn("change", F.lit("remove")))
