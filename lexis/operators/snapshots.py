"""Versions of an alignment: three relations that belong together, written as one and read back as one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RELATIONS = ("mapping", "phrases", "names")
LOG = "number bigint, version string"


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).option("pathGlobFilter", "*.parquet").parquet(f"{path}/log")


def save(path: str, mapping: DataFrame, phrases: DataFrame, names: DataFrame) -> int:
    """Write the relations as a new version below ``path`` and give its number, from 1 on.

    The version counts only when its one line is in the log, which comes last: a writer that dies before leaves all readers at the version before. Of two writers at once
    both versions stay, and the later name of equal numbers is the newer one."""
    spark, version = mapping.sparkSession, uuid.uuid4().hex
    for name, relation in zip(RELATIONS, (mapping, phrases, names)):
        relation.write.parquet(f"{path}/versions/{version}/{name}")
    spark.createDataFrame([], LOG).write.mode("append").parquet(f"{path}/log")
    number = (_log(spark, path).agg(F.max("number")).first()[0] or 0) + 1
    spark.createDataFrame([(number, version)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return number


def load(spark: SparkSession, path: str, number: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The relations of a version, the newest unless told otherwise. A number that isn't there raises a LookupError."""
    rows = _log(spark, path)
    row = (rows if number is None else rows.filter(F.col("number") == number)).orderBy(F.desc("number"), F.desc("version")).first()
    if row is None:
        raise LookupError(f"no version {number or ''} of an alignment in {path}")
    return tuple(spark.read.parquet(f"{path}/versions/{row.version}/{name}") for name in RELATIONS)
