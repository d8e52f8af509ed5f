"""Tables between the steps of an operator, written to the folder that a cluster's executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where that is unset on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/lexis-steps"
    return root.rstrip("/")


class Steps:
    """Step tables of one call: each is written once and read as often as needed, and all are deleted together.

    Nothing is kept in executors' memory, so a lost executor costs no more than its running tasks."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{shared_root(spark)}/steps-{uuid.uuid4().hex}", 0

    def saved(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` written to a folder of its own, after which the steps go."""
        path = f"{self.path}-result"
        df.write.parquet(path)
        self.discard()
        return self.spark.read.schema(df.schema).parquet(path)
