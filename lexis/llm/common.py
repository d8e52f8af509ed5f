"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space, as a Java or RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's checkpoint folder; a temporary one only where that is unset on one machine (tests)."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/lexis-checkpoints-{os.getpid()}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def saved(df: DataFrame, purpose: str = "step", thin: bool = False) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder; columns stay prunable when it is read again.

    A ``thin`` table, such as links or counts, is written in fewer files than it has partitions: tasks take several of them one after
    the other, two tasks or more for each core."""
    path = shared_dir(df.sparkSession, purpose)
    if thin:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-partitions // 16)))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(*steps: DataFrame | None) -> None:
    """Delete tables that ``saved`` wrote and that nothing reads any more: what was made of them is written itself."""
    for df in steps:
        path = getattr(df, "saved_path", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def bitmap(rows: DataFrame, bit: str, bits: int) -> Column:
    """An array of numbers in whose ``bits`` bits (a power of two) those are set that the expression ``bit`` names; a scalar subquery."""
    words = rows.groupBy(F.expr(f"cast(shiftright({bit}, 6) as int)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({bit} & 63 as int))")).alias("bits"))
    all_ = rows.sparkSession.range(bits >> 6).join(words, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    return all_.agg(F.expr("transform(sort_array(collect_list(struct(id, bits))), x -> x.bits)")).scalar()


def is_set(bitmap: Column, bit: str) -> Column:
    return F.getbit(F.get(bitmap, F.expr(f"cast(shiftright({bit}, 6) as int)")), F.expr(f"cast({bit} & 63 as int)")) == 1


def among(rows: DataFrame, places: DataFrame, keys: list[str], bits: int = 1 << 22) -> DataFrame:
    """``rows`` without most of those whose ``keys`` aren't in ``places``, by a bitmap of ``bits`` bits, a power of two.

    It comes before a join with ``places``, so that few rows are shuffled; where the bitmap is full, all are, and the join is right either way."""
    bit = f"(xxhash64({', '.join(keys)}) & {bits - 1}L)"
    return rows.filter(is_set(bitmap(places, bit, bits), bit))


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``make`` runs once per task and gives a function from Arrow batch to Arrow batch over ``columns`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            out = each(batch)
            if out is not None:
                yield out

    return df.select(*columns).mapInArrow(run, schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at exactly the six ASCII white space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
