"""Small Spark helpers of the operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.session import scratch_dir

#: Whether shuffle files are removed at the end of each execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch; bounds what a Python worker holds at once.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def batches(spark: SparkSession) -> None:
    """Let Arrow batches be bounded by bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch."""
    batches(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the shuffle files behind it go when it is written.

    What was written is read from now on, so nothing needs them, and left alone they would fill
    the executors' disks until the query ends.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{label}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove stored tables that no later step reads."""
    for df in tables:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWERED)
