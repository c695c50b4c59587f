"""Row numbers over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column | str], out: str = "rn",
                total: str | None = None) -> DataFrame:
    """Adds the row's number (from 0) in its group, ordered by bucket and then ``order``.

    ``bucket`` must rise with the order (a time slice, a hash prefix).  Rows are
    ranked inside their bucket only; counts per bucket give the offsets.
    """
    keys = list(keys)
    marked = df.withColumn("_bucket", bucket)
    series, in_order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bucket")
    counts = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_bucket",
        F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"),
        *([F.sum("_n").over(series).alias(total)] if total else []))
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        marked.withColumn("_in", F.row_number().over(w)).join(counts, [*keys, "_bucket"])
        .withColumn(out, F.col("_first") + F.col("_in") - 1).drop("_bucket", "_first", "_in")
    )


def cumulative(df: DataFrame, keys: Sequence[str], rn: str, value: Column, out: str, block: int = 16384) -> DataFrame:
    """Running sum in order of an existing row number: inside blocks, plus the totals of earlier blocks."""
    keys = list(keys)
    cut = df.withColumn("_b", F.floor(F.col(rn) / block)).withColumn("_v", value)
    order = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t")).select(
        *keys, "_b", F.coalesce(F.sum("_t").over(order), F.lit(0.0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_b").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    return (cut.withColumn("_part", F.sum("_v").over(inside)).join(base, [*keys, "_b"])
            .withColumn(out, F.col("_base") + F.col("_part")).drop("_b", "_v", "_base", "_part"))
