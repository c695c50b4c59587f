"""Exact quantiles and ranks of groups of any size, whatever their distribution.

``percentile`` keeps every distinct value of a group in one buffer.  Here values
are first counted in order-preserving logarithmic buckets (a bounded number per
group), the buckets that hold the wanted ranks are found from the counts, and
only the values of those buckets are ranked.  A bucket that holds too many values (prices
that lie within a percent of each other share one) is counted again in finer buckets
between its own smallest and largest value, until what has to be ranked in one place is at most
``LIMIT`` values or a single one.  Counts merge map-side, so a pass sends a bounded number of rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.session import materialise


def value_bucket(x: Column, per_e: int = 16, scale: float = 1e6) -> Column:
    """Monotone bucket number of a double: logarithmic, both signs."""
    return F.floor(F.signum(x) * F.ln(1 + F.least(F.abs(x), F.lit(1e300)) * scale) * per_e).cast("int")


#: Most values that one task ranks.
LIMIT = 32768
#: Finer buckets of a bucket that holds more.
SPLITS = 1024


def share_of(x: str, lo: str, hi: str) -> str:
    """SQL: where x lies between lo and hi, from 0 to 1; halves first, as differences of doubles may overflow."""
    return f"(({x} / 2 - {lo} / 2) / ({hi} / 2 - {lo} / 2))"


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    hist: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per group with a column per probability, linearly interpolated.

    The result is written out: it is one row per group, often joined back to the
    data, and its true size then decides how.

    ``hist`` may bring counts per (keys, ``bucket``) as ``n``, with the smallest and largest value
    as ``lo`` and ``hi``, when the caller has them already.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"),
                                                     value_bucket(F.col(value)).alias("bucket"))
    if hist is None:
        hist = materialise(rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")), "hist")
    total = F.sum("n").over(Window.partitionBy(*keys))
    in_order = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.array(*[
        f(F.lit(p) * (F.col("_total") - 1)).cast("long") for p in probs.values() for f in (F.floor, F.ceil)])
    holds = F.exists(wanted, lambda k: (k >= F.col("_first")) & (k < F.col("_first") + F.col("_n")))
    targets = hist.select(*keys, "bucket", "lo", "hi", F.col("n").alias("_n"), total.alias("_total"),
                          (F.sum("n").over(in_order) - F.col("n")).alias("_first")).where(holds)
    targets = materialise(targets, "brackets")
    large = (F.col("_n") > limit) & (F.col("lo") < F.col("hi"))
    while not targets.where(large).isEmpty():
        finer = rows.join(targets.where(large).drop("_n"), [*keys, "bucket"]).where("_x BETWEEN lo AND hi").groupBy(
            *keys, "bucket", F.col("lo").alias("_lo"), "_total", "_first", F.expr(f"CAST({share_of('_x', 'lo', 'hi')} * {SPLITS} AS INT)").alias("_part")).agg(
                F.count(F.lit(1)).alias("_n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        parts = Window.partitionBy(*keys, "bucket", "_lo").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        finer = finer.withColumn("_first", F.col("_first") + F.sum("_n").over(parts) - F.col("_n")).where(holds)
        targets = materialise(targets.where(~large).unionByName(finer.drop("_lo", "_part")), "brackets")
    counted = rows.join(targets, [*keys, "bucket"]).where("_x BETWEEN lo AND hi").groupBy(
        *keys, "bucket", "lo", "_first", "_total", "_x").agg(F.count(F.lit(1)).alias("_c"))
    within = Window.partitionBy(*keys, "bucket", "lo").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_hi", F.col("_first") + F.sum("_c").over(within)).withColumn(
        "_lo", F.col("_hi") - F.col("_c"))
    picks = {}
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        for tag, k in (("f", F.floor(pos)), ("c", F.ceil(pos))):
            hit = (k >= F.col("_lo")) & (k < F.col("_hi"))
            picks[f"_{tag}_{name}"] = F.max(F.when(hit, F.col("_x")))
    out = ranked.groupBy(*keys, "_total").agg(*[e.alias(a) for a, e in picks.items()])
    cols = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.col(f"_f_{name}"), F.col(f"_c_{name}")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return materialise(out.select(*keys, *cols), "quantiles")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str, limit: int = LIMIT) -> DataFrame:
    """Average rank of each value in its group without ranking a group in one task.

    Equal values are counted; counts are ranked inside buckets of at most ``limit`` different values,
    and bucket totals give the offsets.  A bucket is named by its path: the logarithmic one, then
    its parts, which sort as the values do.  Rows without a value are left out.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull())
    counts = materialise(known.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_b", F.array(value_bucket(F.col("_v")).cast("long"))), "counts")
    while True:
        large = counts.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where(F.col("_n") > limit)
        large = materialise(large, "large-buckets")
        if large.isEmpty():
            break
        part = F.expr(f"CAST({share_of('_v', '_lo', '_hi')} * {SPLITS} AS BIGINT)")
        counts = materialise(counts.join(large, [*keys, "_b"], "left").select(
            *keys, "_v", "_c", F.when(F.col("_n").isNull(), F.col("_b")).otherwise(F.concat("_b", F.array(part))).alias("_b")), "counts")
    order = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_t")).select(
        *keys, "_b", F.coalesce(F.sum("_t").over(order), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.join(base, [*keys, "_b"]).select(
        *keys, "_v", (F.col("_base") + F.sum("_c").over(inner) - (F.col("_c") - 1) / 2).alias(out))
    return known.withColumn("_v", F.col(value).cast("double")).join(ranks, [*keys, "_v"]).drop("_v")
