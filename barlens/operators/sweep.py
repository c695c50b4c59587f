"""Parameter grids, picking the best variant, and derived search bounds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlens.functions.core import KEYS


def param_grid(spark: SparkSession, space: Mapping[str, Sequence], pinned: Mapping[str, object] | None = None) -> DataFrame:
    """Every combination of the lists, in grid order, with its identity as sorted JSON.

    A plain value counts as a list of one; an empty space gives the one default row.
    """
    full = {**{k: list(v) if isinstance(v, (list, tuple)) else [v] for k, v in space.items()},
            **{k: [v] for k, v in (pinned or {}).items() if k not in space}}
    df = spark.range(1).select(F.lit(0).cast("long").alias("grid_order"))
    for name, values in full.items():
        df = df.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_i", name)).withColumn(
            "grid_order", F.col("grid_order") * len(values) + F.col("_i")).drop("_i")
    ident = F.to_json(F.struct(*sorted(full))) if full else F.lit("{}")
    return df.withColumn("params_id", ident)


def valid_sessions(grid: DataFrame) -> DataFrame:
    """Drops combinations whose session does not start before it ends."""
    return grid.where(F.col("start_hour") < F.col("end_hour"))


def long_enough(stats: DataFrame, bars: DataFrame, min_bars: int = 200) -> DataFrame:
    """Keeps the results of series with at least so many bars; counted map-side, one row per series."""
    series = bars.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_bars)
    return stats.join(series.select(*KEYS), list(KEYS), "left_semi")


def sweep(stats: DataFrame, *, by: Sequence[str], metric: str, order: str, keep: int = 1) -> DataFrame:
    """Best ``keep`` variants of each group; the earlier one in the grid wins a tie.

    A group holds one row per variant, a number the caller fixes.
    """
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc_nulls_last(), F.col(order).asc())
    return (stats.where(F.col(metric).isNotNull()).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= keep))


def best_symbol_timeframe(metrics: DataFrame, *, by: Sequence[str], min_trades: int = 10, floor: float = -1.0) -> DataFrame:
    """One (symbol, timeframe) per strategy with the reason when the strategy is rejected.

    Enough trades: highest Sharpe; otherwise most trades.  Rejected when nothing
    trades, or when the best Sharpe of all runs lies below ``floor``; a run without
    trades counts with its own Sharpe, 0 if it has none.
    """
    enough = F.col("trades") >= min_trades
    w = Window.partitionBy(*by).orderBy(
        F.when(enough, 0).otherwise(1), F.when(enough, F.col("sharpe")).desc_nulls_last(), F.desc("trades"), "symbol", "timeframe")
    groups = Window.partitionBy(*by)
    marked = metrics.select(
        "*", F.row_number().over(w).alias("_rank"), F.sum("trades").over(groups).alias("_trades"),
        F.max(F.coalesce("sharpe", F.when(F.col("trades") == 0, 0.0))).over(groups).alias("_best"))
    reason = F.when(F.col("_trades") == 0, "zero_trades").when(F.col("_best") < floor, "unprofitable")
    return marked.where("_rank = 1").select(*by, "symbol", "timeframe", "trades", "sharpe", reason.alias("reject_reason"))


def viable_timeframes(metrics: DataFrame, *, by: Sequence[str], top: int = 3) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("trades"), "timeframe")
    return metrics.where("trades > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def tighten_bounds(gain: Column, start: Column, end: Column, min_gain: float = 0.1, slack: int = 3) -> Column:
    """Search bounds around a found session, where the gain is worth it."""
    bounds = F.struct(
        F.greatest(start - slack, F.lit(0)).alias("start_lo"), F.least(start + slack, end - 1).alias("start_hi"),
        F.greatest(start + 1, end - slack).alias("end_lo"), F.least(end + slack, F.lit(23)).alias("end_hi"))
    return F.when(gain > min_gain, bounds)


def tighten_cap(gain: Column, cap: Column, kind: str = "trades", min_gain: float = 0.1) -> Column:
    """Upper bound for daily trades (found + 3, at most 10) or daily losses (found + 2, at most 6)."""
    more, most = (3, 10) if kind == "trades" else (2, 6)
    return F.when(gain > min_gain, F.least(cap + more, F.lit(most)))
