"""Distributed windows over long series.

A series (symbol, timeframe) can hold a large share of all rows, so a window
partitioned by the series alone would put that share into one task.  Instead a
series is cut into *blocks* of a bounded number of rows.  Every block also gets
the rows just before (and after) it that its windows reach back to; those extra
rows are dropped at the end.  Windows then run per (series, block): one shuffle
for any number of chained windows, and no task grows with the series.

The cut needs the number of rows in front of each row.  Bars have unique
timestamps, so a time slice of N bar widths holds at most N rows; counting per
slice is a map-side combined aggregation and the running total runs over slices
only (a calendar-bounded list).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlens.functions.core import KEYS

BLOCK_ROWS = 16384
SLICE_BARS = 1024
FRAME_KEYS = (*KEYS, "_blk")


def timeframe_seconds(col: Column) -> Column:
    """Seconds of '15m', '1h', '4h', '1d', '1w'; case and blanks around don't matter, anything else is an error."""
    plain = F.lower(F.trim(col))
    amount = F.regexp_extract(plain, r"^(\d+)[mhdw]$", 1).try_cast("long")
    unit = F.right(plain, F.lit(1))
    seconds = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)
    unknown = F.raise_error(F.concat(F.lit("unknown timeframe "), F.coalesce(col, F.lit("null")))).cast("long")
    return F.when(amount > 0, amount * seconds).otherwise(unknown)


def blocked(
    bars: DataFrame, *, before: int = 0, after: int = 0,
    block_rows: int = BLOCK_ROWS, slice_bars: int = SLICE_BARS,
) -> DataFrame:
    """Add ``_blk`` and ``_own``; rows in reach of a neighbouring block are repeated there."""
    keys = ", ".join(KEYS)
    width = timeframe_seconds(F.col("timeframe")) * slice_bars
    sliced = bars.withColumn("_slice", F.floor(F.unix_seconds("ts") / width).cast("long"))
    counts = (
        sliced.groupBy(*KEYS, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .selectExpr("*", f"""coalesce(sum(_n) OVER (PARTITION BY {keys} ORDER BY _slice
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _first""")
        .selectExpr("*", f"_first div {block_rows} AS _home", f"max(_n) OVER (PARTITION BY {keys}) AS _nmax",
                    f"max(_first div {block_rows}) OVER (PARTITION BY {keys}) AS _last")
    )
    lo = f"greatest(0, floor((_first - _nmax - {after}) / {block_rows}))" if after else "_home"
    hi = f"least(_last, ceil((_first + _n + {before}) / {block_rows}) - 1)" if before else "_home"
    homes = counts.selectExpr(
        *KEYS, "_slice", "_home", f"explode(sequence(least({lo}, _home), greatest({hi}, _home))) AS _blk")
    return (
        sliced.join(homes, [*KEYS, "_slice"])
        .withColumn("_own", F.expr("_blk = _home"))
        .drop("_slice", "_home")
    )


# the rows of a block in time order, as SQL text
FRAME_SQL = f"PARTITION BY {', '.join(FRAME_KEYS)} ORDER BY ts"


def lag_sql(col: str, k: int = 1) -> str:
    return f"lag({col}, {k}) OVER ({FRAME_SQL})"


def lead_sql(col: str, k: int = 1) -> str:
    return f"lead({col}, {k}) OVER ({FRAME_SQL})"


def rolling_sql(agg: str, col: str, n: int, min_n: int | None = None) -> str:
    """Trailing aggregate over ``n`` rows, null until ``min_n`` (default ``n``) values are present."""
    w = f"OVER ({FRAME_SQL} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {w} >= {min_n or n} THEN {agg} {w} END"


def frame() -> WindowSpec:
    """Rows of a block in time order."""
    return Window.partitionBy(*FRAME_KEYS).orderBy("ts")


def trailing(n: int) -> WindowSpec:
    return frame().rowsBetween(-(n - 1), 0)


def lag(col: str | Column, k: int = 1) -> Column:
    return F.lag(col, k).over(frame())


def lead(col: str | Column, k: int = 1) -> Column:
    return F.lead(col, k).over(frame())


def rolling(agg: Callable[[Column], Column], col: str | Column, n: int, min_n: int | None = None) -> Column:
    """Trailing aggregate, null until ``min_n`` (default ``n``) values are present."""
    x = F.col(col) if isinstance(col, str) else col
    w = trailing(n)
    return F.when(F.count(x).over(w) >= (min_n or n), agg(x).over(w))


@dataclass(frozen=True)
class Step:
    """A derivation over a blocked frame and the rows it reaches back and ahead."""

    ins: tuple[str, ...]
    outs: tuple[str, ...]
    fn: Callable[[DataFrame], DataFrame]
    before: int = 0
    after: int = 0


def reach(steps: Sequence[Step]) -> tuple[int, int]:
    """Rows needed before and after a block when the steps feed one another."""
    back: dict[str, int] = {}
    ahead: dict[str, int] = {}
    for s in steps:
        b = s.before + max((back.get(c, 0) for c in s.ins), default=0)
        a = s.after + max((ahead.get(c, 0) for c in s.ins), default=0)
        for o in s.outs:
            back[o] = max(b, back.get(o, 0))
            ahead[o] = max(a, ahead.get(o, 0))
    return max(back.values(), default=0), max(ahead.values(), default=0)


def run_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    for s in steps:
        df = s.fn(df)
    return df


def own_rows(df: DataFrame) -> DataFrame:
    extra = [c for c in df.columns if c.startswith("_")]
    return df.where("_own").drop(*extra)


def compute(bars: DataFrame, steps: Sequence[Step], *, block_rows: int = BLOCK_ROWS,
            slice_bars: int = SLICE_BARS) -> DataFrame:
    """Bars plus all columns the steps define; one shuffle of the bars for all of them."""
    before, after = reach(steps)
    out = blocked(bars, before=before, after=after,
                  block_rows=max(block_rows, 2 * (before + after)) if block_rows == BLOCK_ROWS else block_rows,
                  slice_bars=slice_bars)
    return own_rows(run_steps(out, steps))


def column(name: str, ins: Sequence[str], expr: Callable[[], Column], before: int = 0, after: int = 0) -> Step:
    """Step that adds one column."""
    return Step(tuple(ins), (name,), lambda df: df.withColumn(name, expr()), before, after)


def columns(ins: Sequence[str], exprs: Callable[[], dict[str, Column]], outs: Sequence[str],
            before: int = 0, after: int = 0) -> Step:
    """Step that adds several columns at once."""
    return Step(tuple(ins), tuple(outs), lambda df: df.withColumns(exprs()), before, after)


def sql_columns(ins: Sequence[str], exprs: dict[str, str], before: int = 0, after: int = 0) -> Step:
    """Step that adds columns given as SQL text."""
    return Step(tuple(ins), tuple(exprs), lambda df: df.selectExpr("*", *[f"{e} AS {n}" for n, e in exprs.items()]),
                before, after)
