"""One open position at a time, and no entry after a day's losses are used up.

Which trades are taken depends on every trade before, but only through when the last one
ends and how many losses its day has.  So every trade has one *link*: the trade that would be
taken next if this one were.  Links are composed by pointer doubling inside a block, which
gives the block as a step function from the state before it to the state behind it; the step
functions are followed block after block, and each block then marks its own trades.  Three
passes whatever the trades are, and no loop over the data on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.operators.blocks import BLOCK_ROWS
from barlens.session import materialise

DAY = 86_400_000_000  # microseconds
NEVER = 1 << 62


class Links:
    """Links of a block's trades; a node is (trade, losses of its day so far)."""

    def __init__(self, entry: np.ndarray, leave: np.ndarray, loss: np.ndarray, limit: int | None):
        n, width = len(entry), limit or 1
        trade = np.repeat(np.arange(n), width)
        before = np.tile(np.arange(width), n)
        self.entry, self.width, self.day = entry, width, entry // DAY
        self.losses = before + loss[trade] if limit else before
        spent = (self.losses >= limit) if limit else np.zeros(n * width, dtype=bool)
        self.trade_day = self.day[trade]
        self.busy = np.where(spent, np.maximum(leave[trade], (self.trade_day + 1) * DAY), leave[trade])
        nxt = np.maximum(np.searchsorted(entry, self.busy, "left"), trade + 1)
        inside = nxt < n
        at = np.minimum(nxt, n - 1)
        carried = np.where(self.day[at] == self.trade_day, self.losses, 0)
        self.next = np.where(inside, at * width + np.minimum(carried, width - 1), np.arange(n * width))

    def ends(self) -> np.ndarray:
        """Last node taken in the block on the way from each node."""
        far = self.next
        while True:
            further = far[far]
            if np.array_equal(further, far):
                return far
            far = further

    def taken(self, busy: int, day: int, losses: int) -> np.ndarray:
        """Trades taken when the block is entered in this state."""
        marks = np.zeros(len(self.next), dtype=bool)
        first = int(np.searchsorted(self.entry, busy, "left"))
        if first < len(self.entry):
            marks[first * self.width + (losses if self.day[first] == day else 0)] = True
            far = self.next
            while True:
                marks[far[marks]] = True
                further = far[far]
                if np.array_equal(further, far):
                    break
                far = further
        return marks.reshape(-1, self.width).any(axis=1)


def flat_only(trades: DataFrame, *, max_daily_losses: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Trades taken when only one position per strategy and symbol may be open.

    With ``max_daily_losses`` no entry follows on a (UTC) day on which so many taken trades lost; a
    trade counts for the day of its entry.  Of trades that enter at one time the one that leaves
    first comes first.  A trade without an exit stays open for good, one without an entry is
    never taken, a missing ``pnl`` is no loss.  Blocks are cut by rows of a range-partitioned
    table, so any number of trades may fall into an hour.  Of the second pass a task holds one
    step at a time; a block has as many steps as it has different ways out, few where paths meet.
    """
    if max_daily_losses is not None and max_daily_losses < 1:
        return trades.where(F.lit(False))
    order = ["_entry", "_leave", "_loss"]
    marked = trades.where("entry_ts IS NOT NULL").select(
        "*", F.struct("strategy_id", "symbol").alias("_series"), F.unix_micros("entry_ts").alias("_entry"),
        F.coalesce(F.unix_micros("exit_ts"), F.lit(NEVER)).alias("_leave"), F.coalesce(F.col("pnl") < 0, F.lit(False)).cast("long").alias("_loss"))
    ranged = materialise(
        marked.repartitionByRange("_series", "_entry").sortWithinPartitions("_series", *order)
        .withColumn("_row", F.monotonically_increasing_id()), "positions")
    # row numbers rise along a series, so blocks of them are its blocks
    framed = ranged.withColumn("_blk", F.expr(f"_row div {int(block_rows)}"))

    def links(rows: pd.DataFrame | dict) -> Links:
        return Links(*[np.asarray(rows[c], dtype=np.int64) for c in order], max_daily_losses)

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        block = links(pdf)
        end = block.ends().reshape(-1, block.width)
        new = np.ones(len(end), dtype=bool)
        new[:-1] = (end[1:] != end[:-1]).any(axis=1) | (block.day[1:] != block.day[:-1])
        last = np.flatnonzero(new)  # last trade of each step
        end = end[last]
        return pd.DataFrame({
            "strategy_id": pdf["strategy_id"].iloc[0], "symbol": pdf["symbol"].iloc[0], "_blk": pdf["_blk"].iloc[0],
            "step": np.arange(len(last)), "upto": block.entry[last], "on": block.day[last],
            "busy": list(block.busy[end]), "day": list(block.trade_day[end]), "losses": list(block.losses[end])})

    keys = ["strategy_id", "symbol", "_blk"]
    kinds = {x: trades.schema[x].dataType.simpleString() for x in ("strategy_id", "symbol")}
    key_ddl = f"strategy_id {kinds['strategy_id']}, symbol {kinds['symbol']}, _blk long"
    walked = framed.select(*keys, "_row", *order).groupBy(*keys).applyInPandas(
        steps, f"{key_ddl}, step long, upto long, on long, busy array<long>, day array<long>, losses array<long>")

    def follow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, blk, state, through = None, None, (-NEVER, -NEVER, 0), True
        for pdf in parts:
            starts = []
            for row in pdf.itertuples(index=False, name=None):
                s, m, b, _, upto, on, busy, day, losses = row
                if (s, m) != series:
                    series, blk, state = (s, m), None, (-NEVER, -NEVER, 0)
                if b != blk:
                    blk, through = b, False
                    starts.append((s, m, b, *state))
                if not through and upto >= state[0]:
                    k = state[2] if on == state[1] else 0
                    state, through = (int(busy[k]), int(day[k]), int(losses[k])), True
            yield pd.DataFrame(starts, columns=[*keys, "_busy", "_day", "_losses"])

    starts = materialise(
        walked.repartition("strategy_id", "symbol").sortWithinPartitions(*keys, "step")
        .mapInPandas(follow, f"{key_ddl}, _busy long, _day long, _losses long"), "position-starts")

    kept = trades.columns

    def take(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        block = links({c: table.column(c).to_numpy() for c in order})
        mask = block.taken(*[table.column(c)[0].as_py() for c in ("_busy", "_day", "_losses")])
        return table.filter(pa.array(mask)).select(kept)

    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    entered = framed.alias("f").join(starts.alias("s"), same).select("f.*", "s._busy", "s._day", "s._losses")
    return entered.groupBy(*keys).applyInArrow(take, trades.schema)
