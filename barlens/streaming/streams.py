"""Structured Streaming versions of the incremental operators.

Streams carry TIMESTAMP columns (a watermark needs that type).  Every operator
gives what its batch twin gives once the watermark has passed a window's end.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barlens.operators.blocks import timeframe_seconds
from barlens.operators.registry import upsert_path
from barlens.session import scratch_dir
from barlens.sources.bars import interval_of


def tick_stream(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def candles(ticks: DataFrame, *, width: str, delay: str, tie: str | None = None) -> DataFrame:
    """Bars of (symbol, ts, price, size) ticks; a bar is final when the watermark passes its end.

    ``tie`` names the column that orders ticks of one time, as in the batch twin. ``late_ticks`` counts what comes too late.
    """
    order = F.struct("ts", tie) if tie else F.col("ts")
    return (
        ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", interval_of(width)).alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
             F.max_by("price", order).alias("close"), F.sum("size").alias("volume"))
        .select("symbol", F.lit(width).alias("timeframe"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


class OrderedEma(StatefulProcessor):
    """EMA in event time: rows wait in slices of time until the watermark closes a slice, then pass in order.

    State per key: the waiting rows of each open slice and the average with its time.  A timer stands at the end of each waiting slice and, once a key has been quiet for ``idle``
    behind its last closed row, at its expiry, which clears the average.
    """

    def __init__(self, key: str, alpha: float, slice_ms: int, idle_ms: int | None) -> None:
        self.key, self.alpha, self.slice_ms, self.idle_ms = key, alpha, slice_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long", "micros array<long>, value array<double>")
        self.average = handle.getValueState("average", "ema double, micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            micros = pdf["micros"].to_numpy(dtype="int64")
            slices = micros // 1000 // self.slice_ms
            values = pdf["value"].to_numpy(dtype="float64")
            closed = (slices + 1) * self.slice_ms <= mark
            if closed.any():
                ema = self.average.get()[0] if self.average.exists() else None
                yield self._rows(key, micros[closed], values[closed], [ema] * int(closed.sum()), True)
            for s in pd.unique(slices[~closed]).tolist():
                mine = slices == s
                old = self.waiting.getValue((s,)) if self.waiting.containsKey((s,)) else None
                if old is None:
                    self.handle.registerTimer((s + 1) * self.slice_ms)
                held, x = ([], []) if old is None else (list(old[0]), list(old[1]))
                self.waiting.updateValue((s,), (held + micros[mine].tolist(), x + values[mine].tolist()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        s = at // self.slice_ms - 1
        if at % self.slice_ms == 0 and self.waiting.containsKey((s,)):
            held, x = self.waiting.getValue((s,))
            self.waiting.removeKey((s,))
            pdf = pd.DataFrame({"micros": list(held), "value": list(x)}).sort_values(["micros", "value"])
            before, last = self.average.get() if self.average.exists() else (None, None)
            quiet = self.idle_ms is not None and last is not None and pdf["micros"].iloc[0] - last >= self.idle_ms * 1000
            start = [] if before is None or quiet else [before]
            ema = pd.Series(start + pdf["value"].tolist(), dtype="float64").ewm(
                alpha=self.alpha, adjust=False, ignore_na=True).mean().tolist()
            last = int(pdf["micros"].iloc[-1])
            self.average.update((None if ema[-1] != ema[-1] else ema[-1], last))
            if self.idle_ms is not None:
                # between two slice ends, so that it never stands for one
                due = last // 1000 + self.idle_ms
                self.handle.registerTimer(due + 1 if due % self.slice_ms == 0 else due)
            yield self._rows(key, pdf["micros"], pdf["value"], ema[len(start):], False)
        elif self.idle_ms is not None and self.average.exists() and at >= self.average.get()[1] // 1000 + self.idle_ms:
            self.average.clear()

    def close(self) -> None:
        pass

    def _rows(self, key, micros, value, ema, late: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: key[0], "ts": pd.to_datetime(np.asarray(micros), unit="us"), "value": np.asarray(value),
                             "ema": np.asarray(ema, dtype="float64"), "late": late})


def stream_ema(values: DataFrame, *, n: int, delay: str, slice_seconds: int = 3600, idle_seconds: int | None = None,
               key: str = "symbol") -> DataFrame:
    """EMA of (symbol, ts, value) in order of time, whatever the triggers and the order of arrival.

    A row comes out when the watermark has passed the end of its slice; ties of time go by value; a missing
    value keeps the last average.  A row of a closed slice is marked late, carries the average of its arrival and changes
    nothing.  After ``idle_seconds`` without rows a symbol starts anew and keeps no state.
    """
    rows = values.withWatermark("ts", delay).select(key, "ts", F.unix_micros("ts").alias("micros"), F.col("value").cast("double"))
    # the time travels as a number: rows that still carry the watermark's column would be dropped when late
    rows = rows.drop("ts")
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(
        OrderedEma(key, 2.0 / (n + 1), slice_seconds * 1000, None if idle_seconds is None else idle_seconds * 1000),
        f"`{key}` {kind}, ts timestamp, value double, ema double, late boolean", "Append", "EventTime")


class LateRows(StatefulProcessor):
    """Counts the rows of a window that arrive after the watermark has closed it; the state is one total per key."""

    def __init__(self, key: str, width_ms: int) -> None:
        self.key, self.width_ms = key, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "late long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        found = pd.Series(dtype="int64")
        for pdf in rows:
            start = pdf["ms"] // self.width_ms * self.width_ms
            found = found.add(start[start + self.width_ms <= mark].value_counts(), fill_value=0)
        if len(found):
            total = (self.total.get()[0] if self.total.exists() else 0) + int(found.sum())
            self.total.update((total,))
            yield pd.DataFrame({self.key: key[0], "ts": pd.to_datetime(found.index.astype("int64"), unit="ms"),
                                "late": found.astype("int64").to_numpy(), "late_so_far": total})

    def close(self) -> None:
        pass


def late_ticks(ticks: DataFrame, *, width: str, delay: str, key: str = "symbol") -> DataFrame:
    """How many ticks each closed candle has missed: what ``candles`` with the same width and delay drops.

    One row per trigger, symbol and window that has late ticks, with the symbol's running total.
    """
    seconds = timeframe_seconds(F.lit(width))
    width_ms = 1000 * int(ticks.sparkSession.range(1).select(seconds).first()[0])
    rows = ticks.withWatermark("ts", delay).select(key, F.unix_millis("ts").alias("ms"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(
        LateRows(key, width_ms), f"`{key}` {kind}, ts timestamp, late long, late_so_far long", "Append", "EventTime")


def budget_alerts(costs: DataFrame, *, cap: float, delay: str) -> DataFrame:
    """Days whose cost reaches the cap, from (ts, cost_usd)."""
    days = costs.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum("cost_usd").alias("spent"))
    return days.select(F.col("w.start").alias("day"), "spent", F.greatest(F.lit(0.0), F.lit(cap) - F.col("spent")).alias("remaining"),
                       (F.col("spent") >= cap).alias("over_cap"))


def sliding_load(costs: DataFrame, *, column: str, limit: float, length: str = "60 seconds", slide: str = "2 seconds",
                 delay: str = "1 minute") -> DataFrame:
    """Sliding sums above a limit."""
    sums = costs.withWatermark("ts", delay).groupBy(F.window("ts", length, slide).alias("w")).agg(F.sum(column).alias("total"))
    return sums.where(F.col("total") > limit).select(F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "total")


def without_duplicates(bars: DataFrame, keys: list[str], *, delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def activity_sessions(beats: DataFrame, *, key: str, gap: str, delay: str) -> DataFrame:
    """Spells of activity; the end of a spell says since when the key is stale."""
    s = beats.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("beats"))
    return s.select(key, F.col("w.start").alias("active_from"), F.col("w.end").alias("stale_from"), "beats")


def upsert_stream(rows: DataFrame, path: str, *, keys: list[str], version: str, partition: list[str], checkpoint: str | None = None) -> Callable[[], None]:
    """Merge every micro-batch into a Parquet table; replaying a batch gives the same table.

    ``checkpoint`` keeps how far the stream has come, by default beside the table, so a run goes on
    where the last one stopped.
    """
    checkpoint = checkpoint or path.rstrip("/") + "_checkpoint"
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("ignore").partitionBy(*partition).parquet(path)

    def merge(batch: DataFrame, _: int) -> None:
        upsert_path(batch, path, keys=keys, version=version, partition=partition)

    def run() -> None:
        q = (rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return run


def _fresh(spark: SparkSession, label: str) -> str:
    return os.path.join(scratch_dir(spark), f"stream-{label}-{uuid.uuid4().hex}")


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state with timers needs and which may exceed memory."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, label: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there, to a Parquet sink, and read the result.

    With ``folder`` the result and how far the stream has come stay there, and a later run goes on from it.
    """
    spark = stream.sparkSession
    folder = folder or _fresh(spark, label)
    out = f"{folder}/rows"
    with _state_on_disk(spark):
        q = (stream.writeStream.outputMode(mode).format("parquet").option("path", out)
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
