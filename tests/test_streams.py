"""Streams against their batch twins, with late rows."""

import pandas as pd
from pyspark.sql import functions as F

from barlens.sources.bars import bars_from_ticks
from barlens.streaming import streams as sm


def write_files(spark, folder, frames):
    import os
    import time
    for i, pdf in enumerate(frames):
        part = os.path.join(folder, f"in{i}")
        spark.createDataFrame(pdf).coalesce(1).write.parquet(part)
        file = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.rename(os.path.join(part, file), os.path.join(folder, f"ticks{i}.parquet"))
        os.utime(os.path.join(folder, f"ticks{i}.parquet"), (time.time() - 100 + i, time.time() - 100 + i))


def ticks(minutes, symbol="A"):
    base = pd.Timestamp("2024-01-01")
    return pd.DataFrame({"symbol": symbol, "ts": [base + pd.Timedelta(minutes=m) for m in minutes], "price": [100.0 + m % 7 for m in minutes], "size": 1.0})


def test_candles_equal_batch_and_drop_late_rows(spark, tmp_path):
    first, second, late = ticks(range(0, 150, 7)), ticks(range(150, 400, 7)), ticks([3, 420])
    write_files(spark, str(tmp_path), [first, second, late])
    schema = spark.createDataFrame(first).schema
    got = sm.drain(sm.candles(sm.tick_stream(spark, str(tmp_path), "ticks", schema), width="1h", delay="30 minutes"), "t")
    batch = bars_from_ticks(spark.createDataFrame(pd.concat([first, second])), symbol=F.col("symbol"), ts=F.col("ts"), price=F.col("price"), size=F.col("size"), width="1h")
    want = batch.where("ts < '2024-01-01 06:00:00'").orderBy("ts").collect()
    assert got.orderBy("ts").collect()[: len(want)] == want and len(want) == 6


def ema_of(spark, folder, frames, **options):
    write_files(spark, folder, frames)
    stream = sm.tick_stream(spark, folder, "ticks", spark.createDataFrame(frames[0]).schema).withColumnRenamed("price", "value")
    return sm.drain(sm.stream_ema(stream, n=5, delay="10 minutes", slice_seconds=600, **options), "e").toPandas()


def test_ema_is_in_order_of_time_whatever_the_arrival(spark, tmp_path):
    """Rows of one slice in two triggers and out of order, a missing value, a late row, and a far row that closes the slices."""
    a, b, late, far = ticks(range(0, 50, 2)), ticks(range(1, 90, 2)), ticks([10.5]), ticks([200])
    shuffled = a.sample(frac=1, random_state=1)
    shuffled.loc[shuffled["ts"] == a["ts"].iloc[7], "price"] = None
    b = b[(b["ts"] >= a["ts"].max() - pd.Timedelta(minutes=8))]
    got = ema_of(spark, str(tmp_path), [shuffled, b, ticks([91]), late, far])
    assert got["late"].sum() == 1 and got.loc[got["late"], "ts"].iloc[0] == pd.Timestamp("2024-01-01 00:10:30")
    on_time = got[~got["late"]].sort_values("ts")
    rows = pd.concat([shuffled, b, ticks([91])]).sort_values("ts")
    want = rows["price"].ewm(span=5, adjust=False, ignore_na=True).mean()
    assert len(on_time) == len(rows) and abs(on_time["ema"].to_numpy() - want.to_numpy()).max() < 1e-9


def test_quiet_symbols_start_anew(spark, tmp_path):
    a, b, far = ticks(range(0, 20)), ticks(range(200, 220)), ticks([600])
    got = ema_of(spark, str(tmp_path), [a, b, far], idle_seconds=3600).sort_values("ts")
    want = pd.concat([x["price"].ewm(span=5, adjust=False).mean() for x in (a, b)])
    assert len(got) == 40 and abs(got["ema"].to_numpy() - want.to_numpy()).max() < 1e-9


def test_late_ticks_are_counted_by_window(spark, tmp_path):
    write_files(spark, str(tmp_path), [ticks(range(0, 300, 7)), ticks([3, 4, 65, 299]), ticks([5, 301])])
    schema = spark.createDataFrame(ticks([0])).schema
    got = sm.drain(sm.late_ticks(sm.tick_stream(spark, str(tmp_path), "ticks", schema), width="1h", delay="30 minutes"), "l")
    rows = sorted((r.ts.hour, r.late, r.late_so_far) for r in got.collect())
    assert rows == [(0, 1, 4), (0, 2, 3), (1, 1, 3)]


def test_duplicates_across_batches(spark, tmp_path):
    a = ticks(range(0, 30))
    write_files(spark, str(tmp_path), [a, a.tail(10)])
    stream = sm.tick_stream(spark, str(tmp_path), "ticks", spark.createDataFrame(a).schema)
    assert sm.drain(sm.without_duplicates(stream, ["symbol", "ts"], delay="1 hour"), "d").count() == 30
