"""Streams run over the events file, compared with batch SQL on the windows that are closed."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.functions.core import r, ts_text
from barlens.plans.catalog import BARS_1H, TS_SQL, ema_sql, query
from barlens.session import scratch_dir, table
from barlens.streaming import streams as sm

# a window is closed, and comes out, when the watermark of one hour has passed its end
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return sm.tick_stream(spark, sf_dir, "events", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_candles", f"WITH {BARS_1H} SELECT symbol, {TS_SQL}, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars WHERE ts + INTERVAL 1 HOUR <= {_CLOSED}")
def stream_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _stream(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts", (F.col("value") + 100.0).alias("price"), F.lit(1.0).alias("size"), "event_id")
    bars = sm.drain(sm.candles(ticks, width="1h", delay="1 hour", tie="event_id"), "candles")
    return bars.select("symbol", ts_text().alias("ts"), *[r(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


# a slice of six hours is closed, and its rows come out in order, when the watermark has passed its end
@query("stream_ema", f"""WITH e AS (SELECT event_type AS symbol, '' AS timeframe, event_id, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) - 1 AS rn FROM events),
a AS (SELECT symbol, ts, {ema_sql('value', 50)} AS ema FROM e)
SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, round(ema, 5) AS ema FROM a WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= {_CLOSED}""")
def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _stream(spark, sf_dir).select(F.col("event_type").alias("symbol"), "ts", "value")
    out = sm.drain(sm.stream_ema(values, n=50, delay="1 hour", slice_seconds=21600), "ema")
    return out.where("NOT late").select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), r("ema", 5).alias("ema"))


@query("stream_late_ticks", f"""WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events WHERE event_id % 10 <> 0),
l AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, count(*) AS late FROM events, m WHERE event_id % 10 = 0 AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2)
SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, late, CAST(sum(late) OVER (PARTITION BY symbol) AS BIGINT) AS late_so_far FROM l""")
def stream_late_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the events arrives after the others: what the closed candles have missed, by window."""
    folder = os.path.join(scratch_dir(spark), f"late-{uuid.uuid4().hex}")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp"), "event_id")
    for arrival in ("event_id % 10 <> 0", "event_id % 10 = 0"):
        events.where(arrival).write.mode("append").parquet(f"{folder}/ticks")
        late = sm.drain(sm.late_ticks(spark.readStream.schema(events.schema).parquet(f"{folder}/ticks"), width="1h", delay="1 hour"),
                        "late", folder=f"{folder}/late")
    return late.select("symbol", ts_text().alias("ts"), "late", "late_so_far")


@query("stream_budget", f"""WITH d AS (SELECT date_trunc('day', ts) AS day, sum(value / 100) AS spent FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, round(spent, 5) AS spent, round(greatest(0, 160.0 - spent), 5) AS remaining, spent >= 160 AS over_cap FROM d WHERE day + INTERVAL 1 DAY <= {_CLOSED}""")
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = _stream(spark, sf_dir).select("ts", (F.col("value") / 100).alias("cost_usd"))
    days = sm.drain(sm.budget_alerts(costs, cap=160.0, delay="1 hour"), "budget")
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), r("spent", 5).alias("spent"), r("remaining", 5).alias("remaining"), "over_cap")


@query("stream_sliding_load", f"""WITH w AS (SELECT e.*, make_timestamp(CAST((epoch_us(ts) // 2000000 - k) * 2000000 AS BIGINT)) AS f FROM events e, range(0, 30) q(k)),
s AS (SELECT f, sum(value) AS total FROM w WHERE f > ts - INTERVAL 60 SECOND GROUP BY 1)
SELECT strftime(f, '%Y-%m-%d %H:%M:%S') AS from_ts, round(total, 5) AS total FROM s WHERE total > 400 AND f + INTERVAL 60 SECOND <= {_CLOSED}""")
def stream_sliding_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = _stream(spark, sf_dir).select("ts", "value")
    s = sm.drain(sm.sliding_load(costs, column="value", limit=400.0, delay="1 hour"), "sliding")
    return s.select(ts_text("from_ts").alias("from_ts"), r("total", 5).alias("total"))


@query("stream_dedupe", "SELECT event_type AS symbol, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event sent three times, let through once."""
    thrice = _stream(spark, sf_dir).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    once = sm.drain(sm.without_duplicates(thrice.select("event_id", "event_type", "ts"), ["event_type", "event_id"], delay="1 hour"), "dedupe")
    return once.groupBy(F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("stream_stale", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g), a AS (SELECT user_id, min(ts) AS f, max(ts) + INTERVAL 6 HOUR AS t, count(*) AS beats FROM s GROUP BY user_id, id)
SELECT user_id, strftime(f, '%Y-%m-%d %H:%M:%S') AS active_from, strftime(t, '%Y-%m-%d %H:%M:%S') AS stale_from, beats FROM a WHERE t <= {_CLOSED}""")
def stream_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = _stream(spark, sf_dir).select("user_id", "ts")
    s = sm.drain(sm.activity_sessions(beats, key="user_id", gap="6 hours", delay="1 hour"), "stale")
    return s.select("user_id", ts_text("active_from").alias("active_from"), ts_text("stale_from").alias("stale_from"), "beats")


@query("stream_upsert", "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of every user, merged batch by batch."""
    path = os.path.join(scratch_dir(spark), f"latest-{uuid.uuid4().hex}")
    rows = _stream(spark, sf_dir).select("user_id", "value", "event_id", (F.col("user_id") % 8).cast("int").alias("bucket"))
    sm.upsert_stream(rows, path, keys=["user_id", "bucket"], version="event_id", partition=["bucket"])()
    return spark.read.schema(rows.schema).parquet(path).drop("bucket")
