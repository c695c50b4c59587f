"""The registered queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.session import table
from barlens.sources.bars import bars_from_ticks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its SQL statement, if it has one."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# --- the tables of market bars that the test tables stand for ------------------


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"),
        (F.lit(100.0) + F.col("value")).alias("price"))


def bars_1h(spark: SparkSession, sf_dir: str, width: str = "1h") -> DataFrame:
    return bars_from_ticks(
        ticks(spark, sf_dir), symbol=F.col("symbol"), ts=F.col("ts"), price=F.col("price"),
        size=F.lit(1.0), width=width)


def bars_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_1h(spark, sf_dir, "15m")


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return bars_from_ticks(
        li, symbol=F.concat("l_returnflag", "l_linestatus"), ts=F.col("l_shipdate"),
        price=F.col("l_extendedprice"), size=F.col("l_quantity"), width="1d",
        tie=[F.col(x) for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])


BARS_1H = """bars AS (
  SELECT event_type AS symbol, '1h' AS timeframe, date_trunc('hour', ts) AS ts,
         arg_min(100.0 + value, (ts, event_id)) AS open, max(100.0 + value) AS high,
         min(100.0 + value) AS low, arg_max(100.0 + value, (ts, event_id)) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY event_type, date_trunc('hour', ts))"""

BARS_15M = """bars AS (
  SELECT event_type AS symbol, '15m' AS timeframe, time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
         arg_min(100.0 + value, (ts, event_id)) AS open, max(100.0 + value) AS high,
         min(100.0 + value) AS low, arg_max(100.0 + value, (ts, event_id)) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY event_type, time_bucket(INTERVAL 15 MINUTE, ts))"""

_TIE = "(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
BARS_1D = f"""bars AS (
  SELECT l_returnflag || l_linestatus AS symbol, '1d' AS timeframe, date_trunc('day', l_shipdate) AS ts,
         arg_min(l_extendedprice, {_TIE}) AS open, max(l_extendedprice) AS high,
         min(l_extendedprice) AS low, arg_max(l_extendedprice, {_TIE}) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2, 3)"""

W_SQL = "(PARTITION BY symbol, timeframe ORDER BY ts)"
SERIES_SQL = "PARTITION BY symbol, timeframe ORDER BY ts"


def roll_sql(agg: str, n: int, min_n: int | None = None, x: str = "close") -> str:
    """Trailing aggregate over ``n`` rows, null until ``min_n`` values are there."""
    w = f"({SERIES_SQL} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} >= {min_n or n} THEN {agg} OVER {w} END"


def ewm_sql(x: str, alpha: str, first: int = 0) -> str:
    """Exponential average by one scaled running sum; ``rn`` numbers rows from 0.

    For series short enough that (1 - alpha) ** -rn stays a finite double.
    """
    k = f"(rn - {first})"
    w = f"({SERIES_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    d = f"ln(1.0 - ({alpha}))"
    return (
        f"CASE WHEN rn >= {first} THEN sum(CASE WHEN rn < {first} THEN 0 ELSE {x} * "
        f"CASE WHEN {k} = 0 THEN 1.0 ELSE ({alpha}) END * exp(-{k} * {d}) END) OVER {w} * exp({k} * {d}) END"
    )


def ema_sql(x: str, p: int) -> str:
    return ewm_sql(x, f"2.0/({p}+1)")


RN = """numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts) - 1 AS rn FROM bars)"""
DIFFS = """diffs AS (SELECT *, lag(close) OVER (PARTITION BY symbol, timeframe ORDER BY ts) AS pc FROM numbered),
tr AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss FROM diffs)"""
TS_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
