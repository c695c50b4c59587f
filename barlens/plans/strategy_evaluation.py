"""Ledger metrics, gates, sessions, folds and resampling tests as queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.functions.core import KEYS, r, ts_text
from barlens.operators import evaluation as ev
from barlens.operators import resampling as rs
from barlens.operators.permutation import PRIME, places_sql
from barlens.operators import statistics as st
from barlens.operators import sweep as sw
from barlens.plans.catalog import BARS_1D, BARS_1H, RN, TS_SQL, W_SQL, bars_1d, bars_1h, ema_sql, query, ticks
from barlens.session import materialise, table
from barlens.sources.bars import bars_from_ticks

# two ledgers: orders (years of daily trades) and events (hours of a month)
ORDERS = """trades AS (SELECT o_orderpriority AS strategy_id, o_orderstatus AS symbol, CAST(o_orderdate AS TIMESTAMP) AS entry_ts,
  CAST(o_orderdate AS TIMESTAMP) + INTERVAL 5 DAY AS exit_ts, o_orderkey AS trade_id, (o_totalprice - 250000.0) / 1000 AS pnl FROM orders)"""
EVENTS = """trades AS (SELECT event_type AS strategy_id, event_type AS symbol, ts AS entry_ts, ts + INTERVAL 1 HOUR AS exit_ts,
  event_id AS trade_id, value - 45.0 - (hour(ts) % 5) AS pnl FROM events)"""
BY = ["strategy_id"]


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    entry = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderpriority").alias("strategy_id"), F.col("o_orderstatus").alias("symbol"), entry.alias("entry_ts"),
        (entry + F.expr("INTERVAL 5 DAY")).alias("exit_ts"), F.col("o_orderkey").alias("trade_id"),
        ((F.col("o_totalprice") - 250000.0) / 1000).alias("pnl"))


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_type").alias("strategy_id"), F.col("event_type").alias("symbol"), ts.alias("entry_ts"),
        (ts + F.expr("INTERVAL 1 HOUR")).alias("exit_ts"), F.col("event_id").alias("trade_id"),
        (F.col("value") - 45.0 - F.hour(ts) % 5).alias("pnl"))


def rounded(df: DataFrame, digits: int, *plain: str) -> DataFrame:
    return df.select(*plain, *[r(c, digits).alias(c) for c in df.columns if c not in plain])


_EQUITY = """dy AS (SELECT strategy_id, CAST(exit_ts AS DATE) AS day, sum(pnl) AS pnl FROM trades GROUP BY 1, 2),
eq AS (SELECT *, 100000.0 + sum(pnl) OVER (PARTITION BY strategy_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity FROM dy),
pk AS (SELECT *, greatest(100000.0, max(equity) OVER (PARTITION BY strategy_id ORDER BY day ROWS UNBOUNDED PRECEDING)) AS peak FROM eq),
dd AS (SELECT *, equity / peak - 1 AS drawdown FROM pk)"""


@query("equity_curve", f"""WITH {ORDERS}, {_EQUITY} SELECT strategy_id, strftime(day, '%Y-%m-%d') AS day, round(equity, 6) AS equity, round(peak, 6) AS peak, round(drawdown, 7) + 0.0 AS drawdown FROM dd""")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev.daily_equity(orders_ledger(spark, sf_dir), BY)
    return e.select("strategy_id", F.date_format("day", "yyyy-MM-dd").alias("day"), r("equity", 6).alias("equity"), r("peak", 6).alias("peak"), r("drawdown", 7).alias("drawdown"))


@query("recovery_factor", f"""WITH {ORDERS}, {_EQUITY}, dr AS (SELECT strategy_id, max(peak - equity) AS worst FROM dd GROUP BY 1), n AS (SELECT strategy_id, sum(pnl) AS net FROM trades GROUP BY 1)
SELECT strategy_id, round(net, 5) + 0.0 AS net, round(worst, 5) AS worst_drawdown, round(net / nullif(worst, 0), 6) + 0.0 AS recovery_factor FROM n JOIN dr USING (strategy_id)""")
def recovery_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net profit over the largest fall of the daily equity from its peak."""
    e = ev.daily_equity(orders_ledger(spark, sf_dir), BY).groupBy("strategy_id").agg(
        F.sum("pnl").alias("net"), F.max(F.col("peak") - F.col("equity")).alias("worst_drawdown"))
    return e.select("strategy_id", r("net", 5).alias("net"), r("worst_drawdown", 5).alias("worst_drawdown"), r(st.recovery_factor(F.col("net"), F.col("worst_drawdown"))).alias("recovery_factor"))


@query("drawdown_profile", f"""WITH {ORDERS}, {_EQUITY},
sp AS (SELECT *, day - coalesce(last_value(CASE WHEN drawdown = 0 THEN day END IGNORE NULLS) OVER (PARTITION BY strategy_id ORDER BY day ROWS UNBOUNDED PRECEDING),
  first_value(day) OVER (PARTITION BY strategy_id ORDER BY day)) AS under FROM dd)
SELECT strategy_id, round(-min(drawdown), 7) AS max_drawdown, round(avg(CASE WHEN drawdown < 0 THEN 1.0 ELSE 0 END), 6) AS underwater_share,
  CAST(max(CASE WHEN drawdown < 0 THEN under ELSE 0 END) AS INTEGER) AS longest_recovery_days FROM sp GROUP BY 1""")
def drawdown_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ev.drawdown_profile(ev.daily_equity(orders_ledger(spark, sf_dir), BY), BY)
    return p.select("strategy_id", r("max_drawdown", 7).alias("max_drawdown"), r("underwater_share").alias("underwater_share"), "longest_recovery_days")


_METRICS = f"""{ORDERS}, {_EQUITY},
py AS (SELECT strategy_id, avg(c) AS per_year FROM (SELECT strategy_id, year(entry_ts) AS y, count(*) AS c FROM trades GROUP BY 1, 2) GROUP BY 1),
ag AS (SELECT strategy_id, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate, round(sum(greatest(pnl, 0)) / abs(sum(least(pnl, 0))), 3) AS profit_factor,
  avg(pnl) AS avg_pnl, stddev_samp(pnl) AS sd, sum(pnl) AS s, CAST(max(exit_ts) AS DATE) - CAST(min(entry_ts) AS DATE) AS days FROM trades GROUP BY 1),
ep AS (SELECT strategy_id, max(peak) AS equity_peak, -min(drawdown) AS max_drawdown FROM dd GROUP BY 1),
metrics AS (SELECT strategy_id, n, win_rate, profit_factor, avg_pnl, avg_pnl / sd * sqrt(greatest(per_year, 1)) AS sharpe, per_year AS signals_per_year, s / 1000 AS return_pct,
  100000 + s AS equity_final, equity_peak, max_drawdown, CASE WHEN max_drawdown > 0 THEN (CASE WHEN 100000 + s > 0 THEN pow((100000 + s) / 100000, 365.25 / days) - 1 ELSE -1 END) / max_drawdown ELSE 0 END AS calmar
  FROM ag JOIN py USING (strategy_id) JOIN ep USING (strategy_id))"""
_M = ("win_rate", "profit_factor", "avg_pnl", "sharpe", "signals_per_year", "return_pct", "equity_final", "equity_peak", "max_drawdown", "calmar")


@query("trade_metrics", f"WITH {_METRICS} SELECT strategy_id, n, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in _M)} FROM metrics")
def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.trade_metrics(orders_ledger(spark, sf_dir), BY), 5, "strategy_id", "n")


@query("quality_gates", f"""WITH {_METRICS} SELECT strategy_id, CASE WHEN n < 100 THEN 'too_few_trades' WHEN sharpe < 0.8 THEN 'low_sharpe' WHEN calmar < 0.5 THEN 'low_calmar'
  WHEN max_drawdown > 0.25 THEN 'deep_drawdown' END AS reject_reason, NOT (n < 100 OR sharpe < 0.8 OR calmar < 0.5 OR max_drawdown > 0.25) AS passed FROM metrics""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.quality_gates(ev.trade_metrics(orders_ledger(spark, sf_dir), BY)).select("strategy_id", "reject_reason", "passed")


@query("signal_count_check", f"""WITH {ORDERS}, y AS (SELECT strategy_id, year(entry_ts) AS y, count(*) AS c FROM trades GROUP BY 1, 2)
SELECT strategy_id, CAST(sum(c) AS BIGINT) AS total, min(c) AS worst_count, CAST(arg_min(y, (c, y)) AS INTEGER) AS worst_year, sum(c) >= 100 AND min(c) >= 100 AS passed FROM y GROUP BY 1""")
def signal_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.signal_count_check(orders_ledger(spark, sf_dir), BY)


@query("hourly_profile", f"""WITH {EVENTS}, s AS (SELECT DISTINCT strategy_id FROM trades)
SELECT s.strategy_id, CAST(h AS INTEGER) AS hour, count(pnl) AS n, round(coalesce(avg(pnl), 0), 9) + 0.0 AS mean, round(coalesce(avg(CASE WHEN pnl > 0 THEN 1.0 WHEN pnl IS NOT NULL THEN 0 END), 0), 6) AS win_rate
FROM s CROSS JOIN range(24) q(h) LEFT JOIN trades t ON t.strategy_id = s.strategy_id AND hour(entry_ts) = h GROUP BY 1, 2""")
def hourly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ev.hourly_profile(events_ledger(spark, sf_dir), BY)
    return p.select("strategy_id", "hour", "n", r("mean", 9).alias("mean"), r("win_rate").alias("win_rate"))


@query("dow_profile", f"""WITH {EVENTS} SELECT strategy_id, CAST(isodow(entry_ts) - 1 AS INTEGER) AS dow, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(entry_ts)] AS day_name,
  count(*) AS n, round(avg(pnl), 9) + 0.0 AS mean, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END), 5) AS win_rate FROM trades GROUP BY 1, 2, 3""")
def dow_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ev.dow_profile(events_ledger(spark, sf_dir), BY)
    return p.select("strategy_id", "dow", "day_name", "n", r("mean", 9).alias("mean"), r("win_rate", 5).alias("win_rate"))


@query("best_hours", f"""WITH {EVENTS}, h AS (SELECT strategy_id, hour(entry_ts) AS hour, avg(pnl) AS m FROM trades GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY m DESC, hour) AS rank FROM h) SELECT strategy_id, CAST(hour AS INTEGER) AS hour, rank, round(m, 9) + 0.0 AS mean FROM k WHERE rank <= 6""")
def best_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ev.best_hours(ev.hourly_profile(events_ledger(spark, sf_dir), BY), BY)
    return b.select("strategy_id", "hour", F.col("rank").cast("long"), r("mean", 9).alias("mean"))


_SESSION = f"""{EVENTS},
base AS (SELECT strategy_id, count(*) AS total, avg(pnl) / stddev_samp(pnl) * sqrt(count(*)) AS b FROM trades GROUP BY 1),
win AS (SELECT t.strategy_id, w.w, s.s, count(*) AS n, avg(pnl) / stddev_samp(pnl) * sqrt(count(*)) AS sh FROM trades t, range(4, 21) w(w), range(24) s(s)
  WHERE (hour(entry_ts) - s.s + 24) % 24 < w.w GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY round(sh, 9) DESC, w, s) AS k FROM win JOIN base USING (strategy_id)
  WHERE n >= greatest(10, total * 0.15) AND round(sh, 9) > round(b, 9)),
session AS (SELECT base.strategy_id, b AS baseline, s AS best_start, (s + w) % 24 AS best_end, coalesce(sh, b) AS sharpe, coalesce(sh, b) - b AS gain FROM base LEFT JOIN (SELECT * FROM best WHERE k = 1) x USING (strategy_id))"""


@query("best_session_window", f"""WITH {_SESSION.replace(', b AS baseline', ', base.b AS baseline').replace('coalesce(sh, b) AS sharpe, coalesce(sh, b) - b AS gain', 'coalesce(sh, base.b) AS sharpe, coalesce(sh, base.b) - base.b AS gain')}
SELECT strategy_id, round(baseline, 4) + 0.0 AS baseline_sharpe, CAST(best_start AS INTEGER) AS best_start_hour, CAST(best_end AS INTEGER) AS best_end_hour, round(sharpe, 4) + 0.0 AS best_sharpe,
  round(gain, 4) + 0.0 AS sharpe_improvement FROM session""")
def best_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ev.best_session_window(events_ledger(spark, sf_dir), BY)
    return b.select("strategy_id", "best_start_hour", "best_end_hour", *[r(c, 4).alias(c) for c in ("baseline_sharpe", "best_sharpe", "sharpe_improvement")])


@query("tightened_bounds", f"""WITH {_SESSION.replace(', b AS baseline', ', base.b AS baseline').replace('coalesce(sh, b) AS sharpe, coalesce(sh, b) - b AS gain', 'coalesce(sh, base.b) AS sharpe, coalesce(sh, base.b) - base.b AS gain')}
SELECT strategy_id, CAST(CASE WHEN gain > 0.1 THEN greatest(best_start - 3, 0) END AS INTEGER) AS start_lo, CAST(CASE WHEN gain > 0.1 THEN least(best_start + 3, best_end - 1) END AS INTEGER) AS start_hi,
  CAST(CASE WHEN gain > 0.1 THEN greatest(best_start + 1, best_end - 3) END AS INTEGER) AS end_lo, CAST(CASE WHEN gain > 0.1 THEN least(best_end + 3, 23) END AS INTEGER) AS end_hi FROM session""")
def tightened_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ev.best_session_window(events_ledger(spark, sf_dir), BY)
    bounds = sw.tighten_bounds(F.col("sharpe_improvement"), F.col("best_start_hour"), F.col("best_end_hour"))
    return b.select("strategy_id", bounds.alias("b")).select("strategy_id", "b.start_lo", "b.start_hi", "b.end_lo", "b.end_hi")


_DAILY_CAP = f"""WITH {EVENTS},
k AS (SELECT *, row_number() OVER (PARTITION BY strategy_id, CAST(entry_ts AS DATE) ORDER BY entry_ts, trade_id) AS k FROM trades),
d AS (SELECT strategy_id, round(avg(c), 1) AS a, max(c) AS m FROM (SELECT strategy_id, CAST(entry_ts AS DATE), count(*) AS c FROM trades GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT strategy_id, avg(pnl) / stddev_samp(pnl) * sqrt(count(*)) AS b FROM trades GROUP BY 1),
c AS (SELECT strategy_id, q.c AS cap, round(avg(pnl) / stddev_samp(pnl) * sqrt(count(*)), 4) AS sh FROM k, range(1, 11) q(c) WHERE k <= q.c GROUP BY 1, 2 HAVING count(*) >= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY sh DESC, cap) AS r FROM c)
SELECT strategy_id, round(b, 4) + 0.0 AS baseline_sharpe, CAST(CASE WHEN sh > b THEN cap END AS INTEGER) AS best_daily_cap, sh + 0.0 AS best_sharpe, round(sh - b, 4) + 0.0 AS sharpe_improvement, a AS avg_trades_per_day, m AS max_trades_per_day
FROM b JOIN d USING (strategy_id) LEFT JOIN (SELECT * FROM r WHERE r = 1) x USING (strategy_id)"""


@query("best_daily_cap", _DAILY_CAP)
def best_daily_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ev.best_daily_cap(events_ledger(spark, sf_dir), BY, "trade_id")
    return b.select("strategy_id", "best_daily_cap", "max_trades_per_day", *[r(c, 4).alias(c) for c in ("baseline_sharpe", "best_sharpe", "sharpe_improvement", "avg_trades_per_day")])


@query("tightened_caps", f"""SELECT strategy_id, CAST(CASE WHEN sharpe_improvement > 0.1 AND best_daily_cap IS NOT NULL THEN least(best_daily_cap + 3, 10) END AS INTEGER) AS trades_hi,
  CAST(CASE WHEN sharpe_improvement > 0.1 AND best_daily_cap IS NOT NULL THEN least(best_daily_cap + 2, 6) END AS INTEGER) AS losses_hi FROM ({_DAILY_CAP})""")
def tightened_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper search bounds of the daily limits, where a cap raises the Sharpe ratio."""
    cap, gain = F.col("best_daily_cap"), F.col("sharpe_improvement")
    return best_daily_cap(spark, sf_dir).select(
        "strategy_id", F.when(cap.isNotNull(), sw.tighten_cap(gain, cap)).cast("int").alias("trades_hi"),
        F.when(cap.isNotNull(), sw.tighten_cap(gain, cap, "losses")).cast("int").alias("losses_hi"))


@query("bar_profile", f"""WITH {BARS_1H}
SELECT symbol, count(*) AS bar_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, round(min(close), 5) AS price_min, round(max(close), 5) AS price_max,
  round(avg(close), 5) AS price_mean, round(stddev_samp(close), 4) AS price_std, round(avg(volume), 5) AS avg_volume,
  least(100.0, round(count(*) / ((CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE) + 1) * 24.0) * 100, 1)) AS completeness_pct, count(*) FILTER (WHERE hour(ts) = 12) AS at_noon FROM bars GROUP BY 1""")
def bar_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ev.bar_profile(bars_1h(spark, sf_dir))
    return p.select("symbol", "bar_count", ts_text("first_ts").alias("first_ts"), ts_text("last_ts").alias("last_ts"),
                    *[r(c, 5).alias(c) for c in ("price_min", "price_max", "price_mean", "avg_volume")], r("price_std", 4).alias("price_std"),
                    "completeness_pct", F.element_at("bars_by_hour", F.lit(12)).alias("at_noon"))


@query("coverage_by_year", f"""WITH {BARS_1D} SELECT symbol, CAST(year(ts) AS INTEGER) AS year, count(*) AS n, round(count(*) / 365.0 * 100, 1) AS pct,
  CASE WHEN count(*) / 365.0 * 100 >= 90 THEN 'green' WHEN count(*) / 365.0 * 100 >= 70 THEN 'amber' ELSE 'red' END AS light FROM bars GROUP BY 1, 2""")
def coverage_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.coverage_by_year(bars_1d(spark, sf_dir), {"1d": 365.0}).drop("timeframe")


@query("start_drift", f"""WITH {BARS_1D} SELECT symbol, CAST(CAST(min(ts) AS DATE) - DATE '1994-11-20' AS INTEGER) AS days_late, CAST(min(ts) AS DATE) - DATE '1994-11-20' > 60 AS drift_warning FROM bars GROUP BY 1""")
def start_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.start_drift(ev.bar_profile(bars_1d(spark, sf_dir)), "1994-11-20").drop("timeframe")


@query("train_oos_split", f"""WITH {BARS_1D} SELECT symbol, count(*) FILTER (WHERE ts < TIMESTAMP '2000-01-01') AS n_train, count(*) FILTER (WHERE ts >= TIMESTAMP '2000-01-01') AS n_oos,
  count(*) FILTER (WHERE ts < TIMESTAMP '2000-01-01') > 0 AND count(*) FILTER (WHERE ts >= TIMESTAMP '2000-01-01') > 0 AS usable FROM bars GROUP BY 1""")
def train_oos_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.split_check(bars_1d(spark, sf_dir), "2000-01-01").drop("timeframe")


@query("recent_window", f"""WITH {BARS_1D}, e AS (SELECT symbol, max(ts) AS e, count(*) AS n FROM bars GROUP BY 1), x AS (SELECT b.*, n FROM bars b JOIN e USING (symbol) WHERE ts >= e - INTERVAL 90 DAY),
c AS (SELECT symbol, count(*) AS k FROM x GROUP BY 1) SELECT symbol, {TS_SQL}, round(close, 4) AS close FROM x JOIN c USING (symbol) WHERE n >= 50 AND k >= 30""")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.recent_window(bars_1d(spark, sf_dir)).select("symbol", ts_text().alias("ts"), r("close", 4).alias("close"))


@query("session_filter", f"""WITH {BARS_1H} SELECT symbol, {TS_SQL}, round(close, 6) AS close FROM bars WHERE hour(ts) >= 7 AND hour(ts) < 17""")
def session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_1h(spark, sf_dir).where((F.hour("ts") >= 7) & (F.hour("ts") < 17)).select("symbol", ts_text().alias("ts"), r("close").alias("close"))


# three timeframes of every event type and of all events together: long series have folds, short ones are marked
_WIDTHS = {"1m": "1 MINUTE", "5m": "5 MINUTE", "1h": "1 HOUR"}
_MANY = "bars AS (" + " UNION ALL ".join(f"""SELECT symbol, '{tf}' AS timeframe, time_bucket(INTERVAL {w}, ts) AS ts, arg_min(100.0 + value, (ts, event_id)) AS open, max(100.0 + value) AS high,
  min(100.0 + value) AS low, arg_max(100.0 + value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM (SELECT event_type AS symbol, * FROM events UNION ALL SELECT 'ALL' AS symbol, * FROM events) GROUP BY 1, 3""" for tf, w in _WIDTHS.items()) + ")"


def _many_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    both = t.union(t.withColumn("symbol", F.lit("ALL")))
    parts = [bars_from_ticks(both, symbol=F.col("symbol"), ts=F.col("ts"), price=F.col("price"), size=F.lit(1.0), width=w, tie=[F.col("event_id")]) for w in _WIDTHS]
    return materialise(parts[0].union(parts[1]).union(parts[2]), "bars")


_FOLDS = f"""{_MANY}, {RN}, c AS (SELECT *, count(*) OVER (PARTITION BY symbol, timeframe) // 6 AS size FROM numbered),
folds AS (SELECT c.*, f AS fold, CASE WHEN rn < (f + 1) * size THEN 'train' ELSE 'test' END AS split FROM c, range(5) q(f) WHERE rn < (f + 2) * size AND size >= 500),
short AS (SELECT symbol, timeframe, count(*) AS bars, min(ts) AS a, max(ts) AS b FROM c WHERE size < 500 GROUP BY 1, 2),
ranges AS (SELECT symbol, timeframe, fold, split, count(*) AS bars, min(ts) AS a, max(ts) AS b FROM folds GROUP BY 1, 2, 3, 4)"""


@query("expanding_folds", f"""WITH {_FOLDS} SELECT symbol, timeframe, CAST(fold AS INTEGER) AS fold, split, bars, strftime(a, '%Y-%m-%d %H:%M') AS from_time, strftime(b, '%Y-%m-%d %H:%M') AS to_time, NULL AS reject_reason FROM ranges
UNION ALL SELECT symbol, timeframe, NULL, NULL, bars, strftime(a, '%Y-%m-%d %H:%M'), strftime(b, '%Y-%m-%d %H:%M'), 'short_folds' FROM short""")
def expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ev.fold_ranges(ev.expanding_folds(_many_bars(spark, sf_dir)))
    return f.select(*KEYS, "fold", "split", "bars", F.date_format("from_ts", "yyyy-MM-dd HH:mm").alias("from_time"), F.date_format("to_ts", "yyyy-MM-dd HH:mm").alias("to_time"), "reject_reason")


@query("purged_folds", f"""WITH {_FOLDS}, t AS (SELECT symbol, timeframe, fold, min(rn) AS a, max(rn) AS b FROM folds WHERE split = 'test' GROUP BY 1, 2, 3)
SELECT symbol, timeframe, CAST(fold AS INTEGER) AS fold, split, count(*) AS n, CAST(max(rn) AS BIGINT) AS last_row FROM folds JOIN t USING (symbol, timeframe, fold) WHERE split = 'test' OR NOT (rn + 10 >= a AND rn <= b + 5) GROUP BY 1, 2, 3, 4
UNION ALL SELECT symbol, timeframe, NULL, NULL, bars, bars - 1 FROM short""")
def purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ev.purged_folds(ev.expanding_folds(_many_bars(spark, sf_dir)), 10, 5)
    return p.groupBy(*KEYS, "fold", "split").agg(F.count(F.lit(1)).alias("n"), F.max("rn").alias("last_row"))


# walk-forward over holding rules of three momentum lengths as a parameter grid
_TRADES = f"""trades AS (SELECT symbol, timeframe, p AS variant, ts AS entry_ts, lead(close, 5) OVER {W_SQL.replace('timeframe', 'timeframe, p', 1)} - close AS pnl, close - lag(close, p) OVER {W_SQL.replace('timeframe', 'timeframe, p', 1)} AS mom
  FROM bars, (VALUES (5), (10), (20)) q(p)),
picked AS (SELECT * FROM trades WHERE mom > 0 AND pnl IS NOT NULL)"""
_WF = f"""{_FOLDS}, {_TRADES},
yearly AS (SELECT t.symbol, t.timeframe, variant, fold, split, year(entry_ts) AS y, count(*) AS c, sum(pnl) AS s, sum(pnl * pnl) AS ss FROM picked t JOIN ranges r ON t.symbol = r.symbol AND t.timeframe = r.timeframe AND entry_ts BETWEEN a AND b GROUP BY ALL),
m AS (SELECT symbol, timeframe, variant, fold, split, sum(c) AS n, coalesce(sum(s) / sum(c) / nullif(sqrt(greatest((sum(ss) - sum(s) * sum(s) / sum(c)) / nullif(sum(c) - 1, 0), 0)), 0), 0) AS ratio, sqrt(greatest(avg(c), 1)) AS annual FROM yearly GROUP BY 1, 2, 3, 4, 5),
w AS (SELECT symbol, timeframe, variant, fold, max(ratio * annual) FILTER (WHERE split = 'train') AS is_sharpe, coalesce(max(ratio * annual) FILTER (WHERE split = 'test'), 0) AS oos_sharpe,
  max(ratio * sqrt(n)) FILTER (WHERE split = 'train') AS is_trade_sharpe, coalesce(max(ratio * sqrt(n)) FILTER (WHERE split = 'test'), 0) AS oos_trade_sharpe, coalesce(max(n) FILTER (WHERE split = 'test'), 0) AS oos_trades FROM m GROUP BY 1, 2, 3, 4),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe, fold ORDER BY round(is_sharpe, 9) DESC, variant) AS k FROM w WHERE is_sharpe IS NOT NULL) WHERE k = 1),
fm AS (SELECT r.symbol, r.timeframe, r.fold, variant, coalesce(is_sharpe, 0) AS is_sharpe, coalesce(oos_sharpe, 0) AS oos_sharpe, coalesce(is_trade_sharpe, 0) AS is_trade_sharpe, coalesce(oos_trade_sharpe, 0) AS oos_trade_sharpe, coalesce(oos_trades, 0) AS oos_trades, NULL AS reject_reason
  FROM (SELECT DISTINCT symbol, timeframe, fold FROM ranges) r LEFT JOIN best b ON b.symbol = r.symbol AND b.timeframe = r.timeframe AND b.fold = r.fold
  UNION ALL SELECT symbol, timeframe, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'short_folds' FROM short)"""


def _momentum_trades(bars: DataFrame) -> DataFrame:
    from barlens.operators.blocks import compute, lag_sql, sql_columns
    moves = compute(bars, [
        sql_columns([], {"pnl": "lead(close, 5) OVER (PARTITION BY symbol, timeframe, _blk ORDER BY ts) - close"}, after=5),
        sql_columns([], {f"mom{p}": f"close - {lag_sql('close', p)}" for p in (5, 10, 20)}, before=20)])
    return moves.select(*KEYS, F.col("ts").alias("entry_ts"), "pnl", F.explode(F.array(*[
        F.struct(F.lit(p).alias("variant"), F.col(f"mom{p}").alias("mom")) for p in (5, 10, 20)])).alias("v")).select(
            *KEYS, "entry_ts", "pnl", "v.*").where("mom > 0 AND pnl IS NOT NULL")


def _wf(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _many_bars(spark, sf_dir)
    ranges = materialise(ev.fold_ranges(ev.expanding_folds(bars)), "folds")
    return ev.fold_metrics(_momentum_trades(bars), ranges, "variant")


_FM = ("is_sharpe", "oos_sharpe", "is_trade_sharpe", "oos_trade_sharpe")


@query("fold_metrics", f"WITH {_WF} SELECT symbol, timeframe, variant, CAST(fold AS INTEGER) AS fold, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in _FM)}, oos_trades, reject_reason FROM fm")
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wf(spark, sf_dir).select(*KEYS, "variant", "fold", *[r(c, 5).alias(c) for c in _FM], "oos_trades", "reject_reason")


@query("walk_forward_summary", f"""WITH {_WF}, a AS (SELECT symbol, timeframe, count(oos_sharpe) AS n_folds, avg(oos_sharpe) AS mo, stddev_pop(oos_sharpe) AS so, min(oos_sharpe) AS mi, avg(is_sharpe) AS ms, count(*) FILTER (WHERE oos_sharpe < 0) AS ng, max(reject_reason) AS given FROM fm GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN mo IS NULL THEN NULL WHEN mo > 0 THEN ms / mo WHEN ms > 0 THEN 10.0 ELSE 1.0 END AS ratio FROM a)
SELECT symbol, timeframe, n_folds, round(mo, 5) + 0.0 AS mean_oos, round(so, 5) AS std_oos, round(mi, 5) + 0.0 AS min_oos, round(ratio, 5) AS overfitting_ratio, ratio > 2.5 AS overfitting_flag,
  coalesce(given, CASE WHEN mo < 0.6 THEN 'low_oos_sharpe' WHEN ng > n_folds // 2 THEN 'negative_folds' WHEN ratio > 2.5 THEN 'overfitted' END) AS reject_reason FROM b""")
def walk_forward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ev.wf_summary(_wf(spark, sf_dir), list(KEYS))
    return s.select(*KEYS, "n_folds", *[r(c, 5).alias(c) for c in ("mean_oos", "std_oos", "min_oos", "overfitting_ratio")], "overfitting_flag", "reject_reason")


@query("robust_params", f"""WITH {_WF}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY round(oos_sharpe, 9), fold) AS r, count(*) OVER (PARTITION BY symbol, timeframe) AS n FROM fm)
SELECT symbol, timeframe, variant, CAST(fold AS INTEGER) AS fold, round(oos_sharpe, 5) + 0.0 AS oos_sharpe, oos_sharpe >= greatest(0.6, 0.5 * is_sharpe) AS holds_up, reject_reason FROM k WHERE r = (n - 1) // 2 + 1""")
def robust_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ev.robust_params(_wf(spark, sf_dir), list(KEYS))
    return p.select(*KEYS, "variant", "fold", r("oos_sharpe", 5).alias("oos_sharpe"), ev.oos_degradation_gate(F.col("oos_sharpe"), F.col("is_sharpe")).alias("holds_up"), "reject_reason")


@query("recent_gate", f"""WITH {BARS_1D}, {_TRADES}, e AS (SELECT symbol, timeframe, max(ts) AS e, count(*) AS n_all FROM bars GROUP BY 1, 2),
q AS (SELECT e.*, (SELECT count(*) FROM bars b WHERE b.symbol = e.symbol AND b.ts >= e.e - INTERVAL 90 DAY) AS n_recent FROM e),
g AS (SELECT q.symbol, variant, n_all >= 50 AND n_recent >= 30 AS judged, count(*) FILTER (WHERE entry_ts >= e - INTERVAL 90 DAY) AS n, avg(pnl) FILTER (WHERE entry_ts >= e - INTERVAL 90 DAY) AS m,
  stddev_samp(pnl) FILTER (WHERE entry_ts >= e - INTERVAL 90 DAY) AS sd FROM picked JOIN q ON picked.symbol = q.symbol GROUP BY 1, 2, 3)
SELECT symbol, variant, judged, n, CASE WHEN n > 0 THEN round(coalesce(m / nullif(sd, 0) * sqrt(n), 0), 5) + 0.0 END AS recent_sharpe, NOT coalesce(judged AND n >= 3 AND m / nullif(sd, 0) * sqrt(n) < -0.3, false) AS passed FROM g""")
def recent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = materialise(bars_1d(spark, sf_dir), "bars")
    g = ev.recent_gate(_momentum_trades(bars), bars, [*KEYS, "variant"])
    return g.select("symbol", "variant", "judged", "n", r("recent_sharpe", 5).alias("recent_sharpe"), "passed")


_SYMTF = """g AS (SELECT o_orderpriority AS strategy_id, o_orderstatus AS symbol, CASE o_orderkey % 3 WHEN 0 THEN '1h' WHEN 1 THEN '4h' ELSE '1d' END AS timeframe, (o_totalprice - 250000.0) / 1000 AS pnl FROM orders),
mt AS (SELECT strategy_id, symbol, timeframe, count(*) AS trades, round(avg(pnl) / stddev_samp(pnl) * sqrt(count(*)), 6) AS sharpe FROM g GROUP BY 1, 2, 3)"""


def _symtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = F.expr("CASE trade_id % 3 WHEN 0 THEN '1h' WHEN 1 THEN '4h' ELSE '1d' END")
    m = ev._moments(orders_ledger(spark, sf_dir).withColumn("timeframe", tf), ["strategy_id", *KEYS])
    return m.select("strategy_id", *KEYS, F.col("n").alias("trades"), r(ev._sharpe()).alias("sharpe"))


@query("best_symbol_timeframe", f"""WITH {_SYMTF}, k AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY CASE WHEN trades >= 10 THEN 0 ELSE 1 END, CASE WHEN trades >= 10 THEN sharpe END DESC NULLS LAST, trades DESC, symbol, timeframe) AS r,
  sum(trades) OVER (PARTITION BY strategy_id) AS tt, max(CASE WHEN sharpe IS NULL AND trades = 0 THEN 0.0 ELSE sharpe END) OVER (PARTITION BY strategy_id) AS best FROM mt)
SELECT strategy_id, symbol, timeframe, trades, sharpe + 0.0 AS sharpe, CASE WHEN tt = 0 THEN 'zero_trades' WHEN best < -1.0 THEN 'unprofitable' END AS reject_reason FROM k WHERE r = 1""")
def best_symbol_timeframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sw.best_symbol_timeframe(_symtf(spark, sf_dir), by=BY)


@query("viable_timeframes", f"""WITH {_SYMTF}, k AS (SELECT *, row_number() OVER (PARTITION BY strategy_id, symbol ORDER BY trades DESC, timeframe) AS rank FROM mt WHERE trades > 0)
SELECT strategy_id, symbol, timeframe, trades, rank FROM k WHERE rank <= 3""")
def viable_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sw.viable_timeframes(_symtf(spark, sf_dir), by=["strategy_id", "symbol"], top=3)
    return v.select("strategy_id", "symbol", "timeframe", "trades", F.col("rank").cast("long"))


# --- resampling -----------------------------------------------------------------


def _frac(*parts: str) -> str:
    """Draw of replicate ``rep`` from the md5 of the parts: two numbers that move from replicate to replicate, multiplied."""
    digest = f"md5(concat_ws(':', {', '.join(parts)}))"
    h = [f"(CAST('0x' || substr({digest}, {at}, 7) AS BIGINT) % {PRIME} + rep * {step} % {PRIME}) % {PRIME}" for at, step in zip((1, 8), rs.DRAW_STEPS)]
    return f"(({h[0]}) * ({h[1]})) % {PRIME} / {PRIME}.0"


_SHARPE = "({s} / {n}) / greatest(sqrt(greatest(({ss} - {s} * {s} / {n}) / ({n} - 1), 0)), 1e-10) * sqrt({n})"
_ACT = f"act AS (SELECT strategy_id, count(*) AS n, {_SHARPE.format(n='count(*)', s='sum(pnl)', ss='sum(pnl * pnl)')} AS actual FROM trades GROUP BY 1)"
REPS = 1000
_TEST = """SELECT strategy_id, any_value(n) AS n, round(any_value(actual), 5) + 0.0 AS actual, round(avg(stat), 5) + 0.0 AS null_mean, round(stddev_pop(stat), 5) + 0.0 AS null_std, round(quantile_cont(stat, 0.95), 5) + 0.0 AS null_p95,
  round(avg(CASE WHEN stat >= actual - 1e-9 THEN 1.0 ELSE 0 END), 6) AS p_value, round(CASE WHEN stddev_pop(stat) > 1e-9 THEN (any_value(actual) - avg(stat)) / stddev_pop(stat) ELSE 0 END, 4) + 0.0 AS z FROM reps JOIN act USING (strategy_id) GROUP BY 1"""


def _test_out(t: DataFrame) -> DataFrame:
    return t.select("strategy_id", "n", *[r(c, 5).alias(c) for c in ("actual", "null_mean", "null_std", "null_p95")], r("p_value").alias("p_value"), r("z", 4).alias("z"))


@query("sign_flip_test", f"""WITH {ORDERS}, {_ACT}, f AS (SELECT strategy_id, rep, pnl * CASE WHEN (CAST('0x' || substr(md5(concat_ws(':', '42', (rep - 1) // 60, trade_id)), 1, 15) AS BIGINT) >> CAST((rep - 1) % 60 AS INTEGER)) & 1 = 1 THEN -1 ELSE 1 END AS x FROM trades, range(1, 1001) q(rep)),
reps AS (SELECT strategy_id, rep, {_SHARPE.format(n='count(*)', s='sum(x)', ss='sum(x * x)')} AS stat FROM f GROUP BY 1, 2) {_TEST}""")
def sign_flip_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _test_out(rs.sign_flip_test(orders_ledger(spark, sf_dir), BY, ["trade_id"], 1000))


@query("order_invariant_check", f"""WITH {ORDERS}, {_ACT}, reps AS (SELECT strategy_id, rep, {_SHARPE.format(n='count(*)', s='sum(pnl)', ss='sum(pnl * pnl)')} AS stat FROM trades, range(1, {REPS + 1}) q(rep) GROUP BY 1, 2) {_TEST}""")
def order_invariant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _test_out(rs.order_invariant_check(orders_ledger(spark, sf_dir), BY, REPS))


def _poisson(u: str) -> str:
    """Smallest k whose Poisson(1) distribution function exceeds u: exp(-1) times the sum of the first inverse factorials."""
    steps, total, inverse = [], 0.0, math.exp(-1)
    for k in range(13):
        inverse = inverse / max(k, 1)
        total += inverse
        steps.append(f"WHEN {u} < {total!r} THEN {k}.0")
    return f"CASE {' '.join(steps)} ELSE 13.0 END"


_CI = """SELECT strategy_id, count(stat) AS replicates, round(avg(stat), 5) + 0.0 AS boot_mean, round(stddev_samp(stat), 5) AS boot_std, round(quantile_cont(stat, 0.025), 5) + 0.0 AS ci_low,
  round(quantile_cont(stat, 0.975), 5) + 0.0 AS ci_high, round(avg(CASE WHEN stat <= 0 THEN 1.0 ELSE 0 END), 6) AS p_value FROM reps GROUP BY 1"""


def _ci_out(c: DataFrame) -> DataFrame:
    return c.select("strategy_id", "replicates", *[r(x, 5).alias(x) for x in ("boot_mean", "boot_std", "ci_low", "ci_high")], r("p_value").alias("p_value"))


@query("bootstrap_ci", f"""WITH {ORDERS}, u AS (SELECT strategy_id, pnl, rep, {_frac("'42'", 'trade_id')} AS u FROM trades, range(1, {REPS + 1}) q(rep)), w AS (SELECT *, {_poisson('u')} AS w FROM u),
reps AS (SELECT strategy_id, rep, {_SHARPE.format(n='sum(w)', s='sum(w * pnl)', ss='sum(w * pnl * pnl)')} AS stat FROM w WHERE w > 0 GROUP BY 1, 2 HAVING sum(w) > 1) {_CI}""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ci_out(rs.bootstrap_ci(orders_ledger(spark, sf_dir), BY, ["trade_id"], REPS))


@query("block_bootstrap", f"""WITH {ORDERS}, nr AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY entry_ts, trade_id) - 1 AS rn, count(*) OVER (PARTITION BY strategy_id) AS nn FROM trades),
b AS (SELECT strategy_id, CASE WHEN nn >= 60 THEN rn // 20 ELSE rn END AS blk, count(*) AS c, sum(pnl) AS s, sum(pnl * pnl) AS ss FROM nr GROUP BY 1, 2),
u AS (SELECT b.*, rep, {_frac("'42'", 'strategy_id', 'blk')} AS u FROM b, range(1, {REPS + 1}) q(rep)), w AS (SELECT *, {_poisson('u')} AS w FROM u),
reps AS (SELECT strategy_id, rep, {_SHARPE.format(n='sum(w * c)', s='sum(w * s)', ss='sum(w * ss)')} AS stat FROM w WHERE w > 0 GROUP BY 1, 2 HAVING sum(w * c) > 1) {_CI}""")
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ci_out(rs.block_bootstrap(orders_ledger(spark, sf_dir), BY, ["entry_ts", "trade_id"], 20, REPS))


PERMS = 300


def _permuted_sql(bars: str, n: int) -> str:
    def places(tag: str, source: str, x: str, size: str) -> str:
        return places_sql(source, x, size, "perm_id", f"'42', '{tag}', symbol, timeframe", "perm_id, symbol, timeframe, rn")
    return f"""{bars}, {RN},
mv AS (SELECT symbol, timeframe, ts, rn, count(*) OVER (PARTITION BY symbol, timeframe) AS n, volume, ln(open) AS lo, ln(high) - ln(open) AS dh, ln(low) - ln(open) AS dl, ln(close) - ln(open) AS dc, ln(open) - ln(lag(close) OVER {W_SQL}) AS gap FROM numbered),
cp AS (SELECT mv.*, perm_id FROM mv, range(1, {n + 1}) q(perm_id)),
sh AS (SELECT perm_id, symbol, dh, dl, dc, y AS pos FROM {places('shape', 'cp', 'rn', 'n')} JOIN mv USING (symbol, timeframe, rn)),
gp AS (SELECT perm_id, symbol, gap, y + 1 AS pos FROM {places('gap', '(SELECT * FROM cp WHERE rn > 0)', '(rn - 1)', '(n - 1)')} JOIN mv USING (symbol, timeframe, rn)),
jn AS (SELECT cp.perm_id, cp.symbol, cp.timeframe, cp.ts, cp.rn, cp.volume, sh.dh, sh.dl, sh.dc, coalesce(CASE WHEN cp.rn = 0 THEN cp.lo END, 0) + coalesce(gp.gap, 0) + coalesce(p.dc, 0) AS step
  FROM cp JOIN sh ON sh.perm_id = cp.perm_id AND sh.symbol = cp.symbol AND sh.pos = cp.rn LEFT JOIN gp ON gp.perm_id = cp.perm_id AND gp.symbol = cp.symbol AND gp.pos = cp.rn
  LEFT JOIN sh p ON p.perm_id = cp.perm_id AND p.symbol = cp.symbol AND p.pos = cp.rn - 1),
lv AS (SELECT *, sum(step) OVER (PARTITION BY perm_id, symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS nlo FROM jn),
pb AS (SELECT perm_id, symbol, timeframe, ts, exp(nlo) AS open, exp(nlo + dh) AS high, exp(nlo + dl) AS low, exp(nlo + dc) AS close, volume FROM lv)"""


@query("bar_permute", f"""WITH {_permuted_sql(BARS_1H, PERMS)} SELECT CAST(perm_id AS INTEGER) AS perm_id, symbol, count(*) AS n, round(avg(ln(open)), 7) + 0.0 AS mean_open, round(avg(ln(high)), 7) + 0.0 AS mean_high,
  round(min(ln(low)), 7) + 0.0 AS lowest, round(arg_max(ln(close), ts), 7) + 0.0 AS last_close, round(regr_slope(ln(close), volume), 6) + 0.0 AS on_volume FROM pb GROUP BY 1, 2""")
def bar_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of 300 permuted copies of every series."""
    p = rs.bar_permute(bars_1h(spark, sf_dir), PERMS)
    log = {c: F.ln(c) for c in ("open", "high", "low", "close")}
    return p.groupBy("perm_id", "symbol").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(log["open"]), 7).alias("mean_open"), r(F.avg(log["high"]), 7).alias("mean_high"), r(F.min(log["low"]), 7).alias("lowest"),
        r(F.max_by(log["close"], "ts"), 7).alias("last_close"), r(F.regr_slope(log["close"], F.col("volume")), 6).alias("on_volume"))


@query("bar_permute_rows", f"WITH {_permuted_sql(BARS_1H, 3)} SELECT CAST(perm_id AS INTEGER) AS perm_id, symbol, {TS_SQL}, round(ln(open), 7) + 0.0 AS log_open, round(ln(high), 7) + 0.0 AS log_high, round(ln(low), 7) + 0.0 AS log_low, round(ln(close), 7) + 0.0 AS log_close FROM pb")
def bar_permute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars themselves of three copies."""
    p = rs.bar_permute(bars_1h(spark, sf_dir), 3)
    return p.select("perm_id", "symbol", ts_text().alias("ts"), *[r(F.ln(c), 7).alias(f"log_{c}") for c in ("open", "high", "low", "close")])


def _pf_sql(src: str, by: str) -> str:
    part = f"(PARTITION BY {by} ORDER BY ts)"
    e = {p: ema_sql("close", p).replace("PARTITION BY symbol, timeframe", f"PARTITION BY {by}") for p in (5, 20)}
    return f"""(SELECT {by}, CASE WHEN count(*) >= 10 THEN sum(greatest(ret, 0)) / nullif(abs(sum(least(ret, 0))), 0) END AS pf FROM
  (SELECT *, fwd * CASE WHEN ef > es AND lag(ef) OVER {part} <= lag(es) OVER {part} THEN 1 WHEN ef < es AND lag(ef) OVER {part} >= lag(es) OVER {part} THEN -1 ELSE 0 END AS ret,
     CASE WHEN ef > es AND lag(ef) OVER {part} <= lag(es) OVER {part} THEN 1 WHEN ef < es AND lag(ef) OVER {part} >= lag(es) OVER {part} THEN -1 ELSE 0 END AS signal FROM
   (SELECT *, {e[5]} AS ef, {e[20]} AS es, ln(lead(close, 5) OVER {part} / close) AS fwd FROM (SELECT *, row_number() OVER {part} - 1 AS rn FROM {src})))
  WHERE signal <> 0 AND fwd IS NOT NULL GROUP BY {by})"""


@query("permutation_pvalue", f"""WITH {_permuted_sql(BARS_1H, PERMS)}, re AS {_pf_sql('bars', 'symbol')}, pe AS {_pf_sql('pb', 'symbol, perm_id')}
SELECT re.symbol, round(any_value(re.pf), 5) AS real_pf, count(pe.pf) AS n_valid, count(*) FILTER (WHERE pe.pf >= re.pf) AS n_better,
  round((count(*) FILTER (WHERE pe.pf >= re.pf) + 1) * 1.0 / (count(pe.pf) + 1), 4) AS p_value FROM re LEFT JOIN pe ON pe.symbol = re.symbol AND pe.pf IS NOT NULL GROUP BY 1""")
def permutation_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often 300 permutations of the bars give an EMA cross at least the profit factor of the real bars."""
    bars = materialise(bars_1h(spark, sf_dir), "bars")
    p = rs.mcpt_pvalue(rs.cross_profit_factor(bars, ["symbol"], 5, 20), rs.permuted_cross_profit_factor(bars, ["symbol"], 5, 20, n=PERMS), ["symbol"])
    return p.select("symbol", r("real_pf", 5).alias("real_pf"), "n_valid", "n_better", "p_value")
