"""Bars, conditions and what follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.functions.core import KEYS, r, ts_text
from barlens.operators import conditions as cnd
from barlens.operators import forward as fwd
from barlens.plans.catalog import (
    BARS_15M, BARS_1D, BARS_1H, DIFFS, RN, SERIES_SQL, TS_SQL, W_SQL, bars_15m, bars_1d, bars_1h, ema_sql, ewm_sql,
    query, roll_sql,
)


@query("after_bullish_bar", f"""
WITH {BARS_1H},
x AS (SELECT symbol, lag(close) OVER {W_SQL} > lag(open) OVER {W_SQL} AS hit,
             lead(close, 1) OVER {W_SQL} / close - 1 AS ret FROM bars)
SELECT symbol, count(*) AS n, round(avg(ret), 6) AS mean_return,
       round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
FROM x WHERE coalesce(hit, false) AND ret IS NOT NULL GROUP BY symbol""")
def after_bullish_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and how much the next bar rises after a bullish bar, per symbol."""
    hits = fwd.spread_hits(fwd.condition_hits(bars_1h(spark, sf_dir), ["prev_candle_bullish"], [1]), [1])
    ret = F.col("ret")
    return hits.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(ret)).alias("mean_return"),
        r(F.avg(F.when(ret > 0, 1.0).otherwise(0.0))).alias("hit_rate"))


# The 65 conditions stated once more, from their definitions and not from the operator's rules:
# bodies and ranges as fractions, times by extract(), days counted from the calendar.
_UP, _DOWN = "c{k} - o{k} > 0", "o{k} - c{k} > 0"
STATED = {
    "prev_candle_bullish": _UP.format(k=1), "prev_candle_bearish": _DOWN.format(k=1),
    "prev_candle_bull_large": "c1 - o1 > greatest(atr14, 0) AND atr14 IS NOT NULL", "prev_candle_bear_large": "o1 - c1 > greatest(atr14, 0) AND atr14 IS NOT NULL",
    "prev_2_bullish": " AND ".join(_UP.format(k=k) for k in (1, 2)), "prev_2_bearish": " AND ".join(_DOWN.format(k=k) for k in (1, 2)),
    "prev_3_bullish": " AND ".join(_UP.format(k=k) for k in (1, 2, 3)), "prev_3_bearish": " AND ".join(_DOWN.format(k=k) for k in (1, 2, 3)),
    "close_near_high": "CASE WHEN high = low THEN false ELSE (close - low) / (high - low) >= 0.75 END",
    "close_near_low": "CASE WHEN high = low THEN false ELSE (close - low) / (high - low) <= 0.25 END",
    "inside_bar": "h1 > high AND l1 < low",
    "doji": "high > low AND 10 * abs(open - close) < high - low", "large_body": "high > low AND abs(open - close) / (high - low) > 0.7",
    "new_5bar_high": "close = max5", "new_5bar_low": "close = min5", "new_20bar_high": "close = max20", "new_20bar_low": "close = min20",
    "gap_up": "open > c1 + 0.1 * atr14", "gap_down": "open < c1 - 0.1 * atr14",
    **{f"above_ema{n}": f"ema{n} < close" for n in (20, 50, 200)}, **{f"below_ema{n}": f"ema{n} > close" for n in (20, 50, 200)},
    "ema20_above_ema50": "ema50 < ema20", "ema20_below_ema50": "ema50 > ema20",
    "cross_ema20_up": "NOT (close <= ema20 OR c1 > ema20_1)", "cross_ema20_dn": "NOT (close >= ema20 OR c1 < ema20_1)",
    "far_above_ema50": "close > ema50 + 1.5 * atr14", "far_below_ema50": "close < ema50 - 1.5 * atr14", "near_ema50": "abs(ema50 - close) < 0.3 * atr14",
    # hours from the definition: Asia before 7, London 7 to 12, overlap 13 to 16, New York 13 to 21, all inclusive
    "session_asian": "extract(hour FROM ts) BETWEEN 0 AND 6", "session_london": "extract(hour FROM ts) BETWEEN 7 AND 12",
    "session_overlap": "extract(hour FROM ts) BETWEEN 13 AND 16", "session_ny": "extract(hour FROM ts) BETWEEN 13 AND 21",
    "hour_10_12": "extract(hour FROM ts) BETWEEN 10 AND 11", "hour_13_15": "extract(hour FROM ts) BETWEEN 13 AND 14", "hour_18_22": "extract(hour FROM ts) BETWEEN 18 AND 21",
    **{f"weekday_{day}": f"isodow(ts) = {i}" for i, day in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday"), 1)},
    "weekday_mid": "isodow(ts) BETWEEN 2 AND 4",
    "month_end": "month(CAST(ts AS DATE) + 3) <> month(CAST(ts AS DATE))", "month_start": "extract(day FROM ts) < 4",
    "high_atr": "atr_q75 < atr14", "low_atr": "atr_q25 > atr14", "above_bb_upper": "bb_upper < close", "below_bb_lower": "bb_lower > close",
    "inside_bb": "close BETWEEN bb_lower AND bb_upper", "bb_squeeze": "bbw_q25 > bb_width", "bb_expansion": "bbw_q75 < bb_width",
    "rsi_oversold": "30 > rsi14", "rsi_overbought": "70 < rsi14",
    "rsi_mid_bull": "rsi14 BETWEEN 45 AND 55 AND rsi14 - rsi14_1 > 0", "rsi_mid_bear": "rsi14 BETWEEN 45 AND 55 AND rsi14 - rsi14_1 < 0",
    "rsi_above_50": "50 < rsi14", "rsi_below_50": "50 > rsi14", "rsi_cross_50_up": "rsi14_1 <= 50 AND 50 < rsi14", "rsi_cross_50_dn": "rsi14_1 >= 50 AND 50 > rsi14",
    "bb_lower_rsi_oversold": "bb_lower > close AND 30 > rsi14", "bb_upper_rsi_overbought": "bb_upper < close AND 70 < rsi14",
    "bb_lower_rsi_mid": "bb_lower > close AND rsi14 BETWEEN 30 AND 50",
}


def _condition_ctes(bars: str) -> str:
    q = "quantile_cont({x}, {p})"
    rolled = ",\n".join(
        f"{roll_sql(q.format(x=x, p=p), 252, 30, x)} AS {name}"
        for name, x, p in (("atr_q25", "atr14", 0.25), ("atr_q75", "atr14", 0.75),
                           ("bbw_q25", "bb_width", 0.25), ("bbw_q75", "bb_width", 0.75)))
    lags = ", ".join(
        [f"lag(close, {k}) OVER {W_SQL} AS c{k}, lag(open, {k}) OVER {W_SQL} AS o{k}" for k in (1, 2, 3)]
        + [f"lag(high) OVER {W_SQL} AS h1, lag(low) OVER {W_SQL} AS l1"])
    ext = ", ".join(f"{roll_sql(f'{f}(close)', n)} AS {f}{n}" for f in ("max", "min") for n in (5, 20))
    flags = ",\n".join(f"coalesce({rule}, false) AS {name}" for name, rule in STATED.items())
    return f"""{bars}, {RN}, {DIFFS},
e AS (SELECT *, {ema_sql('close', 20)} AS ema20, {ema_sql('close', 50)} AS ema50, {ema_sql('close', 200)} AS ema200,
  {ewm_sql('tr', '1.0/14')} AS atr14, {ewm_sql('gain', '1.0/14', 1)} AS ag, {ewm_sql('loss', '1.0/14', 1)} AS al,
  {roll_sql('avg(close)', 20)} AS mid, {roll_sql('stddev_samp(close)', 20)} AS sd FROM tr),
f AS (SELECT *, 100 - 100 / (1 + ag / nullif(al, 0)) AS rsi14, mid + 2.0 * sd AS bb_upper, mid - 2.0 * sd AS bb_lower,
  (mid + 2.0 * sd) - (mid - 2.0 * sd) AS bb_width FROM e),
g AS (SELECT *, {lags}, {ext}, lag(rsi14) OVER {W_SQL} AS rsi14_1, lag(ema20) OVER {W_SQL} AS ema20_1,
  {rolled} FROM f),
flags AS (SELECT symbol, timeframe, ts, close, {flags} FROM g)"""


_IDS = [x.condition_id for x in cnd.CONDITIONS]


def _counts_sql(bars: str) -> str:
    return f"""WITH {_condition_ctes(bars)},
long AS (UNPIVOT flags ON {', '.join(_IDS)} INTO NAME condition_id VALUE hit)
SELECT condition_id, symbol, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits, count(*) AS bars
FROM long GROUP BY condition_id, symbol"""


def _counts(bars: DataFrame) -> DataFrame:
    wide = cnd.conditions_wide(bars)
    sums = wide.groupBy("symbol").agg(*[F.count_if(i).alias(i) for i in _IDS], F.count(F.lit(1)).alias("bars"))
    return sums.unpivot(["symbol", "bars"], _IDS, "condition_id", "hits").select("condition_id", "symbol", "hits", "bars")


@query("conditions_hourly", _counts_sql(BARS_1H))
def conditions_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(bars_1h(spark, sf_dir))


@query("conditions_daily", _counts_sql(BARS_1D))
def conditions_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(bars_1d(spark, sf_dir))


@query("conditions_long", f"""WITH {_condition_ctes(BARS_1H)},
long AS (UNPIVOT flags ON {', '.join(_IDS)} INTO NAME condition_id VALUE hit)
SELECT symbol, condition_id, {TS_SQL} FROM long WHERE hit""")
def conditions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = cnd.conditions_long(bars_1h(spark, sf_dir))
    return long.where("hit").select("symbol", "condition_id", ts_text().alias("ts"))


_P_SQL = """least(1.0, 2 * exp(lgamma((n_samples) / 2.0) - lgamma((n_samples - 1) / 2.0)) / sqrt(pi()) *
  list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)
    * pow(cos(atan(abs(t) / sqrt(n_samples - 1)) + i * (atan((abs(t) + 60) / sqrt(n_samples - 1)) - atan(abs(t) / sqrt(n_samples - 1))) / 2000.0), n_samples - 2)))
  * (atan((abs(t) + 60) / sqrt(n_samples - 1)) - atan(abs(t) / sqrt(n_samples - 1))) / 2000.0 / 3)"""


def _stats_sql(bars: str, per_year: float, horizons: tuple[int, ...] = (1, 4, 12, 24)) -> str:
    leads = ", ".join(f"lead(close, {h}) OVER {W_SQL} / close - 1 AS f{h}" for h in horizons)
    union = " UNION ALL ".join(
        f"SELECT condition_id, symbol, timeframe, CAST({h} AS INTEGER) AS forward_bars, f{h} AS ret FROM long WHERE hit AND f{h} IS NOT NULL"
        for h in horizons)
    return f"""WITH {_condition_ctes(bars)},
fwd AS (SELECT *, {leads} FROM flags),
long AS (UNPIVOT fwd ON {', '.join(_IDS)} INTO NAME condition_id VALUE hit),
rets AS ({union}),
agg AS (SELECT condition_id, symbol, timeframe, forward_bars, count(*) AS n_samples, avg(ret) AS m, stddev_samp(ret) AS sd,
  quantile_cont(ret, 0.5) AS med, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate
  FROM rets GROUP BY ALL HAVING count(*) >= 30),
tt AS (SELECT *, m / (sd / sqrt(n_samples)) AS t FROM agg),
pp AS (SELECT *, {_P_SQL} AS p FROM tt)
SELECT condition_id, symbol, timeframe, forward_bars, n_samples, round(m, 7) AS mean_return, round(sd, 7) AS std_return,
  round(med, 7) AS median_return, round(hit_rate, 6) AS hit_rate, round(t, 4) AS t_stat, round(p, 5) AS p_value,
  round(m / sd * sqrt({per_year} / forward_bars), 4) AS sharpe, p < 0.05 AS is_significant FROM pp"""


def _stats(bars: DataFrame) -> DataFrame:
    s = fwd.condition_stats(bars)
    return s.select(
        "condition_id", *KEYS, "forward_bars", "n_samples",
        *[r(c, 7).alias(c) for c in ("mean_return", "std_return", "median_return")], r("hit_rate").alias("hit_rate"),
        r("t_stat", 4).alias("t_stat"), r("p_value", 5).alias("p_value"), r("sharpe", 4).alias("sharpe"), "is_significant")


@query("condition_stats_hourly", _stats_sql(BARS_1H, 6240.0))
def condition_stats_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward-return statistics of all 65 conditions at four horizons."""
    return _stats(bars_1h(spark, sf_dir))


@query("condition_stats_daily", _stats_sql(BARS_1D, 260.0))
def condition_stats_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(bars_1d(spark, sf_dir))
