"""Sources and indicator columns as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.functions.core import KEYS, r, ts_text
from barlens.operators import indicators as ind
from barlens.operators import sequential as seq
from barlens.operators.blocks import compute
from barlens.operators.recurrence import ewm, span_alpha, wilder_alpha
from barlens.plans.catalog import (
    BARS_15M, BARS_1D, BARS_1H, DIFFS, RN, TS_SQL, W_SQL, bars_15m, bars_1d, bars_1h, ema_sql, ewm_sql, query,
    roll_sql, ticks,
)
from barlens.session import table
from barlens.sources import bars as src


def out(df: DataFrame, **digits: int) -> DataFrame:
    """Symbol, time as text and the named columns rounded."""
    return df.select("symbol", ts_text().alias("ts"), *[r(n, d).alias(n) for n, d in digits.items()])


def sel(ctes: str, frm: str, **digits: int) -> str:
    """The SQL twin of ``out``: ``name=digits`` or ``name=(expression, digits)``."""
    cols = ", ".join(
        f"round({d[0]}, {d[1]}) + 0.0 AS {n}" if isinstance(d, tuple) else f"round({n}, {d}) + 0.0 AS {n}"
        for n, d in digits.items())
    return f"WITH {ctes} SELECT symbol, {TS_SQL}, {cols} FROM {frm}"


_BAR = dict(open=6, high=6, low=6, close=6, volume=6)


@query("bars_hourly", sel(BARS_1H, "bars", **_BAR))
def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(bars_1h(spark, sf_dir), **_BAR)


@query("bars_quarter_hour", sel(BARS_15M, "bars", **_BAR))
def bars_quarter_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(bars_15m(spark, sf_dir), **_BAR)


@query("bars_daily", sel(BARS_1D, "bars", **_BAR))
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(bars_1d(spark, sf_dir), **_BAR)


@query("bars_resampled", sel(BARS_1H + """,
four AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)""", "four", **_BAR))
def bars_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(src.resample_bars(bars_1h(spark, sf_dir), "4h"), **_BAR)


@query("bars_weekly", sel(BARS_1D + """,
weeks AS (SELECT symbol, CAST(date_trunc('week', ts) AS TIMESTAMP) AS ts, arg_min(open, ts) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)""", "weeks", **_BAR))
def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(src.resample_bars(bars_1d(spark, sf_dir), " 1W "), **_BAR)


@query("normalise_bars", """
WITH raw AS (SELECT event_type AS symbol, epoch_ms(date_trunc('minute', ts)) AS ms, value, event_id,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS volume FROM events)
SELECT symbol, strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S') AS ts, round(arg_max(value, event_id), 6) AS close,
  coalesce(arg_max_null(volume, event_id), 0.0) AS volume FROM raw GROUP BY symbol, ms""")
def normalise_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    raw = e.select(
        F.col("event_type").alias("symbol"), F.lit("1m").alias("timeframe"),
        F.unix_millis(F.date_trunc("minute", "ts")).alias("ts_ms"),
        *[F.col("value").alias(c) for c in ("open", "high", "low", "close")],
        F.when(F.col("event_id") % 10 == 0, None).otherwise(F.col("user_id").cast("double")).alias("volume"), "event_id")
    return out(src.normalise_bars(raw, "event_id"), close=6, volume=6)


@query("normalise_symbol", """
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'eur/usd' WHEN 1 THEN 'btc-usd' WHEN 2 THEN 'Aapl'
  WHEN 3 THEN 'gbpjpy' ELSE lower(o_orderpriority) END AS s FROM orders)
SELECT CASE WHEN p IN ('EURUSD', 'GBPJPY') THEN 'C:' || p WHEN p = 'BTCUSD' THEN 'X:' || p ELSE p END AS ticker, count(*) AS n
FROM (SELECT replace(replace(upper(s), '/', ''), '-', '') AS p FROM s) GROUP BY 1""")
def normalise_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    s = (F.when(k == 0, "eur/usd").when(k == 1, "btc-usd").when(k == 2, "Aapl").when(k == 3, "gbpjpy")
         .otherwise(F.lower("o_orderpriority")))
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(src.normalise_symbol(s).alias("ticker")).agg(F.count(F.lit(1)).alias("n"))


@query("parse_timeframe", """
SELECT tf AS timeframe, CAST(regexp_extract(tf, '^[0-9]+') AS INTEGER) AS multiplier,
  CASE right(tf, 1) WHEN 'm' THEN 'minute' WHEN 'h' THEN 'hour' WHEN 'd' THEN 'day' ELSE 'week' END AS span, count(*) AS n
FROM (SELECT l_linenumber || substr('mhdw', 1 + CAST(l_orderkey % 4 AS INTEGER), 1) AS tf FROM lineitem) GROUP BY ALL""")
def parse_timeframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.substring(F.lit("mhdw"), (F.col("l_orderkey") % 4 + 1).cast("int"), F.lit(1))
    tf = table(spark, sf_dir, "lineitem").select(F.concat(F.col("l_linenumber").cast("string"), unit).alias("timeframe"))
    return (tf.withColumn("p", src.parse_timeframe(F.col("timeframe"))).groupBy("timeframe", "p.multiplier", "p.span")
            .agg(F.count(F.lit(1)).alias("n")))


@query("validate_bars", """
WITH raw AS (SELECT event_type AS symbol, event_id, date_trunc('minute', ts) AS ts, value AS close,
  CASE WHEN event_id % 7 = 0 THEN value - 1 ELSE value + 1 END AS high, value AS low FROM events)
SELECT symbol, count(*) AS n_rows, count(*) FILTER (WHERE high < low) AS n_high_lt_low,
  count(*) FILTER (WHERE close <= 0) AS n_nonpositive_close, count(*) - count(DISTINCT ts) AS n_dup_ts, count(*) FILTER (WHERE event_id % 50 = 0) AS n_missing_price FROM raw GROUP BY symbol""")
def validate_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    raw = e.select(
        F.col("event_type").alias("symbol"), F.lit("1m").alias("timeframe"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"),
        F.when(F.col("event_id") % 100 == 0, F.lit(float("nan"))).when(F.col("event_id") % 50 != 0, v).alias("open"),
        F.when(F.col("event_id") % 7 == 0, v - 1).otherwise(v + 1).alias("high"), v.alias("low"), v.alias("close"))
    return src.validate_bars(raw).drop("timeframe")


@query("date_chunks", """
WITH ranges AS (SELECT event_type AS symbol, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY 1),
c AS (SELECT symbol, b, unnest(generate_series(a, b, INTERVAL 7 DAY)) AS s FROM ranges)
SELECT symbol, strftime(s, '%Y-%m-%d') AS chunk_start, strftime(least(s + INTERVAL 6 DAY, b), '%Y-%m-%d') AS chunk_end FROM c""")
def date_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ranges = e.groupBy(F.col("event_type").alias("symbol")).agg(
        F.to_date(F.min("ts")).alias("start_date"), F.to_date(F.max("ts")).alias("end_date"))
    return src.date_chunks(ranges, 7).select(
        "symbol", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("chunk_start", "chunk_end")])


@query("recent_bars", f"""WITH {BARS_15M}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM bars)
SELECT symbol, {TS_SQL}, round(open, 5) AS o, round(high, 5) AS h, round(low, 5) AS l, round(close, 5) AS c, round(volume, 2) AS v
FROM k WHERE n <= 500""")
def recent_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = src.recent_bars(bars_15m(spark, sf_dir), 500)
    return recent.select("symbol", F.inline("recent")).withColumn("t", ts_text("t")).withColumnRenamed("t", "ts")


@query("moving_averages", sel(
    f"""{BARS_1D}, {RN}, x AS (SELECT *, close / lag(close) OVER {W_SQL} - 1 AS ret, ln(close / lag(close) OVER {W_SQL}) AS log_ret,
  {ema_sql('close', 20)} AS ema20, {ema_sql('close', 50)} AS ema50, {ema_sql('close', 200)} AS ema200,
  {roll_sql('avg(close)', 10)} AS sma10, {roll_sql('avg(close)', 50)} AS sma50,
  {roll_sql('max(high)', 20)} AS max20, {roll_sql('min(low)', 20)} AS min20 FROM numbered)""", "x",
    ret=6, log_ret=6, ema20=4, ema50=4, ema200=4, sma10=4, sma50=4, max20=4, min20=4))
def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compute(bars_1d(spark, sf_dir), [
        ind.returns("ret"), ind.returns("log_ret", "log"),
        ewm([(f"ema{p}", "close", span_alpha(p)) for p in (20, 50, 200)]),
        ind.sma("sma10", "close", 10), ind.sma("sma50", "close", 50),
        ind.rolling_max("max20", "high", 20), ind.rolling_min("min20", "low", 20)])
    return out(df, ret=6, log_ret=6, ema20=4, ema50=4, ema200=4, sma10=4, sma50=4, max20=4, min20=4)


@query("atr_rsi", sel(
    f"""{BARS_1D}, {RN}, {DIFFS}, x AS (SELECT *, {ewm_sql('tr', '1.0/14')} AS atr14, {ewm_sql('gain', '1.0/14', 1)} AS ag,
  {ewm_sql('loss', '1.0/14', 1)} AS al FROM tr)""", "x",
    tr=4, atr14=4, rsi14=("100 - 100 / (1 + ag / nullif(al, 0))", 5)))
def atr_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = wilder_alpha(14)
    df = compute(bars_1d(spark, sf_dir), [
        ind.true_range("tr"), ind.rsi_inputs(), ewm([("atr14", "tr", a), ("g", "gain", a), ("s", "loss", a)]),
        ind.rsi_value("rsi14", "g", "s")])
    return out(df, tr=4, atr14=4, rsi14=5)


@query("bollinger_keltner", sel(
    f"""{BARS_1H}, {RN}, {DIFFS}, x AS (SELECT *, {roll_sql('avg(close)', 20)} AS bb_mid, {roll_sql('stddev_samp(close)', 20)} AS sd,
  {ema_sql('close', 20)} AS kc_mid, {ewm_sql('tr', '1.0/20')} AS a FROM tr)""", "x",
    bb_mid=5, bb_upper=("bb_mid + 2 * sd", 5), bb_lower=("bb_mid - 2 * sd", 5), bb_width=("4 * sd", 5),
    kc_upper=("kc_mid + 1.5 * a", 5), kc_lower=("kc_mid - 1.5 * a", 5)))
def bollinger_keltner(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compute(bars_1h(spark, sf_dir), [ind.bollinger(20, 2.0), ind.keltner(20, 1.5)])
    return out(df, bb_mid=5, bb_upper=5, bb_lower=5, bb_width=5, kc_upper=5, kc_lower=5)


@query("rolling_quantiles", sel(
    f"{BARS_1H}, x AS (SELECT *, {roll_sql('quantile_cont(close, 0.25)', 252, 30)} AS q25, {roll_sql('quantile_cont(close, 0.75)', 252, 30)} AS q75 FROM bars)",
    "x", q25=5, q75=5))
def rolling_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(compute(bars_1h(spark, sf_dir), [ind.rolling_quantiles({"q25": 0.25, "q75": 0.75}, "close")]), q25=5, q75=5)


_MACD = f"""{BARS_1H}, {RN}, a AS (SELECT *, {ema_sql('close', 12)} AS ef, {ema_sql('close', 26)} AS es FROM numbered),
b AS (SELECT *, ef - es AS macd FROM a), c AS (SELECT *, {ema_sql('macd', 9)} AS macd_signal FROM b)"""


@query("macd", sel(_MACD, "c", macd=5, macd_signal=5, macd_hist=("macd - macd_signal", 5)))
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(compute(bars_1h(spark, sf_dir), [ind.macd(12, 26, 9)]), macd=5, macd_signal=5, macd_hist=5)


@query("oscillators", sel(
    f"""{BARS_1H}, a AS (SELECT *, 100 * (close - {roll_sql('min(low)', 14)}) / nullif({roll_sql('max(high)', 14)} - {roll_sql('min(low)', 14)}, 0) AS raw,
  {roll_sql('max(high)', 14)} AS hh, {roll_sql('min(low)', 14)} AS ll, lag(close, 9) OVER {W_SQL} AS c9,
  {roll_sql('max(high)', 9)} AS h9, {roll_sql('min(low)', 9)} AS l9, {roll_sql('max(high)', 26)} AS h26, {roll_sql('min(low)', 26)} AS l26 FROM bars),
  b AS (SELECT *, {roll_sql('avg(raw)', 3, x='raw')} AS stoch_k FROM a), c AS (SELECT *, {roll_sql('avg(stoch_k)', 3, x='stoch_k')} AS stoch_d FROM b)""", "c",
    stoch_k=5, stoch_d=5, willr=("-100 * (hh - close) / nullif(hh - ll, 0)", 5), roc9=("100 * (close / c9 - 1)", 5),
    tenkan=("(h9 + l9) / 2", 5), kijun=("(h26 + l26) / 2", 5)))
def oscillators(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compute(bars_1h(spark, sf_dir), [
        ind.stochastic(14, 3, 3), ind.williams_r("willr", 14), ind.roc("roc9", 9), ind.ichimoku()])
    return out(df, stoch_k=5, stoch_d=5, willr=5, roc9=5, tenkan=5, kijun=5)


@query("cci", sel(
    f"""{BARS_1H}, a AS (SELECT *, (high + low + close) / 3 AS tp FROM bars),
  b AS (SELECT *, {roll_sql('avg(tp)', 20, x='tp')} AS m, {roll_sql('list(tp)', 20, x='tp')} AS all_tp FROM a)""", "b",
    cci20=("(tp - m) / nullif(0.015 * list_sum(list_transform(all_tp, lambda t: abs(t - m))) / 20, 0)", 4)))
def cci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(compute(bars_1h(spark, sf_dir), [ind.cci("cci20", 20)]), cci20=4)


_ADX = f"""{BARS_1H}, {RN}, {DIFFS},
dm0 AS (SELECT *, high - lag(high) OVER {W_SQL} AS up, lag(low) OVER {W_SQL} - low AS dn FROM tr),
dm AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM dm0),
sm AS (SELECT *, {ewm_sql('pdm', '1.0/14', 1)} AS sp, {ewm_sql('mdm', '1.0/14', 1)} AS smi, {ewm_sql('tr', '1.0/14', 1)} AS st FROM dm),
di AS (SELECT *, 100 * sp / nullif(st, 0) AS plus_di, 100 * smi / nullif(st, 0) AS minus_di FROM sm),
dx AS (SELECT *, coalesce(100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0), 0) AS dx FROM di),
adx AS (SELECT *, {ewm_sql('dx', '1.0/14', 1)} AS adx FROM dx)"""


@query("adx", sel(_ADX, "adx", adx=4, plus_di=4, minus_di=4))
def adx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(compute(bars_1h(spark, sf_dir), [ind.directional(14)]), adx=4, plus_di=4, minus_di=4)


@query("atr_expansion", f"""WITH {BARS_1H}, {RN}, {DIFFS}, a AS (SELECT *, {ewm_sql('tr', '1.0/14')} AS atr FROM tr),
b AS (SELECT symbol, {TS_SQL.replace(' AS ts', '')} AS ts, coalesce(atr > 1.5 * {roll_sql('avg(atr)', 20, x='atr')}, false) AS expanded FROM a)
SELECT * FROM b WHERE expanded""")
def atr_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compute(bars_1h(spark, sf_dir), [ind.atr_expansion("expanded", 14, 1.5)])
    return df.where("expanded").select("symbol", ts_text().alias("ts"), "expanded")


@query("volume_flow", sel(
    f"""{BARS_1D}, a AS (SELECT *, (high + low + close) / 3 AS tp, CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) * volume END AS mfv,
  lag(close) OVER {W_SQL} AS pc FROM bars),
  b AS (SELECT *, lag(tp) OVER {W_SQL} AS ptp FROM a),
  c AS (SELECT *, CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp > ptp THEN tp * volume ELSE 0 END END AS pf,
    CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp < ptp THEN tp * volume ELSE 0 END END AS nf FROM b),
  d AS (SELECT *, sum(coalesce(sign(close - pc) * volume, 0)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv,
    {roll_sql('sum(mfv)', 20, x='mfv')} / nullif({roll_sql('sum(volume)', 20, x='volume')}, 0) AS cmf20,
    {roll_sql('sum(pf)', 14, x='pf')} AS p, {roll_sql('sum(nf)', 14, x='nf')} AS n,
    {roll_sql('sum(CASE WHEN close > open THEN volume ELSE 0 END)', 20)} / nullif({roll_sql('sum(CASE WHEN close < open THEN volume ELSE 0 END)', 20)}, 0) AS updown,
    (close - lag(close, 5) OVER {W_SQL}) / 5 AS velocity FROM c)""", "d",
    obv=3, cmf20=5, mfi14=("100 * p / nullif(p + n, 0)", 4), updown=5, velocity=4))
def volume_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = ind.obv(bars_1d(spark, sf_dir))
    df = compute(bars, [ind.cmf("cmf20", 20), ind.mfi("mfi14", 14), ind.volume_ratio("updown", 20), ind.velocity("velocity", 5)])
    return out(df, obv=3, cmf20=5, mfi14=4, updown=5, velocity=4)


_D = "(PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)"


@query("vwap_daily", sel(
    f"""{BARS_1H}, a AS (SELECT *, (high + low + close) / 3 AS tp FROM bars),
  b AS (SELECT *, sum(tp * volume) OVER {_D} / sum(volume) OVER {_D} AS vwap, sum(tp * tp * volume) OVER {_D} / sum(volume) OVER {_D} AS m2 FROM a)""", "b",
    vwap=7, vwap_upper=("vwap + sqrt(greatest(m2 - vwap * vwap, 0))", 3), vwap_lower=("vwap - sqrt(greatest(m2 - vwap * vwap, 0))", 3)))
def vwap_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(ind.vwap_daily(bars_1h(spark, sf_dir)), vwap=7, vwap_upper=3, vwap_lower=3)


def _swing_sql(n: int) -> str:
    p = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    q = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"
    full = f"count(*) OVER {p} = {n} AND count(*) OVER {q} = {n}"
    return f"""CASE WHEN {full} AND high > max(high) OVER {p} AND high > max(high) OVER {q} THEN high END AS swing_high,
  CASE WHEN {full} AND low < min(low) OVER {p} AND low < min(low) OVER {q} THEN low END AS swing_low,
  lead(ts, {n}) OVER {W_SQL} AS confirmed_ts"""


@query("swing_levels", f"""WITH {BARS_1H}, a AS (SELECT *, {_swing_sql(10)} FROM bars)
SELECT symbol, {TS_SQL}, round(swing_high, 6) AS swing_high, round(swing_low, 6) AS swing_low,
  strftime(confirmed_ts, '%Y-%m-%d %H:%M:%S') AS confirmed_ts FROM a WHERE swing_high IS NOT NULL OR swing_low IS NOT NULL""")
def swing_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compute(bars_1h(spark, sf_dir), [ind.swing_levels(10)]).where("swing_high IS NOT NULL OR swing_low IS NOT NULL")
    return out(df.withColumn("c", ts_text("confirmed_ts")), swing_high=6, swing_low=6).join(
        df.select("symbol", ts_text().alias("ts"), ts_text("confirmed_ts").alias("confirmed_ts")), ["symbol", "ts"])


_SIDES = [f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {a} AND {b})" for a, b in (("L PRECEDING", "1 PRECEDING"), ("1 FOLLOWING", "L FOLLOWING"))]


def _adaptive_sql(x: str, agg: str, sign: str) -> str:
    return " AND ".join(f"count(*) OVER {w} = L AND {x} {sign} {agg}({x}) OVER {w}" for w in _SIDES)


@query("cluster_levels", f"""WITH RECURSIVE {BARS_1H},
n AS (SELECT symbol, CAST(greatest(3, least(10, count(*) // 40)) AS BIGINT) AS L, arg_max(close, ts) AS ref FROM bars GROUP BY symbol HAVING count(*) >= 30),
a AS (SELECT bars.*, L, ref FROM bars JOIN n USING (symbol)),
p AS (SELECT symbol, ref, high AS p FROM a QUALIFY {_adaptive_sql('high', 'max', '>')} UNION ALL SELECT symbol, ref, low FROM a QUALIFY {_adaptive_sql('low', 'min', '<')}),
o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p) AS k FROM p),
g AS (SELECT symbol, k, p AS centre, CAST(1 AS BIGINT) AS touches, CAST(1 AS BIGINT) AS id FROM o WHERE k = 1
  UNION ALL SELECT symbol, k, CASE WHEN joins THEN (centre * touches + p) / (touches + 1) ELSE p END, CASE WHEN joins THEN touches + 1 ELSE 1 END, CASE WHEN joins THEN id ELSE id + 1 END
  FROM (SELECT o.symbol, o.k, o.p, g.centre, g.touches, g.id, abs(o.p - g.centre) <= o.ref * 0.003 AS joins FROM g JOIN o ON o.symbol = g.symbol AND o.k = g.k + 1)),
c AS (SELECT symbol, id, max(touches) AS touches, arg_max(centre, k) AS level FROM g GROUP BY symbol, id HAVING max(touches) >= 2),
k AS (SELECT symbol, touches, round(level, 6) AS level, row_number() OVER (PARTITION BY symbol ORDER BY touches DESC, c.level) AS rank FROM c)
SELECT symbol, touches, level, rank FROM k WHERE rank <= 8""")
def cluster_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    swings = ind.adaptive_swings(bars_1h(spark, sf_dir))
    levels = swings.select("symbol", "last_close", F.explode(F.array_compact(F.array("swing_high", "swing_low"))).alias("price"))
    found = ind.cluster_levels(levels, ["symbol"], "price", "last_close")
    return found.select("symbol", "touches", r("level").alias("level"), F.col("rank").cast("long"))


@query("daily_levels", f"""WITH {BARS_1H},
d AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2),
e AS (SELECT symbol, day, lag(h) OVER w AS ph, lag(l) OVER w AS pl, lag(c) OVER w AS pc FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, {TS_SQL}, round(ph, 6) AS prior_high, round(pl, 6) AS prior_low, round((ph + pl + pc) / 3, 6) AS pivot,
  round(2 * (ph + pl + pc) / 3 - ph, 6) AS s1, round(2 * (ph + pl + pc) / 3 - pl, 6) AS r1
FROM bars JOIN e USING (symbol) WHERE CAST(ts AS DATE) = day""")
def daily_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(ind.with_daily_levels(bars_1h(spark, sf_dir)), prior_high=6, prior_low=6, pivot=6, s1=6, r1=6)


@query("candle_anatomy", f"""WITH {BARS_1H}, a AS (SELECT *, lag(high) OVER {W_SQL} AS h1, lag(low) OVER {W_SQL} AS l1, lag(close) OVER {W_SQL} AS c1,
  lag(high, 2) OVER {W_SQL} AS h2, lag(low, 2) OVER {W_SQL} AS l2, lead(high) OVER {W_SQL} AS h3, lead(low) OVER {W_SQL} AS l3,
  lead(high, 2) OVER {W_SQL} AS h4, lead(low, 2) OVER {W_SQL} AS l4 FROM bars)
SELECT symbol, {TS_SQL}, round(abs(close - open), 6) AS body, round(high - low, 6) AS range, round(high - greatest(open, close), 6) AS upper_wick,
  round(least(open, close) - low, 6) AS lower_wick, round(abs(close - open) / nullif(high - low, 0), 6) AS body_ratio,
  coalesce(high < h1 AND low > l1, false) AS inside_bar, coalesce(high > h1 AND low < l1, false) AS outside_bar, round(open - c1, 6) AS gap,
  coalesce(high > h1 AND high > h2 AND high > h3 AND high > h4, false) AS fractal_high,
  coalesce(low < l1 AND low < l2 AND low < l3 AND low < l4, false) AS fractal_low, round(floor(close / 0.5) * 0.5, 6) AS round_level FROM a""")
def candle_anatomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compute(bars_1h(spark, sf_dir), [ind.candle_anatomy(), ind.fractals(), ind.round_level("round_level", 0.5)])
    nums = ("body", "range", "upper_wick", "lower_wick", "body_ratio", "gap", "round_level")
    return df.select("symbol", ts_text().alias("ts"), *[r(c).alias(c) for c in nums],
                     "inside_bar", "outside_bar", "fractal_high", "fractal_low")


@query("bar_sizes", f"""WITH {BARS_1H}, {RN}, {DIFFS}, a AS (SELECT *, {ewm_sql('tr', '1.0/14')} AS atr, floor(close / 0.5 + 0.5) * 0.5 AS nearest FROM tr)
SELECT symbol, {TS_SQL}, round(abs(close - open) / nullif(atr, 0), 5) + 0.0 AS body_atr, round((high - low) / nullif(atr, 0), 5) + 0.0 AS range_atr,
  round(nearest, 6) + 0.0 AS nearest_level, coalesce(abs(close / nullif(nearest, 0) - 1) <= 0.001, false) AS near_level FROM a""")
def bar_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each bar in average true ranges, and its nearest round level."""
    df = compute(bars_1h(spark, sf_dir), [ind.size_over_atr(14), ind.nearest_level(0.5)])
    return df.select("symbol", ts_text().alias("ts"), r("body_atr", 5).alias("body_atr"), r("range_atr", 5).alias("range_atr"),
                     r("nearest_level").alias("nearest_level"), "near_level")


@query("gap_fills", f"""WITH {BARS_1H}, {RN}, g AS (SELECT symbol, ts, rn, open, lag(close) OVER {W_SQL} AS c1 FROM numbered)
SELECT g.symbol, strftime(g.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(any_value(g.open - c1), 6) + 0.0 AS gap_size, min(n.rn) - any_value(g.rn) AS fill_lag FROM g LEFT JOIN numbered n ON n.symbol = g.symbol AND n.rn BETWEEN g.rn AND g.rn + 50
  AND CASE WHEN g.open > c1 THEN n.low <= c1 ELSE n.high >= c1 END WHERE g.open <> c1 GROUP BY g.symbol, g.ts""")
def gap_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gap between two bars and how many bars later the price has come back."""
    df = compute(bars_1h(spark, sf_dir), [ind.gap_fill(50)]).where("gap_size <> 0")
    return df.select("symbol", ts_text().alias("ts"), r("gap_size").alias("gap_size"), "fill_lag")


@query("streaks", f"""WITH {BARS_1H}, a AS (SELECT *, CAST(sign(close - open) AS INTEGER) AS dir, row_number() OVER {W_SQL} AS i FROM bars),
b AS (SELECT *, CASE WHEN coalesce(dir <> lag(dir) OVER {W_SQL}, true) THEN i END AS s FROM a)
SELECT symbol, {TS_SQL}, dir, i - max(s) OVER (PARTITION BY symbol, timeframe ORDER BY ts ROWS UNBOUNDED PRECEDING) + 1 AS streak FROM b""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.streaks(bars_1h(spark, sf_dir)).select("symbol", ts_text().alias("ts"), "dir", F.col("streak").cast("long"))


@query("rolling_statistics", sel(
    f"""{BARS_1D}, a AS (SELECT *, close / lag(close) OVER {W_SQL} - 1 AS ret FROM bars),
  b AS (SELECT *, lag(ret) OVER {W_SQL} AS ret1 FROM a)""", "b",
    zscore=(f"(close - {roll_sql('avg(close)', 20)}) / nullif({roll_sql('stddev_samp(close)', 20)}, 0)", 5),
    vol=(roll_sql("stddev_samp(ret)", 20, x="ret"), 6),
    autocorr=(f"{roll_sql('corr(ret, ret1)', 50, x='ret1')}", 5),
    pv_corr=(roll_sql("corr(close, volume)", 20), 5)))
def rolling_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compute(bars_1d(spark, sf_dir), [
        ind.returns("ret"), ind.rolling_zscore("zscore", "close", 20), ind.rolling_std("vol", "ret", 20),
        ind.rolling_autocorr("autocorr", "ret", 1, 50), ind.rolling_corr("pv_corr", "close", "volume", 20)])
    return out(df, zscore=5, vol=6, autocorr=5, pv_corr=5)


@query("higher_timeframe_trend", f"""WITH {BARS_1H},
d AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2),
m AS (SELECT symbol, CAST(day AS TIMESTAMP) + INTERVAL 1 DAY AS at, c,
  CASE WHEN count(c) OVER w >= 5 THEN avg(c) OVER w END AS sma5 FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(m.c, 6) AS higher_close, round(m.sma5, 5) AS higher_sma5,
  CASE WHEN m.c > m.sma5 THEN 'up' WHEN m.c < m.sma5 THEN 'down' ELSE 'none' END AS regime
FROM bars b ASOF LEFT JOIN m ON b.symbol = m.symbol AND b.ts >= m.at""")
def higher_timeframe_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hourly bar with the trend of the last closed daily bar."""
    hourly = bars_1h(spark, sf_dir)
    daily = compute(src.resample_bars(hourly, "1d"), [ind.sma("sma5", "close", 5)])
    df = ind.asof_higher(hourly, daily, ["close", "sma5"])
    c, m = F.col("higher_close"), F.col("higher_sma5")
    return df.select("symbol", ts_text().alias("ts"), r(c).alias("higher_close"), r(m, 5).alias("higher_sma5"),
                     F.when(c > m, "up").when(c < m, "down").otherwise("none").alias("regime"))


_ATR10 = f"{BARS_1H}, {RN}, {DIFFS}, a AS (SELECT *, {ewm_sql('tr', '1.0/10')} AS atr, (high + low) / 2 AS mid FROM tr)"


@query("supertrend", f"""WITH RECURSIVE {_ATR10},
st AS (SELECT symbol, rn, ts, 1 AS d, mid + 3 * atr AS up, mid - 3 * atr AS low FROM a WHERE rn = 0
  UNION ALL SELECT symbol, rn, ts, d, CASE WHEN d < 0 AND nu > up THEN up ELSE nu END, CASE WHEN d > 0 AND nl < low THEN low ELSE nl END FROM
  (SELECT a.symbol, a.rn, a.ts, CASE WHEN a.close > st.up THEN 1 WHEN a.close < st.low THEN -1 ELSE st.d END AS d,
    a.mid + 3 * a.atr AS nu, a.mid - 3 * a.atr AS nl, st.up, st.low FROM st JOIN a ON a.symbol = st.symbol AND a.rn = st.rn + 1))
SELECT symbol, {TS_SQL}, d AS direction, round(CASE WHEN d > 0 THEN low ELSE up END, 5) AS line FROM st""")
def supertrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = seq.supertrend(bars_1h(spark, sf_dir), [(10, 3.0)])
    return df.select("symbol", ts_text().alias("ts"), F.col("st_dir_0").alias("direction"), r("st_line_0", 5).alias("line"))


@query("psar", f"""WITH RECURSIVE {BARS_1H}, {RN},
b AS (SELECT *, coalesce(lag(low) OVER {W_SQL}, low) AS l1, coalesce(lag(high) OVER {W_SQL}, high) AS h1,
  coalesce(lag(low, 2) OVER {W_SQL}, lag(low) OVER {W_SQL}, low) AS l2, coalesce(lag(high, 2) OVER {W_SQL}, lag(high) OVER {W_SQL}, high) AS h2 FROM numbered),
st AS (SELECT symbol, rn, ts, 1 AS trend, low AS sar, high AS ep, 0.02::DOUBLE AS af FROM b WHERE rn = 0
  UNION ALL SELECT symbol, rn, ts, CASE WHEN flip THEN -trend ELSE trend END, CASE WHEN flip THEN ep ELSE nxt END,
    CASE WHEN flip THEN (CASE WHEN trend > 0 THEN low ELSE high END) WHEN trend > 0 THEN greatest(ep, high) ELSE least(ep, low) END,
    CASE WHEN flip THEN 0.02 WHEN (trend > 0 AND high > ep) OR (trend < 0 AND low < ep) THEN least(af + 0.02, 0.2) ELSE af END FROM
  (SELECT *, CASE WHEN trend > 0 THEN low < nxt ELSE high > nxt END AS flip FROM
    (SELECT b.symbol, b.rn, b.ts, b.low, b.high, st.trend, st.ep, st.af,
      CASE WHEN st.trend > 0 THEN least(st.sar + st.af * (st.ep - st.sar), b.l1, b.l2) ELSE greatest(st.sar + st.af * (st.ep - st.sar), b.h1, b.h2) END AS nxt
     FROM st JOIN b ON b.symbol = st.symbol AND b.rn = st.rn + 1)))
SELECT symbol, {TS_SQL}, trend AS direction, round(sar, 5) AS sar FROM st""")
def psar(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = seq.psar(bars_1h(spark, sf_dir), [(0.02, 0.2)])
    return df.select("symbol", ts_text().alias("ts"), F.col("psar_dir_0").alias("direction"), r("psar_0", 5).alias("sar"))


def _structure_sql(n: int = 5) -> str:
    side = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {2 * n} PRECEDING AND {n + 1} PRECEDING)"
    aft = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    back = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    upto = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{BARS_1D}, a AS (SELECT *, lag(high, {n}) OVER {W_SQL} AS hn, lag(low, {n}) OVER {W_SQL} AS ln, count(*) OVER {side} AS k, max(high) OVER {side} AS mh, min(low) OVER {side} AS ml,
  max(high) OVER {aft} AS ah, min(low) OVER {aft} AS al, {roll_sql('avg(close)', 50)} AS ma, {roll_sql('avg(volume)', 20)} AS vm, 4 * {roll_sql('stddev_samp(close)', 20)} AS w FROM bars),
b AS (SELECT *, CASE WHEN k = {n} AND hn > mh AND hn > ah THEN hn END AS sh, CASE WHEN k = {n} AND ln < ml AND ln < al THEN ln END AS sl, (ma - lag(ma, 10) OVER {W_SQL}) / 10 AS slope,
  {roll_sql('quantile_cont(w, 0.25)', 252, 30, 'w')} AS w25, {roll_sql('quantile_cont(w, 0.75)', 252, 30, 'w')} AS w75 FROM a),
c AS (SELECT *, CASE WHEN sh IS NOT NULL THEN sh > last_value(sh IGNORE NULLS) {back} END AS hh, CASE WHEN sl IS NOT NULL THEN sl > last_value(sl IGNORE NULLS) {back} END AS hl FROM b),
d AS (SELECT *, last_value(hh IGNORE NULLS) {upto} AS h9, last_value(hl IGNORE NULLS) {upto} AS l9 FROM c)"""


@query("market_structure", f"""WITH {_structure_sql()} SELECT symbol, {TS_SQL}, CASE WHEN h9 AND l9 THEN 'up' WHEN NOT h9 AND NOT l9 THEN 'down' ELSE 'mixed' END AS structure, round(slope, 4) + 0.0 AS ma_slope,
  CASE WHEN w < w25 THEN 'narrow' WHEN w > w75 THEN 'wide' WHEN w25 IS NOT NULL THEN 'normal' END AS width_regime,
  CASE WHEN volume > 1.5 * vm THEN 'high' WHEN volume < 0.5 * vm THEN 'low' WHEN vm IS NOT NULL THEN 'normal' END AS volume_regime FROM d""")
def market_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ind.market_structure(bars_1d(spark, sf_dir))
    return df.select("symbol", ts_text().alias("ts"), "structure", r("ma_slope", 4).alias("ma_slope"), "width_regime", "volume_regime")


@query("apply_indicator", sel(f"{BARS_1H}, x AS (SELECT *, {roll_sql('avg(close)', 10)} - {roll_sql('avg(open)', 10, x='open')} AS spread FROM bars)", "x", spread=6))
def apply_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's Python function over blocks of bars."""
    def spread(pdf):
        pdf["spread"] = pdf["close"].rolling(10).mean() - pdf["open"].rolling(10).mean()
        return pdf[["symbol", "timeframe", "ts", "spread"]]
    df = ind.apply_indicator(bars_1h(spark, sf_dir), spread, "symbol string, timeframe string, ts timestamp, spread double", before=10)
    return out(df, spread=6)


@query("bars_written_and_read", sel(BARS_1H, "bars", **_BAR))
def bars_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars through the partitioned Parquet layout."""
    import os
    import uuid
    from barlens.session import scratch_dir
    path = os.path.join(scratch_dir(spark), f"bars-{uuid.uuid4().hex}")
    src.write_bars(bars_1h(spark, sf_dir), path)
    return out(src.read_bars(spark, path), **_BAR)
