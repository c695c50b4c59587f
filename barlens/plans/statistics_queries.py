"""Statistics of daily returns as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.functions.core import r, ts_text
from barlens.operators import indicators as ind
from barlens.operators import statistics as st
from barlens.operators.blocks import compute, lag_sql, sql_columns
from barlens.plans.catalog import BARS_1D, BARS_1H, TS_SQL, W_SQL, bars_1d, bars_1h, query, roll_sql
from barlens.plans.condition_research import _stats_sql
from barlens.session import materialise

_RET = f"{BARS_1D}, rt AS (SELECT *, close / lag(close) OVER {W_SQL} - 1 AS ret, ln(close / lag(close) OVER {W_SQL}) AS lr FROM bars)"


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute(bars_1d(spark, sf_dir), [ind.returns("ret"), ind.returns("lr", "log")])


def rr(df: DataFrame, digits: int, *plain: str) -> DataFrame:
    return df.select(*plain, *[r(c, digits).alias(c) for c in df.columns if c not in plain])


_MOM = """mm AS (SELECT symbol, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, avg(pow(ret - mu, 3)) / pow(var_pop(ret), 1.5) AS skew, avg(pow(ret - mu, 4)) / pow(var_pop(ret), 2) - 3 AS kurtosis
  FROM (SELECT *, avg(ret) OVER (PARTITION BY symbol) AS mu FROM rt WHERE ret IS NOT NULL) GROUP BY symbol)"""


@query("return_moments", f"WITH {_RET}, {_MOM} SELECT symbol, n, round(mean, 7) AS mean, round(std, 7) AS std, round(skew, 5) AS skew, round(kurtosis, 5) AS kurtosis FROM mm")
def return_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = st.moments(_returns(spark, sf_dir), ["symbol"], "ret")
    return m.select("symbol", "n", r("mean", 7).alias("mean"), r("std", 7).alias("std"), r("skew", 5).alias("skew"), r("kurtosis", 5).alias("kurtosis"))


@query("robust_moments", f"""WITH {_RET}, q AS (SELECT symbol, quantile_cont(ret, 0.5) AS md, quantile_cont(ret, 0.05) AS lo, quantile_cont(ret, 0.95) AS hi FROM rt GROUP BY 1)
SELECT symbol, round(any_value(md), 7) AS median, round(quantile_cont(abs(ret - md), 0.5), 7) AS mad, round(avg(CASE WHEN ret IS NOT NULL THEN least(greatest(ret, lo), hi) END), 7) AS winsorised_mean FROM rt JOIN q USING (symbol) GROUP BY 1""")
def robust_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rr(st.robust_moments(materialise(_returns(spark, sf_dir), "returns"), ["symbol"], "ret"), 7, "symbol")


@query("performance_ratios", f"""WITH {_RET}, b AS (SELECT *, avg(ret) OVER (PARTITION BY ts) AS bench FROM rt WHERE ret IS NOT NULL),
a AS (SELECT symbol, count(*) AS n, avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END)) AS sortino, sum(greatest(ret, 0)) / sum(greatest(-ret, 0)) AS omega, avg(ret) FILTER (WHERE ret > 0) AS w, avg(-ret) FILTER (WHERE ret < 0) AS l,
  avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS p, avg(CASE WHEN ret < 0 THEN 1.0 ELSE 0 END) AS q, avg(ret - bench) / stddev_samp(ret - bench) AS ir FROM b GROUP BY 1)
SELECT symbol, n, round(sortino, 6) AS sortino, round(omega, 6) AS omega, round(w / l, 6) AS payoff, round(p * w - q * l, 6) AS expectancy, round(p - (1 - p) / (w / l), 6) AS kelly, round(ir, 6) AS information_ratio FROM a""")
def performance_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    ret = materialise(_returns(spark, sf_dir).where("ret IS NOT NULL").select("symbol", "ts", "ret"), "returns")
    bench = ret.groupBy("ts").agg(F.avg("ret").alias("bench"))
    return rr(st.performance_ratios(ret.join(bench, "ts"), ["symbol"], "ret", "bench"), 6, "symbol", "n")


@query("tail_ratio", f"""WITH {_RET} SELECT symbol, round(quantile_cont(ret, 0.05), 7) AS p05, round(quantile_cont(ret, 0.95), 7) AS p95, round(abs(quantile_cont(ret, 0.95)) / abs(quantile_cont(ret, 0.05)), 6) AS tail_ratio FROM rt GROUP BY 1""")
def tail_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = st.tail_ratio(materialise(_returns(spark, sf_dir), "returns"), ["symbol"], "ret")
    return t.select("symbol", r("p05", 7).alias("p05"), r("p95", 7).alias("p95"), r("tail_ratio").alias("tail_ratio"))


_Z1, _Z2 = st._normal_quantile(1 - 1 / 50), st._normal_quantile(1 - 1 / (50 * 2.718281828459045))
_CDF = """(CASE WHEN z >= 0 THEN 0.5 + a ELSE 0.5 - a END)"""


@query("sharpe_errors", f"""WITH {_RET}, {_MOM}, s AS (SELECT *, mean / std AS sr FROM mm), t AS (SELECT *, 1 - skew * sr + (kurtosis + 2) / 4 * sr * sr AS shape FROM s),
u AS (SELECT *, (sr - ({(1 - 0.5772156649015329) * _Z1 + 0.5772156649015329 * _Z2!r}) / sqrt(n)) / sqrt(shape / (n - 1)) AS z FROM t),
v AS (SELECT *, least(abs(z), 10) AS y, list_sum(list_transform(range(0, 1001), lambda i: (CASE WHEN i IN (0, 1000) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * exp(-pow(least(abs(z), 10) / 1000 * i, 2) / 2))) * least(abs(z), 10) / 3000 / sqrt(2 * pi()) AS a FROM u)
SELECT symbol, n, round(sr, 6) AS sr, round(sqrt((1 + sr * sr / 2) / n), 7) AS se_normal, round(sqrt(shape / (n - 1)), 7) AS se_adjusted, round(1 + shape * pow(1.6448536269514722 / sr, 2), 2) AS min_track_record, round({_CDF}, 6) AS deflated_sharpe FROM v""")
def sharpe_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.sharpe_errors(st.moments(_returns(spark, sf_dir), ["symbol"], "ret"), trials=50)
    return s.select("symbol", "n", r("sr").alias("sr"), r("se_normal", 7).alias("se_normal"), r("se_adjusted", 7).alias("se_adjusted"),
                    r("min_track_record", 2).alias("min_track_record"), r("deflated_sharpe").alias("deflated_sharpe"))


@query("multiple_testing", _stats_sql(BARS_1H, 6240.0).split("SELECT condition_id, symbol, timeframe, forward_bars, n_samples, round(m")[0].rstrip() + """,
fam AS (SELECT condition_id, symbol, forward_bars, round(p, 9) AS p FROM pp), rk AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS m, count(*) OVER (PARTITION BY symbol ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM fam),
adj AS (SELECT *, min(p * m / k) OVER (PARTITION BY symbol ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bh FROM rk)
SELECT condition_id, symbol, forward_bars, round(least(1, p * m), 5) AS p_bonferroni, round(least(1, bh), 5) AS p_bh, least(1, bh) <= 0.05 AS rejected_bh FROM adj""")
def multiple_testing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All condition results of a symbol as one family of tests."""
    from barlens.operators.forward import condition_stats
    s = condition_stats(bars_1h(spark, sf_dir)).select("condition_id", "symbol", "forward_bars", F.round("p_value", 9).alias("p"))
    t = st.multiple_testing(s, ["symbol"], "p")
    return t.select("condition_id", "symbol", "forward_bars", r("p_bonferroni", 5).alias("p_bonferroni"), r("p_bh", 5).alias("p_bh"), "rejected_bh")


_ZV = st._normal_quantile(0.05)


@query("value_at_risk", f"""WITH {_RET}, {_MOM}, q AS (SELECT symbol, quantile_cont(ret, {1 - 0.95!r}) AS q FROM rt GROUP BY 1), c AS (SELECT symbol, -any_value(q) AS var, -avg(ret) FILTER (WHERE ret <= q) AS cvar FROM rt JOIN q USING (symbol) GROUP BY 1)
SELECT symbol, n, round(var, 6) AS var, round(cvar, 6) AS cvar, round(-(mean + std * ({_ZV!r} + {(_ZV * _ZV - 1) / 6!r} * skew + {(_ZV ** 3 - 3 * _ZV) / 24!r} * kurtosis - {(2 * _ZV ** 3 - 5 * _ZV) / 36!r} * skew * skew)), 6) AS cornish_fisher_var FROM c JOIN mm USING (symbol)""")
def value_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rr(st.value_at_risk(materialise(_returns(spark, sf_dir), "returns"), ["symbol"], "ret"), 6, "symbol", "n")


@query("correlation_matrix", f"""WITH {_RET} SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, round(corr(x.ret, y.ret), 6) AS corr FROM rt x JOIN rt y ON x.ts = y.ts AND x.symbol < y.symbol WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2""")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = st.correlation_matrix(materialise(_returns(spark, sf_dir), "returns"), "ret")
    return rr(df, 6, "a", "b", "n")


@query("tail_dependence", f"""WITH {_RET}, q AS (SELECT symbol, quantile_cont(ret, 0.1) AS q FROM rt GROUP BY 1), l AS (SELECT rt.symbol, ts, ret <= q AS low FROM rt JOIN q USING (symbol) WHERE ret IS NOT NULL)
SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, round(count(*) FILTER (WHERE x.low AND y.low) * 1.0 / nullif(count(*) FILTER (WHERE x.low), 0), 6) AS tail_dependence FROM l x JOIN l y ON x.ts = y.ts AND x.symbol < y.symbol GROUP BY 1, 2""")
def tail_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = st.tail_dependence(materialise(_returns(spark, sf_dir), "returns"), "ret")
    return rr(df, 6, "a", "b", "n")


@query("serial_dependence", f"""WITH {_RET}, l AS (SELECT *, lag(ret, 1) OVER {W_SQL} AS r1, lag(ret, 5) OVER {W_SQL} AS r5 FROM rt)
SELECT symbol, count(*) AS n, round(corr(ret, r1), 6) AS acf_1, round(corr(abs(ret), abs(r1)), 6) AS acf_abs_1, round(corr(abs(ret), r1), 6) AS leverage_1,
  round(corr(ret, r5), 6) AS acf_5, round(corr(abs(ret), abs(r5)), 6) AS acf_abs_5, round(corr(abs(ret), r5), 6) AS leverage_5 FROM l WHERE r5 IS NOT NULL GROUP BY 1""")
def serial_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compute(bars_1d(spark, sf_dir), [ind.returns("ret"), st.lag_columns("ret", [1, 5])])
    return rr(st.serial_dependence(df, ["symbol"], "ret", [1, 5]), 6, "symbol", "n")


@query("variance_ratio", f"""WITH {_RET}, m AS (SELECT *, ln(close / lag(close, 5) OVER {W_SQL}) AS l5 FROM rt), v AS (SELECT symbol, var_samp(l5) / (5 * var_samp(lr)) AS vr FROM m WHERE l5 IS NOT NULL GROUP BY 1)
SELECT symbol, round(vr, 6) AS variance_ratio, round(0.5 + ln(vr) / (2 * ln(5)), 6) AS hurst FROM v""")
def variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compute(bars_1d(spark, sf_dir), [ind.returns("lr", "log"), ind.returns("l5", "log", 5)])
    return rr(st.variance_ratio(df, ["symbol"], "lr", "l5", 5), 6, "symbol")


@query("mean_reversion", f"""WITH {_RET}, l AS (SELECT *, lag(close) OVER {W_SQL} AS c1 FROM rt), g AS (SELECT symbol, regr_slope(close - c1, c1) AS s, regr_intercept(close - c1, c1) AS i FROM l GROUP BY 1)
SELECT symbol, round(s, 6) AS slope, round(i, 3) AS intercept, round(CASE WHEN s < 0 AND s > -1 THEN -ln(2) / ln(1 + s) END, 5) AS half_life FROM g""")
def mean_reversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compute(bars_1d(spark, sf_dir), [sql_columns([], {"c1": lag_sql("close")}, before=1)])
    h = st.half_life(df, ["symbol"], "close", "c1")
    return h.select("symbol", r("slope").alias("slope"), r("intercept", 3).alias("intercept"), r("half_life", 5).alias("half_life"))


_EDGES = [-0.5, -0.1, 0.0, 0.2, 1.0]
_BIN = "(" + " + ".join(f"CAST(ret > {e} AS INTEGER)" for e in _EDGES) + ")"
_BINS = f"{_RET}, bn AS (SELECT *, {_BIN} AS cell, CASE WHEN volume > 25 THEN 1 ELSE 0 END AS vol_cell, ts >= TIMESTAMP '2000-01-01' AS late FROM rt WHERE ret IS NOT NULL)"


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _returns(spark, sf_dir).where("ret IS NOT NULL").withColumns({
        "cell": st.bin_of(F.col("ret"), _EDGES), "vol_cell": F.when(F.col("volume") > 25, 1).otherwise(0),
        "late": F.col("ts") >= F.lit("2000-01-01").cast("timestamp")})


@query("return_entropy", f"WITH {_BINS}, c AS (SELECT symbol, cell, count(*) AS c FROM bn GROUP BY 1, 2) SELECT symbol, CAST(sum(c) AS BIGINT) AS n, round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 7) AS entropy FROM c GROUP BY 1")
def return_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rr(st.entropy(_binned(spark, sf_dir), ["symbol"], "cell"), 7, "symbol", "n")


@query("rolling_entropy", f"""WITH {_BINS}, w AS (SELECT *, {', '.join(f"count(*) FILTER (WHERE cell = {i}) OVER w AS b{i}" for i in range(6))}, count(*) OVER w AS k FROM bn WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT symbol, {TS_SQL}, round(-({' + '.join(f"CASE WHEN b{i} > 0 THEN b{i} / 50.0 * ln(b{i} / 50.0) ELSE 0 END" for i in range(6))}), 6) + 0.0 AS entropy FROM w WHERE k = 50""")
def rolling_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = _BIN.replace("CAST(ret", "int(ret").replace(" AS INTEGER)", ")")
    steps = [ind.returns("ret"), sql_columns(["ret"], {"cell": cell}), *st.rolling_entropy("entropy", "cell", 6, 50)]
    df = compute(bars_1d(spark, sf_dir), steps).where("entropy IS NOT NULL")
    return df.select("symbol", ts_text().alias("ts"), r("entropy").alias("entropy"))


@query("distribution_drift", f"""WITH {_BINS}, c AS (SELECT symbol, cell, count(*) FILTER (WHERE late) AS a, count(*) FILTER (WHERE NOT late) AS b FROM bn GROUP BY 1, 2),
t AS (SELECT *, (a + 1.0) / (sum(a) OVER (PARTITION BY symbol) + count(*) OVER (PARTITION BY symbol)) AS p, (b + 1.0) / (sum(b) OVER (PARTITION BY symbol) + count(*) OVER (PARTITION BY symbol)) AS q FROM c)
SELECT symbol, round(sum(p * ln(p / q)), 7) AS kl, round(sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2), 7) AS js FROM t GROUP BY 1""")
def distribution_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rr(st.divergence(_binned(spark, sf_dir), ["symbol"], "cell", "late"), 7, "symbol")


@query("mutual_information", f"""WITH {_BINS}, j AS (SELECT symbol, cell, vol_cell, count(*) AS c FROM bn GROUP BY 1, 2, 3),
k AS (SELECT *, sum(c) OVER (PARTITION BY symbol, cell) AS cx, sum(c) OVER (PARTITION BY symbol, vol_cell) AS cy, sum(c) OVER (PARTITION BY symbol) AS t FROM j)
SELECT symbol, CAST(max(t) AS BIGINT) AS n, round(sum(c / t * ln(c * t / (cx::DOUBLE * cy))), 7) AS mutual_information FROM k GROUP BY 1""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rr(st.mutual_information(_binned(spark, sf_dir), ["symbol"], "cell", "vol_cell"), 7, "symbol", "n")


@query("transfer_entropy", f"""WITH {_RET}, b0 AS (SELECT *, {_BIN} AS cell, CASE WHEN volume > 25 THEN 1 ELSE 0 END AS vol_cell FROM rt), bn AS (SELECT *, lead(cell) OVER {W_SQL} AS nxt FROM b0 WHERE ret IS NOT NULL),
j AS (SELECT symbol, vol_cell, cell, nxt, count(*) AS c FROM bn WHERE nxt IS NOT NULL GROUP BY 1, 2, 3, 4),
k AS (SELECT *, sum(c) OVER (PARTITION BY symbol, vol_cell, cell) AS cst, sum(c) OVER (PARTITION BY symbol, cell, nxt) AS ctn, sum(c) OVER (PARTITION BY symbol, cell) AS ct, sum(c) OVER (PARTITION BY symbol) AS t FROM j)
SELECT symbol, round(sum(c / t * ln(c::DOUBLE * ct / (cst::DOUBLE * ctn))), 7) AS transfer_entropy FROM k GROUP BY 1""")
def transfer_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = _BIN.replace("CAST(ret", "int(ret").replace(" AS INTEGER)", ")")
    nxt = "lead(cell) OVER (PARTITION BY symbol, timeframe, _blk ORDER BY ts)"
    df = compute(bars_1d(spark, sf_dir), [
        ind.returns("ret"), sql_columns(["ret"], {"cell": cell, "vol_cell": "CASE WHEN volume > 25 THEN 1 ELSE 0 END"}), sql_columns(["cell"], {"nxt": nxt}, after=1)])
    return rr(st.transfer_entropy(df.where("ret IS NOT NULL"), ["symbol"], "vol_cell", "cell", "nxt"), 7, "symbol")


_FD = " + ".join(f"({w!r}) * {'close' if k == 0 else f'lag(close, {k}) OVER {W_SQL}'}" for k, w in enumerate(st.fracdiff_weights(0.4, 20)))


@query("fractional_difference", f"WITH {BARS_1D}, x AS (SELECT symbol, ts, {_FD} AS fd FROM bars) SELECT symbol, {TS_SQL}, round(fd, 3) + 0.0 AS fracdiff FROM x WHERE fd IS NOT NULL")
def fractional_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compute(bars_1d(spark, sf_dir), [st.fractional_difference("fracdiff", "close", 0.4, 20)]).where("fracdiff IS NOT NULL")
    return df.select("symbol", ts_text().alias("ts"), r("fracdiff", 3).alias("fracdiff"))


@query("realised_variance", f"""WITH {BARS_1H}, l AS (SELECT *, ln(close / lag(close) OVER {W_SQL}) AS ret FROM bars), d AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(ret * ret) AS rv FROM l WHERE ret IS NOT NULL GROUP BY 1, 2)
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, round(rv, 7) AS rv, {', '.join(f"round(CASE WHEN count(rv) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN avg(rv) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END, 7) AS {a}" for n, a in ((1, 'rv_day'), (5, 'rv_week'), (22, 'rv_month')))} FROM d""")
def realised_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = st.realised_variance(compute(bars_1h(spark, sf_dir), [ind.returns("ret", "log")]), ["symbol"])
    return v.select("symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), *[r(c, 7).alias(c) for c in ("rv", "rv_day", "rv_week", "rv_month")])


@query("volume_profile", f"""WITH {BARS_1H}, h AS (SELECT symbol, hour(ts) AS hour, sum(volume) AS volume FROM bars GROUP BY 1, 2)
SELECT symbol, CAST(hour AS INTEGER) AS hour, round(volume, 3) AS volume, round(volume / sum(volume) OVER (PARTITION BY symbol), 7) AS vwap_share, round(1.0 / count(*) OVER (PARTITION BY symbol), 7) AS twap_share FROM h""")
def volume_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = st.volume_profile(bars_1h(spark, sf_dir), ["symbol"])
    return p.select("symbol", "hour", r("volume", 3).alias("volume"), r("vwap_share", 7).alias("vwap_share"), r("twap_share", 7).alias("twap_share"))


_IMPACT = f"""lr AS (SELECT symbol, volume, ln(close / lag(close) OVER {W_SQL}) AS ret FROM bars),
m AS (SELECT symbol, stddev_samp(ret) AS volatility, avg(volume) AS volume FROM lr GROUP BY symbol)"""


@query("market_impact", f"""WITH {BARS_1D}, {_IMPACT} SELECT symbol, size_share, round(volatility, 8) AS volatility, round(volume, 3) AS volume, round(1.0 * volatility * sqrt(size_share), 8) AS impact FROM m, (VALUES (CAST(0.001 AS DOUBLE)), (0.01), (0.1)) q(size_share)""")
def market_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square-root impact of orders of a thousandth, a hundredth and a tenth of a symbol's mean daily volume."""
    rets = compute(bars_1d(spark, sf_dir), [ind.returns("ret", "log")])
    m = rets.groupBy("symbol").agg(F.stddev_samp("ret").alias("volatility"), F.avg("volume").alias("volume"))
    grid = m.select("*", F.explode(F.array(*[F.lit(x) for x in (0.001, 0.01, 0.1)])).alias("size_share"))
    impact = st.square_root_impact(F.col("volatility"), F.col("size_share") * F.col("volume"), F.col("volume"))
    return grid.select("symbol", "size_share", r("volatility", 8).alias("volatility"), r("volume", 3).alias("volume"), r(impact, 8).alias("impact"))
