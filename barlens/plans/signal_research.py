"""Entry signals, their forward statistics, and the verdicts drawn from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.functions.core import KEYS, r, sharpe_from_t, ts_text
from barlens.operators import forward as fwd
from barlens.operators import indicators as ind
from barlens.operators import signals as sig
from barlens.operators.blocks import compute
from barlens.operators.recurrence import ewm, span_alpha, wilder_alpha
from barlens.operators.sweep import long_enough, param_grid, sweep
from barlens.plans.catalog import (
    BARS_1D, BARS_1H, DIFFS, RN, TS_SQL, W_SQL, bars_1d, bars_1h, ema_sql, ewm_sql, query, roll_sql,
)
from barlens.plans.condition_research import _P_SQL, _stats, _stats_sql

SPECS = sig.catalogue()
FLIPS = [s for s in SPECS if "st_dir" in s.long or "psar" in s.long]
STEP = 0.5  # distance of round levels for prices near 100


def _of(category: str) -> list[sig.Spec]:
    return [s for s in SPECS if s.category == category and s not in FLIPS]


def _columns_sql() -> str:
    emas = (5, 8, 9, 10, 12, 13, 17, 19, 20, 21, 26, 30, 34, 35, 39, 50, 100, 200)
    macds = ((12, 26, 9), (8, 17, 9), (5, 35, 5), (19, 39, 9))
    adxs, rsis, atrs = (10, 14, 20), (7, 10, 14, 21, 28), (7, 10, 14, 20)
    d = "(PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    run = "(PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"

    def before(n: int, m: int) -> str:
        return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND {m} PRECEDING)"

    def upto(agg: str, n: int, m: int) -> str:
        return f"CASE WHEN count(*) OVER {before(n, m)} = {n - m + 1} THEN {agg} OVER {before(n, m)} END"

    l1 = [f"{ema_sql('close', p)} AS ema{p}" for p in emas]
    l1 += [f"{ewm_sql('tr', f'1.0/{p}')} AS atr{p}" for p in atrs]
    l1 += [f"{ewm_sql(x, f'1.0/{p}', 1)} AS _{x}{p}" for p in rsis for x in ("gain", "loss")]
    l1 += [f"{ewm_sql(x, f'1.0/{p}', 1)} AS _{x}{p}" for p in adxs for x in ("pdm", "mdm", "tr1")]
    l1 += [f"{ema_sql('obv', p)} AS obve{p}" for p in (10, 20, 30)]
    l1 += [f"{roll_sql('avg(close)', p)} AS sma{p}, {roll_sql('stddev_samp(close)', p)} AS _sd{p}" for p in (10, 20, 30, 50, 200)]
    l1 += [f"{roll_sql('max(high)', p)} AS _hh{p}, {roll_sql('min(low)', p)} AS _ll{p}" for p in (5, 9, 10, 14, 21)]
    l1 += [f"100 * (close / lag(close, {p}) OVER {W_SQL} - 1) AS roc{p}" for p in (9, 14, 20)]
    l1 += [f"{roll_sql('avg(tp)', p)} AS _m{p}, {roll_sql('list(tp)', p)} AS _tps{p}" for p in (14, 20, 30)]
    l1 += [f"{roll_sql('sum(mfv)', p)} / nullif({roll_sql('sum(volume)', p)}, 0) AS cmf{p}" for p in (10, 20)]
    l1 += [f"100 * {roll_sql('sum(pf)', p, x='pf')} / nullif({roll_sql('sum(pf)', p, x='pf')} + {roll_sql('sum(nf)', p, x='nf')}, 0) AS mfi{p}" for p in (10, 14)]
    l1 += [f"{upto('max(high)', 20, 1)} AS hh20, {upto('min(low)', 20, 1)} AS ll20"]
    l1 += [f"last_value(_{x}{k} IGNORE NULLS) OVER {run} AS {x}{k}" for k in (10, 20, 30) for x in ("swl", "swh")]
    swings = ", ".join(
        f"CASE WHEN count({x}) OVER {before(2 * k, k + 1)} = {k} AND lag({x}, {k}) OVER {W_SQL} {sign} {agg}({x}) OVER {before(2 * k, k + 1)} "
        f"AND lag({x}, {k}) OVER {W_SQL} {sign} {agg}({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) "
        f"THEN lag({x}, {k}) OVER {W_SQL} END AS _{name}{k}"
        for k in (10, 20, 30) for name, x, agg, sign in (("swl", "low", "min", "<"), ("swh", "high", "max", ">")))
    l2 = [f"100 - 100 / (1 + _gain{p} / nullif(_loss{p}, 0)) AS rsi{p}" for p in rsis]
    l2 += [f"ema{f} - ema{s} AS macd_{f}_{s}" for f, s, _ in macds]
    l2 += [f"100 * _pdm{p} / nullif(_tr1{p}, 0) AS pdi{p}, 100 * _mdm{p} / nullif(_tr1{p}, 0) AS mdi{p}, "
           f"coalesce(100 * abs(_pdm{p} - _mdm{p}) / nullif(_pdm{p} + _mdm{p}, 0), 0) AS _dx{p}" for p in adxs]
    l2 += [f"ema{p} + {k / 10} * atr{p} AS kcu{p}_{k}, ema{p} - {k / 10} * atr{p} AS kcl{p}_{k}" for p in (10, 20) for k in (15, 20, 25)]
    l2 += [f"sma{p} + {k / 10} * _sd{p} AS bbu{p}_{k}, sma{p} - {k / 10} * _sd{p} AS bbl{p}_{k}, "
           f"CASE WHEN abs(close - sma{p}) <= {k / 10} * _sd{p} THEN 1 ELSE 0 END AS _in{p}_{k}" for p in (10, 20, 30) for k in (15, 20, 25)]
    l2 += [f"-100 * (_hh{p} - close) / nullif(_hh{p} - _ll{p}, 0) AS willr{p}" for p in (10, 14, 21)]
    l2 += [f"100 * (close - _ll{p}) / nullif(_hh{p} - _ll{p}, 0) AS _raw{p}" for p in (5, 9, 14, 21)]
    l2 += [f"(tp - _m{p}) / nullif(0.015 * list_sum(list_transform(_tps{p}, lambda t: abs(t - _m{p}))) / {p}, 0) AS cci{p}" for p in (14, 20, 30)]
    l2 += ["4.0 * _sd20 / sma20 AS bbw20"]
    l2 += [f"{roll_sql(f'avg(atr{p})', 20, x=f'atr{p}')} AS atrm{p}" for p in atrs]
    l3 = [f"{ema_sql(f'macd_{f}_{s}', g)} AS macds_{f}_{s}_{g}" for f, s, g in macds]
    l3 += [f"{ewm_sql(f'_dx{p}', f'1.0/{p}', 1)} AS adx{p}" for p in adxs]
    l3 += [f"{roll_sql(f'avg(_raw{p})', 3, x=f'_raw{p}')} AS stoch{p}" for p in (5, 9, 14, 21)]
    l3 += [f"{roll_sql('avg(bbw20)', 20, x='bbw20')} AS bbwm20"]
    l3 += [f"sum(_in{p}_{k}) OVER {before(3, 1)} AS bbin{p}_{k}" for p in (10, 20, 30) for k in (15, 20, 25)]
    l4 = [f"macd_{f}_{s} - macds_{f}_{s}_{g} AS macdh_{f}_{s}_{g}" for f, s, g in macds]
    _, lagged = sig.columns_of([s for s in SPECS if s not in FLIPS])
    l5 = [f"lag({c}) OVER {W_SQL} AS {c}_1" for c in sorted(lagged)]
    return f"""{BARS_1H}, {RN}, {DIFFS},
days AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2),
levels AS (SELECT symbol, day, lag(h) OVER w AS prior_high, lag(l) OVER w AS prior_low, lag(c) OVER w AS plc FROM days WINDOW w AS (PARTITION BY symbol ORDER BY day)),
joined AS (SELECT tr.*, prior_high, prior_low, plc FROM tr JOIN levels ON tr.symbol = levels.symbol AND CAST(tr.ts AS DATE) = levels.day),
k0 AS (SELECT *, 2 * ((prior_high + prior_low + plc) / 3) - prior_high AS s1, 2 * ((prior_high + prior_low + plc) / 3) - prior_low AS r1,
  (high + low + close) / 3 AS tp, coalesce((2 * close - high - low) / nullif(high - low, 0), 0) * volume AS mfv,
  high - lag(high) OVER {W_SQL} AS rise, lag(low) OVER {W_SQL} - low AS fall, coalesce(sign(close - pc) * volume, 0) AS dv,
  ceil(pc / {STEP}) * {STEP} AS rnd_up, floor(pc / {STEP}) * {STEP} AS rnd_dn, {swings}
  FROM joined),
k1 AS (SELECT *, CASE WHEN rise IS NOT NULL THEN CASE WHEN rise > fall AND rise > 0 THEN rise ELSE 0 END END AS pdm,
  CASE WHEN rise IS NOT NULL THEN CASE WHEN fall > rise AND fall > 0 THEN fall ELSE 0 END END AS mdm, tr AS tr1,
  sum(dv) OVER {run} AS obv, lag(tp) OVER {W_SQL} AS ptp,
  sum(tp * volume) OVER {d} / sum(volume) OVER {d} AS vwap, sum(tp * tp * volume) OVER {d} / sum(volume) OVER {d} AS vm2 FROM k0),
k2 AS (SELECT *, CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp > ptp THEN tp * volume ELSE 0 END END AS pf,
  CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp < ptp THEN tp * volume ELSE 0 END END AS nf,
  vwap + sqrt(greatest(vm2 - vwap * vwap, 0)) AS vwap_upper, vwap - sqrt(greatest(vm2 - vwap * vwap, 0)) AS vwap_lower FROM k1),
l1 AS (SELECT *, {', '.join(l1)} FROM k2), l2 AS (SELECT *, {', '.join(l2)} FROM l1), l3 AS (SELECT *, {', '.join(l3)} FROM l2),
l4 AS (SELECT *, {', '.join(l4)} FROM l3), l5 AS (SELECT *, {', '.join(l5)} FROM l4)"""


_COLUMNS = _columns_sql()


def _signals_ctes(specs: list[sig.Spec]) -> str:
    states = ", ".join(f"CASE WHEN {s.long} THEN 1 WHEN {s.short} THEN -1 ELSE 0 END AS \"{s.spec_id}\"" for s in specs)
    leads = ", ".join(f"ln(lead(close, {h}) OVER {W_SQL} / close) AS fwd{h}" for h in (5, 10, 20, 50))
    names = ", ".join(f'"{s.spec_id}"' for s in specs)
    return f"""{_COLUMNS},
st AS (SELECT symbol, timeframe, ts, close, ema200, {leads}, {states} FROM l5),
su AS (UNPIVOT st ON {names} INTO NAME spec_id VALUE state),
sl AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY symbol, spec_id ORDER BY ts), 0) AS prev FROM su),
sigs AS (SELECT *, state AS signal, coalesce((state = 1 AND close > ema200) OR (state = -1 AND close < ema200), false) AS with_trend
  FROM sl WHERE state <> 0 AND state <> prev)"""


def _signals_sql(category: str) -> str:
    return f"WITH {_signals_ctes(_of(category))} SELECT symbol, {TS_SQL}, spec_id, CAST(signal AS INTEGER) AS signal, with_trend FROM sigs"


def _signals(spark: SparkSession, sf_dir: str, specs: list[sig.Spec]) -> DataFrame:
    found = sig.signals_long(bars_1h(spark, sf_dir), specs, round_step=STEP)
    return found.select("symbol", ts_text().alias("ts"), "spec_id", "signal", "with_trend")


def _register(category: str) -> None:
    @query(f"signals_{category}", _signals_sql(category))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _signals(spark, sf_dir, _of(category))


for _category in ("momentum", "trend", "volatility", "volume", "structure", "combo"):
    _register(_category)


def _flip_ctes() -> str:
    atrs = ", ".join(f"{ewm_sql('tr', f'1.0/{p}')} AS atr{p}" for p in (7, 10, 14))
    st = ", ".join(f"({i}, {p}, {m})" for i, (p, m) in enumerate(sig.SUPERTREND_VARIANTS))
    ps = ", ".join(f"({i}, {s}, {m})" for i, (s, m) in enumerate(sig.PSAR_VARIANTS))
    sid = "CASE v " + " ".join(f"WHEN {i} THEN 'SUPERTREND_{p}_{int(m * 10)}'" for i, (p, m) in enumerate(sig.SUPERTREND_VARIANTS)) + " END"
    pid = "CASE v " + " ".join(f"WHEN {i} THEN 'PSAR_{int(s * 100)}_{int(m * 10)}'" for i, (s, m) in enumerate(sig.PSAR_VARIANTS)) + " END"
    return f"""WITH RECURSIVE {BARS_1H}, {RN}, {DIFFS},
a AS (SELECT *, (high + low) / 2 AS mid, {atrs}, {ewm_sql('gain', '1.0/14', 1)} AS ag, {ewm_sql('loss', '1.0/14', 1)} AS al, {ema_sql('close', 200)} AS ema200,
  coalesce(lag(low) OVER {W_SQL}, low) AS l1, coalesce(lag(high) OVER {W_SQL}, high) AS h1,
  coalesce(lag(low, 2) OVER {W_SQL}, lag(low) OVER {W_SQL}, low) AS l2, coalesce(lag(high, 2) OVER {W_SQL}, lag(high) OVER {W_SQL}, high) AS h2 FROM tr),
sv(v, p, m) AS (VALUES {st}), pv(v, step, top) AS (VALUES {ps}),
b AS (SELECT a.*, v, m, CASE p WHEN 7 THEN atr7 WHEN 10 THEN atr10 ELSE atr14 END AS atr FROM a, sv),
c AS (SELECT a.*, v, step::DOUBLE AS step, top::DOUBLE AS top FROM a, pv),
s1 AS (SELECT symbol, v, rn, ts, 1 AS d, mid + m * atr AS up, mid - m * atr AS low FROM b WHERE rn = 0
  UNION ALL SELECT symbol, v, rn, ts, d, CASE WHEN d < 0 AND nu > up THEN up ELSE nu END, CASE WHEN d > 0 AND nl < low THEN low ELSE nl END FROM
  (SELECT b.symbol, b.v, b.rn, b.ts, CASE WHEN b.close > s1.up THEN 1 WHEN b.close < s1.low THEN -1 ELSE s1.d END AS d,
    b.mid + b.m * b.atr AS nu, b.mid - b.m * b.atr AS nl, s1.up, s1.low FROM s1 JOIN b ON b.symbol = s1.symbol AND b.v = s1.v AND b.rn = s1.rn + 1)),
p1 AS (SELECT symbol, v, rn, ts, 1 AS trend, low AS sar, high AS ep, step AS af FROM c WHERE rn = 0
  UNION ALL SELECT symbol, v, rn, ts, CASE WHEN flip THEN -trend ELSE trend END, CASE WHEN flip THEN ep ELSE nxt END,
    CASE WHEN flip THEN (CASE WHEN trend > 0 THEN low ELSE high END) WHEN trend > 0 THEN greatest(ep, high) ELSE least(ep, low) END,
    CASE WHEN flip THEN step WHEN (trend > 0 AND high > ep) OR (trend < 0 AND low < ep) THEN least(af + step, top) ELSE af END FROM
  (SELECT *, CASE WHEN trend > 0 THEN low < nxt ELSE high > nxt END AS flip FROM
    (SELECT c.symbol, c.v, c.rn, c.ts, c.low, c.high, c.step, c.top, p1.trend, p1.ep, p1.af,
      CASE WHEN p1.trend > 0 THEN least(p1.sar + p1.af * (p1.ep - p1.sar), c.l1, c.l2) ELSE greatest(p1.sar + p1.af * (p1.ep - p1.sar), c.h1, c.h2) END AS nxt
     FROM p1 JOIN c ON c.symbol = p1.symbol AND c.v = p1.v AND c.rn = p1.rn + 1))),
rr AS (SELECT symbol, rn, ts, close, ema200, 100 - 100 / (1 + ag / nullif(al, 0)) AS rsi FROM a),
q AS (SELECT *, lag(rsi) OVER (PARTITION BY symbol ORDER BY rn) AS rsi1, lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS c1 FROM rr),
e AS (SELECT symbol, rn, {sid} AS spec_id, CASE WHEN d = 1 AND pd = -1 THEN 1 WHEN d = -1 AND pd = 1 THEN -1 ELSE 0 END AS state
   FROM (SELECT *, lag(d) OVER (PARTITION BY symbol, v ORDER BY rn) AS pd FROM s1)
  UNION ALL SELECT x.symbol, x.rn, {pid}, CASE WHEN q.close > sar AND c1 <= ps THEN 1 WHEN q.close < sar AND c1 >= ps THEN -1 ELSE 0 END
   FROM (SELECT *, lag(sar) OVER (PARTITION BY symbol, v ORDER BY rn) AS ps FROM p1) x JOIN q USING (symbol, rn)
  UNION ALL SELECT s1.symbol, s1.rn, 'SUPERTREND_RSI_pullback', CASE WHEN d = 1 AND rsi > 40 AND rsi1 <= 40 THEN 1 WHEN d = -1 AND rsi < 60 AND rsi1 >= 60 THEN -1 ELSE 0 END
   FROM s1 JOIN q USING (symbol, rn) WHERE v = 1),
f AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY symbol, spec_id ORDER BY rn), 0) AS prev FROM e)"""


_WITH_TREND = "coalesce((state = 1 AND close > ema200) OR (state = -1 AND close < ema200), false) AS with_trend"


def _flip_sql() -> str:
    return f"""{_flip_ctes()}
SELECT symbol, {TS_SQL}, spec_id, CAST(state AS INTEGER) AS signal,
  {_WITH_TREND}
FROM f JOIN q USING (symbol, rn) WHERE state <> 0 AND state <> prev"""


def _flip_signals_ctes() -> str:
    """The state machines' signals with what follows them, named as in ``_signals_ctes``."""
    leads = ", ".join(f"ln(lead(close, {h}) OVER {W_SQL} / close) AS fwd{h}" for h in (5, 10, 20, 50))
    return f"""{_flip_ctes()},
ld AS (SELECT symbol, timeframe, rn, {leads} FROM numbered),
sigs AS (SELECT symbol, timeframe, q.ts, spec_id, state, state AS signal, fwd5, fwd10, fwd20, fwd50,
  {_WITH_TREND}
  FROM f JOIN q USING (symbol, rn) JOIN ld USING (symbol, rn) WHERE state <> 0 AND state <> prev)"""


@query("signals_trend_flips", _flip_sql())
def signals_trend_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SuperTrend and PSAR signals, whose state passes from bar to bar."""
    return _signals(spark, sf_dir, FLIPS)


# --- forward statistics ---------------------------------------------------------

# the state machines, whose SQL is recursive, have queries of their own, as in signals_trend_flips;
# no family of variants has members on both sides
_SWEPT = [s for s in SPECS if s not in FLIPS]
_STAT_CTES = f""",
rp AS (SELECT *, unnest(CASE WHEN with_trend THEN [false, true] ELSE [false] END) AS regime_filter FROM sigs),
fr AS ({' UNION ALL '.join(f"SELECT spec_id, regime_filter, symbol, timeframe, CAST({h} AS INTEGER) AS horizon, signal, fwd{h} * signal AS ret FROM rp WHERE fwd{h} IS NOT NULL" for h in (5, 10, 20, 50))}),
sd AS (SELECT *, 'both' AS side FROM fr UNION ALL SELECT *, CASE WHEN signal > 0 THEN 'long' ELSE 'short' END FROM fr),
ag AS (SELECT spec_id, regime_filter, symbol, timeframe, horizon, side, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit, avg(ret) AS m,
  stddev_samp(ret) AS sd, sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / nullif(abs(sum(CASE WHEN ret < 0 THEN ret ELSE 0 END)), 0) AS pf FROM sd GROUP BY ALL),
tt AS (SELECT *, n AS n_samples, m / nullif(sd / sqrt(n), 0) AS t FROM ag),
stats AS (SELECT spec_id, regime_filter, symbol, timeframe, horizon, side, n, CASE WHEN n >= 10 THEN hit END AS hit_rate, CASE WHEN n >= 10 THEN m END AS avg_log_return,
  CASE WHEN n >= 10 THEN pf END AS profit_factor, CASE WHEN n >= 10 THEN t END AS t_stat, CASE WHEN n >= 10 THEN {_P_SQL} END AS p_value FROM tt)"""
_STAT_SQL = f"WITH {_signals_ctes(_SWEPT)}" + _STAT_CTES
_FLIP_STAT_SQL = _flip_signals_ctes() + _STAT_CTES


def swept_stats(spark: SparkSession, sf_dir: str, specs: list[sig.Spec]) -> DataFrame:
    found = sig.with_regime_param(sig.signals_long(bars_1h(spark, sf_dir), specs, horizons=(5, 10, 20, 50), round_step=STEP))
    return fwd.signal_stats(found, keys=["spec_id", "regime_filter", *KEYS])


_SIGNAL_STATS = """
SELECT spec_id, regime_filter, symbol, timeframe, horizon, side, n, round(hit_rate, 6) AS hit_rate, round(avg_log_return, 7) AS avg_log_return,
  round(profit_factor, 5) AS profit_factor, round(t_stat, 4) AS t_stat, round(p_value, 5) AS p_value FROM stats"""


def _signal_stats(spark: SparkSession, sf_dir: str, specs: list[sig.Spec]) -> DataFrame:
    s = swept_stats(spark, sf_dir, specs)
    return s.select("spec_id", "regime_filter", *KEYS, "horizon", "side", "n", r("hit_rate").alias("hit_rate"),
                    r("avg_log_return", 7).alias("avg_log_return"), r("profit_factor", 5).alias("profit_factor"),
                    r("t_stat", 4).alias("t_stat"), r("p_value", 5).alias("p_value"))


_BEST_VARIANT = """,
named AS (SELECT *, split_part(spec_id, '_', 1) AS family FROM stats WHERE horizon = 5 AND side = 'both' AND profit_factor IS NOT NULL
  AND (symbol, timeframe) IN (SELECT (symbol, timeframe) FROM bars GROUP BY symbol, timeframe HAVING count(*) >= 200)),
k AS (SELECT *, row_number() OVER (PARTITION BY family, symbol, timeframe ORDER BY round(profit_factor, 9) DESC, spec_id, regime_filter) AS rank FROM named)
SELECT family, symbol, spec_id, regime_filter, n, round(profit_factor, 5) AS profit_factor, rank FROM k WHERE rank <= 3"""


def _best_variant(spark: SparkSession, sf_dir: str, specs: list[sig.Spec]) -> DataFrame:
    """Best three parameter variants per indicator family and symbol by profit factor five bars ahead."""
    s = swept_stats(spark, sf_dir, specs).where("horizon = 5 AND side = 'both'")
    s = long_enough(s, bars_1h(spark, sf_dir))
    s = s.withColumn("family", F.split_part("spec_id", F.lit("_"), F.lit(1))).withColumns(
        {"_order": F.struct("spec_id", "regime_filter"), "_pf": F.round("profit_factor", 9)})
    best = sweep(s, by=["family", *KEYS], metric="_pf", order="_order", keep=3)
    return best.select("family", "symbol", "spec_id", "regime_filter", "n", r("profit_factor", 5).alias("profit_factor"),
                       F.col("rank").cast("long"))


_KNOWLEDGE = """
SELECT spec_id, symbol, horizon, CASE WHEN coalesce(profit_factor >= 1.4 AND hit_rate >= 0.53 AND t_stat >= 1.8 AND p_value < 0.10, false) THEN 'works'
  WHEN coalesce(profit_factor <= 0.8 OR (t_stat <= -1.5 AND hit_rate <= 0.47), false) THEN 'fails' ELSE 'partial' END AS category,
  coalesce(round(least(greatest(1 - round(p_value, 6), 0), 1), 2), 0.5) AS confidence, CASE WHEN n >= 10 THEN round(t_stat / sqrt(n) * sqrt(252), 2) END AS sharpe
FROM stats WHERE side = 'both' AND NOT regime_filter"""


def _knowledge(spark: SparkSession, sf_dir: str, specs: list[sig.Spec]) -> DataFrame:
    s = swept_stats(spark, sf_dir, specs).where("side = 'both' AND NOT regime_filter")
    c = F.col
    return s.select(
        "spec_id", "symbol", "horizon",
        fwd.categorise_entry(c("profit_factor"), c("hit_rate"), c("t_stat"), c("p_value")).alias("category"),
        fwd.confidence_from_p(F.round("p_value", 6)).alias("confidence"),
        (sharpe_from_t(c("t_stat"), c("n")) + F.lit(0.0)).alias("sharpe"))


def _register_swept(name: str, sql: str, fn: Callable[[SparkSession, str, list[sig.Spec]], DataFrame]) -> None:
    query(name, _STAT_SQL + sql)(lambda spark, sf_dir: fn(spark, sf_dir, _SWEPT))
    query(f"{name}_flips", _FLIP_STAT_SQL + sql)(lambda spark, sf_dir: fn(spark, sf_dir, FLIPS))


_register_swept("signal_stats", _SIGNAL_STATS, _signal_stats)
_register_swept("sweep_best_variant", _BEST_VARIANT, _best_variant)
_register_swept("entry_knowledge", _KNOWLEDGE, _knowledge)


@query("param_grid", """
WITH p AS (SELECT unnest([10, 14, 21]) AS period), t AS (SELECT unnest([25, 30]) AS threshold), f AS (SELECT unnest([false, true]) AS regime_filter)
SELECT symbol, period, threshold, regime_filter, '{"period":' || period || ',"regime_filter":' || regime_filter || ',"threshold":' || threshold || '}' AS params_id
FROM (SELECT DISTINCT event_type AS symbol FROM events), p, t, f""")
def param_grid_per_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlens.session import table
    symbols = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    grid = param_grid(spark, {"period": [10, 14, 21], "threshold": [25, 30], "regime_filter": [False, True]})
    # the grid has as many rows as its lists multiply to, fixed by the caller
    return symbols.crossJoin(F.broadcast(grid)).select("symbol", "period", "threshold", "regime_filter", "params_id")


# --- the result table as the pages read it --------------------------------------


@query("viable_conditions", _stats_sql(BARS_1H, 6240.0).replace("FROM pp", "FROM pp WHERE abs(m) >= 0.0012") )
def viable_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition results whose mean return covers three times the round-trip cost."""
    from barlens.operators.forward import condition_stats, cost_viable
    s = condition_stats(bars_1h(spark, sf_dir)).where(cost_viable(F.col("mean_return")))
    return s.select(
        "condition_id", *KEYS, "forward_bars", "n_samples",
        *[r(c, 7).alias(c) for c in ("mean_return", "std_return", "median_return")], r("hit_rate").alias("hit_rate"),
        r("t_stat", 4).alias("t_stat"), r("p_value", 5).alias("p_value"), r("sharpe", 4).alias("sharpe"), "is_significant")


@query("bullish_conditions", _stats_sql(BARS_1H, 6240.0, (4,)).split("SELECT condition_id, symbol, timeframe, forward_bars, n_samples, round(m")[0] + """
SELECT condition_id, symbol, n_samples, round(hit_rate, 6) AS hit_rate, 'bull' AS direction FROM pp WHERE coalesce(hit_rate, 0.5) > 0.5 AND timeframe IN ('4h', '1d', '1h')
ORDER BY round(abs(t), 6) DESC, condition_id, symbol LIMIT 40""")
def bullish_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest results that point up; the direction is filtered before the limit."""
    s = fwd.condition_stats(bars_1h(spark, sf_dir), horizons=[4]).withColumn("direction", fwd.direction_of(F.col("hit_rate")))
    s = s.where((F.col("direction") == "bull") & F.col("timeframe").isin("4h", "1d", "1h"))
    top = s.orderBy(F.desc(F.round(F.abs("t_stat"), 6)), "condition_id", "symbol").limit(40)
    return top.select("condition_id", "symbol", "n_samples", r("hit_rate").alias("hit_rate"), "direction")


_FEATURE = f"""{BARS_1D}, {RN}, {DIFFS}, a AS (SELECT *, {ewm_sql('gain', '1.0/14', 1)} AS ag, {ewm_sql('loss', '1.0/14', 1)} AS al,
  {ema_sql('close', 50)} AS ema50, lead(close, 1) OVER {W_SQL} / close - 1 AS ret FROM tr),
f AS (SELECT *, round(100 - 100 / (1 + ag / nullif(al, 0)), 1) AS rsi, close > ema50 AS trend FROM a)"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute(bars_1d(spark, sf_dir), [
        ind.rsi_inputs(), ewm([("g", "gain", wilder_alpha(14)), ("s", "loss", wilder_alpha(14)), ("ema50", "close", span_alpha(50))]),
        ind.rsi_value("rsi_raw", "g", "s"), fwd.forward_return("ret", 1)]).select(
            "symbol", F.round("rsi_raw", 1).alias("rsi"), F.expr("close > ema50").alias("trend"), "ret")


@query("feature_forward_corr", f"""WITH {_FEATURE}, k AS (SELECT symbol, rsi, ret,
  rank() OVER (PARTITION BY symbol ORDER BY rsi) + (count(*) OVER (PARTITION BY symbol, rsi) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY symbol ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2.0 AS b FROM f WHERE rsi IS NOT NULL AND ret IS NOT NULL)
SELECT symbol, count(*) AS n, round(corr(rsi, ret), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM k GROUP BY symbol""")
def feature_forward_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fwd.feature_forward_corr(_features(spark, sf_dir), ["symbol"], "rsi", "ret")
    return c.select("symbol", "n", r("pearson").alias("pearson"), r("spearman").alias("spearman"))


@query("two_sample_tests", f"""WITH {_FEATURE}, k AS (SELECT symbol, trend, ret,
  rank() OVER (PARTITION BY symbol ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, ret) - 1) / 2.0 AS rk FROM f WHERE ret IS NOT NULL),
g AS (SELECT symbol, count(*) FILTER (WHERE trend) AS n1, count(*) FILTER (WHERE NOT trend) AS n0, avg(ret) FILTER (WHERE trend) AS m1, avg(ret) FILTER (WHERE NOT trend) AS m0,
  var_samp(ret) FILTER (WHERE trend) AS v1, var_samp(ret) FILTER (WHERE NOT trend) AS v0, sum(rk) FILTER (WHERE trend) AS r1 FROM k GROUP BY symbol)
SELECT symbol, n1 AS n_on, n0 AS n_off, round(m1, 7) AS mean_on, round(m0, 7) AS mean_off,
  round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)), 5) AS t_pooled, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 5) AS t_welch,
  round(r1 - n1 * (n1 + 1) / 2.0, 1) AS u_stat, round((r1 - n1 * (n1 + 1) / 2.0 - n1 * n0 / 2.0) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0), 5) AS u_z FROM g""")
def two_sample_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fwd.two_sample_tests(_features(spark, sf_dir), ["symbol"], "trend", "ret")
    return t.select("symbol", "n_on", "n_off", r("mean_on", 7).alias("mean_on"), r("mean_off", 7).alias("mean_off"),
                    r("t_pooled", 5).alias("t_pooled"), r("t_welch", 5).alias("t_welch"), r("u_stat", 1).alias("u_stat"), r("u_z", 5).alias("u_z"))


@query("regime_filter_quality", f"""WITH {_FEATURE} SELECT symbol, count(*) AS n,
  round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) FILTER (WHERE trend), 6) AS hit_on, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) FILTER (WHERE NOT trend), 6) AS hit_off,
  round(avg(CASE WHEN trend THEN 1.0 ELSE 0 END), 6) AS time_on,
  round(count(*) FILTER (WHERE ret > 0 AND NOT trend) * 1.0 / count(*) FILTER (WHERE ret > 0), 6) AS winners_blocked FROM f WHERE ret IS NOT NULL GROUP BY symbol""")
def regime_filter_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fwd.regime_filter_quality(_features(spark, sf_dir), ["symbol"], "trend", "ret")
    return q.select("symbol", "n", *[r(c).alias(c) for c in ("hit_on", "hit_off", "time_on", "winners_blocked")])
