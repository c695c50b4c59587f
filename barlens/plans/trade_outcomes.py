"""Trade outcomes as queries, over daily bars and their EMA or RSI entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.functions.core import KEYS, r, ts_text
from barlens.operators import outcomes as oc
from barlens.operators import positions
from barlens.operators.blocks import compute, lag_sql, lead_sql, sql_columns
from barlens.operators.recurrence import ewm, wilder_alpha
from barlens.plans.catalog import BARS_15M, BARS_1D, BARS_1H, DIFFS, RN, W_SQL, bars_15m, bars_1d, bars_1h, ema_sql, ewm_sql, query, roll_sql
from barlens.plans.condition_research import _P_SQL
from barlens.session import materialise

N = 40


def _entry_sql(bars: str, fast: int = 20, slow: int = 50) -> str:
    return f"""{bars}, {RN}, {DIFFS},
em AS (SELECT *, {ema_sql('close', fast)} AS ef, {ema_sql('close', slow)} AS es, {ewm_sql('tr', '1.0/14')} AS atr14 FROM tr),
sg AS (SELECT *, CASE WHEN ef > es AND lag(ef) OVER {W_SQL} <= lag(es) OVER {W_SQL} THEN 1
  WHEN ef < es AND lag(ef) OVER {W_SQL} >= lag(es) OVER {W_SQL} THEN -1 ELSE 0 END AS signal FROM em)"""


def _path_sql(n: int, risk: str, extra: str = "", params: str = "") -> str:
    """Path rows: one per signal, parameter and step, moves in R."""
    return f"""ent AS (SELECT sg.*, close AS entry {', q.*' if params else ''} FROM sg{params} WHERE signal <> 0),
entr AS (SELECT *, {risk} AS risk FROM ent),
pth AS (SELECT e.*, b.rn - e.rn AS step, b.ts AS bts, b.high AS bh, b.low AS bl, b.close AS bc, b.open AS bo{extra},
  CASE WHEN e.signal = 1 THEN e.entry - b.low ELSE b.high - e.entry END / e.risk AS adv,
  CASE WHEN e.signal = 1 THEN b.high - e.entry ELSE e.entry - b.low END / e.risk AS fav,
  e.signal * (b.close - e.entry) / e.risk AS pl
  FROM entr e JOIN sg b ON b.symbol = e.symbol AND b.rn > e.rn AND b.rn <= e.rn + {n} WHERE e.risk > 0)"""


def _closed_sql(key: str, xs: str, pnl: str, reason: str = "''") -> str:
    """Closing rows from ``xs`` (one row per trade with exit step ``xstep``)."""
    return f"""hel AS (SELECT p.*, {reason} AS exit_reason, xstep, {pnl} AS pnl_r FROM pth p JOIN {xs} x USING ({key})),
tr8 AS (SELECT {key}, any_value(signal) AS signal, any_value(exit_reason) AS exit_reason, CAST(any_value(xstep) AS INTEGER) AS bars_held, any_value(pnl_r) FILTER (WHERE step = xstep) AS pnl_r,
  greatest(0, max(adv) FILTER (WHERE step <= xstep)) AS mae_r, greatest(0, max(fav) FILTER (WHERE step <= xstep)) AS mfe_r FROM hel GROUP BY {key})"""


_BARRIER = """bx AS (SELECT {key}, min(step) FILTER (WHERE adv >= 1) AS s, min(step) FILTER (WHERE fav >= {target}) AS t, max(step) AS m FROM pth GROUP BY {key}),
xs AS (SELECT *, s IS NOT NULL AND s <= coalesce(t, s) AS stopped, CASE WHEN s IS NOT NULL AND s <= coalesce(t, s) THEN s ELSE coalesce(t, m) END AS xstep FROM bx)"""
_REASON = "CASE WHEN stopped THEN 'stop' WHEN t IS NOT NULL THEN 'target' ELSE 'time' END"


def _barrier_sql(key: str, target: str) -> str:
    return (_BARRIER.format(key=key, target=target) + ",\n"
            + _closed_sql(key, "xs", f"CASE WHEN stopped THEN -1.0 WHEN t IS NOT NULL THEN {target} ELSE pl END", _REASON))


_OUT = """symbol, strftime(ts, '%Y-%m-%d') AS day, signal, exit_reason, round(pnl_r, 6) + 0.0 AS pnl_r,
  round(mae_r, 6) + 0.0 AS mae_r, round(mfe_r, 6) + 0.0 AS mfe_r, bars_held"""
STATS_SQL = """n, win_rate, avg_pnl_r, profit_factor, avg_mfe_r, avg_mae_r, mfe_capture, avg_bars"""


def _rule_stats_sql(by: str, src: str = "tr8") -> str:
    def null10(e: str, a: str) -> str:
        return f"CASE WHEN count(*) >= 10 THEN round({e}, 6) + 0.0 END AS {a}"
    return f"""SELECT {by}, count(*) AS n, {null10('avg(CASE WHEN pnl_r > 0 THEN 1.0 ELSE 0 END)', 'win_rate')}, {null10('avg(pnl_r)', 'avg_pnl_r')},
  {null10('sum(greatest(pnl_r, 0)) / nullif(abs(sum(least(pnl_r, 0))), 0)', 'profit_factor')}, {null10('avg(mfe_r)', 'avg_mfe_r')}, {null10('avg(mae_r)', 'avg_mae_r')},
  {null10('avg(CASE WHEN mfe_r > 0 THEN pnl_r / mfe_r ELSE 0 END)', 'mfe_capture')}, {null10('avg(bars_held)', 'avg_bars')} FROM {src} GROUP BY {by}"""


def _rule_stats(trades: DataFrame, *by: str) -> DataFrame:
    s = oc.exit_rule_stats(trades, list(by))
    return s.select(*by, "n", *[r(c).alias(c) for c in STATS_SQL.split(", ")[1:]])


_KEY = "symbol, ts"
_E1D = "WITH " + _entry_sql(BARS_1D)


def _daily_paths(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    return oc.forward_paths(bars_1d(spark, sf_dir), oc.ema_cross_entry(), n)


@query("barrier_outcomes", f"{_E1D}, {_path_sql(N, '1.5 * atr14')}, {_barrier_sql(_KEY, '2.0')} SELECT {_OUT} FROM tr8")
def barrier_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = oc.barrier_outcomes(_daily_paths(spark, sf_dir), stop="1.5D * atr14", target_r="2.0D")
    return t.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), "signal", "exit_reason",
                    r("pnl_r").alias("pnl_r"), r("mae_r").alias("mae_r"), r("mfe_r").alias("mfe_r"), "bars_held")


# stops of 1 to 3 ATR of two periods on two entries, and the baseline of 20 pips, a pip being a ten-thousandth of the price
_GRID = [("atr_stop", p, m) for p in (10, 14) for m in (1.0, 1.5, 2.0, 2.5, 3.0)]
_BASELINE = ("fixed_20_pips", 0, 0.0)
_GRID_KEY = "entry_rule, symbol, ts, rule, atr_period, atr_mult"
_GRID_VALUES = ", ".join(f"('{a}', {b}, CAST({c} AS DOUBLE))" for a, b, c in [*_GRID, _BASELINE])
_GRID_RISK = "CASE WHEN rule = 'fixed_20_pips' THEN entry * 0.002 ELSE atr_mult * CASE WHEN atr_period = 10 THEN atr10 ELSE atr14 END END"
_GRID_SQL = f"""WITH {BARS_1D}, {RN}, {DIFFS},
em AS (SELECT *, {ema_sql('close', 20)} AS ef, {ema_sql('close', 50)} AS es, {ewm_sql('tr', '1.0/14')} AS atr14, {ewm_sql('tr', '1.0/10')} AS atr10,
  100 - 100 / (1 + {ewm_sql('gain', '1.0/14', 1)} / nullif({ewm_sql('loss', '1.0/14', 1)}, 0)) AS rsi FROM tr),
sg AS (SELECT *, 'ema_cross' AS entry_rule, CASE WHEN ef > es AND lag(ef) OVER {W_SQL} <= lag(es) OVER {W_SQL} THEN 1 WHEN ef < es AND lag(ef) OVER {W_SQL} >= lag(es) OVER {W_SQL} THEN -1 ELSE 0 END AS signal FROM em
  UNION ALL SELECT *, 'rsi_mr' AS entry_rule, CASE WHEN rsi > 30 AND lag(rsi) OVER {W_SQL} <= 30 THEN 1 WHEN rsi < 70 AND lag(rsi) OVER {W_SQL} >= 70 THEN -1 ELSE 0 END AS signal FROM em),
{_path_sql(N, _GRID_RISK, params=f', (VALUES {_GRID_VALUES}) q(rule, atr_period, atr_mult)').replace('JOIN sg b', 'JOIN em b')}, {_barrier_sql(_GRID_KEY, '2.0')}"""


def _grid_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = materialise(bars_1d(spark, sf_dir), "bars")
    shorter = ewm([("atr10", "tr", wilder_alpha(10))])
    paths = None
    for name, entry in (("ema_cross", oc.ema_cross_entry()), ("rsi_mr", oc.rsi_entry())):
        part = oc.forward_paths(bars, [*entry, shorter], N, keep=("atr14", "atr10")).withColumn("entry_rule", F.lit(name))
        paths = part if paths is None else paths.unionByName(part)
    grid = oc.with_grid(paths, ("rule", "atr_period", "atr_mult"), [*_GRID, _BASELINE])
    return oc.barrier_outcomes(grid, stop=_GRID_RISK, target_r="2.0D", keep=["entry_rule", "rule", "atr_period", "atr_mult"])


@query("atr_stop_grid", f"{_GRID_SQL} " + _rule_stats_sql("entry_rule, rule, atr_period, atr_mult"))
def atr_stop_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop distances of 1 to 3 ATR with a target of 2R, on EMA crosses and RSI entries, beside the fixed stop."""
    return _rule_stats(_grid_trades(spark, sf_dir), "entry_rule", "rule", "atr_period", "atr_mult")


@query("exit_knowledge", f"""{_GRID_SQL},
d AS (SELECT a.entry_rule, a.atr_period, a.atr_mult, a.pnl_r, b.pnl_r AS base_r, a.pnl_r - b.pnl_r AS d FROM tr8 a JOIN tr8 b ON a.entry_rule = b.entry_rule AND a.symbol = b.symbol AND a.ts = b.ts AND b.rule = 'fixed_20_pips' WHERE a.rule = 'atr_stop'),
g AS (SELECT entry_rule, atr_period, atr_mult, count(*) AS n_samples, avg(pnl_r) AS r, avg(base_r) AS base, sum(greatest(pnl_r, 0)) / nullif(abs(sum(least(pnl_r, 0))), 0) AS pf,
  sum(greatest(base_r, 0)) / nullif(abs(sum(least(base_r, 0))), 0) AS base_pf, avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0) AS t FROM d GROUP BY 1, 2, 3),
p AS (SELECT *, {_P_SQL} AS p FROM g)
SELECT entry_rule, atr_period, atr_mult, n_samples AS n, round(pf, 5) AS profit_factor, round(base_pf, 5) AS base_profit_factor, round(r, 5) + 0.0 AS avg_pnl_r, round(r - base, 5) + 0.0 AS improvement, round(p, 5) AS p_value,
  CASE WHEN pf - base_pf >= 0.2 AND r - base >= 0.15 AND p < 0.10 THEN 'works' WHEN pf < base_pf THEN 'fails' ELSE 'partial' END AS verdict,
  coalesce(round(least(greatest(1 - p, 0), 1), 2), 0.5) AS confidence FROM p""")
def exit_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each stop distance works, fails or is mixed against the fixed stop, trade by trade."""
    trades = materialise(_grid_trades(spark, sf_dir), "trades")
    base = trades.where(F.col("rule") == _BASELINE[0])
    k = oc.exit_knowledge(trades.where("rule = 'atr_stop'"), base, ["entry_rule", "atr_period", "atr_mult"], ["entry_rule", *KEYS, "ts"])
    return k.select("entry_rule", "atr_period", "atr_mult", "n", *[r(c, 5).alias(c) for c in ("profit_factor", "base_profit_factor", "avg_pnl_r", "improvement", "p_value")], "verdict", "confidence")


def _trail_sql(best: str) -> str:
    return f"""tl AS (SELECT *, CASE WHEN step = 1 THEN -1.0 ELSE greatest(-1.0, {best}) END AS trail FROM pth),
xs AS (SELECT symbol, ts, q.trail_mult, min(step) FILTER (WHERE -adv <= trail) AS s, max(step) AS m, coalesce(min(step) FILTER (WHERE -adv <= trail), max(step)) AS xstep
  FROM tl q GROUP BY symbol, ts, q.trail_mult),
x2 AS (SELECT xs.*, trail FROM xs JOIN tl ON tl.symbol = xs.symbol AND tl.ts = xs.ts AND tl.trail_mult = xs.trail_mult AND tl.step = xs.xstep)"""


_TW = "(PARTITION BY symbol, ts, trail_mult ORDER BY step ROWS BETWEEN {a} PRECEDING AND 1 PRECEDING)"


def _trail_query(best: str) -> str:
    p = _path_sql(N, "trail_mult * atr14", params=", (VALUES (CAST(1.5 AS DOUBLE)), (2.0), (2.5), (3.0)) q(trail_mult)")
    return (f"{_E1D}, {p}, {_trail_sql(best)}, "
            + _closed_sql("symbol, ts, trail_mult", "x2", "CASE WHEN s IS NULL THEN pl ELSE trail END") + " " + _rule_stats_sql("trail_mult"))


def _register_trail(kind: str, best: str) -> None:
    @query(f"trail_{kind}", _trail_query(best))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = oc.with_params(_daily_paths(spark, sf_dir), "trail_mult", [1.5, 2.0, 2.5, 3.0])
        return _rule_stats(oc.trailing_outcomes(paths, kind=kind, mult="trail_mult", keep=["trail_mult"]), "trail_mult")


_register_trail("atr_trail", f"max(pl) OVER {_TW.format(a='UNBOUNDED')} - 1")
_register_trail("highest_close_trail", f"max(pl) OVER {_TW.format(a=14)} - trail_mult / 100 * entry / risk")
_register_trail("chandelier", f"max(fav) OVER {_TW.format(a=14)} - 1")


@query("breakeven_stop", f"""{_E1D}, {_path_sql(N, '1.5 * atr14', params=', (VALUES (CAST(0.5 AS DOUBLE)), (0.75), (1.0), (1.25), (1.5)) q(breakeven_trigger_r)')},
g AS (SELECT symbol, ts, breakeven_trigger_r, min(step) FILTER (WHERE fav >= breakeven_trigger_r) AS g FROM pth GROUP BY ALL),
h AS (SELECT pth.*, g.g FROM pth JOIN g USING (symbol, ts, breakeven_trigger_r)),
bx AS (SELECT symbol, ts, breakeven_trigger_r, any_value(g) AS g, min(step) FILTER (WHERE CASE WHEN g IS NOT NULL AND step > g THEN adv >= 0 ELSE adv >= 1 END) AS s,
  min(step) FILTER (WHERE fav >= 2.0) AS t, max(step) AS m FROM h GROUP BY symbol, ts, breakeven_trigger_r),
xs AS (SELECT *, s IS NOT NULL AND s <= coalesce(t, s) AS stopped, CASE WHEN s IS NOT NULL AND s <= coalesce(t, s) THEN s ELSE coalesce(t, m) END AS xstep FROM bx),
{_closed_sql('symbol, ts, breakeven_trigger_r', 'xs', "CASE WHEN stopped AND g IS NOT NULL AND s > g THEN 0.0 WHEN stopped THEN -1.0 WHEN t IS NOT NULL THEN 2.0 ELSE pl END")}
""" + _rule_stats_sql("breakeven_trigger_r"))
def breakeven_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = oc.with_params(_daily_paths(spark, sf_dir), "breakeven_trigger_r", [0.5, 0.75, 1.0, 1.25, 1.5])
    return _rule_stats(oc.breakeven_outcomes(paths, trigger="breakeven_trigger_r", keep=["breakeven_trigger_r"]), "breakeven_trigger_r")


@query("scale_out", f"""{_E1D}, {_path_sql(N, '1.5 * atr14', params=', (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.75)) q(scale_out_pct)')},
tl AS (SELECT *, CASE WHEN step = 1 THEN -1.0 ELSE greatest(-1.0, max(pl) OVER (PARTITION BY symbol, ts, scale_out_pct ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1) END AS trail FROM pth),
bx AS (SELECT symbol, ts, scale_out_pct, min(step) FILTER (WHERE -adv <= trail) AS s, min(step) FILTER (WHERE fav >= 1.0) AS t, max(step) AS m FROM tl GROUP BY ALL),
xs AS (SELECT *, coalesce(s, m) AS xstep FROM bx), x2 AS (SELECT xs.*, trail FROM xs JOIN tl ON tl.symbol = xs.symbol AND tl.ts = xs.ts AND tl.scale_out_pct = xs.scale_out_pct AND tl.step = xs.xstep),
{_closed_sql('symbol, ts, scale_out_pct', 'x2', "CASE WHEN t IS NOT NULL AND (s IS NULL OR t < s) THEN scale_out_pct * 1.0 + (1 - scale_out_pct) * (CASE WHEN s IS NULL THEN pl ELSE trail END) ELSE (CASE WHEN s IS NULL THEN pl ELSE trail END) END")}
""" + _rule_stats_sql("scale_out_pct"))
def scale_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = oc.with_params(_daily_paths(spark, sf_dir), "scale_out_pct", [0.25, 0.5, 0.75])
    return _rule_stats(oc.scale_out_outcomes(paths, share="scale_out_pct", first_r="1.0D", keep=["scale_out_pct"]), "scale_out_pct")


_RSI_ENTRY = f"""WITH {BARS_1D}, {RN}, {DIFFS},
em AS (SELECT *, 100 - 100 / (1 + {ewm_sql('gain', '1.0/14', 1)} / nullif({ewm_sql('loss', '1.0/14', 1)}, 0)) AS rsi, {ewm_sql('tr', '1.0/14')} AS atr14 FROM tr),
sg AS (SELECT *, CASE WHEN rsi > 30 AND lag(rsi) OVER {W_SQL} <= 30 THEN 1 WHEN rsi < 70 AND lag(rsi) OVER {W_SQL} >= 70 THEN -1 ELSE 0 END AS signal,
  coalesce(atr14 > 1.5 * {roll_sql('avg(atr14)', 20, x='atr14')}, false) AS high_vol FROM em)"""


@query("volatility_regime_exit", f"""{_RSI_ENTRY}, {_path_sql(N, 'CASE WHEN high_vol THEN 3.0 ELSE 1.0 END * atr14')},
bx AS (SELECT symbol, ts, any_value(high_vol) AS hv, min(step) FILTER (WHERE adv >= 1) AS s, min(step) FILTER (WHERE fav >= CASE WHEN high_vol THEN 1.0 ELSE 1.5 END) AS t, max(step) AS m FROM pth GROUP BY symbol, ts),
xs AS (SELECT *, s IS NOT NULL AND s <= coalesce(t, s) AS stopped, CASE WHEN s IS NOT NULL AND s <= coalesce(t, s) THEN s ELSE coalesce(t, m) END AS xstep FROM bx),
{_closed_sql('symbol, ts', 'xs', "CASE WHEN stopped THEN -1.0 WHEN t IS NOT NULL THEN CASE WHEN hv THEN 1.0 ELSE 1.5 END ELSE pl END")},
j AS (SELECT tr8.*, high_vol FROM tr8 JOIN sg USING (symbol, ts)) """ + _rule_stats_sql("high_vol", "j"))
def volatility_regime_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop and target by volatility regime of the entry bar."""
    paths = oc.forward_paths(bars_1d(spark, sf_dir), [*oc.rsi_entry(14, 30, 70), *oc.regime_columns()], N, keep=("atr14", "high_vol"))
    t = oc.barrier_outcomes(paths, stop="IF(high_vol, 3D, 1D) * atr14", target_r="IF(high_vol, 1D, 1.5D)", keep=["high_vol"])
    return _rule_stats(t, "high_vol")


_E1H = "WITH " + _entry_sql(BARS_1H)


def _session_sql(hour: int | None) -> str:
    test = f"hour(bts) >= {hour}" if hour is not None else "false"
    return f"""{_E1H}, {_path_sql(24, '1.5 * atr14')},
xs AS (SELECT symbol, ts, coalesce(min(step) FILTER (WHERE {test}), max(step)) AS xstep FROM pth GROUP BY symbol, ts),
{_closed_sql('symbol, ts', 'xs', 'pl')}, """


@query("session_close_exit", _session_sql(17) + """o AS (SELECT tr8.*, CAST(b.ts AS DATE) > CAST(tr8.ts AS DATE) AS overnight
 FROM tr8 JOIN sg e ON e.symbol = tr8.symbol AND e.ts = tr8.ts JOIN sg b ON b.symbol = e.symbol AND b.rn = e.rn + tr8.bars_held) """
       + _rule_stats_sql("overnight", "o"))
def session_close_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = oc.forward_paths(bars_1h(spark, sf_dir), oc.ema_cross_entry(), 24)
    return _rule_stats(oc.session_close_outcomes(paths, close_hour=17), "overnight")


@query("time_exit_excursions", f"""{_E1D}, {_path_sql(N, 'entry / 100')},
e AS (SELECT symbol, ts, h, greatest(0, max(adv)) AS mae, greatest(0, max(fav)) AS mfe, max(pl) FILTER (WHERE step = h) AS pl
  FROM pth, (VALUES (5), (10), (20), (40)) q(h) WHERE step <= h GROUP BY symbol, ts, h HAVING max(step) = h)
SELECT CAST(h AS INTEGER) AS horizon, count(*) AS n, round(avg(pl), 5) AS avg_pnl_pct, round(avg(mae), 5) AS avg_mae_pct, round(avg(mfe), 5) AS avg_mfe_pct,
  round(avg(mfe) / avg(mae), 5) AS mfe_mae_ratio, round(avg(CASE WHEN mae > 1 THEN 1.0 ELSE 0 END), 6) AS mae_over_1, round(avg(CASE WHEN mae > 2 THEN 1.0 ELSE 0 END), 6) AS mae_over_2,
  round(avg(CASE WHEN mae > 3 THEN 1.0 ELSE 0 END), 6) AS mae_over_3, round(quantile_cont(mae, 0.25), 5) AS mae_pct_q25, round(quantile_cont(mae, 0.5), 5) AS mae_pct_q50,
  round(quantile_cont(mae, 0.75), 5) AS mae_pct_q75, round(quantile_cont(mfe, 0.25), 5) AS mfe_pct_q25, round(quantile_cont(mfe, 0.5), 5) AS mfe_pct_q50,
  round(quantile_cont(mfe, 0.75), 5) AS mfe_pct_q75 FROM e GROUP BY h""")
def time_exit_excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _daily_paths(spark, sf_dir)
    rows = None
    for h in (5, 10, 20, 40):
        part = oc.excursions(paths, h).withColumn("horizon", F.lit(h))
        rows = part if rows is None else rows.unionByName(part)
    p = oc.excursion_profile(materialise(rows, "excursions"), ["horizon"])
    shares = ("mae_over_1", "mae_over_2", "mae_over_3")
    return p.select("horizon", "n", *[r(c, 6 if c in shares else 5).alias(c) for c in p.columns if c not in ("horizon", "n")])


def _indicator_exit_sql() -> str:
    from barlens.plans.signal_research import _COLUMNS
    xs = " UNION ALL ".join(
        f"SELECT symbol, ts, '{name}' AS rule, coalesce(min(step) FILTER (WHERE CASE WHEN signal = 1 THEN {lo} ELSE {sh} END), max(step)) AS xstep FROM pth GROUP BY symbol, ts"
        for name, (lo, sh) in ((n, (a.replace("x.high", "bh").replace("x.low", "bl").replace("x.", "i_"), b.replace("x.high", "bh").replace("x.low", "bl").replace("x.", "i_")))
                               for n, (a, b) in oc.INDICATOR_EXITS.items()))
    extra = "".join(f", b.{c} AS i_{c}" for c in oc.EXIT_COLUMNS)
    return f"""WITH {_COLUMNS}, sg AS (SELECT *, CASE WHEN ema20 > ema50 AND lag(ema20) OVER {W_SQL} <= lag(ema50) OVER {W_SQL} THEN 1
  WHEN ema20 < ema50 AND lag(ema20) OVER {W_SQL} >= lag(ema50) OVER {W_SQL} THEN -1 ELSE 0 END AS signal FROM l5),
{_path_sql(N, '1.5 * atr14', extra)}, xs AS ({xs}),
hel AS (SELECT p.*, rule, xstep FROM pth p JOIN xs USING (symbol, ts)),
tr8 AS (SELECT symbol, ts, rule, any_value(xstep) AS bars_held, any_value(pl) FILTER (WHERE step = xstep) AS pnl_r,
  greatest(0, max(adv) FILTER (WHERE step <= xstep)) AS mae_r, greatest(0, max(fav) FILTER (WHERE step <= xstep)) AS mfe_r FROM hel GROUP BY ALL),
base0 AS ({_BARRIER.format(key='symbol, ts', target='2.0').split(', max(step) AS m FROM pth')[0].replace('bx AS (', '')}, max(step) AS m FROM pth GROUP BY symbol, ts),
base1 AS (SELECT avg(CASE WHEN s IS NOT NULL AND s <= coalesce(t, s) THEN -1.0 WHEN t IS NOT NULL THEN 2.0 ELSE pl END) AS base_pnl_r
  FROM base0 JOIN pth USING (symbol, ts) WHERE step = m)
SELECT st.*, round(raw - base_pnl_r, 6) + 0.0 AS improvement FROM ({_rule_stats_sql('rule')}) st JOIN (SELECT rule, avg(pnl_r) AS raw FROM tr8 GROUP BY rule) USING (rule), base1"""


@query("indicator_exits", _indicator_exit_sql())
def indicator_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six indicator exits on EMA cross entries against a fixed target of 2R."""
    entry = oc.ema_cross_entry()
    paths = materialise(oc.forward_paths(
        bars_1h(spark, sf_dir), [*oc.path_indicators(), *entry], N, path=(*oc.OHLC, *oc.EXIT_COLUMNS)), "paths")
    rules = None
    for name, (lo, sh) in oc.INDICATOR_EXITS.items():
        part = oc.indicator_exit_outcomes(paths.withColumn("rule", F.lit(name)), long_exit=lo, short_exit=sh, keep=["rule"])
        rules = part if rules is None else rules.unionByName(part)
    stats = oc.exit_rule_stats(rules, ["rule"]).withColumn("_all", F.lit(1))
    base = oc.exit_rule_stats(oc.barrier_outcomes(paths, stop="1.5D * atr14", target_r="2.0D").withColumn("_all", F.lit(1)), ["_all"])
    both = oc.improvement(stats, base, ["_all"])
    return both.select("rule", "n", *[r(c).alias(c) for c in [*STATS_SQL.split(", ")[1:], "improvement"]])


def _pending_sql(kind: str) -> str:
    sign = "-signal" if kind == "limit" else "signal"
    low = "signal = 1" if kind == "limit" else "signal = -1"
    n = 60
    return f"""{_E1H}, {_path_sql(n, '1.0')},
lv AS (SELECT *, entry + {sign} * atr14 * 0.2 AS level FROM pth),
f AS (SELECT symbol, ts, any_value(signal) AS signal, min(step) FILTER (WHERE step <= 10 AND CASE WHEN {low} THEN bl <= level ELSE bh >= level END) AS wait,
  any_value(level) AS level, max(step) AS m, any_value(bc) FILTER (WHERE step = 1) AS c1 FROM lv GROUP BY symbol, ts),
fh AS (SELECT f.*, h FROM f, (VALUES (5), (10), (20), (50)) q(h)),
x AS (SELECT fh.*, ln(a.bc / level) * fh.signal AS ret, ln(b.bc / c1) * fh.signal AS mret FROM fh
  LEFT JOIN pth a ON a.symbol = fh.symbol AND a.ts = fh.ts AND a.step = wait + h LEFT JOIN pth b ON b.symbol = fh.symbol AND b.ts = fh.ts AND b.step = 1 + h)
SELECT CAST(h AS INTEGER) AS horizon, count(*) AS signals, round(avg(CASE WHEN wait IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS fill_rate, round(avg(wait), 6) AS avg_wait_bars,
  count(ret) AS count, round(avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0 END), 6) AS hit_rate, round(avg(ret), 6) AS avg_log_return,
  round(sum(greatest(ret, 0)) / nullif(abs(sum(least(ret, 0))), 0), 6) AS profit_factor, round(avg(ret) / (stddev_samp(ret) / sqrt(count(ret))), 5) AS t_stat,
  count(mret) AS market_count, round(avg(CASE WHEN mret > 0 THEN 1.0 WHEN mret IS NOT NULL THEN 0 END), 6) AS market_hit_rate, round(avg(mret), 6) AS market_avg_log_return,
  round(sum(greatest(mret, 0)) / nullif(abs(sum(least(mret, 0))), 0), 6) AS market_profit_factor, round(avg(mret) / (stddev_samp(mret) / sqrt(count(mret))), 5) AS market_t_stat
FROM x GROUP BY h"""


def _register_pending(kind: str) -> None:
    @query(f"pending_{kind}_orders", _pending_sql(kind))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = oc.forward_paths(bars_1h(spark, sf_dir), oc.ema_cross_entry(), 60)
        s = oc.pending_order_stats(oc.pending_order_outcomes(paths, kind=kind, offset_atr=0.2, max_wait=10), [])
        nums = [c for c in s.columns if c not in ("horizon", "signals", "count", "market_count")]
        return s.select("horizon", "signals", "count", "market_count", *[r(c, 5 if c.endswith("t_stat") else 6).alias(c) for c in nums])


_register_pending("limit")
_register_pending("stop")

HOLD = 10
_LEDGER = f"""{_entry_sql(BARS_1D, 10, 20)},
lg AS (SELECT symbol, signal, lead(ts, 1) OVER {W_SQL} AS entry_ts, lead(open, 1) OVER {W_SQL} AS eo, lead(ts, {HOLD}) OVER {W_SQL} AS exit_ts, lead(close, {HOLD}) OVER {W_SQL} AS xc FROM sg),
trades AS (SELECT 'ema_cross' AS strategy_id, symbol, entry_ts, exit_ts, signal AS direction, signal * (xc / eo - 1) - 0.0004 AS return_pct, (signal * (xc / eo - 1) - 0.0004) * eo AS pnl
  FROM lg WHERE signal <> 0 AND xc IS NOT NULL)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = oc.forward_paths(bars_1d(spark, sf_dir), oc.ema_cross_entry(10, 20), HOLD)
    return oc.time_exit_ledger(paths, hold=HOLD)


_TRADE_COLS = """symbol, strftime(entry_ts, '%Y-%m-%d') AS entry_day, strftime(exit_ts, '%Y-%m-%d') AS exit_day, CAST(direction AS INTEGER) AS direction,
  round(return_pct, 6) + 0.0 AS return_pct, round(pnl, 3) + 0.0 AS pnl"""


def _trades_out(t: DataFrame) -> DataFrame:
    return t.select("symbol", F.date_format("entry_ts", "yyyy-MM-dd").alias("entry_day"), F.date_format("exit_ts", "yyyy-MM-dd").alias("exit_day"),
                    "direction", r("return_pct").alias("return_pct"), r("pnl", 3).alias("pnl"))


@query("time_exit_ledger", f"WITH {_LEDGER} SELECT {_TRADE_COLS} FROM trades")
def time_exit_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trades_out(ledger(spark, sf_dir))


@query("flat_only_ledger", f"""WITH RECURSIVE {_LEDGER},
nx AS (SELECT t.*, row_number() OVER (PARTITION BY symbol ORDER BY entry_ts) AS k FROM trades t),
tk AS (SELECT * FROM nx WHERE k = 1
  UNION ALL SELECT n.* FROM tk JOIN nx n ON n.symbol = tk.symbol AND n.k = (SELECT min(m.k) FROM nx m WHERE m.symbol = tk.symbol AND m.k > tk.k AND m.entry_ts >= tk.exit_ts))
SELECT {_TRADE_COLS} FROM tk""")
def flat_only_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades left when entries are skipped while a position is open."""
    return _trades_out(positions.flat_only(ledger(spark, sf_dir)))



_TRIES = f"""tries AS (SELECT 'every_bar' AS strategy_id, symbol, ts AS entry_ts, lead(ts, 2) OVER {W_SQL} AS exit_ts,
  sign(lag(close) OVER {W_SQL} - lag(open) OVER {W_SQL}) * (lead(close, 2) OVER {W_SQL} - open) AS pnl FROM bars)"""


@query("daily_loss_limit", f"""WITH RECURSIVE {BARS_15M}, {_TRIES},
lined AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_ts) AS k FROM tries WHERE exit_ts IS NOT NULL AND pnl IS NOT NULL),
s AS (SELECT symbol, CAST(0 AS BIGINT) AS k, TIMESTAMP '1900-01-01' AS busy, DATE '1900-01-01' AS day, 0 AS losses, false AS taken FROM lined GROUP BY symbol
  UNION ALL SELECT symbol, k, CASE WHEN took THEN exit_ts ELSE busy END, today, lost + CASE WHEN took AND pnl < 0 THEN 1 ELSE 0 END, took
  FROM (SELECT *, entry_ts >= busy AND lost < 3 AS took FROM (
    SELECT n.*, s.busy, CAST(n.entry_ts AS DATE) AS today, CASE WHEN s.day = CAST(n.entry_ts AS DATE) THEN s.losses ELSE 0 END AS lost
    FROM s JOIN lined n ON n.symbol = s.symbol AND n.k = s.k + 1)))
SELECT n.symbol, strftime(n.entry_ts, '%Y-%m-%d %H:%M:%S') AS ts, round(n.pnl, 4) + 0.0 AS pnl FROM lined n JOIN s ON s.symbol = n.symbol AND s.k = n.k WHERE s.taken""")
def daily_loss_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quarter hour follows the bar before it for three bars; a day ends after three losses."""
    tries = compute(bars_15m(spark, sf_dir), [sql_columns([], {
        "exit_ts": lead_sql("ts", 2), "pnl": f"signum({lag_sql('close')} - {lag_sql('open')}) * ({lead_sql('close', 2)} - open)"}, before=1, after=2)])
    tries = tries.where("exit_ts IS NOT NULL AND pnl IS NOT NULL").select(F.lit("every_bar").alias("strategy_id"), "symbol", F.col("ts").alias("entry_ts"), "exit_ts", "pnl")
    return positions.flat_only(tries, max_daily_losses=3).select("symbol", ts_text("entry_ts").alias("ts"), r("pnl", 4).alias("pnl"))
