"""What happens to a trade after its signal.

Each signal gets the next ``n`` bars as an array.  The arrays are cut out of the
block the signal lies in (blocks carry ``n`` bars of their successor), so there
is no join and no second shuffle, and a path is never longer than ``n``.  Exit
rules are then expressions over the array.

A bar does not tell whether its high or its low came first: when stop and target
are both touched in one bar the stop counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.functions.core import KEYS, profit_factor, safe_div, student_t_pvalue, t_stat
from barlens.operators import indicators as ind
from barlens.operators.blocks import (
    FRAME_KEYS, Step, blocked, lag_sql, reach, rolling_sql, run_steps, sql_columns,
)
from barlens.operators.forward import categorise_exit, confidence_from_p
from barlens.operators.recurrence import ewm, span_alpha, wilder_alpha
from barlens.operators.quantiles import exact_quantiles

OHLC = ("open", "high", "low", "close")


def ema_cross_entry(fast: int = 20, slow: int = 50) -> list[Step]:
    """``signal`` of the representative entry, with ATR(14) as ``atr14``."""
    f, s = f"ema{fast}", f"ema{slow}"
    return [
        ind.true_range("tr"),
        ewm([(f, "close", span_alpha(fast)), (s, "close", span_alpha(slow)), ("atr14", "tr", wilder_alpha(14))]),
        sql_columns([f, s], {"signal": f"""CASE WHEN {f} > {s} AND {lag_sql(f)} <= {lag_sql(s)} THEN 1
            WHEN {f} < {s} AND {lag_sql(f)} >= {lag_sql(s)} THEN -1 ELSE 0 END"""}, before=1),
    ]


def rsi_entry(period: int = 14, low: float = 30, high: float = 70) -> list[Step]:
    """``signal`` of RSI leaving its extremes, with ATR(14)."""
    a = wilder_alpha(period)
    return [
        ind.true_range("tr"), ind.rsi_inputs(),
        ewm([("_g", "gain", a), ("_s", "loss", a), ("atr14", "tr", wilder_alpha(14))]),
        ind.rsi_value("rsi", "_g", "_s"),
        sql_columns(["rsi"], {"signal": f"""CASE WHEN rsi > {low} AND {lag_sql('rsi')} <= {low} THEN 1
            WHEN rsi < {high} AND {lag_sql('rsi')} >= {high} THEN -1 ELSE 0 END"""}, before=1),
    ]


def forward_paths(bars: DataFrame, steps: Sequence[Step], n: int, *, path: Sequence[str] = OHLC,
                  keep: Sequence[str] = ("atr14",)) -> DataFrame:
    """One row per signal: key, ``signal``, ``entry`` (close), kept columns, ``path`` of the next ``n`` bars."""
    before, after = reach(steps)
    framed = run_steps(blocked(bars, before=before, after=after + n), steps)
    cols = list(dict.fromkeys(["ts", "signal", "close", *path, *keep]))
    # a bounded block of rows in one array, no shuffle: the frame is already grouped that way
    blocks = framed.groupBy(*FRAME_KEYS).agg(
        F.array_sort(F.collect_list(F.struct(*cols, "_own"))).alias("rows"))
    step = ", ".join(f"'{c}', x.{c}" for c in ("ts", *path))
    kept = "".join(f", '{c}', x.{c}" for c in keep)
    signals = f"""filter(transform(rows, (x, i) -> IF(x._own AND x.signal <> 0, named_struct('ts', x.ts, 'signal', x.signal,
        'entry', x.close{kept}, 'path', transform(slice(rows, i + 2, {n}), x -> named_struct({step}))), NULL)), s -> s IS NOT NULL)"""
    return blocks.selectExpr(*KEYS, f"inline({signals})").where("size(path) > 0")


def in_r(paths: DataFrame, risk: str) -> DataFrame:
    """Adds ``risk`` (price distance of 1R) and ``p``: adverse, favourable and closing move of each step in R."""
    return paths.selectExpr("*", f"{risk} AS risk").where("risk > 0").selectExpr("*", """transform(path, x -> named_struct(
        'adv', IF(signal = 1, entry - x.low, x.high - entry) / risk,
        'fav', IF(signal = 1, x.high - entry, entry - x.low) / risk,
        'pnl', signal * (x.close - entry) / risk)) AS p""")


def first_step(test: str) -> str:
    """Number of the first step that meets ``test`` (over ``x``), null if none does."""
    return f"nullif(array_position(transform(p, x -> coalesce({test}, false)), true), 0)"


def close_out(df: DataFrame, exit_step: str, exit_pnl: str, keep: Sequence[str] = ()) -> DataFrame:
    """Result rows from the exit step (null: hold to the end) and the R earned there."""
    df = df.selectExpr("*", f"CAST(coalesce({exit_step}, size(p)) AS INT) AS bars_held")
    df = df.selectExpr("*", "slice(p, 1, bars_held) AS held", f"CAST({exit_pnl} AS DOUBLE) AS pnl_r")
    return df.selectExpr(
        *KEYS, "ts", "signal", *keep, "path[bars_held - 1].ts AS exit_ts", "pnl_r",
        "greatest(0D, array_max(transform(held, x -> x.adv))) AS mae_r",
        "greatest(0D, array_max(transform(held, x -> x.fav))) AS mfe_r", "bars_held")


def with_params(paths: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """Each path once per parameter value."""
    return paths.select("*", F.explode(F.array(*[F.lit(float(x)) for x in values])).alias(name))


def with_grid(paths: DataFrame, names: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """Each path once per row of parameters."""
    return paths.select("*", F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row)]) for row in rows])))


def barrier_outcomes(paths: DataFrame, *, stop: str, target_r: str, keep: Sequence[str] = ()) -> DataFrame:
    """First of stop (at 1R), target and time; ``stop`` and ``target_r`` are SQL over the path's columns."""
    df = in_r(paths, stop).selectExpr(
        "*", f"{first_step('x.adv >= 1')} AS _s", f"{first_step(f'x.fav >= {target_r}')} AS _t")
    df = df.selectExpr("*", "_s IS NOT NULL AND _s <= coalesce(_t, _s) AS _stopped")
    return close_out(
        df.selectExpr("*", "CASE WHEN _stopped THEN 'stop' WHEN _t IS NOT NULL THEN 'target' ELSE 'time' END AS exit_reason"),
        "CASE WHEN _stopped THEN _s ELSE _t END",
        f"CASE exit_reason WHEN 'stop' THEN -1D WHEN 'target' THEN {target_r} ELSE element_at(p, bars_held).pnl END",
        [*keep, "exit_reason"])


def trailing_outcomes(paths: DataFrame, *, kind: str, mult: str, period: int = 14, keep: Sequence[str] = ()) -> DataFrame:
    """Stops that follow the price: ``atr_trail``, ``highest_close_trail`` (percent) or ``chandelier``.

    The stop of a step only uses earlier steps; it starts one ``mult`` ATR (1R) away.
    """
    df = in_r(paths, f"{mult} * atr14")
    best = {
        "atr_trail": "array_max(transform(slice(p, 1, i), y -> y.pnl)) - 1",
        "highest_close_trail": f"""array_max(transform(slice(p, greatest(i - {period} + 1, 1), least(i, {period})), y -> y.pnl))
            - {mult} / 100 * entry / risk""",
        "chandelier": f"array_max(transform(slice(p, greatest(i - {period} + 1, 1), least(i, {period})), y -> y.fav)) - 1",
    }[kind]
    df = df.selectExpr("*", f"transform(p, (x, i) -> IF(i = 0, -1D, greatest(-1D, {best}))) AS _trail")
    df = df.selectExpr("*", "nullif(array_position(zip_with(p, _trail, (x, s) -> -x.adv <= s), true), 0) AS _s")
    return close_out(df, "_s", "IF(_s IS NULL, element_at(p, bars_held).pnl, element_at(_trail, bars_held))", keep)


def indicator_exit_outcomes(paths: DataFrame, *, long_exit: str, short_exit: str, risk: str = "1.5D * atr14",
                            keep: Sequence[str] = ()) -> DataFrame:
    """Leave at the close of the first step on which a rule over the path columns (``x.…``) holds."""
    df = in_r(paths, risk).selectExpr(
        "*", f"nullif(array_position(transform(path, x -> coalesce(IF(signal = 1, {long_exit}, {short_exit}), false)), true), 0) AS _s")
    return close_out(df, "_s", "element_at(p, bars_held).pnl", keep)


def breakeven_outcomes(paths: DataFrame, *, trigger: str, stop: str = "1.5D * atr14", target_r: float = 2.0,
                       keep: Sequence[str] = ()) -> DataFrame:
    """The stop moves to the entry on the bar after the price has gained ``trigger`` R."""
    df = in_r(paths, stop).selectExpr("*", f"{first_step(f'x.fav >= {trigger}')} AS _g")
    df = df.selectExpr(
        "*", "nullif(array_position(transform(p, (x, i) -> IF(_g IS NOT NULL AND i >= _g, x.adv >= 0, x.adv >= 1)), true), 0) AS _s",
        f"{first_step(f'x.fav >= {target_r}')} AS _t")
    df = df.selectExpr("*", "_s IS NOT NULL AND _s <= coalesce(_t, _s) AS _stopped")
    df = df.selectExpr("*", """CASE WHEN _stopped AND _g IS NOT NULL AND _s > _g THEN 'breakeven' WHEN _stopped THEN 'stop'
        WHEN _t IS NOT NULL THEN 'target' ELSE 'time' END AS exit_reason""")
    return close_out(
        df, "CASE WHEN _stopped THEN _s ELSE _t END",
        f"""CASE exit_reason WHEN 'breakeven' THEN 0D WHEN 'stop' THEN -1D WHEN 'target' THEN {target_r}
            ELSE element_at(p, bars_held).pnl END""", [*keep, "exit_reason"])


def scale_out_outcomes(paths: DataFrame, *, share: str, first_r: str, trail_r: float = 1.0, stop: str = "1.5D * atr14",
                       keep: Sequence[str] = ()) -> DataFrame:
    """Part of the position leaves at ``first_r``; the rest trails ``trail_r`` R behind the best close.

    Both parts share the 1R stop; the exit row is that of the rest.
    """
    df = in_r(paths, stop).selectExpr("*", f"""transform(p, (x, i) -> IF(i = 0, -1D,
        greatest(-1D, array_max(transform(slice(p, 1, i), y -> y.pnl)) - {trail_r}))) AS _trail""")
    df = df.selectExpr(
        "*", "nullif(array_position(zip_with(p, _trail, (x, s) -> -x.adv <= s), true), 0) AS _s",
        f"{first_step(f'x.fav >= {first_r}')} AS _t")
    df = df.selectExpr("*", "IF(_s IS NULL, element_at(p, size(p)).pnl, element_at(_trail, CAST(_s AS INT))) AS _rest",
                       "_t IS NOT NULL AND (_s IS NULL OR _t < _s) AS _part")
    return close_out(df, "_s", f"IF(_part, {share} * {first_r} + (1 - {share}) * _rest, _rest)", keep)


def session_close_outcomes(paths: DataFrame, *, close_hour: int | None, risk: str = "1.5D * atr14",
                           keep: Sequence[str] = ()) -> DataFrame:
    """Leave at the first bar at or after ``close_hour`` (null: hold to the end of the path)."""
    df = in_r(paths, risk)
    test = f"hour(x.ts) >= {close_hour}" if close_hour is not None else "false"
    df = df.selectExpr("*", f"nullif(array_position(transform(path, x -> {test}), true), 0) AS _s",
                       "to_date(element_at(path, 1).ts) AS _day")
    out = close_out(df, "_s", "element_at(p, bars_held).pnl", keep)
    return out.withColumn("overnight", F.to_date("exit_ts") > F.to_date("ts"))


def excursions(paths: DataFrame, horizon: int, keep: Sequence[str] = ()) -> DataFrame:
    """Percent moved against and for the trade within ``horizon`` bars, for full-length paths."""
    return in_r(paths.where(f"size(path) >= {horizon}"), "entry / 100").selectExpr(
        *KEYS, "ts", "signal", *keep, f"greatest(0D, array_max(transform(slice(p, 1, {horizon}), x -> x.adv))) AS mae_pct",
        f"greatest(0D, array_max(transform(slice(p, 1, {horizon}), x -> x.fav))) AS mfe_pct",
        f"element_at(p, {horizon}).pnl AS pnl_pct")


def excursion_profile(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distribution of the excursions: exact quartiles and the share beyond 1, 2 and 3 percent."""
    keys = list(keys)
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("pnl_pct").alias("avg_pnl_pct"), F.avg("mae_pct").alias("avg_mae_pct"),
        F.avg("mfe_pct").alias("avg_mfe_pct"), safe_div(F.avg("mfe_pct"), F.avg("mae_pct")).alias("mfe_mae_ratio"),
        *[F.avg((F.col("mae_pct") > k).cast("double")).alias(f"mae_over_{k}") for k in (1, 2, 3)])
    for col in ("mae_pct", "mfe_pct"):
        q = exact_quantiles(rows, keys, col, {f"{col}_q25": 0.25, f"{col}_q50": 0.5, f"{col}_q75": 0.75})
        agg = agg.join(q, keys)
    return agg


def exit_rule_stats(trades: DataFrame, by: Sequence[str], min_n: int = 10) -> DataFrame:
    """Count, win rate, mean R, profit factor, excursions and capture; null below ``min_n`` trades."""
    ok = F.count(F.lit(1)) >= min_n
    pnl = F.col("pnl_r")
    parts: dict[str, Column] = {
        "win_rate": F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)), "avg_pnl_r": F.avg(pnl), "profit_factor": profit_factor(pnl),
        "avg_mfe_r": F.avg("mfe_r"), "avg_mae_r": F.avg("mae_r"),
        "mfe_capture": F.avg(F.coalesce(pnl / F.when(F.col("mfe_r") > 0, F.col("mfe_r")), F.lit(0.0))),
        "avg_bars": F.avg("bars_held"),
    }
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.when(ok, e).alias(n) for n, e in parts.items()])


def exit_knowledge(trades: DataFrame, baseline: DataFrame, by: Sequence[str], trade: Sequence[str]) -> DataFrame:
    """Verdict and confidence of each exit rule (``by``) against a baseline exit of the same trades.

    ``trade`` names a trade in both tables.  Profit factors and mean R are taken over the trades that both have; the
    p-value is that of the paired differences (two-sided Student), so an entry's own luck cancels out.
    """
    base = baseline.select(*trade, F.col("pnl_r").alias("_base"))
    x, b = F.col("pnl_r"), F.col("_base")
    d = x - b
    agg = trades.select(*dict.fromkeys([*by, *trade]), "pnl_r").join(base, list(trade)).groupBy(*by).agg(
        F.count(d).alias("n"), profit_factor(x).alias("profit_factor"), profit_factor(b).alias("base_profit_factor"),
        F.avg(x).alias("avg_pnl_r"), F.avg(b).alias("base_pnl_r"), F.avg(d).alias("improvement"), F.stddev_samp(d).alias("_sd"))
    t = t_stat(F.col("improvement"), F.col("_sd"), F.col("n"))
    out = agg.withColumn("p_value", student_t_pvalue(t, F.col("n") - 1))
    verdict = categorise_exit(F.col("profit_factor"), F.col("base_profit_factor"), F.col("avg_pnl_r"), F.col("base_pnl_r"), F.col("p_value"))
    return out.withColumn("verdict", verdict).withColumn("confidence", confidence_from_p(F.col("p_value"))).drop("_sd")


def improvement(rule: DataFrame, baseline: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rule statistics with the mean R gained over the baseline's."""
    base = baseline.select(*on, F.col("avg_pnl_r").alias("base_pnl_r"), F.col("profit_factor").alias("base_profit_factor"))
    return rule.join(base, list(on), "left").withColumn("improvement", F.col("avg_pnl_r") - F.col("base_pnl_r"))


def pending_order_outcomes(paths: DataFrame, *, kind: str, offset_atr: float, max_wait: int,
                           horizons: Sequence[int] = (5, 10, 20, 50)) -> DataFrame:
    """One row per signal and horizon for an order waiting beside the signal's close.

    A limit order fills when the price comes back to its level, a stop order when
    the price runs on to it.  ``ret`` is measured from the level at the fill,
    ``market_ret`` from the close of the next bar.  Paths need max_wait + the
    largest horizon bars.
    """
    sign = "-signal" if kind == "limit" else "signal"
    toward_low = f"(signal = {1 if kind == 'limit' else -1})"
    df = paths.selectExpr("*", f"entry + {sign} * coalesce(atr14, entry * 0.001D) * {offset_atr}D AS level")
    df = df.selectExpr("*", f"""nullif(array_position(transform(slice(path, 1, {max_wait}),
        x -> IF({toward_low}, x.low <= level, x.high >= level)), true), 0) AS wait_bars""")
    hs = ", ".join(str(h) for h in horizons)
    df = df.selectExpr("*", f"explode(array({hs})) AS horizon")
    return df.selectExpr(
        *KEYS, "ts", "signal", "wait_bars", "horizon",
        """CASE WHEN wait_bars IS NOT NULL AND wait_bars + horizon <= size(path)
            THEN ln(element_at(path, CAST(wait_bars + horizon AS INT)).close / level) * signal END AS ret""",
        """CASE WHEN 1 + horizon <= size(path)
            THEN ln(element_at(path, 1 + horizon).close / element_at(path, 1).close) * signal END AS market_ret""")


def pending_order_stats(rows: DataFrame, keys: Sequence[str], min_n: int = 10) -> DataFrame:
    """Fill rate, mean wait, and the statistics of both entries per horizon."""
    def block(x: str, prefix: str) -> list[Column]:
        v, n = F.col(x), F.count(x)
        ok = n >= min_n
        return [n.alias(f"{prefix}count"), F.when(ok, F.avg(F.when(v > 0, 1.0).when(v.isNotNull(), 0.0))).alias(f"{prefix}hit_rate"),
                F.when(ok, F.avg(v)).alias(f"{prefix}avg_log_return"), F.when(ok, profit_factor(v)).alias(f"{prefix}profit_factor"),
                F.when(ok, t_stat(F.avg(v), F.stddev_samp(v), n)).alias(f"{prefix}t_stat")]
    return rows.groupBy(*keys, "horizon").agg(
        F.count(F.lit(1)).alias("signals"), F.avg(F.col("wait_bars").isNotNull().cast("double")).alias("fill_rate"),
        F.avg("wait_bars").alias("avg_wait_bars"), *block("ret", ""), *block("market_ret", "market_"))


def time_exit_ledger(paths: DataFrame, *, hold: int, cost: float = 0.0002, strategy_id: str = "ema_cross") -> DataFrame:
    """Trades entered at the next bar's open and closed at the close of bar ``hold``; ``cost`` per side."""
    return paths.where(f"size(path) >= {hold}").selectExpr(
        f"'{strategy_id}' AS strategy_id", "symbol", "path[0].ts AS entry_ts", f"path[{hold - 1}].ts AS exit_ts",
        "signal AS direction", f"signal * (path[{hold - 1}].close / path[0].open - 1) - 2 * {cost}D AS return_pct",
        "path[0].open AS entry_price").selectExpr("*", "return_pct * entry_price AS pnl", "1D AS size").drop("entry_price")


def path_indicators() -> list[Step]:
    """Columns that the indicator exits look at."""
    from barlens.operators.signals import column_steps
    return column_steps({"rsi14", "macdh_12_26_9", "bbu20_20", "bbl20_20", "adx14", "stoch14"})


# fixed values: the indicator exits (long, short)
INDICATOR_EXITS = {
    "rsi_60_40": ("x.rsi14 > 60", "x.rsi14 < 40"),
    "rsi_70_30": ("x.rsi14 > 70", "x.rsi14 < 30"),
    "macd_hist_flip": ("x.macdh_12_26_9 < 0", "x.macdh_12_26_9 > 0"),
    "bb_touch": ("x.high >= x.bbu20_20", "x.low <= x.bbl20_20"),
    "adx_below_20": ("x.adx14 < 20", "x.adx14 < 20"),
    "stoch_80_20": ("x.stoch14 > 80", "x.stoch14 < 20"),
}
EXIT_COLUMNS = ("rsi14", "macdh_12_26_9", "bbu20_20", "bbl20_20", "adx14", "stoch14")


def all_signal_p_values(stats: DataFrame) -> DataFrame:
    """p of a ``t_stat`` column with ``count`` values."""
    return stats.withColumn("p_value", student_t_pvalue(F.col("t_stat"), F.col("count") - 1))


def regime_columns() -> list[Step]:
    """``high_vol``: ATR above one and a half times its 20-bar mean."""
    return [sql_columns(["atr14"], {"high_vol": f"coalesce(atr14 > 1.5D * {rolling_sql('avg(atr14)', 'atr14', 20)}, false)"}, before=20)]
