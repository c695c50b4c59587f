"""The catalogue of entry signals: ±1 on the bar where a rule becomes true."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.functions.core import KEYS
from barlens.operators import indicators as ind
from barlens.operators import sequential as seq
from barlens.operators.blocks import FRAME_SQL, Step, compute, lag_sql, rolling_sql, sql_columns
from barlens.operators.forward import forward_return
from barlens.operators.recurrence import ewm, span_alpha, wilder_alpha
from barlens.session import materialise


@dataclass(frozen=True)
class Spec:
    spec_id: str
    indicator: str
    category: str
    long: str   # SQL over the catalogue's columns
    short: str


def up(x: str, y: str) -> str:
    """``x`` crosses above ``y`` (a column or a number)."""
    return f"({x} > {y} AND {x}_1 <= {_before(y)})"


def down(x: str, y: str) -> str:
    return f"({x} < {y} AND {x}_1 >= {_before(y)})"


def _before(y: str) -> str:
    return y if re.fullmatch(r"-?\d+(\.\d+)?", y) else f"{y}_1"


# fixed values: SuperTrend and PSAR variants; their columns are numbered in this order
SUPERTREND_VARIANTS = [(p, m) for p in (7, 10, 14) for m in (2.0, 3.0, 4.0)]
PSAR_VARIANTS = [(0.02, 0.2), (0.01, 0.1), (0.03, 0.3)]
LEVELS = [(20, 80), (25, 75), (30, 70)]


def catalogue() -> list[Spec]:
    """All entry specs, generated from their parameter grids."""
    out: list[Spec] = []

    def add(spec_id: str, indicator: str, category: str, long: str, short: str) -> None:
        out.append(Spec(spec_id, indicator, category, long, short))

    for p in (7, 10, 14, 21, 28):
        for os_, ob in LEVELS:
            add(f"RSI_mr_{p}_{os_}", "RSI", "momentum", up(f"rsi{p}", f"{os_}"), down(f"rsi{p}", f"{ob}"))
        add(f"RSI_trend_{p}", "RSI", "momentum", up(f"rsi{p}", "50"), down(f"rsi{p}", "50"))
    for f, s, g in ((12, 26, 9), (8, 17, 9), (5, 35, 5), (19, 39, 9)):
        line, sig, hist = f"macd_{f}_{s}", f"macds_{f}_{s}_{g}", f"macdh_{f}_{s}_{g}"
        add(f"MACD_signal_{f}_{s}_{g}", "MACD", "momentum", up(line, sig), down(line, sig))
        add(f"MACD_hist_{f}_{s}_{g}", "MACD", "momentum", up(hist, "0"), down(hist, "0"))
    for k in (5, 9, 14, 21):
        for os_, ob in LEVELS[:2]:
            add(f"STOCH_{k}_3_{os_}", "STOCH", "momentum", up(f"stoch{k}", f"{os_}"), down(f"stoch{k}", f"{ob}"))
    for p in (10, 14, 21):
        add(f"WILLR_{p}", "WILLR", "momentum", up(f"willr{p}", "-80"), down(f"willr{p}", "-20"))
    for p in (14, 20, 30):
        for lv in (100, 150):
            add(f"CCI_{p}_{lv}", "CCI", "momentum", up(f"cci{p}", f"-{lv}"), down(f"cci{p}", f"{lv}"))
    for p in (9, 14, 20):
        add(f"ROC_zero_{p}", "ROC", "momentum", up(f"roc{p}", "0"), down(f"roc{p}", "0"))
    for f, s in ((5, 20), (8, 21), (9, 21), (10, 30), (13, 34), (20, 50), (50, 200)):
        add(f"EMA_{f}_{s}", "EMA_cross", "trend", up(f"ema{f}", f"ema{s}"), down(f"ema{f}", f"ema{s}"))
    for f, s in ((10, 30), (20, 50), (50, 200)):
        add(f"SMA_{f}_{s}", "SMA_cross", "trend", up(f"sma{f}", f"sma{s}"), down(f"sma{f}", f"sma{s}"))
    for i, (p, m) in enumerate(SUPERTREND_VARIANTS):
        d = f"st_dir_{i}"
        add(f"SUPERTREND_{p}_{int(m * 10)}", "SUPERTREND", "trend", f"{d} = 1 AND {d}_1 = -1", f"{d} = -1 AND {d}_1 = 1")
    for p in (10, 14, 20):
        for t in (20, 25):
            add(f"ADX_{p}_{t}", "ADX", "trend", f"{up(f'pdi{p}', f'mdi{p}')} AND adx{p} > {t}",
                f"{down(f'pdi{p}', f'mdi{p}')} AND adx{p} > {t}")
    for i, (s, m) in enumerate(PSAR_VARIANTS):
        add(f"PSAR_{int(s * 100)}_{int(m * 10)}", "PSAR", "trend", up("close", f"psar_{i}"), down("close", f"psar_{i}"))
    for p in (10, 20, 30):
        for k in (15, 20, 25):
            u, lo, inside = f"bbu{p}_{k}", f"bbl{p}_{k}", f"bbin{p}_{k}"
            add(f"BB_bounce_{p}_{k}", "BBANDS", "volatility", f"close < {lo}", f"close > {u}")
            calm = f"{inside} = 3"
            add(f"BB_break_{p}_{k}", "BBANDS", "volatility", f"close > {u} AND {calm}", f"close < {lo} AND {calm}")
    release = "bbw20 >= bbwm20 AND bbw20_1 < bbwm20_1"
    add("BB_squeeze_20_20", "BBANDS", "volatility", f"{release} AND close > bbu20_20", f"{release} AND close < bbl20_20")
    for p in (10, 20):
        for k in (15, 20, 25):
            add(f"KC_bounce_{p}_{k}", "KC", "volatility", f"low <= kcl{p}_{k}", f"high >= kcu{p}_{k}")
    for p in (7, 10, 14, 20):
        for m in (1.5, 2.0):
            wide = f"atr{p} > {m} * atrm{p}"
            add(f"ATR_exp_{p}_{int(m * 10)}", "ATR", "volatility", f"{wide} AND close > hh20", f"{wide} AND close < ll20")
    for p in (10, 20, 30):
        add(f"OBV_ema_{p}", "OBV", "volume", up("obv", f"obve{p}"), down("obv", f"obve{p}"))
    for p in (10, 20):
        add(f"CMF_zero_{p}", "CMF", "volume", up(f"cmf{p}", "0"), down(f"cmf{p}", "0"))
    for p in (10, 14):
        for os_, ob in LEVELS[:2]:
            add(f"MFI_{p}_{os_}", "MFI", "volume", up(f"mfi{p}", f"{os_}"), down(f"mfi{p}", f"{ob}"))
    add("VWAP_cross", "VWAP", "volume", up("close", "vwap"), down("close", "vwap"))
    add("VWAP_band_bounce", "VWAP", "volume", "low <= vwap_lower AND close > vwap_lower",
        "high >= vwap_upper AND close < vwap_upper")
    for k in (10, 20, 30):
        add(f"swing_bounce_{k}", "swing_levels", "structure",
            f"abs(low_1 / swl{k}_1 - 1) <= 0.003 AND close > swl{k}_1", f"abs(high_1 / swh{k}_1 - 1) <= 0.003 AND close < swh{k}_1")
    add("prior_session_hl", "prior_session_hl", "structure", "close > prior_high", "close < prior_low")
    add("round_numbers", "round_numbers", "structure",
        "close_1 < rnd_up AND close_1 >= rnd_up * 0.999 AND close > rnd_up",
        "close_1 > rnd_dn AND close_1 <= rnd_dn * 1.001 AND close < rnd_dn")
    add("pivot_points", "pivot_points", "structure", "low <= s1 AND close > s1", "high >= r1 AND close < r1")
    for p in (10, 14):
        for e in (50, 200):
            add(f"RSI_EMA_filter_{p}_{e}", "RSI+EMA", "combo", f"{up(f'rsi{p}', '30')} AND close > ema{e}",
                f"{down(f'rsi{p}', '70')} AND close < ema{e}")
    for t in (20, 25):
        add(f"MACD_ADX_{t}", "MACD+ADX", "combo", f"{up('macd_12_26', 'macds_12_26_9')} AND adx14 > {t}",
            f"{down('macd_12_26', 'macds_12_26_9')} AND adx14 > {t}")
    add("BB_RSI_confirm", "BBANDS+RSI", "combo", "close < bbl20_20 AND rsi14 < 35", "close > bbu20_20 AND rsi14 > 65")
    add("EMA_OBV_confirm", "EMA+OBV", "combo", f"{up('ema20', 'ema50')} AND obv > obve20", f"{down('ema20', 'ema50')} AND obv < obve20")
    add("SUPERTREND_RSI_pullback", "SUPERTREND+RSI", "combo", f"st_dir_1 = 1 AND {up('rsi14', '40')}",
        f"st_dir_1 = -1 AND {down('rsi14', '60')}")
    for e in (50, 100):
        add(f"STOCH_EMA_{e}", "STOCH+EMA", "combo", f"{up('stoch14', '20')} AND close > ema{e}",
            f"{down('stoch14', '80')} AND close < ema{e}")
    add("RSI_BB_volume_triple", "RSI+BB+OBV", "combo", "rsi14 < 30 AND close < bbl20_20 AND obv > obve20",
        "rsi14 > 70 AND close > bbu20_20 AND obv < obve20")
    add("EMA_MACD_ADX_triple", "EMA+MACD+ADX", "combo", "ema20 > ema50 AND macd_12_26 > macds_12_26_9 AND adx14 > 20",
        "ema20 < ema50 AND macd_12_26 < macds_12_26_9 AND adx14 > 20")
    return dedupe(out)


def dedupe(specs: Sequence[Spec]) -> list[Spec]:
    """First spec of each id."""
    return list({s.spec_id: s for s in reversed(specs)}.values())[::-1]


_WORD = re.compile(r"[a-z][a-z0-9_]*")
_SQL_WORDS = {"abs"}
BAR_COLUMNS = {"open", "high", "low", "close", "volume", "ts"}


def columns_of(specs: Sequence[Spec]) -> tuple[set[str], set[str]]:
    """Columns that the rules name, and those of them whose previous value is named."""
    words = {w for s in specs for w in _WORD.findall(f"{s.long} {s.short}")} - _SQL_WORDS
    lagged = {w[:-2] for w in words if w.endswith("_1") and not re.fullmatch(r"(st_dir|psar)_1", w)}
    base = {w for w in words if not (w.endswith("_1") and w[:-2] in lagged)} | lagged
    return base, lagged


def _family(names: set[str], pattern: str) -> list[tuple[int, ...]]:
    found = (re.fullmatch(pattern, n) for n in names)
    return sorted({tuple(int(x) for x in m.groups()) for m in found if m})


def column_steps(names: set[str], round_step: float = 0.01) -> list[Step]:
    """Steps for the wanted columns; averages that can share a pass are computed in one."""
    rsis = [p for p, in _family(names, r"rsi(\d+)")]
    macds = sorted({t[:2] for t in _family(names, r"macd[sh]?_(\d+)_(\d+)(?:_\d+)?")})
    signals = _family(names, r"macd[sh]_(\d+)_(\d+)_(\d+)")
    keltners = _family(names, r"kc[ul](\d+)_(\d+)")
    emas = {p for p, in _family(names, r"ema(\d+)")} | {p for t in macds for p in t} | {p for p, _ in keltners}
    atrs = {p for p, in _family(names, r"atrm?(\d+)")} | {p for p, _ in keltners}
    adxs = sorted({p for p, in _family(names, r"(?:adx|pdi|mdi)(\d+)")})
    obvs = [p for p, in _family(names, r"obve(\d+)")]
    bands = sorted({*_family(names, r"bb(?:[ul]|in)(\d+)_(\d+)"), *([(20, 20)] if "bbw20" in names else [])})
    smas = {p for p, in _family(names, r"sma(\d+)")} | {p for p, _ in bands}

    steps: list[Step] = []
    first: list[tuple[str, str, float]] = [(f"ema{p}", "close", span_alpha(p)) for p in sorted(emas)]
    if rsis:
        steps.append(ind.rsi_inputs())
        first += [(f"_{x}{p}", x, wilder_alpha(p)) for p in rsis for x in ("gain", "loss")]
    if atrs:
        steps.append(ind.true_range("tr"))
        first += [(f"atr{p}", "tr", wilder_alpha(p)) for p in sorted(atrs)]
    if adxs:
        rise, fall = f"(high - {lag_sql('high')})", f"({lag_sql('low')} - low)"
        known = f"CASE WHEN {rise} IS NOT NULL THEN"
        steps.append(sql_columns([], {
            "pdm": f"{known} CASE WHEN {rise} > {fall} AND {rise} > 0 THEN {rise} ELSE 0D END END",
            "mdm": f"{known} CASE WHEN {fall} > {rise} AND {fall} > 0 THEN {fall} ELSE 0D END END",
            "tr1": f"{known} {ind.TRUE_RANGE_SQL} END"}, before=1))
        first += [(f"_{x}{p}", x, wilder_alpha(p)) for p in adxs for x in ("pdm", "mdm", "tr1")]
    first += [(f"obve{p}", "obv", span_alpha(p)) for p in obvs]
    if first:
        steps.append(ewm(first))

    derived = {f"rsi{p}": f"100 - 100 / (1 + _gain{p} / nullif(_loss{p}, 0))" for p in rsis}
    derived.update({f"macd_{f}_{s}": f"ema{f} - ema{s}" for f, s in macds})
    for p in adxs:
        derived[f"pdi{p}"] = f"100 * _pdm{p} / nullif(_tr1{p}, 0)"
        derived[f"mdi{p}"] = f"100 * _mdm{p} / nullif(_tr1{p}, 0)"
        derived[f"_dx{p}"] = (f"CASE WHEN _tr1{p} IS NOT NULL THEN coalesce(100 * abs(_pdm{p} - _mdm{p})"
                              f" / nullif(_pdm{p} + _mdm{p}, 0), 0D) END")
    derived.update({f"kc{side}{p}_{m}": f"ema{p} {sign} {m / 10!r}D * atr{p}"
                    for p, m in keltners for side, sign in (("u", "+"), ("l", "-"))})
    if derived:
        steps.append(sql_columns([o for o, _, _ in first], derived))
    second = [(f"macds_{f}_{s}_{g}", f"macd_{f}_{s}", span_alpha(g)) for f, s, g in signals]
    second += [(f"adx{p}", f"_dx{p}", wilder_alpha(p)) for p in adxs]
    if second:
        steps.append(ewm(second))
        steps.append(sql_columns([o for o, _, _ in second], {
            f"macdh_{f}_{s}_{g}": f"macd_{f}_{s} - macds_{f}_{s}_{g}" for f, s, g in signals}))

    rolled: dict[str, str] = {f"sma{p}": rolling_sql("avg(close)", "close", p) for p in sorted(smas)}
    rolled.update({f"_sd{p}": rolling_sql("stddev_samp(close)", "close", p) for p in sorted({p for p, _ in bands})})
    for p, in _family(names, r"atrm(\d+)"):
        rolled[f"atrm{p}"] = rolling_sql(f"avg(atr{p})", f"atr{p}", 20)
    for p, in _family(names, r"willr(\d+)"):
        hh, ll = rolling_sql("max(high)", "high", p), rolling_sql("min(low)", "low", p)
        rolled[f"willr{p}"] = f"-100 * ({hh} - close) / nullif({hh} - {ll}, 0)"
    for p, in _family(names, r"stoch(\d+)"):
        hh, ll = rolling_sql("max(high)", "high", p), rolling_sql("min(low)", "low", p)
        rolled[f"_raw{p}"] = f"100 * (close - {ll}) / nullif({hh} - {ll}, 0)"
    for p, in _family(names, r"roc(\d+)"):
        rolled[f"roc{p}"] = f"100 * (close / {lag_sql('close', p)} - 1)"
    earlier = f"OVER ({FRAME_SQL} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    if {"hh20", "ll20"} & names:
        rolled["hh20"] = f"CASE WHEN count(high) {earlier} = 20 THEN max(high) {earlier} END"
        rolled["ll20"] = f"CASE WHEN count(low) {earlier} = 20 THEN min(low) {earlier} END"
    cmfs = [p for p, in _family(names, r"cmf(\d+)")]
    if cmfs:
        steps.append(sql_columns([], {"_mfv": "coalesce((2 * close - high - low) / nullif(high - low, 0), 0D) * volume"}))
        rolled.update({f"cmf{p}": f"{rolling_sql('sum(_mfv)', '_mfv', p)} / nullif({rolling_sql('sum(volume)', 'volume', p)}, 0)"
                       for p in cmfs})
    if rolled:
        steps.append(sql_columns([f"atr{p}" for p in atrs], rolled, before=201))
    after: dict[str, str] = {}
    for p, k in bands:
        after[f"bbu{p}_{k}"] = f"sma{p} + {k / 10!r}D * _sd{p}"
        after[f"bbl{p}_{k}"] = f"sma{p} - {k / 10!r}D * _sd{p}"
        after[f"_in{p}_{k}"] = f"CASE WHEN abs(close - sma{p}) <= {k / 10!r}D * _sd{p} THEN 1 ELSE 0 END"
    for p, in _family(names, r"stoch(\d+)"):
        after[f"stoch{p}"] = rolling_sql(f"avg(_raw{p})", f"_raw{p}", 3)
    if "bbw20" in names:
        after["bbw20"] = "2 * 2D * _sd20 / sma20"
    if {"rnd_up", "rnd_dn"} & names:
        after["rnd_up"] = f"ceil({lag_sql('close')} / {round_step}D) * {round_step}D"
        after["rnd_dn"] = f"floor({lag_sql('close')} / {round_step}D) * {round_step}D"
    if after:
        steps.append(sql_columns(list(rolled), after, before=3))
    last: dict[str, str] = {}
    for p, k in bands:
        last[f"bbin{p}_{k}"] = f"sum(_in{p}_{k}) OVER ({FRAME_SQL} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
    if "bbwm20" in names:
        last["bbwm20"] = rolling_sql("avg(bbw20)", "bbw20", 20)
    if last:
        steps.append(sql_columns(list(after), last, before=20))
    steps += [ind.cci(f"cci{p}", p) for p, in _family(names, r"cci(\d+)")]
    steps += [ind.mfi(f"mfi{p}", p) for p, in _family(names, r"mfi(\d+)")]
    return steps


def prepare(bars: DataFrame, names: set[str]) -> DataFrame:
    """Adds the columns that are not plain windows (running totals, days, state machines)."""
    if any(n == "obv" or n.startswith("obve") for n in names):
        bars = ind.obv(bars)
    if any(n.startswith("vwap") for n in names):
        bars = ind.vwap_daily(bars)
    if {"prior_high", "prior_low", "s1", "r1"} & names:
        bars = ind.with_daily_levels(bars)
    swings = sorted({k for k, in _family(names, r"sw[lh](\d+)")})
    if swings:
        bars = ind.last_swings(bars, swings)
    if any(n.startswith("st_dir") for n in names):
        bars = seq.supertrend(bars, SUPERTREND_VARIANTS)
    if any(n.startswith("psar") for n in names):
        bars = seq.psar(bars, PSAR_VARIANTS)
    return bars


def signals_long(bars: DataFrame, specs: Sequence[Spec] | None = None, *, horizons: Sequence[int] = (),
                 carry: Sequence[str] = (), round_step: float = 0.01) -> DataFrame:
    """(symbol, timeframe, ts, spec_id, signal, with_trend, fwd<h>…): one row per signal.

    ``with_trend`` says whether the signal passes the EMA(200) regime filter.  All
    rules are evaluated on one blocked pass; only bars with a signal leave rows.
    ``carry`` names further bar or catalogue columns to keep.
    """
    specs = list(specs or catalogue())
    base, lagged = columns_of(specs)
    wanted = base | {"ema200"} | set(carry)
    special = [n for n in wanted if re.match(r"obv|vwap|prior_|s1$|r1$|sw[lh]\d|st_dir|psar", n)]
    if special:
        bars = materialise(prepare(bars, wanted), "features")
    steps = column_steps(wanted, round_step)
    made = tuple(o for s in steps for o in s.outs)
    lags = sql_columns(made, {f"{c}_1": lag_sql(c) for c in sorted(lagged)}, before=1) if lagged else None

    def evaluate(df: DataFrame) -> DataFrame:
        state = ", ".join(f"CASE WHEN {s.long} THEN 1 WHEN {s.short} THEN -1 ELSE 0 END" for s in specs)
        zeros = f"array_repeat(0, {len(specs)})"
        hidden = ["_blk", "_own"]
        kept = list(dict.fromkeys([*KEYS, "ts", "close", *carry, "ema200", *[f"fwd{h}" for h in horizons], *hidden]))
        df = df.selectExpr(*kept, f"array({state}) AS state")
        df = df.selectExpr("*", f"coalesce({lag_sql('state')}, {zeros}) AS prev")
        ids = ", ".join(f"'{s.spec_id}'" for s in specs)
        fired = ("filter(transform(zip_with(state, prev, (a, b) -> if(a <> b, a, 0)), "
                 "(x, i) -> named_struct('i', i, 'signal', x)), x -> x.signal <> 0)")
        return df.selectExpr(*kept, f"{fired} AS fired").where("size(fired) > 0").selectExpr(*kept, "inline(fired)").selectExpr(
            *kept, f"element_at(array({ids}), i + 1) AS spec_id", "signal",
            "coalesce((signal = 1 AND close > ema200) OR (signal = -1 AND close < ema200), false) AS with_trend")

    all_steps = [*steps, *([lags] if lags else []), *[forward_return(f"fwd{h}", h, "log") for h in horizons],
                 Step((*made, *[f"{c}_1" for c in lagged], *[f"fwd{h}" for h in horizons]), ("spec_id",), evaluate, before=1)]
    found = compute(bars, all_steps)
    extra = [c for c in carry if c not in (*KEYS, "ts")]
    return found.select(*KEYS, "ts", "spec_id", "signal", "with_trend", *extra, *[f"fwd{h}" for h in horizons])


def with_regime_param(signals: DataFrame) -> DataFrame:
    """One row per value of ``regime_filter`` under which the signal counts."""
    both = F.when(F.col("with_trend"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return signals.withColumn("regime_filter", F.explode(both))


def cross_signal(x: str, above: str, below: str) -> str:
    """SQL of a generic signal: +1 crossing above one level, -1 crossing below another (lag columns ``<x>_1``)."""
    return f"CASE WHEN {up(x, above)} THEN 1 WHEN {down(x, below)} THEN -1 ELSE 0 END"
