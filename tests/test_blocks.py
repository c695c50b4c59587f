"""Operators must give the same values however a series is cut into blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlens.operators import conditions as cnd
from barlens.operators import indicators as ind
from barlens.operators import outcomes as oc
from barlens.operators import positions
from barlens.operators import sequential as seq
from barlens.operators import signals as sig
from barlens.operators.blocks import blocked, compute, reach
from barlens.operators.forward import forward_return
from barlens.operators.recurrence import ewm, span_alpha, wilder_alpha

SMALL = dict(block_rows=64, slice_bars=16)


def ordered(df):
    return df.toPandas().sort_values(["symbol", "ts"], ignore_index=True)


def test_missing_values_carry_an_average_on(spark):
    """Over several chunks and blocks, beside pandas over the values that are there."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(9)
    x = 100 + np.cumsum(rng.normal(0, 1, 1500))
    x[rng.random(1500) < 0.2] = np.nan
    x[:3] = np.nan
    x[700:720] = np.nan
    ts = pd.date_range("2024-01-01", periods=1500, freq="h")
    pdf = pd.DataFrame({"symbol": "X", "timeframe": "1h", "ts": ts, "close": [None if v != v else v for v in x], "flat": [None if v != v else 100.0 for v in x]})
    bars = spark.createDataFrame(pdf, "symbol string, timeframe string, ts timestamp, close double, flat double").withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in ("close", "flat")})
    step = [ewm([("a", "close", span_alpha(5)), ("b", "close", wilder_alpha(14)), ("f", "flat", span_alpha(20))])]
    got = compute(bars, step, block_rows=400, slice_bars=50).orderBy("ts").toPandas()
    for name, a in (("a", span_alpha(5)), ("b", wilder_alpha(14))):
        np.testing.assert_allclose(got[name], pd.Series(x).ewm(alpha=a, adjust=False, ignore_na=True).mean(), rtol=1e-9)
    assert got["f"].isna().sum() == 3 and np.allclose(got["f"].dropna(), 100.0)


def test_every_row_is_owned_once_and_sees_its_reach(walk):
    pdf, bars = walk
    b = blocked(bars, before=37, after=11, **SMALL).toPandas()
    assert b["_blk"].max() > 5
    own = b[b["_own"]]
    assert len(own) == len(pdf) and not own.duplicated(["symbol", "ts"]).any()
    for symbol, series in pdf.groupby("symbol"):
        times = series["ts"].sort_values().reset_index(drop=True)
        for _, block in b[b["symbol"] == symbol].groupby("_blk"):
            first, last = (times[times == block.loc[block["_own"], "ts"].agg(f)].index[0] for f in ("min", "max"))
            need = times[max(0, first - 37): last + 12]
            assert need.isin(block["ts"]).all()


def test_averages_match_pandas(walk):
    pdf, bars = walk
    rates = {"e5": span_alpha(5), "e20": span_alpha(20), "e200": span_alpha(200), "w14": wilder_alpha(14), "e1": 1.0}
    step = [ewm([(n, "close", a) for n, a in rates.items()])]
    for layout in ({}, SMALL):
        got = ordered(compute(bars, step, **layout))
        for symbol, g in got.groupby("symbol"):
            for name, a in rates.items():
                want = g["close"].ewm(alpha=a, adjust=False).mean()
                np.testing.assert_allclose(g[name], want, rtol=1e-11)


def test_rsi_atr_match_pandas(walk):
    _, bars = walk
    got = ordered(compute(bars, [ind.atr("atr", 14), ind.rsi("rsi", 14)], **SMALL))
    for _, g in got.groupby("symbol"):
        d = g["close"].diff()
        gain, loss = (x.ewm(alpha=1 / 14, adjust=False).mean() for x in (d.clip(lower=0), (-d).clip(lower=0)))
        np.testing.assert_allclose(g["rsi"].iloc[1:], (100 - 100 / (1 + gain / loss.replace(0, np.nan))).iloc[1:], rtol=1e-9)
        pc = g["close"].shift()
        tr = pd.concat([g["high"] - g["low"], (g["high"] - pc).abs(), (g["low"] - pc).abs()], axis=1).max(axis=1)
        np.testing.assert_allclose(g["atr"], tr.ewm(alpha=1 / 14, adjust=False).mean(), rtol=1e-10)


def test_rolling_match_pandas(walk):
    _, bars = walk
    got = ordered(compute(bars, [
        ind.rolling_quantiles({"q25": 0.25, "q75": 0.75}, "close", 50, 10), ind.rolling_std("sd", "close", 20),
        ind.rolling_max("mx", "high", 5)], **SMALL))
    for _, g in got.groupby("symbol"):
        np.testing.assert_allclose(g["q25"], g["close"].rolling(50, min_periods=10).quantile(0.25), rtol=1e-12)
        np.testing.assert_allclose(g["q75"], g["close"].rolling(50, min_periods=10).quantile(0.75), rtol=1e-12)
        np.testing.assert_allclose(g["sd"], g["close"].rolling(20).std(), rtol=1e-9)
        np.testing.assert_allclose(g["mx"], g["high"].rolling(5).max())


@pytest.mark.parametrize("build", [
    lambda b, **k: cnd.conditions_wide(b, **k),
    lambda b, **k: compute(b, [ind.macd(12, 26, 9), ind.directional(14), ind.cci("cci", 20), ind.mfi("mfi", 14), ind.swing_levels(4),
                               ind.fractals(), forward_return("f", 7)], **k),
])
def test_blocks_do_not_change_results(walk, build):
    _, bars = walk
    one, many = ordered(build(bars)), ordered(build(bars, **SMALL))
    pd.testing.assert_frame_equal(one, many, check_exact=False, rtol=1e-9)


def test_state_machines_are_exact_across_blocks(walk):
    _, bars = walk
    for build in (lambda **k: seq.supertrend(bars, [(10, 3.0), (7, 2.0)], **k), lambda **k: seq.psar(bars, [(0.02, 0.2), (0.01, 0.1)], **k)):
        one, many = ordered(build()), ordered(build(**SMALL))
        pd.testing.assert_frame_equal(one, many, check_exact=False, rtol=1e-9)


def test_wrong_start_states_are_repaired(walk):
    """With no warm-up rows every block starts wrong and must be run again."""
    _, bars = walk
    machine = seq.psar_machine([(0.02, 0.2)])
    outs = {"psar_0": "double", "psar_dir_0": "int"}
    one = ordered(seq.run_machine(bars, machine, outs, reads=["high", "low"]))
    many = ordered(seq.run_machine(bars, machine, outs, reads=["high", "low"], before=0, **SMALL))
    pd.testing.assert_frame_equal(one, many)


def test_flat_only_against_a_loop(walk, spark):
    pdf, _ = walk
    t = pdf[["symbol", "ts", "close"]].iloc[::3].assign(strategy_id="s")
    t["entry_ts"], t["exit_ts"] = t["ts"], t["ts"] + pd.to_timedelta(3 + (t["close"] * 7 % 11).astype(int), unit="h")
    t["pnl"] = (t["close"] * 13) % 3 - 1
    want = []
    for _, g in t.sort_values("entry_ts").groupby("symbol"):
        busy, day, lost = pd.Timestamp.min, None, 0
        for row in g.itertuples():
            if row.entry_ts.date() != day:
                day, lost = row.entry_ts.date(), 0
            if row.entry_ts < busy or lost >= 2:
                continue
            want.append((row.symbol, row.entry_ts))
            busy = row.exit_ts
            lost += row.pnl < 0
    trades = spark.createDataFrame(t[["strategy_id", "symbol", "entry_ts", "exit_ts", "pnl"]])
    for layout in ({}, {"block_rows": 7}):
        got = positions.flat_only(trades, max_daily_losses=2, **layout).select("symbol", "entry_ts").toPandas()
        assert sorted(map(tuple, got.itertuples(index=False))) == sorted(want)


def test_positions_with_ties_open_trades_and_limits(spark):
    """Equal entries, trades of no length, missing exits, and paths that never meet, block by block."""
    rng = np.random.default_rng(3)
    rows = []
    for book in range(6):
        at = np.sort(rng.integers(0, 4 * 86400, 300))
        for k, sec in enumerate(at):
            length = 7200 if book % 2 else int(rng.integers(0, 9000))
            rows.append((f"b{book}", None if book == 5 else "x", int(sec), None if book == 4 and k == 250 else int(sec) + length,
                         None if k % 17 == 0 else float(rng.normal()), k))
    trades = spark.createDataFrame(rows, "strategy_id string, symbol string, e long, x long, pnl double, id int").selectExpr(
        "strategy_id", "symbol", "timestamp_seconds(e) AS entry_ts", "timestamp_seconds(x) AS exit_ts", "pnl", "id")
    for limit in (None, 1, 3):
        want = set()
        for book in range(6):
            busy, day, lost = -1, None, 0
            mine = sorted((r for r in rows if r[0] == f"b{book}"), key=lambda r: (r[2], 1 << 60 if r[3] is None else r[3], (r[4] or 0) < 0))
            for _, _, e, x, pnl, k in mine:
                if e // 86400 != day:
                    day, lost = e // 86400, 0
                if e < busy or (limit and lost >= limit):
                    continue
                want.add((f"b{book}", e, x))
                busy, lost = 1 << 60 if x is None else x, lost + ((pnl or 0) < 0)
        for block in (16384, 11):
            got = positions.flat_only(trades, max_daily_losses=limit, block_rows=block)
            kept = got.selectExpr("strategy_id", "unix_seconds(entry_ts) AS e", "unix_seconds(exit_ts) AS x").collect()
            assert {tuple(r) for r in kept} == want and len(kept) == len(want)
    assert positions.flat_only(trades.where("false")).count() == 0


def test_no_look_ahead(walk):
    """Later bars change no condition, signal or indicator of an earlier bar."""
    pdf, bars = walk
    cut = pdf["ts"].quantile(0.4)
    early = bars.where(F.col("ts") <= F.lit(cut))
    full = ordered(cnd.conditions_wide(bars).where(F.col("ts") <= F.lit(cut)))
    pd.testing.assert_frame_equal(full, ordered(cnd.conditions_wide(early)), check_exact=False, rtol=1e-10)
    specs = [s for s in sig.catalogue() if s.category in ("momentum", "volatility", "structure")]
    a = sig.signals_long(bars, specs).where(F.col("ts") <= F.lit(cut)).toPandas()
    b = sig.signals_long(early, specs).toPandas()
    key = ["symbol", "spec_id", "ts", "signal"]
    assert len(a) and sorted(map(tuple, a[key].itertuples(index=False))) == sorted(map(tuple, b[key].itertuples(index=False)))


def test_scale_does_not_change_oscillators(walk):
    _, bars = walk
    steps = [ind.rsi("rsi", 14), ind.williams_r("willr", 14)]
    big = bars.select("symbol", "timeframe", "ts", *[(F.col(c) * 8).alias(c) for c in ("open", "high", "low", "close")], "volume")
    a, b = ordered(compute(bars, steps)), ordered(compute(big, steps))
    np.testing.assert_allclose(a["rsi"], b["rsi"], rtol=1e-9)
    np.testing.assert_allclose(a["willr"], b["willr"], rtol=1e-9)


def test_running_totals_and_streaks(walk, monkeypatch):
    _, bars = walk
    from barlens.operators import indicators
    monkeypatch.setattr(indicators, "blocked", lambda df, **k: blocked(df, **{**k, **SMALL}))
    for _, g in ordered(ind.obv(bars)).groupby("symbol"):
        want = (np.sign(g["close"].diff().fillna(0)) * g["volume"]).cumsum()
        np.testing.assert_allclose(g["obv"], want)
    for _, g in ordered(ind.streaks(bars)).groupby("symbol"):
        d = np.sign(g["close"] - g["open"])
        want = d.groupby((d != d.shift()).cumsum()).cumcount() + 1
        assert (g["streak"].to_numpy() == want.to_numpy()).all()


def test_paths_hold_the_next_bars(walk, monkeypatch):
    pdf, bars = walk
    monkeypatch.setattr(oc, "blocked", lambda df, **k: blocked(df, **{**k, **SMALL}))
    paths = oc.forward_paths(bars, oc.ema_cross_entry(5, 20), 12).toPandas()
    assert len(paths) > 20
    for row in paths.itertuples():
        series = pdf[pdf["symbol"] == row.symbol].sort_values("ts")
        want = series[series["ts"] > row.ts]["close"].head(12).to_numpy()
        np.testing.assert_allclose([p["close"] for p in row.path], want)


def test_reach_adds_up():
    steps = [ind.true_range("tr"), ewm([("atr", "tr", wilder_alpha(14))]), ind.sma("m", "atr", 20)]
    before, after = reach(steps)
    assert before >= 1 + 540 + 20 and after == 0


def test_market_structure_remembers_swings_of_any_age(spark):
    """Rising swings, then three hundred bars without one, then a random walk; in small blocks, beside brute force."""
    rng = np.random.default_rng(5)
    zigzag = np.concatenate([np.linspace(a, b, 8, endpoint=False) for a, b in ((100, 110), (110, 104), (104, 116), (116, 109), (109, 121))])
    close = np.concatenate((zigzag, np.full(300, 121.0), 121 + np.cumsum(rng.normal(0, 1, 200)), np.full(280, 130.0), 130 + np.cumsum(rng.normal(0, 1, 60))))
    pdf = pd.DataFrame({"symbol": "AAA", "timeframe": "1h", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(close)), unit="h"),
                        "open": close, "high": close + 0.5, "low": close - 0.5, "close": close, "volume": 1.0})
    got = ordered(ind.market_structure(spark.createDataFrame(pdf), block_rows=64, slice_bars=16))
    k, want, last, state = 5, [], {}, {}
    for t in range(len(pdf)):
        for name, sign in (("high", 1), ("low", -1)):
            x = pdf[name].to_numpy() * sign
            level = x[t - k] if t >= 2 * k else None
            if level is not None and level > x[t - 2 * k:t - k].max() and level > x[t - k + 1:t + 1].max():
                if name in last:
                    state[name] = level * sign > last[name]
                last[name] = level * sign
        both = [state.get("high"), state.get("low")]
        want.append("up" if both == [True, True] else "down" if both == [False, False] else "mixed")
    assert got["structure"].tolist() == want
    assert want[330] == "up" and len(got) == len(pdf)
