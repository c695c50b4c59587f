"""Row-after-row state machines over long series, run block by block.

Some indicators carry a state that no window expresses.  Blocks are run in parallel, each from the state that
its warm-up rows suggest; then every block's starting state is checked against
the final state of the block before it, and only blocks that started wrongly are
run again from the right state.  The first block of a series starts from the
series' true beginning, so the result is exact when no block is left to fix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.operators.blocks import BLOCK_ROWS, FRAME_KEYS, blocked
from barlens.session import materialise

# (rows of a block in order, state or None) -> (new columns, final state)
Machine = Callable[[pd.DataFrame, "list[float] | None"], "tuple[dict[str, np.ndarray], list[float]]"]

_KEY_DDL = "symbol string, timeframe string, _blk long"


def _run(framed: DataFrame, machine: Machine, names: Sequence[str]) -> DataFrame:
    """States only: (keys, entry, final) per block; ``entry`` given or taken from the warm-up rows."""
    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        own = pdf[pdf["_own"]]
        warm = pdf[~pdf["_own"]]
        entry = pdf["entry"].iloc[0] if "entry" in pdf else None
        if entry is None and len(warm):
            entry = machine(warm, None)[1]
        entry = None if entry is None else [float(x) for x in entry]
        final = machine(own, entry)[1]
        return pd.DataFrame({
            "symbol": [pdf["symbol"].iloc[0]], "timeframe": [pdf["timeframe"].iloc[0]],
            "_blk": [pdf["_blk"].iloc[0]], "entry": [entry], "final": [final]})

    return framed.groupBy(*FRAME_KEYS).applyInPandas(states, f"{_KEY_DDL}, entry array<double>, final array<double>")


def run_machine(
    series: DataFrame, machine: Machine, outputs: dict[str, str], *, reads: Sequence[str],
    before: int = 512, block_rows: int = BLOCK_ROWS, slice_bars: int = 1024,
) -> DataFrame:
    """``series`` plus the machine's output columns (name -> SQL type).

    ``series`` has symbol, timeframe, ts (unique per series) and the columns read.
    """
    keys = list(FRAME_KEYS)
    cols = ["symbol", "timeframe", "ts", *reads]
    framed = blocked(series.select(*cols), before=before, block_rows=block_rows, slice_bars=slice_bars)
    states = materialise(_run(framed, machine, cols), "machine-states")
    while True:
        ends = states.select("symbol", "timeframe", (F.col("_blk") + 1).alias("_blk"), F.col("final").alias("_want"))
        stale = states.join(ends, keys).where("NOT (entry <=> _want)").select(*keys, F.col("_want").alias("entry"))
        if stale.isEmpty():
            break
        redone = _run(framed.join(stale, keys), machine, cols)
        states = materialise(states.join(stale.select(*keys), keys, "left_anti").unionByName(redone), "machine-states")

    ddl = ", ".join(["symbol string", "timeframe string", "ts timestamp", *[f"{n} {t}" for n, t in outputs.items()]])
    kinds = dict(outputs)

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        entry = pdf["entry"].iloc[0]
        new, _ = machine(pdf, None if entry is None else [float(x) for x in entry])
        return pd.DataFrame({
            "symbol": pdf["symbol"].to_numpy(), "timeframe": pdf["timeframe"].to_numpy(), "ts": pdf["ts"].to_numpy(),
            **{n: new[n] for n in kinds}})

    added = framed.where("_own").join(states.select(*keys, "entry"), keys).groupBy(*keys).applyInPandas(rows, ddl)
    return series.join(added, ["symbol", "timeframe", "ts"])


def supertrend_machine(variants: Sequence[tuple[str, float]]) -> Machine:
    """SuperTrend for several (ATR column, multiplier) at once; state is upper, lower, direction each."""
    mult = np.array([m for _, m in variants])
    atrs = [a for a, _ in variants]
    n = len(variants)

    def run(pdf: pd.DataFrame, state: list[float] | None):
        close = pdf["close"].to_numpy()
        mid = ((pdf["high"] + pdf["low"]) / 2).to_numpy()
        atr = pdf[atrs].to_numpy()
        up_all, low_all = mid[:, None] + mult * atr, mid[:, None] - mult * atr
        dirs = np.empty((len(pdf), n))
        lines = np.empty((len(pdf), n))
        if state is None:
            up, low, d = np.full(n, np.inf), np.full(n, -np.inf), np.ones(n)
        else:
            up, low, d = (np.array(x) for x in np.reshape(state, (3, n)))
        for i in range(len(pdf)):
            d = np.where(close[i] > up, 1.0, np.where(close[i] < low, -1.0, d))
            nu, nl = up_all[i], low_all[i]
            low = np.where((d > 0) & (nl < low), low, nl)
            up = np.where((d < 0) & (nu > up), up, nu)
            dirs[i], lines[i] = d, np.where(d > 0, low, up)
        out = {f"st_dir_{k}": dirs[:, k].astype("int32") for k in range(n)}
        out.update({f"st_line_{k}": lines[:, k] for k in range(n)})
        return out, [*up, *low, *d]

    return run


def psar_machine(variants: Sequence[tuple[float, float]]) -> Machine:
    """Parabolic stop and reverse for several (step, maximum) at once.

    State per variant: trend, SAR, extreme, acceleration; then the two previous lows and highs.
    """
    step = np.array([s for s, _ in variants])
    top = np.array([m for _, m in variants])
    n = len(variants)

    def run(pdf: pd.DataFrame, state: list[float] | None):
        high, low = pdf["high"].to_numpy(), pdf["low"].to_numpy()
        sars, trends = np.empty((len(pdf), n)), np.empty((len(pdf), n))
        if state is not None:
            trend, sar, ep, af = (np.array(x) for x in np.reshape(state[: 4 * n], (4, n)))
            l1, l2, h1, h2 = state[4 * n:]
        for i in range(len(pdf)):
            if state is None and i == 0:
                trend, sar, ep, af = np.ones(n), np.full(n, low[0]), np.full(n, high[0]), step.copy()
                l1 = l2 = low[0]
                h1 = h2 = high[0]
            else:
                nxt = sar + af * (ep - sar)
                up = trend > 0
                nxt = np.where(up, np.minimum(nxt, min(l1, l2)), np.maximum(nxt, max(h1, h2)))
                flip = np.where(up, low[i] < nxt, high[i] > nxt)
                longer = np.where(up, high[i] > ep, low[i] < ep)
                new_ep = np.where(up, np.maximum(ep, high[i]), np.minimum(ep, low[i]))
                sar = np.where(flip, ep, nxt)
                af = np.where(flip, step, np.where(longer, np.minimum(af + step, top), af))
                ep = np.where(flip, np.where(up, low[i], high[i]), new_ep)
                trend = np.where(flip, -trend, trend)
                l2, l1, h2, h1 = l1, low[i], h1, high[i]
            sars[i], trends[i] = sar, trend
        out = {f"psar_{k}": sars[:, k] for k in range(n)}
        out.update({f"psar_dir_{k}": trends[:, k].astype("int32") for k in range(n)})
        return out, [*trend, *sar, *ep, *af, l1, l2, h1, h2]

    return run


def supertrend(bars: DataFrame, variants: Sequence[tuple[int, float]], **layout: int) -> DataFrame:
    """Direction ``st_dir_<k>`` and line ``st_line_<k>`` of each (period, multiplier)."""
    from barlens.operators.blocks import compute
    from barlens.operators.indicators import true_range
    from barlens.operators.recurrence import ewm, wilder_alpha

    periods = sorted({p for p, _ in variants})
    atrs = compute(bars, [true_range("tr"), ewm([(f"atr_{p}", "tr", wilder_alpha(p)) for p in periods])])
    machine = supertrend_machine([(f"atr_{p}", m) for p, m in variants])
    outs = {**{f"st_dir_{k}": "int" for k in range(len(variants))},
            **{f"st_line_{k}": "double" for k in range(len(variants))}}
    out = run_machine(atrs, machine, outs, reads=["high", "low", "close", *[f"atr_{p}" for p in periods]], **layout)
    return out.drop("tr", *[f"atr_{p}" for p in periods])


def psar(bars: DataFrame, variants: Sequence[tuple[float, float]], **layout: int) -> DataFrame:
    """Stop ``psar_<k>`` and trend ``psar_dir_<k>`` of each (step, maximum)."""
    outs = {**{f"psar_{k}": "double" for k in range(len(variants))},
            **{f"psar_dir_{k}": "int" for k in range(len(variants))}}
    return run_machine(bars, psar_machine(variants), outs, reads=["high", "low"], **layout)
