"""Level clustering and pairwise statistics against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlens.operators import indicators as ind
from barlens.operators import statistics as st
from barlens.operators.blocks import compute


def greedy(prices, width):
    groups = []
    for p in sorted(prices):
        if groups and abs(p - groups[-1][0]) <= width:
            centre, n = groups[-1]
            groups[-1] = ((centre * n + p) / (n + 1), n + 1)
        else:
            groups.append((p, 1))
    return sorted([g for g in groups if g[1] >= 2], key=lambda g: -g[1])


def test_levels_have_a_moving_centre(spark):
    """Dense prices, where the centre moves and a gap rule would make one group, repeated prices and missing ones."""
    rng = np.random.default_rng(11)
    rows = [("dense", float(p), 100.0) for p in np.round(rng.uniform(95, 105, 900), 2)]
    rows += [("sparse", float(p), 2000.0) for p in np.repeat(np.round(rng.uniform(1000, 3000, 60), 1), 3)]
    rows += [("sparse", None, 2000.0), (None, 1.0, 1.0), (None, 1.0, 1.0)]
    levels = spark.createDataFrame(rows, "symbol string, price double, ref double").repartition(5)
    got = ind.cluster_levels(levels, ["symbol"], "price", "ref", top=1000).collect()
    for symbol in ("dense", "sparse"):
        mine = [r for r in rows if r[0] == symbol and r[1] is not None]
        want = greedy([r[1] for r in mine], mine[0][2] * 0.003)
        found = sorted((r for r in got if r["symbol"] == symbol), key=lambda r: r["rank"])
        assert [r["touches"] for r in found] == [n for _, n in want] and len(want) > 10
        assert [r["level"] for r in found] == pytest.approx([c for c, _ in want])
    assert ind.cluster_levels(levels.where("false"), ["symbol"], "price", "ref").count() == 0


def test_swings_with_a_lookback_by_length(walk):
    pdf, bars = walk
    got = ind.adaptive_swings(bars.unionByName(bars.where("symbol = 'BBB'").limit(29).withColumn("symbol", F.lit("short"))))
    got = got.select("symbol", "ts", "swing_high", "swing_low", "lookback").toPandas()
    assert set(got["symbol"]) == {"AAA", "BBB"}
    for symbol, g in pdf.groupby("symbol"):
        n = max(3, min(10, len(g) // 40))
        high, low, ts = g["high"].to_numpy(), g["low"].to_numpy(), g["ts"].to_numpy()
        mine = got[got["symbol"] == symbol]
        assert set(mine["lookback"]) == {n}
        for x, column, better in ((high, "swing_high", np.less), (-low, "swing_low", np.less)):
            want = {ts[i] for i in range(n, len(x) - n) if better(np.delete(x[i - n:i + n + 1], n), x[i]).all()}
            assert set(mine.dropna(subset=[column])["ts"].to_numpy()) == want and want


def test_pairs_of_symbols_by_tiles(spark):
    """Tiles smaller than the symbols, blocks smaller than the days, holes, a constant, repeats and infinities."""
    rng = np.random.default_rng(5)
    wide = pd.DataFrame(rng.normal(1000, 1, (60, 9)) + rng.normal(0, 1, (60, 1)), columns=[f"s{i}" for i in range(9)])
    wide["s3"] = wide["s3"].where(rng.random(60) < 0.5)
    wide["s8"] = 5.0
    long = wide.stack().rename("ret").reset_index().rename(columns={"level_0": "ts", "level_1": "symbol"})
    odd = pd.DataFrame({"ts": [0, 1, 2], "symbol": ["s0", None, "zz"], "ret": [-1e9, 1.0, np.inf]})
    df = spark.createDataFrame(pd.concat([long, odd]))
    got = {(r["a"], r["b"]): r for r in st.correlation_matrix(df, "ret", tile=2, block=7).collect()}
    want = wide.corr()
    assert len(got) == 36 and all(a < b for a, b in got)
    for (a, b), r in got.items():
        assert r["n"] == (wide[a].notna() & wide[b].notna()).sum()
        assert r["corr"] is None if b == "s8" else r["corr"] == pytest.approx(want.loc[a, b], abs=1e-9)
    low = spark.createDataFrame(long)
    tails = {(r["a"], r["b"]): r["tail_dependence"] for r in st.tail_dependence(low, "ret", tile=4, block=16).collect()}
    for (a, b), p in tails.items():
        both = wide[[a, b]].dropna()
        x, y = (both[c] <= wide[c].quantile(0.1) for c in (a, b))
        assert p == (pytest.approx((x & y).sum() / x.sum()) if x.any() else None)
    assert st.correlation_matrix(df.where("false"), "ret").count() == 0


def test_swings_last_until_the_next_one_over_block_borders(spark):
    """Against a loop; blocks of a few rows, quiet stretches longer than a block, ties and a missing value."""
    rng = np.random.default_rng(3)
    n, k = 160, 3
    low = np.round(100 + rng.normal(0, 1, n).cumsum(), 1)
    low[60:110] = 90.0  # a flat stretch has no strict swing
    high = low + 1.0
    rows = [("A", "1h", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), float(low[i]), float(high[i])) for i in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, low double, high double")
    got = ind.last_swings(bars, [k], block_rows=8, slice_bars=4).orderBy("ts").collect()
    lo = hi = None
    for i in range(n):
        m = i - k
        if m >= k:
            near = [j for j in range(m - k, m + k + 1) if j != m]
            if all(low[m] < low[j] for j in near):
                lo = low[m]
            if all(high[m] > high[j] for j in near):
                hi = high[m]
        assert (got[i].swl3, got[i].swh3) == (lo, hi), i
    assert ind.last_swings(bars.limit(0), [k]).count() == 0


def test_gaps_are_filled_by_the_side_they_left(spark):
    def bar(i, o, h, lo, c):
        return ("A", "1h", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), float(o), float(h), float(lo), float(c), 1.0)
    rows = [bar(0, 10, 10, 10, 10), bar(1, 12, 13, 11, 12), bar(2, 12, 13, 10, 12), bar(3, 11, 12, 11, 11), bar(4, 9, 9.5, 8, 9), bar(5, 9, 9, 9, 9)]
    bars = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double")
    got = [(r.gap_size, r.fill_lag) for r in compute(bars, [ind.gap_fill(3)]).orderBy("ts").collect()]
    assert got == [(None, None), (2.0, 1), (0.0, None), (-1.0, 0), (-2.0, None), (0.0, None)]
