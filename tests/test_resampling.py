"""Permutations, bootstrap weights, quantiles and ranks beside plain computations."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlens.operators import quantiles
from barlens.operators import resampling as rs
from barlens.operators.permutation import PRIME, with_places


def test_places_are_permutations(spark):
    sizes = [1, 2, 3, 5, 7, 16, 17, 101, 1000, 1023]
    df = spark.createDataFrame([(n, x) for n in sizes for x in range(n)], "n long, x long").withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(40))))
    got = with_places(df, "y", "x", "n", "perm", [F.lit("42"), F.col("n")]).toPandas()
    assert list(got.columns) == ["n", "x", "perm", "y"]
    for (n, _), g in got.groupby(["n", "perm"]):
        assert sorted(g["y"]) == list(range(n))
    big = got[got["n"] == 1000].pivot(index="perm", columns="x", values="y").to_numpy()
    assert len({tuple(r) for r in big}) == 40
    # places behave as those of random permutations: uniform, and unrelated to the number and to the neighbour's place
    assert abs(big.mean() - 499.5) < 1e-9 and max(abs(np.corrcoef(np.arange(1000), r)[0, 1]) for r in big) < 0.15
    assert max(abs(np.corrcoef(r[:-1], r[1:])[0, 1]) for r in big) < 0.15
    assert abs((big == np.arange(1000)).sum() / 40 - 1) < 0.6, "about one fixed point each"
    hits = np.histogram(big[:, 123], bins=4, range=(0, 1000))[0]
    assert hits.min() >= 3


def test_permutations_in_small_blocks_are_the_same(spark, walk):
    _, bars = walk
    whole = rs.bar_permute(bars, 3).toPandas()
    small = rs.own_rows(rs.permuted_frames(bars, 3, before=9, after=5, block_rows=64)).toPandas()
    order = ["perm_id", "symbol", "ts"]
    whole, small = (x.sort_values(order, ignore_index=True)[sorted(x.columns)] for x in (whole, small))
    pd.testing.assert_frame_equal(whole, small, rtol=1e-9)
    a = rs.permuted_cross_profit_factor(bars, ["symbol"], 2, 5, n=4).orderBy("symbol", "perm_id").toPandas()
    b = rs.permuted_cross_profit_factor(bars, ["symbol"], 2, 5, n=4, block_rows=256).orderBy("symbol", "perm_id").toPandas()
    pd.testing.assert_frame_equal(a, b, rtol=1e-6)
    assert len(a) == 8


def test_a_single_bar_and_no_bars(spark, walk):
    _, bars = walk
    one = bars.where("symbol = 'AAA'").limit(1)
    got = rs.bar_permute(one, 2).toPandas()
    assert len(got) == 2 and np.allclose(got["close"], one.first().close)
    assert rs.bar_permute(bars.limit(0), 2).count() == 0


def weights_of(parts, n):
    digest = hashlib.md5(":".join(parts).encode()).hexdigest()
    h = [int(digest[at: at + 7], 16) % PRIME for at in (0, 7)]
    out = []
    for rep in range(1, n + 1):
        u = ((h[0] + rep * rs.DRAW_STEPS[0]) % PRIME) * ((h[1] + rep * rs.DRAW_STEPS[1]) % PRIME) % PRIME / PRIME
        out.append(sum(u >= step for step in rs.POISSON_STEPS))
    return out


def test_weighted_sums_equal_single_draws(spark, monkeypatch):
    monkeypatch.setattr(rs, "DRAWN_ROWS", 7)
    rng = np.random.default_rng(1)
    rows = [(["a", "b", None][i % 3] if i < 90 else "a", i, float(rng.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, i int, x double").repartition(3)
    got = {(r.g, r.rep): r.x for r in rs.weighted_sums(df, ["g"], ["i"], ["x"], 25, 7).collect()}
    want = {}
    for g, i, x in rows:
        for rep, w in enumerate(weights_of(["7", str(i)], 25), 1):
            want[g, rep] = want.get((g, rep), 0.0) + w * x
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    w = rs.poisson_weights(rng.integers(0, PRIME, 3000), rng.integers(0, PRIME, 3000), 200).astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, :40].T) - np.eye(40)).max() < 0.09


def test_bootstrap_interval_covers_the_statistic(spark):
    rng = np.random.default_rng(2)
    pnl = rng.normal(0.3, 1, 200)
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(pnl)] + [("s", 999, None)], "strategy_id string, trade_id int, pnl double")
    row = rs.bootstrap_ci(df, ["strategy_id"], ["trade_id"]).first()
    stat = pnl.mean() / pnl.std(ddof=1) * np.sqrt(200)
    assert row.replicates == 1000 and row.ci_low < stat < row.ci_high and abs(row.boot_mean - stat) < 0.3 and 0.8 < row.boot_std < 1.25


@pytest.mark.parametrize("limit", [quantiles.LIMIT, 50])
def test_quantiles_of_crowded_values(spark, limit):
    rng = np.random.default_rng(4)
    parts = {"price": 1.08 + rng.normal(0, 0.001, 4000), "tied": np.repeat([1.0, 1.0 + 1e-9, 7.0], 300), "wide": np.r_[-rng.random(400) * 1e-7, rng.random(600) * 1e300, -1e308, 1e308], "one": [5.0]}
    pdf = pd.concat([pd.DataFrame({"k": k, "x": v}) for k, v in parts.items()])
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = quantiles.exact_quantiles(spark.createDataFrame(pdf), ["k"], "x", probs, limit=limit).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, list(probs)].astype(float), np.quantile(g["x"], list(probs.values())), rtol=1e-12)


@pytest.mark.parametrize("limit", [quantiles.LIMIT, 40])
def test_ranks_of_crowded_values(spark, limit):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 3000), "x": np.r_[1.08 + rng.normal(0, 0.004, 2500).round(5), rng.normal(0, 1e6, 500)]})
    got = quantiles.average_ranks(spark.createDataFrame(pdf), ["k"], "x", "rank", limit).toPandas()
    want = pdf.assign(rank=pdf.groupby("k")["x"].rank())
    assert sorted(zip(got["k"], got["x"], got["rank"])) == sorted(zip(want["k"], want["x"], want["rank"]))


def test_no_task_ranks_more_than_the_limit(spark):
    """A million values within 0.4 % of each other: what is left to rank is small."""
    df = spark.range(1_000_000).select(F.lit("s").alias("k"), (F.lit(1.08) + F.randn(3) * 0.001).alias("x"))
    seen = []
    keep = quantiles.materialise

    def watch(table, label="stage"):
        out = keep(table, label)
        if label == "brackets":
            seen.append(out.agg(F.max("_n")).first()[0])
        return out
    quantiles.materialise = watch
    try:
        row = quantiles.exact_quantiles(df, ["k"], "x", {"median": 0.5, "p95": 0.95}).first()
    finally:
        quantiles.materialise = keep
    assert seen[0] > 10 * quantiles.LIMIT and seen[-1] <= quantiles.LIMIT
    assert abs(row.median - 1.08) < 1e-4 and abs(row.p95 - 1.08 - 0.001645) < 1e-4
