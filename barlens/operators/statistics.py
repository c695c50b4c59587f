"""Statistics of return series and ledgers: moments, risk, dependence, information."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.core import normal_cdf, safe_corr, safe_div
from barlens.operators.blocks import Step, rolling_sql, sql_columns
from barlens.operators.quantiles import exact_quantiles
from barlens.session import materialise


def moments(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Mean, deviation, skewness and excess kurtosis."""
    return df.where(F.col(x).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"))


def robust_moments(df: DataFrame, by: Sequence[str], x: str, trim: float = 0.05) -> DataFrame:
    """Median, median absolute deviation and winsorised mean, all exact."""
    by = list(by)
    q = exact_quantiles(df, by, x, {"median": 0.5, "_lo": trim, "_hi": 1 - trim})
    marked = df.where(F.col(x).isNotNull()).join(q, by).withColumn("_dev", F.abs(F.col(x) - F.col("median")))
    mad = exact_quantiles(marked, by, "_dev", {"mad": 0.5})
    wins = marked.groupBy(*by).agg(F.avg(F.least(F.greatest(F.col(x), F.col("_lo")), F.col("_hi"))).alias("winsorised_mean"))
    return q.select(*by, "median").join(mad, by).join(wins, by)


def performance_ratios(df: DataFrame, by: Sequence[str], x: str, benchmark: str | None = None) -> DataFrame:
    """Sortino, Omega, payoff, expectancy, gain-to-pain, and information ratio against a benchmark column."""
    v = F.col(x)
    down = F.sqrt(F.avg(F.when(v < 0, v * v).otherwise(0.0)))
    win, loss = F.avg(F.when(v > 0, v)), F.avg(F.when(v < 0, -v))
    gain, pain = F.sum(F.when(v > 0, v).otherwise(0.0)), F.sum(F.when(v < 0, -v).otherwise(0.0))
    p = F.avg(F.when(v > 0, 1.0).otherwise(0.0))
    q = F.avg(F.when(v < 0, 1.0).otherwise(0.0))
    cols = {"sortino": safe_div(F.avg(v), down), "omega": safe_div(gain, pain), "payoff": safe_div(win, loss),
            "expectancy": p * win - q * loss, "kelly": p - safe_div(1 - p, safe_div(win, loss))}
    if benchmark:
        d = v - F.col(benchmark)
        cols["information_ratio"] = safe_div(F.avg(d), F.stddev_samp(d))
    return df.where(v.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[e.alias(n) for n, e in cols.items()])


def tail_ratio(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    q = exact_quantiles(df, by, x, {"p05": 0.05, "p95": 0.95})
    return q.withColumn("tail_ratio", safe_div(F.abs("p95"), F.abs("p05")))


def recovery_factor(net: Column, max_drawdown_amount: Column) -> Column:
    return safe_div(net, max_drawdown_amount)


def sharpe_errors(m: DataFrame, trials: int, benchmark: float = 0.0) -> DataFrame:
    """Standard errors of the per-period Sharpe, minimum track record, and the deflated Sharpe probability.

    ``m`` comes from ``moments``.
    """
    n, sr = F.col("n"), F.col("sr")
    shape = 1 - F.col("skew") * sr + (F.col("kurtosis") + 2) / 4 * sr * sr
    euler = 0.5772156649015329
    z1, z2 = _normal_quantile(1 - 1 / trials), _normal_quantile(1 - 1 / (trials * math.e))
    expected_max = F.lit((1 - euler) * z1 + euler * z2) / F.sqrt(n.cast("double"))
    return m.withColumn("sr", safe_div(F.col("mean"), F.col("std"))).withColumns({
        "se_normal": F.sqrt((1 + sr * sr / 2) / n), "se_adjusted": F.sqrt(shape / (n - 1)),
        "min_track_record": 1 + shape * F.pow(F.lit(1.6448536269514722) / F.when(sr != benchmark, sr - benchmark), 2),
    }).withColumn("deflated_sharpe", normal_cdf((sr - expected_max) / F.col("se_adjusted")))


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist
    return NormalDist().inv_cdf(p)


def multiple_testing(results: DataFrame, by: Sequence[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg adjusted p-values within a family of tests.

    Equal p-values are ranked together.  A family is the set of tests run, which
    the caller bounds (conditions times horizons, variants of one sweep).
    """
    by = list(by)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    pv = F.col(p)
    order = Window.partitionBy(*by).orderBy(p)
    upto = F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, 0))
    ranked = results.where(pv.isNotNull()).withColumns({"_m": m, "_k": upto}).withColumn("_raw", pv * F.col("_m") / F.col("_k"))
    bh = F.min("_raw").over(order.rangeBetween(0, Window.unboundedFollowing))
    return ranked.withColumns({"p_bonferroni": F.least(F.lit(1.0), pv * F.col("_m")), "p_bh": F.least(F.lit(1.0), bh)}).withColumn(
        "rejected_bh", F.col("p_bh") <= alpha).drop("_m", "_k", "_raw")


def value_at_risk(df: DataFrame, by: Sequence[str], x: str, level: float = 0.95) -> DataFrame:
    """Historical VaR and CVaR (exact) and Cornish-Fisher VaR."""
    by = list(by)
    q = exact_quantiles(df, by, x, {"_q": 1 - level})
    tail = df.where(F.col(x).isNotNull()).join(q, by).groupBy(*by).agg(
        (-F.avg(F.when(F.col(x) <= F.col("_q"), F.col(x)))).alias("cvar"), (-F.max("_q")).alias("var"))
    z = _normal_quantile(1 - level)
    s, k = F.col("skew"), F.col("kurtosis")
    zcf = z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
    return tail.join(moments(df, by, x), by).select(
        *by, "n", "var", "cvar", (-(F.col("mean") + F.col("std") * zcf)).alias("cornish_fisher_var"))


def _finite(x: str) -> Column:
    return F.abs(F.col(x).cast("double")) < F.lit(math.inf)


#: Symbols of a tile and timestamps of a block: what one task multiplies is two matrices of this shape.
TILE, BLOCK = 64, 4096


def co_moments(df: DataFrame, x: str, on: str = "ts", *, centred: bool = False, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """a, b (a < b) and n, sx, sy, sxx, syy, sxy over the values of ``on`` at which both symbols have ``x``.

    A tiled Gram matrix: symbols are cut into tiles and timestamps into blocks, each by hash, and every two tiles
    meet once per block as two matrices, whose products are summed over blocks.  A row is sent once per tile, and no
    list of symbols or pairs is made on the driver.  Of several rows of a symbol and timestamp the largest counts;
    missing, NaN and infinite values are left out.  ``centred`` takes a symbol's mean off first, so that squares don't cancel.
    """
    known = df.where(F.col("symbol").isNotNull() & F.col(on).isNotNull() & _finite(x))
    cells = known.groupBy("symbol", F.col(on).alias("_on")).agg(F.max(F.col(x).cast("double")).alias("_x"))
    cells = materialise(cells, "cells")
    size = cells.agg(F.approx_count_distinct("symbol").alias("s"), F.approx_count_distinct("_on").alias("t")).first()
    tiles, blocks = max(1, math.ceil(size["s"] / tile)), max(1, math.ceil(size["t"] / block))
    if centred:
        mid = materialise(cells.groupBy("symbol").agg(F.avg("_x").alias("_mid")), "means")
        cells = cells.join(mid, "symbol").withColumn("_x", F.col("_x") - F.col("_mid")).drop("_mid")
    own = F.pmod(F.xxhash64("symbol"), F.lit(tiles))
    sent = cells.withColumns({"_own": own, "_blk": F.pmod(F.xxhash64("_on"), F.lit(blocks))}).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    sent = sent.select("symbol", "_on", "_x", "_own", "_blk", F.least("_own", "_other").alias("_ta"), F.greatest("_own", "_other").alias("_tb"))
    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")

    def multiply(pdf):
        ta, tb = pdf["_ta"].iloc[0], pdf["_tb"].iloc[0]
        row, _ = pd.factorize(pdf["_on"])
        sides = []
        for t in (ta, tb):
            here = (pdf["_own"] == t).to_numpy()
            col, names = pd.factorize(pdf["symbol"][here], sort=True)
            value, there = (np.zeros((row.max() + 1, len(names))) for _ in range(2))
            value[row[here], col], there[row[here], col] = pdf["_x"].to_numpy()[here], 1.0
            sides.append((np.asarray(names, dtype=object), value, there))
        (na, va, ma), (nb, vb, mb) = sides
        found = dict(zip(sums, (ma.T @ mb, va.T @ mb, ma.T @ vb, (va * va).T @ mb, ma.T @ (vb * vb), va.T @ vb)))
        left, right = (g.ravel() for g in np.meshgrid(na, nb, indexing="ij"))
        out = pd.DataFrame({"a": left, "b": right, **{k: v.ravel() for k, v in found.items()}})
        out = out[(out["n"] > 0) & ((out["a"] < out["b"]) if ta == tb else True)]
        turned = out.rename(columns={"a": "b", "b": "a", "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"})[out.columns]
        return pd.concat([out[out["a"] < out["b"]], turned[turned["a"] < turned["b"]]])

    parts = sent.groupBy("_ta", "_tb", "_blk").applyInPandas(multiply, "a string, b string, " + ", ".join(f"{k} double" for k in sums))
    return parts.groupBy("a", "b").agg(*[F.sum(k).alias(k) for k in sums]).withColumn("n", F.round("n").cast("long"))


def correlation_matrix(df: DataFrame, x: str, on: str = "ts", **tiling: int) -> DataFrame:
    """Correlation of every two symbols over the timestamps that both have; null where a side is constant there."""
    n, sx, sy = (F.col(c) for c in ("n", "sx", "sy"))
    vx, vy = F.col("sxx") - sx * sx / n, F.col("syy") - sy * sy / n
    # what rounding leaves of a constant side's variance is not a variance
    ok = (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy"))
    return co_moments(df, x, on, centred=True, **tiling).select("a", "b", "n", F.when(ok, (F.col("sxy") - sx * sy / n) / F.sqrt(vx) / F.sqrt(vy)).alias("corr"))


def tail_dependence(df: DataFrame, x: str, q: float = 0.1, on: str = "ts", **tiling: int) -> DataFrame:
    """P(second below its q-quantile | first below its own) for every two symbols."""
    cut = exact_quantiles(df, ["symbol"], x, {"_cut": q})
    flags = df.where(F.col(x).isNotNull()).join(cut, "symbol").withColumn("_low", F.when(F.col(x) <= F.col("_cut"), 1.0).otherwise(0.0))
    return co_moments(flags, "_low", on, **tiling).select("a", "b", "n", safe_div(F.col("sxy"), F.col("sx")).alias("tail_dependence"))


def serial_dependence(df: DataFrame, by: Sequence[str], x: str, lags: Sequence[int]) -> DataFrame:
    """Autocorrelation of x and |x|, and of x with later |x| (leverage), for columns ``<x>_lag<k>`` made by ``lag_columns``."""
    cols = []
    for k in lags:
        y = f"{x}_lag{k}"
        cols += [safe_corr(x, y).alias(f"acf_{k}"), safe_corr(F.abs(x), F.abs(y)).alias(f"acf_abs_{k}"), safe_corr(F.abs(x), y).alias(f"leverage_{k}")]
    return df.where(F.col(f"{x}_lag{max(lags)}").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *cols)


def lag_columns(x: str, lags: Sequence[int]) -> Step:
    from barlens.operators.blocks import lag_sql
    return sql_columns([x], {f"{x}_lag{k}": lag_sql(x, k) for k in lags}, before=max(lags))


def variance_ratio(df: DataFrame, by: Sequence[str], one: str, many: str, k: int) -> DataFrame:
    """Variance of k-step log returns over k times that of one step; Hurst exponent from it."""
    agg = df.where(F.col(many).isNotNull()).groupBy(*by).agg(safe_div(F.var_samp(many), k * F.var_samp(one)).alias("variance_ratio"))
    return agg.withColumn("hurst", 0.5 + F.ln("variance_ratio") / (2 * math.log(k)))


def half_life(df: DataFrame, by: Sequence[str], x: str, lagged: str) -> DataFrame:
    """Half-life of mean reversion from the regression of changes on the previous level."""
    ok = df.where(F.col(x).isNotNull() & F.col(lagged).isNotNull())
    change = F.col(x) - F.col(lagged)
    agg = ok.groupBy(*by).agg(F.regr_slope(change, F.col(lagged)).alias("slope"), F.regr_intercept(change, F.col(lagged)).alias("intercept"))
    return agg.withColumn("half_life", F.when((F.col("slope") < 0) & (F.col("slope") > -1), -math.log(2) / F.ln(1 + F.col("slope"))))


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    out = F.lit(0)
    for i, e in enumerate(edges):
        out = F.when(x > e, i + 1).otherwise(out)
    return out


def entropy(df: DataFrame, by: Sequence[str], cell: str) -> DataFrame:
    """Shannon entropy (nats) of a binned column; cells are counted first."""
    by = list(by)
    cells = df.groupBy(*by, cell).agg(F.count(F.lit(1)).alias("c"))
    return cells.groupBy(*by).agg(F.sum("c").alias("n"), (F.ln(F.sum("c")) - F.sum(F.col("c") * F.ln("c")) / F.sum("c")).alias("entropy"))


def rolling_entropy(out: str, cell: str, bins: int, n: int) -> list[Step]:
    """Entropy of the last ``n`` binned values from one running count per bin."""
    w = {f"_b{i}": rolling_sql(f"count(CASE WHEN {cell} = {i} THEN 1 END)", cell, n) for i in range(bins)}
    term = " + ".join(f"CASE WHEN _b{i} > 0 THEN _b{i} / {float(n)}D * ln(_b{i} / {float(n)}D) ELSE 0D END" for i in range(bins))
    return [sql_columns([cell], w, before=n), sql_columns(list(w), {out: f"CASE WHEN _b0 IS NOT NULL THEN -({term}) END"})]


def divergence(df: DataFrame, by: Sequence[str], cell: str, side: str) -> DataFrame:
    """KL and Jensen-Shannon divergence between two sides (``side`` true and false) of a binned column.

    KL is over add-one smoothed shares so that an empty cell does not make it infinite.
    """
    by = list(by)
    cells = df.groupBy(*by, cell).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    totals = cells.groupBy(*by).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count(F.lit(1)).alias("k"))
    joined = cells.join(totals, by)
    p, q = (F.col("a") + 1) / (F.col("ta") + F.col("k")), (F.col("b") + 1) / (F.col("tb") + F.col("k"))
    m = (p + q) / 2
    return joined.groupBy(*by).agg(
        F.sum(p * F.ln(p / q)).alias("kl"), F.sum((p * F.ln(p / m) + q * F.ln(q / m)) / 2).alias("js"))


def mutual_information(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Mutual information (nats) of two binned columns from their joint counts."""
    by = list(by)
    joint = df.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("c"))
    nx, ny, n = (Window.partitionBy(*by, x), Window.partitionBy(*by, y), Window.partitionBy(*by))
    cells = joint.select(*by, "c", F.sum("c").over(nx).alias("cx"), F.sum("c").over(ny).alias("cy"), F.sum("c").over(n).alias("t"))
    term = F.col("c") / F.col("t") * F.ln(F.col("c") * F.col("t") / (F.col("cx").cast("double") * F.col("cy")))
    return cells.groupBy(*by).agg(F.max("t").alias("n"), F.sum(term).alias("mutual_information"))


def transfer_entropy(df: DataFrame, by: Sequence[str], source: str, target: str, nxt: str) -> DataFrame:
    """Information of the source's bin about the target's next bin beyond the target's own bin."""
    by = list(by)
    joint = df.where(F.col(nxt).isNotNull()).groupBy(*by, source, target, nxt).agg(F.count(F.lit(1)).alias("c"))
    n = Window.partitionBy(*by)
    cells = joint.select(
        *by, "c", F.sum("c").over(Window.partitionBy(*by, source, target)).alias("cst"), F.sum("c").over(Window.partitionBy(*by, target, nxt)).alias("ctn"),
        F.sum("c").over(Window.partitionBy(*by, target)).alias("ct"), F.sum("c").over(n).alias("t"))
    term = F.col("c") / F.col("t") * F.ln(F.col("c").cast("double") * F.col("ct") / (F.col("cst").cast("double") * F.col("ctn")))
    return cells.groupBy(*by).agg(F.sum(term).alias("transfer_entropy"))


def fracdiff_weights(d: float, n: int) -> list[float]:
    w = [1.0]
    for k in range(1, n):
        w.append(-w[-1] * (d - k + 1) / k)
    return w


def fractional_difference(out: str, x: str, d: float, n: int = 20) -> Step:
    """Fixed-width fractional differencing as one weighted sum of earlier values."""
    from barlens.operators.blocks import lag_sql
    terms = " + ".join(f"({w!r}D) * {x if k == 0 else lag_sql(x, k)}" for k, w in enumerate(fracdiff_weights(d, n)))
    return sql_columns([x], {out: terms}, before=n)


def realised_variance(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily sum of squared log returns (column ``ret``) with its one, five and 22 day means of earlier days."""
    days = bars.where("ret IS NOT NULL").groupBy(*keys, F.to_date("ts").alias("day")).agg(F.sum(F.col("ret") * F.col("ret")).alias("rv"))
    w = Window.partitionBy(*keys).orderBy("day")

    def past(n: int) -> Column:
        f = w.rowsBetween(-n, -1)
        return F.when(F.count("rv").over(f) == n, F.avg("rv").over(f))
    return days.withColumns({"rv_day": past(1), "rv_week": past(5), "rv_month": past(22)})


def volume_profile(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the volume per hour of the day, and the equal share of a time-weighted plan."""
    keys = list(keys)
    hours = bars.groupBy(*keys, F.hour("ts").alias("hour")).agg(F.sum("volume").alias("volume"))
    w = Window.partitionBy(*keys)
    return hours.withColumns({"vwap_share": F.col("volume") / F.sum("volume").over(w), "twap_share": F.lit(1.0) / F.count(F.lit(1)).over(w)})


def square_root_impact(volatility: Column, size: Column, volume: Column, y: float = 1.0) -> Column:
    return y * volatility * F.sqrt(size / F.when(volume > 0, volume))
