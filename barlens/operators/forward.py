"""What follows a condition or a signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.functions.core import (
    KEYS, profit_factor, safe_corr, sd_from_sums, sharpe_horizon, student_t_pvalue, t_stat,
)
from barlens.operators.blocks import Step, column, compute, frame
from barlens.operators.conditions import check_ids, inputs, with_conditions
from barlens.operators.quantiles import average_ranks, exact_quantiles, value_bucket
from barlens.session import materialise


def forward_return(out: str, h: int, kind: str = "simple") -> Step:
    """Return over the next ``h`` bars; null for the last ``h`` bars of a series."""
    def expr() -> Column:
        later = F.lead("close", h).over(frame())
        return F.ln(later / F.col("close")) if kind == "log" else later / F.col("close") - 1
    return column(out, [], expr, after=h)


def condition_hits(bars: DataFrame, ids: Sequence[str] | None, horizons: Sequence[int]) -> DataFrame:
    """Per bar the numbers of the conditions that hold (``hits``) and the forward returns ``fwd<h>``."""
    chosen = check_ids(list(ids) if ids is not None else None)

    def pack(df: DataFrame) -> DataFrame:
        df = with_conditions(df, chosen)
        hits = ", ".join(f"CASE WHEN {c} THEN CAST({i} AS SMALLINT) END" for i, c in enumerate(chosen))
        return df.selectExpr(*KEYS, f"array_compact(array({hits})) AS hits", *[f"fwd{h}" for h in horizons],
                             *[c for c in df.columns if c.startswith("_")])

    return compute(bars, [*inputs(), *[forward_return(f"fwd{h}", h) for h in horizons],
                          Step(tuple(f"fwd{h}" for h in horizons), (), pack)])


def spread_hits(wide: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(symbol, timeframe, forward_bars, ret, bucket, condition_no): only what holds, only known returns.

    Conditions that do not hold leave no row, and the rows feed an aggregation
    in the same stage; they are never shuffled as such.
    """
    pairs = F.array(*[F.struct(F.lit(h).alias("forward_bars"), F.col(f"fwd{h}").alias("ret")) for h in horizons])
    return (
        wide.select(*KEYS, "hits", F.explode(pairs).alias("_p"))
        .select(*KEYS, "hits", "_p.*").where("ret IS NOT NULL")
        .withColumn("bucket", value_bucket(F.col("ret")))
        .select(*KEYS, "forward_bars", "ret", "bucket", F.explode("hits").alias("condition_no"))
    )


def condition_stats(bars: DataFrame, *, ids: Sequence[str] | None = None,
                    horizons: Sequence[int] = (1, 4, 12, 24), min_n: int = 30, alpha: float = 0.05) -> DataFrame:
    """Sample size, mean, deviation, median, hit rate, t, p and Sharpe per condition and horizon.

    The conditions of each bar are written once as small numbers; sums and value
    counts come from one pass over them, exact medians from a second pass over
    the values near the middle.
    """
    chosen = check_ids(list(ids) if ids is not None else None)
    keys = ["condition_no", *KEYS, "forward_bars"]
    hits = spread_hits(materialise(condition_hits(bars, chosen, horizons), "hits"), horizons)
    ret = F.col("ret")
    hist = materialise(
        hits.groupBy(*keys, "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.sum(ret).alias("s"), F.sum(ret * ret).alias("ss"),
            F.count_if(ret > 0).alias("wins"), F.min(ret).alias("lo"), F.max(ret).alias("hi")),
        "condition-hist")
    median = exact_quantiles(hits, keys, "ret", {"median_return": 0.5}, hist=hist)
    sums = hist.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "wins")]).where(F.col("n") >= min_n)
    n, mean, sd = F.col("n"), F.col("mean_return"), F.col("std_return")
    stats = (
        sums.withColumn("mean_return", F.col("s") / n).withColumn("std_return", sd_from_sums(n, F.col("s"), F.col("ss")))
        .withColumn("t_stat", t_stat(mean, sd, n))
        .withColumn("p_value", student_t_pvalue(F.col("t_stat"), n - 1))
        .withColumn("sharpe", sharpe_horizon(mean, sd, F.col("timeframe"), F.col("forward_bars")))
    )
    name = F.element_at(F.array(*[F.lit(c) for c in chosen]), F.col("condition_no").cast("int") + 1)
    return stats.join(median, keys, "left").select(
        name.alias("condition_id"), *KEYS, "forward_bars", n.alias("n_samples"), "mean_return", "std_return", "median_return",
        (F.col("wins") / n).alias("hit_rate"), "t_stat", "p_value", "sharpe",
        F.coalesce((F.col("p_value") < alpha) & (n >= 30), F.lit(False)).alias("is_significant"))


def signal_stats(signals: DataFrame, *, keys: Sequence[str], horizons: Sequence[int] = (5, 10, 20, 50),
                 min_n: int = 10) -> DataFrame:
    """Forward log-return statistics of ±1 signals per horizon for both sides and each alone.

    ``signals`` carries ``signal`` and one ``fwd<h>`` log return per horizon.  The
    sides come from one grouping-sets aggregation over the signed returns.
    """
    keys = list(keys)
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), (F.col(f"fwd{h}") * F.col("signal")).alias("ret"))
                      for h in horizons])
    rows = (
        signals.where("signal <> 0")
        .select(*keys, F.when(F.col("signal") > 0, "long").otherwise("short").alias("side"), F.explode(pairs).alias("_p"))
        .select(*keys, "side", "_p.*").where("ret IS NOT NULL")
    )
    ret = F.col("ret")
    by = [F.col(k) for k in (*keys, "horizon")]
    agg = rows.groupingSets([by, [*by, F.col("side")]], *by, F.col("side")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(ret > 0, 1.0).otherwise(0.0)).alias("hit"),
        F.avg(ret).alias("m"), F.stddev_samp(ret).alias("sd"), profit_factor(ret).alias("pf"))
    ok = F.col("n") >= min_n
    t = t_stat(F.col("m"), F.col("sd"), F.col("n"))
    return agg.select(
        *keys, "horizon", F.coalesce("side", F.lit("both")).alias("side"), "n",
        F.when(ok, F.col("hit")).alias("hit_rate"), F.when(ok, F.col("m")).alias("avg_log_return"),
        F.when(ok, F.col("pf")).alias("profit_factor"), F.when(ok, t).alias("t_stat"),
        F.when(ok, student_t_pvalue(t, F.col("n") - 1)).alias("p_value"))


def categorise_entry(pf: Column, hit: Column, t: Column, p: Column) -> Column:
    """'works', 'fails' or 'partial' from the stated thresholds; p >= 0.10 allows 'partial' at best."""
    works = (pf >= 1.4) & (hit >= 0.53) & (t >= 1.8) & (p < 0.10)
    fails = (pf <= 0.8) | ((t <= -1.5) & (hit <= 0.47))
    return F.when(F.coalesce(works, F.lit(False)), "works").when(
        F.coalesce(fails, F.lit(False)), "fails").otherwise("partial")


def categorise_exit(pf: Column, base_pf: Column, r: Column, base_r: Column, p: Column) -> Column:
    works = (pf - base_pf >= 0.2) & (r - base_r >= 0.15) & (p < 0.10)
    return F.when(F.coalesce(works, F.lit(False)), "works").when(
        F.coalesce(pf < base_pf, F.lit(False)), "fails").otherwise("partial")


def confidence_from_p(p: Column) -> Column:
    return F.coalesce(F.round(F.least(F.greatest(1 - p, F.lit(0.0)), F.lit(1.0)), 2), F.lit(0.5))


def cost_viable(mean_return: Column, cost_rt: float = 0.0004, k: float = 3.0) -> Column:
    return F.abs(mean_return) >= k * cost_rt


def direction_of(hit_rate: Column) -> Column:
    rate = F.coalesce(hit_rate, F.lit(0.5))
    return F.when(rate > 0.5, "bull").when(rate < 0.5, "bear").otherwise("none")


def feature_forward_corr(df: DataFrame, keys: Sequence[str], feature: str, ret: str) -> DataFrame:
    """Pearson and Spearman correlation of a feature with the next return."""
    keys = list(keys)
    known = df.where(F.col(feature).isNotNull() & F.col(ret).isNotNull())
    ranked = average_ranks(average_ranks(known, keys, feature, "_rf"), keys, ret, "_rr")
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), safe_corr(feature, ret).alias("pearson"), safe_corr("_rf", "_rr").alias("spearman"))


def two_sample_tests(df: DataFrame, keys: Sequence[str], flag: str, value: str) -> DataFrame:
    """t (pooled and Welch), and Mann-Whitney U with its normal approximation, of flagged against other rows."""
    keys = list(keys)
    ranked = average_ranks(df.where(F.col(value).isNotNull()), keys, value, "_rank")
    on, x = F.col(flag), F.col(value)
    agg = ranked.groupBy(*keys).agg(
        F.count_if(on).alias("n_on"), F.count_if(~on).alias("n_off"),
        F.avg(F.when(on, x)).alias("mean_on"), F.avg(F.when(~on, x)).alias("mean_off"),
        F.var_samp(F.when(on, x)).alias("_v1"), F.var_samp(F.when(~on, x)).alias("_v0"),
        F.sum(F.when(on, F.col("_rank"))).alias("_r1"))
    n1, n0 = F.col("n_on"), F.col("n_off")
    pooled = ((n1 - 1) * F.col("_v1") + (n0 - 1) * F.col("_v0")) / (n1 + n0 - 2)
    diff = F.col("mean_on") - F.col("mean_off")
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    return agg.select(
        *keys, "n_on", "n_off", "mean_on", "mean_off",
        (diff / F.sqrt(pooled * (1 / n1 + 1 / n0))).alias("t_pooled"),
        (diff / F.sqrt(F.col("_v1") / n1 + F.col("_v0") / n0)).alias("t_welch"), u.alias("u_stat"),
        ((u - n1 * n0 / 2) / F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12)).alias("u_z"))


def regime_filter_quality(df: DataFrame, keys: Sequence[str], regime: str, ret: str) -> DataFrame:
    """How a regime flag splits signed returns: hit rates, time on, winners it blocks."""
    on, x = F.col(regime), F.col(ret)
    win = F.when(x > 0, 1.0).otherwise(0.0)
    return df.where(x.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(on, win)).alias("hit_on"), F.avg(F.when(~on, win)).alias("hit_off"),
        F.avg(on.cast("double")).alias("time_on"),
        (F.sum(F.when(~on, win).otherwise(0.0)) / F.when(F.sum(win) > 0, F.sum(win))).alias("winners_blocked"))
