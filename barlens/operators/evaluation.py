"""Metrics of trade ledgers, gates, session and cap analysis, walk-forward folds.

A ledger has strategy_id, symbol, entry_ts, exit_ts, direction, pnl, return_pct.
Everything is partial aggregation; windows run over days, hours, caps or folds,
whose number per strategy is bounded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.core import (
    KEYS, profit_factor, sd_from_sums, sharpe_trade_annual, sharpe_trade_count, weekday,
)
from barlens.operators.blocks import SLICE_BARS, timeframe_seconds
from barlens.operators.numbering import number_rows
from barlens.session import materialise


def daily_equity(trades: DataFrame, by: Sequence[str], cash: float = 100000.0) -> DataFrame:
    """Equity at the close of every day with a closed trade, its peak so far and the drawdown."""
    by = list(by)
    days = trades.groupBy(*by, F.to_date("exit_ts").alias("day")).agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (
        days.withColumn("equity", F.lit(cash) + F.sum("pnl").over(w))
        .withColumn("peak", F.greatest(F.lit(cash), F.max("equity").over(w)))
        .withColumn("drawdown", F.col("equity") / F.col("peak") - 1)
    )


def drawdown_profile(equity: DataFrame, by: Sequence[str]) -> DataFrame:
    """Deepest drawdown, share of days under water, longest spell below the peak in days."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy("day")
    at_peak = F.last(F.when(F.col("drawdown") == 0, F.col("day")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    start = F.first("day").over(w)
    spells = equity.withColumn("_under", F.datediff("day", F.coalesce(at_peak, start)))
    return spells.groupBy(*by).agg(
        (-F.min("drawdown")).alias("max_drawdown"), F.avg((F.col("drawdown") < 0).cast("double")).alias("underwater_share"),
        F.max(F.when(F.col("drawdown") < 0, F.col("_under")).otherwise(0)).alias("longest_recovery_days"))


def trade_metrics(trades: DataFrame, by: Sequence[str], cash: float = 100000.0) -> DataFrame:
    """Count, win rate, profit factor, annualised trade Sharpe, return, equity, drawdown, Calmar."""
    by = list(by)
    pnl = F.col("pnl")
    per_year = trades.groupBy(*by, F.year("entry_ts").alias("_y")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(pnl).alias("_s"), F.sum(pnl * pnl).alias("_ss"),
        F.count_if(pnl > 0).alias("_w"), F.sum(F.when(pnl > 0, pnl).otherwise(0.0)).alias("_gain"),
        F.sum(F.when(pnl < 0, -pnl).otherwise(0.0)).alias("_loss"),
        F.min("entry_ts").alias("_from"), F.max("exit_ts").alias("_to"))
    total = per_year.groupBy(*by).agg(
        F.sum("_c").alias("n"), F.avg("_c").alias("signals_per_year"), *[F.sum(c).alias(c) for c in ("_s", "_ss", "_w", "_gain", "_loss")],
        F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    n = F.col("n")
    sd = sd_from_sums(n, F.col("_s"), F.col("_ss"))
    equity = daily_equity(trades, by, cash).groupBy(*by).agg(
        F.max("peak").alias("equity_peak"), (-F.min("drawdown")).alias("max_drawdown"))
    final = F.lit(cash) + F.col("_s")
    years = F.greatest(F.datediff("_to", "_from") / 365.25, F.lit(1 / 365.25))
    growth = F.when(final > 0, F.pow(final / cash, 1 / years) - 1).otherwise(-1.0)
    pf = F.when(F.col("_loss") > 0, F.col("_gain") / F.col("_loss")).when(F.col("_gain") > 0, float("inf")).otherwise(0.0)
    return total.join(equity, by).select(
        *by, "n", (F.col("_w") / n).alias("win_rate"), F.round(pf, 3).alias("profit_factor"), (F.col("_s") / n).alias("avg_pnl"),
        F.coalesce(sharpe_trade_annual(F.col("_s") / n, sd, F.col("signals_per_year")), F.lit(0.0)).alias("sharpe"),
        "signals_per_year", ((final / cash - 1) * 100).alias("return_pct"), final.alias("equity_final"), "equity_peak",
        "max_drawdown", F.when(F.col("max_drawdown") > 0, growth / F.col("max_drawdown")).otherwise(0.0).alias("calmar"))


GATES = {"min_trades": 100, "min_sharpe": 0.8, "min_calmar": 0.5, "max_drawdown": 0.25}


def quality_gates(metrics: DataFrame, gates: Mapping[str, float] = GATES) -> DataFrame:
    """First failed gate in the order trades, Sharpe, Calmar, drawdown."""
    c = F.col
    reason = (
        F.when(c("n") < gates["min_trades"], "too_few_trades").when(c("sharpe") < gates["min_sharpe"], "low_sharpe")
        .when(c("calmar") < gates["min_calmar"], "low_calmar").when(c("max_drawdown") > gates["max_drawdown"], "deep_drawdown"))
    return metrics.withColumn("reject_reason", reason).withColumn("passed", F.col("reject_reason").isNull())


def signal_count_check(trades: DataFrame, by: Sequence[str], min_total: int = 100, min_year: int = 100) -> DataFrame:
    """Whether there are enough trades in total and in every year, with the worst year."""
    by = list(by)
    years = trades.groupBy(*by, F.year("entry_ts").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    agg = years.groupBy(*by).agg(F.sum("n").alias("total"), F.min("n").alias("worst_count"),
                                 F.min_by("year", F.struct("n", "year")).alias("worst_year"))
    return agg.withColumn("passed", (F.col("total") >= min_total) & (F.col("worst_count") >= min_year))


def _moments(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    pnl = F.col("pnl")
    return trades.groupBy(*by).agg(
        F.count(pnl).alias("n"), F.sum(pnl).alias("s"), F.sum(pnl * pnl).alias("ss"), F.count_if(pnl > 0).alias("w"))


def _sharpe():
    n = F.col("n")
    return F.coalesce(sharpe_trade_count(F.col("s") / n, sd_from_sums(n, F.col("s"), F.col("ss")), n), F.lit(0.0))


def hourly_profile(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, mean and win rate for each of the 24 hours, zero where nothing traded."""
    by = list(by)
    m = _moments(trades.withColumn("hour", F.hour("entry_ts")), [*by, "hour"])
    hours = m.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    n = F.col("n")
    return hours.join(m, [*by, "hour"], "left").select(
        *by, "hour", F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(F.col("s") / n, F.lit(0.0)).alias("mean"),
        F.coalesce(F.col("w") / n, F.lit(0.0)).alias("win_rate"))


def dow_profile(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, mean and win rate of each weekday that traded (Monday first)."""
    m = _moments(trades.withColumn("dow", weekday("entry_ts")), [*by, "dow"])
    names = F.array(*[F.lit(x) for x in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")])
    return m.select(*by, "dow", names[F.col("dow")].alias("day_name"), "n", (F.col("s") / F.col("n")).alias("mean"),
                    (F.col("w") / F.col("n")).alias("win_rate"))


def best_hours(profile: DataFrame, by: Sequence[str], top: int = 6) -> DataFrame:
    """Hours with the highest mean among those that traded."""
    w = Window.partitionBy(*by).orderBy(F.desc("mean"), "hour")
    return profile.where("n > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def best_session_window(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Circular window of 4 to 20 hours with the best Sharpe above that of all trades.

    Works on 24 sums per strategy; the first window in (width, start) order wins a tie.
    """
    by = list(by)
    hours = _moments(trades.withColumn("hour", F.hour("entry_ts")), [*by, "hour"])
    parts = hours.withColumn("width", F.explode(F.sequence(F.lit(4), F.lit(20)))).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).withColumn("start", F.pmod(F.col("hour") - F.col("i"), F.lit(24)))
    windows = parts.groupBy(*by, "width", "start").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]).withColumn("sharpe", _sharpe())
    base = hours.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]).select(
        *by, F.col("n").alias("total"), _sharpe().alias("baseline_sharpe"))
    enough = F.col("n") >= F.greatest(F.lit(10.0), F.col("total") * 0.15)
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("sharpe", 9)), "width", "start")
    best = (windows.join(base, by).where(enough & (F.round("sharpe", 9) > F.round("baseline_sharpe", 9)))
            .withColumn("_r", F.row_number().over(order)).where("_r = 1"))
    return base.join(best.drop("total", "baseline_sharpe"), by, "left").select(
        *by, "baseline_sharpe", F.col("start").alias("best_start_hour"),
        F.pmod(F.col("start") + F.col("width"), F.lit(24)).alias("best_end_hour"),
        F.coalesce("sharpe", "baseline_sharpe").alias("best_sharpe"),
        (F.coalesce("sharpe", "baseline_sharpe") - F.col("baseline_sharpe")).alias("sharpe_improvement"))


def daily_caps(trades: DataFrame, by: Sequence[str], tie: str, most: int = 10, min_n: int = 10) -> DataFrame:
    """Sharpe when only the first k trades of a day are taken, for k up to ``most`` and the busiest day.

    Only the first ``most`` rows of a day pass the ranking, which Spark limits
    before the shuffle; sums per rank then add up over the caps.
    """
    by = list(by)
    day = F.to_date("entry_ts").alias("day")
    ranked = trades.select(*by, day, "entry_ts", tie, "pnl").withColumn(
        "k", F.row_number().over(Window.partitionBy(*by, "day").orderBy("entry_ts", tie))).where(F.col("k") <= most)
    sums = _moments(ranked, [*by, "k"])
    w = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    caps = sums.select(*by, "k", *[F.sum(c).over(w).alias(c) for c in ("n", "s", "ss")])
    return caps.where(F.col("n") >= min_n).select(*by, F.col("k").alias("cap"), "n", F.round(_sharpe(), 4).alias("sharpe"))


def best_daily_cap(trades: DataFrame, by: Sequence[str], tie: str) -> DataFrame:
    """The cap with the best Sharpe if it beats taking every trade, and how busy days are."""
    by = list(by)
    days = trades.groupBy(*by, F.to_date("entry_ts").alias("day")).agg(F.count(F.lit(1)).alias("c")).groupBy(*by).agg(
        F.round(F.avg("c"), 1).alias("avg_trades_per_day"), F.max("c").alias("max_trades_per_day"))
    base = _moments(trades, by).select(*by, _sharpe().alias("baseline_sharpe"))
    order = Window.partitionBy(*by).orderBy(F.desc("sharpe"), "cap")
    best = daily_caps(trades, by, tie).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return base.join(days, by).join(best, by, "left").select(
        *by, "baseline_sharpe", F.when(F.col("sharpe") > F.col("baseline_sharpe"), F.col("cap")).alias("best_daily_cap"),
        F.col("sharpe").alias("best_sharpe"), (F.col("sharpe") - F.col("baseline_sharpe")).alias("sharpe_improvement"),
        "avg_trades_per_day", "max_trades_per_day")


# fixed values: bars per calendar day
BARS_PER_DAY = {"1m": 1440, "5m": 288, "15m": 96, "1h": 24, "4h": 6, "1d": 1}


def bar_profile(bars: DataFrame) -> DataFrame:
    """Size, range, price statistics, completeness and counts by year and hour of each series."""
    bpd = F.lit(None).cast("int")
    for tf, k in BARS_PER_DAY.items():
        bpd = F.when(F.col("timeframe") == tf, k).otherwise(bpd)
    close = F.col("close")
    cells = bars.groupBy(*KEYS, F.year("ts").alias("y"), F.hour("ts").alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.min(close).alias("lo"), F.max(close).alias("hi"),
        F.sum(close).alias("s"), F.sum(close * close).alias("ss"), F.sum("volume").alias("v"))
    years = cells.groupBy(*KEYS, "y").agg(F.sum("n").alias("n")).groupBy(*KEYS).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("y", "n")))).alias("bars_by_year"))
    hours = cells.groupBy(*KEYS, "h").agg(F.sum("n").alias("n")).groupBy(*KEYS).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", "n")))).alias("bars_by_hour"))
    n = F.col("bar_count")
    total = cells.groupBy(*KEYS).agg(
        F.sum("n").alias("bar_count"), F.min("a").alias("first_ts"), F.max("b").alias("last_ts"), F.min("lo").alias("price_min"),
        F.max("hi").alias("price_max"), F.sum("s").alias("_s"), F.sum("ss").alias("_ss"), F.sum("v").alias("_v"))
    expected = (F.datediff("last_ts", "first_ts") + 1) * bpd
    return total.join(years, list(KEYS)).join(hours, list(KEYS)).select(
        *KEYS, "bar_count", "first_ts", "last_ts", "price_min", "price_max", (F.col("_s") / n).alias("price_mean"),
        sd_from_sums(n, F.col("_s"), F.col("_ss")).alias("price_std"), (F.col("_v") / n).alias("avg_volume"),
        F.least(F.round(n / expected * 100, 1), F.lit(100.0)).alias("completeness_pct"), "bars_by_year", "bars_by_hour")


def coverage_by_year(bars: DataFrame, expected_per_year: Mapping[str, float]) -> DataFrame:
    """Bars per year against the expected number, with a traffic light at 90 and 70 percent."""
    exp = F.lit(None).cast("double")
    for tf, k in expected_per_year.items():
        exp = F.when(F.col("timeframe") == tf, float(k)).otherwise(exp)
    pct = F.col("n") / exp * 100
    return bars.groupBy(*KEYS, F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n")).select(
        *KEYS, "year", "n", F.round(pct, 1).alias("pct"),
        F.when(pct >= 90, "green").when(pct >= 70, "amber").otherwise("red").alias("light"))


def start_drift(profile: DataFrame, expected_start: str, days: int = 60) -> DataFrame:
    """Series that begin more than ``days`` after they should."""
    late = F.datediff("first_ts", F.lit(expected_start))
    return profile.select(*KEYS, late.alias("days_late"), (late > days).alias("drift_warning"))


# --- splits and folds -----------------------------------------------------------


def split_train_oos(bars: DataFrame, cutoff: str) -> DataFrame:
    """Adds ``split``: 'train' strictly before the cutoff, 'oos' from it on."""
    return bars.withColumn("split", F.when(F.col("ts") < F.lit(cutoff).cast("timestamp"), "train").otherwise("oos"))


def split_check(bars: DataFrame, cutoff: str) -> DataFrame:
    """Rows on both sides of the cutoff per series; ``usable`` when neither is empty."""
    s = split_train_oos(bars, cutoff).groupBy(*KEYS).agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "oos").alias("n_oos"))
    return s.withColumn("usable", (F.col("n_train") > 0) & (F.col("n_oos") > 0))


def recent_window(bars: DataFrame, days: int = 90, min_all: int = 50, min_recent: int = 30) -> DataFrame:
    """Bars of the last ``days`` of each series that has enough bars in all and recently."""
    ends = bars.groupBy(*KEYS).agg(F.max("ts").alias("_end"), F.count(F.lit(1)).alias("_all"))
    near = bars.join(ends, list(KEYS)).where(F.col("ts") >= F.col("_end") - F.make_dt_interval(F.lit(days)))
    counts = near.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_recent"))
    return near.join(counts, list(KEYS)).where((F.col("_all") >= min_all) & (F.col("_recent") >= min_recent)).drop("_end", "_all", "_recent")


SHORT_FOLDS = "short_folds"


def expanding_folds(bars: DataFrame, n_folds: int = 5, min_size: int = 500) -> DataFrame:
    """Bars once per fold and split: fold i trains on [0, (i+1) f) and tests on [(i+1) f, (i+2) f).

    A series whose folds would have fewer than ``min_size`` bars stays in the result: its bars come once,
    without fold and split, with ``reject_reason`` 'short_folds'.
    """
    if n_folds < 3:
        raise ValueError("at least three folds are needed")
    slice_ = F.floor(F.unix_seconds("ts") / (timeframe_seconds(F.col("timeframe")) * SLICE_BARS))
    numbered = number_rows(bars, KEYS, slice_, ["ts"], "rn", "_total").withColumn("_size", F.floor(F.col("_total") / (n_folds + 1)))
    short = F.col("_size") < min_size
    place = F.floor(F.col("rn") / F.when(short, F.lit(1)).otherwise(F.col("_size")))
    of_fold = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda i: F.struct(
            i.alias("fold"), F.when(place <= i, "train").when(place == i + 1, "test").alias("split"))),
        lambda x: x["split"].isNotNull())
    unplaced = F.array(F.struct(F.lit(None).cast("int").alias("fold"), F.lit(None).cast("string").alias("split")))
    return numbered.select("*", F.when(short, F.lit(SHORT_FOLDS)).alias("reject_reason"), F.inline(F.when(short, unplaced).otherwise(of_fold))).drop("_total", "_size")


def fold_ranges(folds: DataFrame) -> DataFrame:
    """Bars and first and last time of each series, fold and split; of a short series once, without fold and split."""
    return folds.groupBy(*KEYS, "fold", "split", "reject_reason").agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))


def in_folds(trades: DataFrame, ranges: DataFrame) -> DataFrame:
    """Trades with each fold and split of their series that their entry lies in.

    Times are cut into slices of ``SLICE_BARS`` bar widths; a range is listed under every slice it touches and a
    trade looks into its own slice only, so a hot series is met slice by slice and not as one key.
    """
    width = timeframe_seconds(F.col("timeframe")) * SLICE_BARS
    place = lambda c: F.floor(F.unix_seconds(c) / width)
    listed = ranges.where("fold IS NOT NULL").select(*KEYS, "fold", "split", "from_ts", "to_ts", F.explode(F.sequence(place("from_ts"), place("to_ts"))).alias("_slice"))
    return trades.withColumn("_slice", place("entry_ts")).join(listed, [*KEYS, "_slice"]).where("entry_ts BETWEEN from_ts AND to_ts").drop("_slice", "from_ts", "to_ts")


def fold_metrics(trades: DataFrame, ranges: DataFrame, variant: str) -> DataFrame:
    """Per series and fold the variant that is best in training and how it does in the test part.

    ``trades`` has symbol, timeframe, entry_ts, pnl and the variant, ``ranges`` one row per series, fold and
    split.  A trade counts where it is entered.  ``is_sharpe`` and ``oos_sharpe`` are annual (trades per calendar year), as in the
    trade metrics, and choose the variant; ``is_trade_sharpe`` and ``oos_trade_sharpe`` go by the number of trades.  A fold
    without training trades has no variant and zeros; a short series comes once with its ``reject_reason``.
    """
    by = [*KEYS, "fold"]
    yearly = _moments(in_folds(trades, ranges).withColumn("_y", F.year("entry_ts")), [*by, variant, "split", "_y"])
    m = yearly.groupBy(*by, variant, "split").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")], F.avg("n").alias("_per_year"))
    n, mean = F.col("n"), F.col("s") / F.col("n")
    annual = F.coalesce(sharpe_trade_annual(mean, sd_from_sums(n, F.col("s"), F.col("ss")), F.col("_per_year")), F.lit(0.0))
    m = m.select(*by, variant, "split", "n", annual.alias("annual"), _sharpe().alias("count"))

    def of(split: str, c: str):
        return F.max(F.when(F.col("split") == split, F.col(c)))
    wide = m.groupBy(*by, variant).agg(
        of("train", "annual").alias("is_sharpe"), F.coalesce(of("test", "annual"), F.lit(0.0)).alias("oos_sharpe"), of("train", "count").alias("is_trade_sharpe"),
        F.coalesce(of("test", "count"), F.lit(0.0)).alias("oos_trade_sharpe"), F.coalesce(of("test", "n"), F.lit(0)).alias("oos_trades"))
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(F.round("is_sharpe", 9)), variant)
    best = wide.where("is_sharpe IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    every = ranges.select(*by, "reject_reason").distinct().join(best, by, "left")
    placed = F.col("fold").isNotNull()
    return every.select(*by, variant, *[F.when(placed, F.coalesce(c, F.lit(0))).alias(c) for c in ("is_sharpe", "oos_sharpe", "is_trade_sharpe", "oos_trade_sharpe", "oos_trades")], "reject_reason")


def wf_summary(folds: DataFrame, by: Sequence[str], min_oos_sharpe: float = 0.6, max_ratio: float = 2.5) -> DataFrame:
    """Mean, deviation (population), minimum, overfitting ratio and the first reason to reject.

    A series that had no folds keeps its own reason and has no figures.
    """
    oos = F.col("oos_sharpe")
    agg = folds.groupBy(*by).agg(
        *([F.max("reject_reason").alias("_given")] if "reject_reason" in folds.columns else [F.max(F.lit(None).cast("string")).alias("_given")]), F.count(oos).alias("n_folds"), F.avg(oos).alias("mean_oos"), F.stddev_pop(oos).alias("std_oos"),
        F.min(oos).alias("min_oos"), F.avg("is_sharpe").alias("mean_is"), F.count_if(oos < 0).alias("n_negative"))
    mo, mi = F.col("mean_oos"), F.col("mean_is")
    ratio = F.when(mo.isNull(), None).when(mo > 0, mi / mo).when(mi > 0, 10.0).otherwise(1.0)
    return agg.withColumn("overfitting_ratio", ratio).withColumn("overfitting_flag", F.col("overfitting_ratio") > max_ratio).withColumn(
        "reject_reason", F.coalesce("_given", F.when(mo < min_oos_sharpe, "low_oos_sharpe").when(
            F.col("n_negative") > F.floor(F.col("n_folds") / 2), "negative_folds").when(F.col("overfitting_flag"), "overfitted"))).drop("_given")


def robust_params(folds: DataFrame, by: Sequence[str]) -> DataFrame:
    """The fold with the lower median test Sharpe."""
    w = Window.partitionBy(*by)
    ranked = folds.select("*", F.row_number().over(w.orderBy(F.round("oos_sharpe", 9), "fold")).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))
    return ranked.where(F.col("_r") == F.floor((F.col("_n") - 1) / 2) + 1).drop("_r", "_n")


def oos_degradation_gate(oos, train, floor: float = 0.6, share: float = 0.5):
    return oos >= F.greatest(F.lit(floor), share * train)


def recent_gate(trades: DataFrame, bars: DataFrame, by: Sequence[str], days: int = 90, min_n: int = 3, floor: float = -0.3,
                min_all: int = 50, min_recent: int = 30) -> DataFrame:
    """Fails a strategy that over the last ``days`` of its series' bars makes at least ``min_n`` trades with a Sharpe below ``floor``.

    ``by`` holds symbol and timeframe.  Series with fewer than ``min_all`` bars, or ``min_recent`` in the window, are not judged:
    they pass with ``judged`` false.  A strategy without recent trades passes with n = 0.
    """
    by = list(by)
    ends = materialise(bars.groupBy(*KEYS).agg(F.max("ts").alias("_end"), F.count(F.lit(1)).alias("_all")), "ends")
    since = F.col("_end") - F.make_dt_interval(F.lit(days))
    recent = bars.join(ends, list(KEYS)).where(F.col("ts") >= since).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_recent"))
    series = materialise(ends.join(recent, list(KEYS)).select(*KEYS, since.alias("_since"), ((F.col("_all") >= min_all) & (F.col("_recent") >= min_recent)).alias("judged")), "recent")
    near = F.when(F.col("entry_ts") >= F.col("_since"), F.col("pnl"))
    m = _moments(trades.join(series, list(KEYS)).select(*by, "judged", near.alias("pnl")), [*by, "judged"])
    found = m.withColumn("recent_sharpe", F.when(F.col("n") > 0, _sharpe()))
    fails = F.col("judged") & (F.col("n") >= min_n) & (F.col("recent_sharpe") < floor)
    return found.select(*by, "judged", "n", "recent_sharpe", (~F.coalesce(fails, F.lit(False))).alias("passed"))


def purged_folds(folds: DataFrame, label_bars: int, embargo_bars: int) -> DataFrame:
    """Train rows whose label window or embargo reaches into the fold's test rows are left out; short series stay as they are."""
    tests = folds.where("split = 'test'").groupBy(*KEYS, "fold").agg(F.min("rn").alias("_a"), F.max("rn").alias("_b"))
    joined = folds.join(tests, [*KEYS, "fold"], "left")
    overlaps = (F.col("rn") + label_bars >= F.col("_a")) & (F.col("rn") <= F.col("_b") + embargo_bars)
    return joined.where(F.col("split").isNull() | (F.col("split") == "test") | ~overlaps).drop("_a", "_b")
