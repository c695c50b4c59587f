"""Hand-checked cases and brute-force comparisons."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlens.functions import core
from barlens.operators import conditions as cnd
from barlens.operators import evaluation as ev
from barlens.operators import forward as fwd
from barlens.operators import indicators as ind
from barlens.operators import registry as rg
from barlens.operators import resampling as rs
from barlens.operators import sweep as sw
from barlens.operators import textscan as tx
from barlens.operators.blocks import compute
from barlens.operators.numbering import cumulative, number_rows
from barlens.operators.quantiles import exact_quantiles
from barlens.operators.recurrence import ema
from barlens.sources import bars as src


def make_bars(spark, rows, start="2024-01-01"):
    """(open, high, low, close) per hour."""
    pdf = pd.DataFrame(rows, columns=["open", "high", "low", "close"]).astype(float)
    pdf.insert(0, "ts", pd.date_range(start, periods=len(pdf), freq="h"))
    pdf.insert(0, "timeframe", "1h")
    pdf.insert(0, "symbol", "X")
    return spark.createDataFrame(pdf.assign(volume=1.0))


def closes(spark, values):
    return make_bars(spark, [(v, v, v, v) for v in values])


def col(df, name):
    return [row[name] for row in df.orderBy("ts").select("ts", name).collect()]


def test_ema_has_no_warm_up(spark):
    assert col(compute(closes(spark, [10, 11, 12]), [ema("e", "close", 3)]), "e") == pytest.approx([10, 10.5, 11.25])


def test_true_range_and_atr(spark):
    bars = make_bars(spark, [(11, 12, 10, 11), (12, 13, 11, 12), (10, 12, 9, 10)])
    df = compute(bars, [ind.true_range("tr"), ind.atr("atr", 2)])
    assert col(df, "tr") == [2, 2, 3] and col(df, "atr") == pytest.approx([2, 2, 2.5])


def test_rsi_is_null_without_losses(spark):
    got = col(compute(closes(spark, [10, 11, 10.5]), [ind.rsi("r", 2)]), "r")
    assert got[:2] == [None, None] and got[2] == pytest.approx(66.6667, abs=1e-4)


def test_zero_range_bar_and_new_high(spark):
    ids = ["close_near_high", "close_near_low", "doji", "large_body", "new_5bar_high"]
    df = cnd.conditions_wide(closes(spark, [1, 2, 3, 4, 5]), ids)
    assert all(col(df, i) == [False] * 5 for i in ids[:4])
    assert col(df, "new_5bar_high") == [False] * 4 + [True]


def test_unknown_condition_is_an_error(spark):
    with pytest.raises(ValueError):
        cnd.conditions_wide(closes(spark, [1]), ["no_such"])


def test_month_end_counts_calendar_days(spark):
    for day, want in (("2024-02-27", True), ("2024-02-26", False), ("2024-02-29", True)):
        bars = make_bars(spark, [(1, 1, 1, 1)], day)
        assert col(cnd.conditions_wide(bars, ["month_end"]), "month_end") == [want]


def test_forward_return_drops_the_end(spark):
    got = col(compute(closes(spark, [100, 110, 99]), [fwd.forward_return("f", 1)]), "f")
    assert got[:2] == pytest.approx([0.1, -0.1]) and got[2] is None


def test_catalogues():
    from barlens.operators import signals as sig
    assert len(cnd.CONDITIONS) == 65 and len({c.condition_id for c in cnd.CONDITIONS}) == 65
    assert len(sig.catalogue()) == 139


def test_profit_factor_and_sharpe(spark):
    df = spark.createDataFrame([(2.0,), (-1.0,), (3.0,), (-2.0,)], "pnl double")
    row = df.agg(core.profit_factor(F.col("pnl")).alias("pf"), core.sharpe_trade_count(
        F.avg("pnl"), F.stddev_samp("pnl"), F.count("pnl")).alias("s")).first()
    assert row.pf == pytest.approx(5 / 3) and row.s == pytest.approx(0.4201, abs=1e-4)
    wins = df.where("pnl > 0")
    got = wins.agg(*[core.profit_factor(F.col("pnl"), k).alias(k) for k in ("null", "inf", "zero")]).first()
    assert got["null"] is None and got["inf"] == float("inf") and got["zero"] == 0


def test_folds(spark):
    f = ev.expanding_folds(closes(spark, range(1, 25)), 3, 1).groupBy("fold", "split").agg(
        F.min("rn").alias("a"), F.max("rn").alias("b")).collect()
    got = {(x.fold, x.split): (x.a, x.b + 1) for x in f}
    assert got == {(0, "train"): (0, 6), (1, "train"): (0, 12), (2, "train"): (0, 18),
                   (0, "test"): (6, 12), (1, "test"): (12, 18), (2, "test"): (18, 24)}


def test_short_series_and_two_timeframes_keep_apart(spark):
    long = closes(spark, range(1, 41))
    both = long.union(long.withColumn("timeframe", F.lit("2h"))).union(closes(spark, range(1, 6)).withColumn("symbol", F.lit("short")))
    ranges = ev.fold_ranges(ev.expanding_folds(both, 3, 4))
    mark = [x for x in ranges.collect() if x.symbol == "short"]
    assert [(x.fold, x.split, x.bars, x.reject_reason) for x in mark] == [(None, None, 5, "short_folds")]
    trades = both.selectExpr("symbol", "timeframe", "ts AS entry_ts", "1 AS variant", "close % 7 - 2 AS pnl")
    alone = ev.fold_metrics(trades.where("timeframe = '2h'"), ranges.where("timeframe = '2h'"), "variant").collect()
    got = ev.fold_metrics(trades, ranges, "variant").collect()
    assert sorted(tuple(x) for x in got if x.timeframe == "2h") == sorted(tuple(x) for x in alone) and len(alone) == 3
    assert [x.reject_reason for x in got if x.symbol == "short"] == ["short_folds"]
    summary = {(x.symbol, x.timeframe): x for x in ev.wf_summary(ev.fold_metrics(trades, ranges, "variant"), ["symbol", "timeframe"]).collect()}
    assert len(summary) == 3 and summary["short", mark[0].timeframe].n_folds == 0
    untraded = ev.fold_metrics(trades.where("timeframe = 'none'"), ranges, "variant").where("fold IS NOT NULL").collect()
    assert len(untraded) == 6 and all(x.is_sharpe == 0 and x.variant is None for x in untraded)


def test_recent_gate_goes_by_the_bars(spark):
    bars = closes(spark, range(1, 201))  # hourly bars: all are recent
    old = bars.selectExpr("symbol", "timeframe", "'s' AS strategy_id", "ts AS entry_ts", "IF(close % 2 = 0, -3.0, 1.0) AS pnl")
    by = ["symbol", "timeframe", "strategy_id"]
    row = ev.recent_gate(old, bars, by).first()
    assert (row.n, row.judged, row.passed) == (200, True, False)
    gone = ev.recent_gate(old.withColumn("entry_ts", F.expr("entry_ts - INTERVAL 200 DAYS")), bars, by).first()
    assert (gone.n, gone.recent_sharpe, gone.passed) == (0, None, True)
    few = ev.recent_gate(old, bars.limit(20), by).first()
    assert few.judged is False and few.passed


def test_walk_forward_summary_and_robust_fold(spark):
    folds = spark.createDataFrame([(0, 1.0, -0.2), (1, 1.0, -0.2)], "fold int, is_sharpe double, oos_sharpe double")
    row = ev.wf_summary(folds.withColumn("k", F.lit(1)), ["k"]).first()
    assert row.overfitting_ratio == 10 and row.overfitting_flag
    four = spark.createDataFrame(list(enumerate([0.9, 1.1, 0.7, 1.2])), "fold int, oos_sharpe double").withColumn("k", F.lit(1))
    assert ev.robust_params(four, ["k"]).first().oos_sharpe == 0.9


def test_leakage_score(spark):
    code = "class S:\n  def init(self):\n    self.I(f)\n  y = x.shift(-1)\n  # z.shift(-1)\n  s = MinMaxScaler()"
    row = tx.leakage_scan(spark.createDataFrame([(code,)], "code string"), "code").first()
    assert (row.critical, row.warnings, row.score, row.passed) == (1, 1, 7.0, True)


def test_normalise_keeps_the_last_duplicate(spark):
    raw = spark.createDataFrame([("X", "1m", 0, 1.0, 1), ("X", "1m", 0, 2.0, 2)], "symbol string, timeframe string, ts_ms long, close double, arrival int")
    raw = raw.select("*", *[F.col("close").alias(c) for c in ("open", "high", "low")], F.lit(None).cast("double").alias("volume"))
    row = src.normalise_bars(raw, "arrival").first()
    assert row.close == 2 and row.volume == 0


def test_permutation_p(spark):
    real = spark.createDataFrame([("X", 1.5)], "symbol string, profit_factor double")
    perm = spark.createDataFrame([("X", x) for x in (1.0, 1.6, 1.2)], "symbol string, profit_factor double")
    assert rs.mcpt_pvalue(real, perm, ["symbol"]).first().p_value == 0.5


def test_error_classes(spark):
    texts = {"optimization_regression in walk-forward sharpe": "code_bug", "OOS degradation": "quality_rejection", "got SIGKILL": "infrastructure",
             "KeyError: 3": "code_bug", "": "unknown", "other": "unknown"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.c for r in df.select("t", rg.classify_error(F.col("t")).alias("c")).collect()} == texts


def test_order_does_not_matter_to_the_shuffle_test(spark):
    trades = spark.createDataFrame([("s", float(x)) for x in (1, -2, 3, 4, -1, 2, 5, -3, 1, 2, 0.5)], "strategy_id string, pnl double")
    row = rs.order_invariant_check(trades, ["strategy_id"], 50).first()
    assert row.p_value == 1 and row.null_std < 1e-9


def test_sign_flips_are_those_of_the_md5(spark):
    pnl = [1.0, -2.0, 3.0, 4.0, -1.0, 2.0, 5.0, -3.0, 1.0, 2.5]
    trades = spark.createDataFrame([("s", i, x) for i, x in enumerate(pnl)], "strategy_id string, trade_id int, pnl double")
    got = rs.sign_flip_test(trades, ["strategy_id"], ["trade_id"], 40).first()

    def stat(v):
        return np.mean(v) / max(np.std(v, ddof=1), 1e-10) * np.sqrt(len(v))
    null = []
    for rep in range(40):
        v = []
        for i, x in enumerate(pnl):
            digits = hashlib.md5(f"42:{rep // 60}:{i}".encode()).hexdigest()[:15]
            v.append(-x if int(digits, 16) >> rep % 60 & 1 else x)
        null.append(stat(v))
    assert got.p_value == pytest.approx(np.mean([n >= stat(pnl) - 1e-9 for n in null]))
    assert got.null_mean == pytest.approx(np.mean(null))


def test_permuted_bars_keep_their_shapes(spark, walk):
    pdf, bars = walk
    p = rs.bar_permute(bars, 2).toPandas()
    assert len(p) == 2 * len(pdf)
    for (_, symbol), g in p.groupby(["perm_id", "symbol"]):
        real = pdf[pdf["symbol"] == symbol]
        shapes = [np.sort(np.log(x["close"] / x["open"])) for x in (g, real)]
        np.testing.assert_allclose(*shapes, atol=1e-9)
        g = g.sort_values("ts")
        assert g["open"].iloc[0] == pytest.approx(real.sort_values("ts")["open"].iloc[0])
        gaps = [np.sort(np.log(x["open"].to_numpy()[1:] / x["close"].to_numpy()[:-1])) for x in (g, real.sort_values("ts"))]
        np.testing.assert_allclose(*gaps, atol=1e-9)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    pdf = pd.concat([
        pd.DataFrame({"k": "a", "x": rng.normal(0, 1, 501)}), pd.DataFrame({"k": "b", "x": np.repeat([1.0, 1.0 + 1e-9, 7.0], 30)}),
        pd.DataFrame({"k": "c", "x": [5.0]}), pd.DataFrame({"k": "d", "x": np.r_[-rng.random(40) * 1e-7, rng.random(60) * 1e5]})])
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "x", probs).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, list(probs)].astype(float), np.quantile(g["x"], list(probs.values())), rtol=1e-12)


def test_average_ranks(spark):
    pdf = pd.DataFrame({"k": ["a"] * 8, "x": [3.0, 1.0, 3.0, -2.0, 0.0, 0.0, 9.0, 3.0]})
    got = fwd.average_ranks(spark.createDataFrame(pdf), ["k"], "x", "rank").toPandas()
    want = pdf.assign(rank=pdf["x"].rank())
    assert sorted(zip(got["x"], got["rank"])) == sorted(zip(want["x"], want["rank"]))


def test_numbers_and_running_sums(spark):
    df = spark.createDataFrame([("a", i, (i * 37) % 101) for i in range(100)], "k string, i int, x int")
    got = number_rows(df, ["k"], F.floor(F.col("x") / 10), ["x"], "rn", "total")
    out = cumulative(got, ["k"], "rn", F.col("x").cast("double"), "run", block=8).orderBy("rn").toPandas()
    xs = sorted((i * 37) % 101 for i in range(100))
    assert out["x"].tolist() == xs and out["run"].tolist() == np.cumsum(xs).tolist() and (out["total"] == 100).all()


def test_student_p_values(spark):
    # two-sided values of the t distribution
    known = [(2.045, 29, 0.05), (2.262, 9, 0.05), (1.96, 100000, 0.05), (3.25, 9, 0.01), (0.0, 50, 1.0)]
    df = spark.createDataFrame([(t, n) for t, n, _ in known], "t double, n int")
    got = [r.p for r in df.select(core.student_t_pvalue(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got == pytest.approx([p for _, _, p in known], abs=1e-4)


def test_upsert_is_idempotent_and_newest_wins(spark, tmp_path):
    base = spark.createDataFrame([(1, 0, "old", 1), (2, 0, "keep", 5)], "k int, part int, v string, version int")
    new = spark.createDataFrame([(1, 0, "new", 2), (2, 0, "stale", 3), (3, 1, "added", 1)], base.schema)
    once = rg.upsert(base, new, keys=["k", "part"], version="version")
    twice = rg.upsert(once, new, keys=["k", "part"], version="version")
    want = {1: "new", 2: "keep", 3: "added"}
    assert {r.k: r.v for r in once.collect()} == want == {r.k: r.v for r in twice.collect()}
    path = str(tmp_path / "t")
    base.write.partitionBy("part").parquet(path)
    for _ in range(2):
        rg.upsert_path(new, path, keys=["k", "part"], version="version", partition=["part"])
    assert {r.k: r.v for r in spark.read.schema(base.schema).parquet(path).collect()} == want


def test_exit_categories_and_bounds(spark):
    df = spark.createDataFrame([(1.5, 1.2, 0.4, 0.2, 0.01), (1.0, 1.2, 0.4, 0.2, 0.01), (1.5, 1.2, 0.4, 0.2, 0.5)], "pf double, b double, r double, br double, p double")
    got = [x.c for x in df.select(fwd.categorise_exit(*[F.col(c) for c in ("pf", "b", "r", "br", "p")]).alias("c")).collect()]
    assert got == ["works", "fails", "partial"]
    row = spark.range(1).select(sw.tighten_bounds(F.lit(0.5), F.lit(2), F.lit(10)).alias("b"), sw.tighten_cap(F.lit(0.5), F.lit(9)).alias("c")).first()
    assert tuple(row.b) == (0, 5, 7, 13) and row.c == 10


def test_param_grid(spark):
    g = sw.param_grid(spark, {"a": [1, 2], "b": ["x"]}, {"c": 5}).orderBy("grid_order").collect()
    assert [r.params_id for r in g] == ['{"a":1,"b":"x","c":5}', '{"a":2,"b":"x","c":5}']
    assert sw.param_grid(spark, {}).count() == 1


def test_salvaged_json(spark):
    raw = ['[{"k": 1}, {"k": 2}, {"cu', '{"k": 3},', "nothing"]
    df = spark.createDataFrame([(x,) for x in raw], "raw string")
    got = df.select(F.expr("1"), tx.salvage_json_array(F.col("raw")).alias("v")).selectExpr("try_variant_get(v, '$[0].k', 'int') k", "v IS NULL AS bad").collect()
    assert [r.k for r in got] == [1, 3, None] and [r.bad for r in got] == [False, False, True]


def test_bars_round_trip_prunes(spark, walk, tmp_path):
    pdf, bars = walk
    path = str(tmp_path / "bars")
    src.write_bars(bars, path)
    back = src.read_bars(spark, path).where("symbol = 'BBB'")
    assert back.count() == (pdf["symbol"] == "BBB").sum()
    assert "PartitionFilters: [isnotnull(symbol" in back._jdf.queryExecution().toString()


def test_faulty_bars_are_reported(spark):
    bad = make_bars(spark, [(1, 1, 2, 1), (1, 2, 1, 0), (1, 2, 1, 1)])
    row = src.validate_bars(bad.unionByName(bad.limit(1))).first()
    assert (row.n_rows, row.n_high_lt_low, row.n_nonpositive_close, row.n_dup_ts) == (4, 2, 1, 1)
    with pytest.raises(Exception, match="faulty bar"):
        src.require_valid(bad).collect()


def test_symbols_and_timeframes(spark):
    df = spark.createDataFrame([("eur/usd",), ("BTC-USD",), ("aapl",)], "s string")
    assert [r.t for r in df.select(src.normalise_symbol(F.col("s")).alias("t")).collect()] == ["C:EURUSD", "X:BTCUSD", "AAPL"]
    tf = spark.createDataFrame([("15m",), ("1x",)], "tf string").select(src.parse_timeframe(F.col("tf")).alias("p"))
    with pytest.raises(Exception, match="unknown timeframe"):
        tf.collect()


def test_session_hours_are_inclusive_of_their_last_hour(spark):
    df = cnd.conditions_wide(closes(spark, range(1, 25)), ["session_asian", "session_london", "session_overlap", "session_ny"])
    hours = {c: [r.ts.hour for r in df.where(c).orderBy("ts").collect()] for c in ("session_asian", "session_london", "session_overlap", "session_ny")}
    assert hours == {"session_asian": list(range(7)), "session_london": list(range(7, 13)), "session_overlap": list(range(13, 17)), "session_ny": list(range(13, 22))}


def test_widths_of_any_kind(spark):
    assert src.width_of(" 2H ") == (2, "h") and src.interval_of("1w") == "1 weeks"
    for bad in ("1mo", "h", "0m", "", "1x"):
        with pytest.raises(ValueError, match="unknown timeframe"):
            src.width_of(bad)
    bars = closes(spark, range(1, 24 * 15 + 1))  # 2024-01-01 is a Monday
    weeks = src.resample_bars(bars, "1W").orderBy("ts").collect()
    assert [str(w.ts.date()) for w in weeks] == ["2024-01-01", "2024-01-08", "2024-01-15"] and {w.timeframe for w in weeks} == {"1w"}
    assert src.resample_bars(bars, "30m").count() == bars.count() and src.resample_bars(bars, "2h").count() == bars.count() // 2
    with pytest.raises(Exception, match="several timeframes"):
        src.resample_bars(bars.union(bars.withColumn("timeframe", F.lit("1d"))), "1d").collect()


def test_rows_of_an_unknown_timeframe_are_an_error_and_never_lost(spark):
    bars = closes(spark, [1.0, 2.0, 3.0])
    assert compute(bars.withColumn("timeframe", F.lit(" 1H")), [ind.sma("s", "close", 2)]).count() == 3
    with pytest.raises(Exception, match="unknown timeframe"):
        compute(bars.withColumn("timeframe", F.lit("1mo")), [ind.sma("s", "close", 2)]).collect()


def test_nan_is_a_missing_value(spark):
    raw = spark.createDataFrame([("X", "1h", 0, 1.0, 2.0, 0.5, float("nan"), float("nan"))], "symbol string, timeframe string, ts_ms long, open double, high double, low double, close double, volume double")
    row = src.normalise_bars(raw).first()
    assert row.close is None and row.volume == 0.0
    assert src.validate_bars(raw.withColumn("ts", F.timestamp_millis("ts_ms"))).first().n_missing_price == 1
    with pytest.raises(Exception, match="faulty bar"):
        src.require_valid(raw).collect()
    ticks = spark.createDataFrame([("X", 0, 1.0), ("X", 1, float("nan")), ("X", 2, None), ("X", 3, 2.0)], "s string, t long, p double")
    bar = src.bars_from_ticks(ticks, symbol=F.col("s"), ts=F.timestamp_seconds("t"), price=F.col("p"), size=F.lit(1.0), width="1h").first()
    assert (bar.open, bar.high, bar.close, bar.volume) == (1.0, 2.0, 2.0, 2.0)


def test_duplicates_without_arrival_have_one_result(spark):
    rows = [("X", "1h", 0, 1.0, 2.0, 0.5, float(c), 1.0) for c in (1, 3, 2)]
    raw = spark.createDataFrame(rows, "symbol string, timeframe string, ts_ms long, open double, high double, low double, close double, volume double")
    assert [src.normalise_bars(raw.orderBy(F.rand(s))).first().close for s in range(4)] == [3.0] * 4


def test_every_strategy_is_answered_about_its_dependencies(spark):
    s = spark.createDataFrame([(1, [10]), (2, []), (3, None), (4, [99]), (5, [10, 11]), (6, [12, 99])], "id int, pending_ids array<int>")
    t = spark.createDataFrame([(10, "done"), (11, "running"), (12, "failed")], "id int, status string")
    assert {r.id: r.next for r in rg.dependencies_done(s, t).collect()} == {1: "ready", 2: "filtered", 3: "filtered", 4: "filtered", 5: None, 6: "ready"}


def test_missing_times_and_counts_are_stale_and_retried(spark):
    t = spark.createDataFrame(
        [(1, "running", None, 0, "a"), (2, "failed", None, None, None), (3, "failed", None, 3, "b"), (4, "live", None, 0, None),
         (5, "backtesting", None, 1, None), (6, "backtesting", None, 1, "c"), (7, "failed", None, 2, "d")],
        "id int, status string, updated_at timestamp, retry_count int, job_id string")
    got = {r.id: (r.new, r.retry_count, r.job_id) for r in rg.stale_jobs(t, "2024-01-01 00:00:00", key="id").collect()}
    assert got == {1: ("failed", 0, None), 2: ("pending", 1, None), 6: ("failed", 1, None), 7: ("pending", 3, None)}


def test_series_below_the_least_length_are_left_out_of_a_sweep(spark):
    bars = spark.range(300).selectExpr("CASE WHEN id < 200 THEN 'A' ELSE 'B' END AS symbol", "'1h' AS timeframe")
    stats = spark.createDataFrame([("A", "1h", 1.0), ("B", "1h", 2.0), ("C", "1h", 3.0)], "symbol string, timeframe string, pf double")
    assert [r.symbol for r in sw.long_enough(stats, bars).collect()] == ["A"]
    assert sw.long_enough(stats, bars.limit(0)).count() == 0


def test_a_cluster_must_name_its_scratch_folder():
    from barlens.session import scratch_dir

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session())
