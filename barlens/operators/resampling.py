"""Permutation and bootstrap tests as aggregations over replicates.

Draws come from an md5 of (seed, row key) and the number of the replicate, so they do not depend on
partitioning and a lost task redraws the same numbers.  A row is never repeated per
replicate: sign flips are bits of a digest, bootstrap weights an array per row that is summed position
by position inside the task; only sums per replicate are shuffled.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.functions.core import KEYS, profit_factor, sd_from_sums, sharpe_perm
from barlens.operators.blocks import BLOCK_ROWS, SLICE_BARS, Step, compute, lag_sql, own_rows, reach, run_steps, sql_columns, timeframe_seconds
from barlens.operators.numbering import number_rows
from barlens.operators.permutation import PRIME, key_number, with_places
from barlens.session import materialise

# cumulative Poisson(1) probabilities; a weight above 12 is less likely than the 2**-28 that a draw can tell apart
POISSON_STEPS = tuple(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(13)))
#: Signs that one digest gives: 15 hexadecimal digits fit a long.
SIGNS = 60


# fixed values: steps by which a row's two numbers move from replicate to replicate
DRAW_STEPS = (1299709, 15485863)
#: Rows whose weights are drawn at a time: a few megabytes for a thousand replicates.
DRAWN_ROWS = 512


def poisson_weights(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """Times that each row enters each of ``n`` replicates (rows x replicates)."""
    rep = np.arange(1, n + 1, dtype=np.int64)
    left = (first[:, None] + (rep * DRAW_STEPS[0] % PRIME)[None]) % PRIME
    left *= (second[:, None] + (rep * DRAW_STEPS[1] % PRIME)[None]) % PRIME
    left %= PRIME
    u = left / float(PRIME)
    out = np.zeros(u.shape, np.int8)
    for step in POISSON_STEPS:
        out += u >= step
    return out


def weighted_sums(df: DataFrame, by: Sequence[str], key: Sequence[str], values: Sequence[str], n: int, seed: int) -> DataFrame:
    """``by``, ``rep`` (from 1) and, for each of the ``values``, its sum over the rows times their Poisson(1) weights.

    Each task draws a row's weights for all replicates as one array and adds the arrays of a
    group position by position; what it sends on is one array per group and batch of rows, however many rows there are.
    """
    by, values = list(by), list(values)
    parts = [F.lit(str(seed)), *[F.col(k) for k in key]]
    ready = df.select(*by, key_number(parts, 0).alias("_h1"), key_number(parts, 1).alias("_h2"), *[F.col(v).cast("double").alias(v) for v in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            numbers: dict[tuple, int] = {}
            group = np.array([numbers.setdefault(k, len(numbers)) for k in zip(*[batch.column(i).to_pylist() for i in range(len(by))])])
            order = np.argsort(group, kind="stable")
            h1, h2 = (batch.column(len(by) + i).to_numpy(zero_copy_only=False)[order] for i in range(2))
            x = [batch.column(len(by) + 2 + i).to_numpy(zero_copy_only=False)[order] for i in range(len(values))]
            group, held = group[order], None

            def out(rows: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
                keys = batch.select(list(range(len(by)))).take(pa.array(order[rows]))
                arrays = [pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), n).cast(pa.list_(pa.float64())) for s in sums]
                return pa.RecordBatch.from_arrays([*keys.columns, *arrays], [*by, *values])

            for a in range(0, len(group), DRAWN_ROWS):
                part = group[a: a + DRAWN_ROWS]
                w = poisson_weights(h1[a: a + DRAWN_ROWS], h2[a: a + DRAWN_ROWS], n).astype(float)
                starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                sums = [np.add.reduceat(w * v[a: a + DRAWN_ROWS, None], starts, axis=0) for v in x]
                rows = (starts + a).tolist()
                if held is not None:
                    if group[held[0]] == part[0]:  # the group goes on
                        for s, h in zip(sums, held[1]):
                            s[0] += h[0]
                    else:
                        yield out([held[0]], held[1])
                if len(rows) > 1:
                    yield out(rows[:-1], [s[:-1] for s in sums])
                held = rows[-1], [s[-1:] for s in sums]
            yield out([held[0]], held[1])

    ddl = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in ready.select(*by).schema], *[f"{v} array<double>" for v in values]])
    summed = ready.mapInArrow(run, ddl).select(*by, F.posexplode(F.arrays_zip(*values)).alias("rep", "_z"))
    return summed.groupBy(*by, (F.col("rep") + 1).alias("rep")).agg(*[F.sum(f"_z.{v}").alias(v) for v in values])


def _replicates(n: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rep")


def _stat(n: Column, s: Column, ss: Column) -> Column:
    return sharpe_perm(s / n, sd_from_sums(n, s, ss), n)


def _actual(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    pnl = F.col("pnl")
    return trades.groupBy(*by).agg(F.count(pnl).alias("_n"), F.sum(pnl).alias("_s"), F.sum(pnl * pnl).alias("_ss")).select(
        *by, F.col("_n").alias("n"), _stat(F.col("_n"), F.col("_s"), F.col("_ss")).alias("actual"))


def _test(null: DataFrame, actual: DataFrame, by: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """p, z and spread of the null distribution; a group holds one row per replicate."""
    stat = F.col("stat")
    out = null.join(actual, list(by)).groupBy(*by, "n", "actual").agg(
        F.avg(stat).alias("null_mean"), F.stddev_pop(stat).alias("null_std"), F.percentile(stat, F.lit(0.95)).alias("null_p95"),
        F.avg(F.when(stat >= F.col("actual") - tol, 1.0).otherwise(0.0)).alias("p_value"))
    z = F.when(F.col("null_std") > 1e-9, (F.col("actual") - F.col("null_mean")) / F.col("null_std")).otherwise(0.0)
    small = F.col("n") < 10
    return out.withColumn("p_value", F.when(small, 1.0).otherwise(F.col("p_value"))).withColumn("z", z)


def order_invariant_check(trades: DataFrame, by: Sequence[str], n: int = 1000) -> DataFrame:
    """The shuffled-order test: its statistic does not depend on the order.

    Mean and deviation of a shuffled list equal those of the list, so every
    replicate equals the actual value up to rounding and p is 1.  Kept to show
    that; use ``sign_flip_test`` or ``block_bootstrap`` instead.
    """
    pnl = F.col("pnl")
    reps = trades.select(*by, "pnl", _replicates(n)).groupBy(*by, "rep").agg(
        F.count(pnl).alias("_n"), F.sum(pnl).alias("_s"), F.sum(pnl * pnl).alias("_ss"))
    return _test(reps.select(*by, _stat(F.col("_n"), F.col("_s"), F.col("_ss")).alias("stat")), _actual(trades, by), by)


def sign_flip_test(trades: DataFrame, by: Sequence[str], key: Sequence[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """Null of a symmetric outcome: each trade keeps or flips its sign.

    A sign needs one bit, so one md5 of (seed, group of replicates, row key) serves sixty
    replicates, whose sums are columns of one map-side combined aggregation.  The number of trades and
    the sum of squares are the same in all replicates.
    """
    pnl = F.col("pnl")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_g").cast("string"), *[F.col(k).cast("string") for k in key]))
    drawn = trades.select(*by, *[k for k in key if k not in by], "pnl", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // SIGNS))).alias("_g")) \
        .select(*by, "pnl", "_g", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("_h"))
    sums = drawn.groupBy(*by, "_g").agg(
        F.count(pnl).alias("_n"), F.sum(pnl * pnl).alias("_ss"), *[F.sum(F.when(F.getbit("_h", F.lit(k)) == 1, -pnl).otherwise(pnl)).alias(f"_s{k}") for k in range(SIGNS)])
    reps = sums.select(*by, "_n", "_ss", "_g", F.posexplode(F.array(*[f"_s{k}" for k in range(SIGNS)])).alias("_k", "_s")).where(F.col("_g") * SIGNS + F.col("_k") < n)
    return _test(reps.select(*by, _stat(F.col("_n"), F.col("_s"), F.col("_ss")).alias("stat")), _actual(trades, by), by)


def _interval(stats: DataFrame, by: Sequence[str], level: float) -> DataFrame:
    a = (1 - level) / 2
    s = F.col("stat")
    return stats.groupBy(*by).agg(
        F.count(s).alias("replicates"), F.avg(s).alias("boot_mean"), F.stddev_samp(s).alias("boot_std"),
        F.percentile(s, F.lit(a)).alias("ci_low"), F.percentile(s, F.lit(1 - a)).alias("ci_high"),
        F.avg(F.when(s <= 0, 1.0).otherwise(0.0)).alias("p_value"))


def bootstrap_ci(trades: DataFrame, by: Sequence[str], key: Sequence[str], n: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile interval of the Sharpe statistic; rows are drawn with Poisson(1) weights.

    Those weights are what drawing with replacement tends to, and they need no
    row numbers, no join and no second pass.  Trades without a result don't count.
    """
    x = F.col("pnl")
    slim = trades.where(x.isNotNull()).select(*by, *[k for k in key if k not in by], F.lit(1.0).alias("_n"), x.alias("_s"), (x * x).alias("_ss"))
    sums = weighted_sums(slim, by, key, ["_n", "_s", "_ss"], n, seed).where("_n > 1")
    return _interval(sums.select(*by, _stat(F.col("_n"), F.col("_s"), F.col("_ss")).alias("stat")), by, level)


def block_bootstrap(trades: DataFrame, by: Sequence[str], order: Sequence[str], block: int = 20, n: int = 1000, seed: int = 42,
                    level: float = 0.95) -> DataFrame:
    """As ``bootstrap_ci`` but drawing runs of ``block`` consecutive trades; below three blocks single trades are drawn."""
    by = list(by)
    numbered = number_rows(trades, by, F.floor(F.unix_seconds(order[0]) / 86400), list(order), "rn", "_total")
    x = F.col("pnl")
    place = F.when(F.col("_total") >= 3 * block, F.floor(F.col("rn") / block)).otherwise(F.col("rn"))
    blocks = numbered.groupBy(*by, place.alias("blk")).agg(
        F.count(x).alias("_c"), F.coalesce(F.sum(x), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("_ss"))
    sums = weighted_sums(blocks, by, [*by, "blk"], ["_c", "_s", "_ss"], n, seed).where("_c > 1")
    return _interval(sums.select(*by, _stat(F.col("_c"), F.col("_s"), F.col("_ss")).alias("stat")), by, level)


#: Blocks of different permutations are numbered apart by this much.
PERM_STRIDE = 1 << 32


def permuted_frames(bars: DataFrame, n: int, seed: int = 42, before: int = 0, after: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Permuted copies of each series as blocked frames, with ``perm_id`` from 1 (see :func:`bar_permute`).

    A keyed bijection tells each bar where its shape and its gap go in every permutation, so
    copies are not sorted: shapes, gaps and times travel straight to the blocks of their new places, with the rows
    that windows of ``before`` and ``after`` reach, and one shuffle serves the assembly and the windows of
    :func:`run_steps` after it.  A block starts at the sum of all moves before it, which is a
    map-side combined total per block; series within one block need none.
    """
    block_rows = max(block_rows, 2 * (before + after))
    slice_ = F.floor(F.unix_seconds("ts") / (timeframe_seconds(F.col("timeframe")) * SLICE_BARS))
    with_gap = compute(bars, [sql_columns([], {"gap": f"ln(open) - ln({lag_sql('close')})"}, before=1)])
    moves = materialise(number_rows(with_gap, KEYS, slice_, ["ts"], "rn", "total").select(
        *KEYS, "ts", "rn", "total", "volume", F.ln("open").alias("lo"), (F.ln("high") - F.ln("open")).alias("dh"),
        (F.ln("low") - F.ln("open")).alias("dl"), (F.ln("close") - F.ln("open")).alias("dc"), "gap"), "moves")
    longest = moves.agg(F.max("total")).first()[0] or 0
    copies = moves.withColumn("perm_id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    key = [F.lit(str(seed)), F.col("symbol"), F.col("timeframe")]
    shapes = with_places(copies, "pos", "rn", "total", "perm_id", [key[0], F.lit("shape"), *key[1:]])
    gaps = with_places(copies.where("rn > 0").selectExpr("*", "rn - 1 AS _x", "total - 1 AS _m"), "pos", "_x", "_m", "perm_id", [key[0], F.lit("gap"), *key[1:]]).withColumn("pos", F.col("pos") + 1)

    def piece(df: DataFrame, pos: str, **given: str) -> DataFrame:
        kinds = {"ts": "timestamp", "volume": "double", "dh": "double", "dl": "double", "dc": "double", "gap": "double"}
        return df.selectExpr("perm_id", *KEYS, "total", f"{pos} AS pos", *[f"{given[c]} AS {c}" if c in given else f"CAST(NULL AS {t}) AS {c}" for c, t in kinds.items()])

    # the first bar keeps its level: it enters as the gap of place 0
    pieces = piece(copies, "rn", ts="ts", volume="volume", gap="CASE WHEN rn = 0 THEN lo END") \
        .union(piece(shapes, "pos", dh="dh", dl="dl", dc="dc")).union(piece(gaps, "pos", gap="gap"))
    first, last = f"greatest(0L, (pos - {after}) div {block_rows})", f"least((total - 1) div {block_rows}, (pos + {before}) div {block_rows})"
    spread = pieces.selectExpr("*", f"explode(sequence({first}, {last})) AS _at").selectExpr(
        "* EXCEPT (total, _at)", f"perm_id * {PERM_STRIDE}L + _at AS _blk", f"_at = pos div {block_rows} AS _own")
    carried = ("ts", "volume", "dh", "dl", "dc", "gap")
    rows = spread.repartition(*KEYS, "_blk").groupBy(*KEYS, "_blk", "pos").agg(
        F.max("perm_id").alias("perm_id"), F.max("_own").alias("_own"), *[F.max(c).alias(c) for c in carried])
    order = f"OVER (PARTITION BY {', '.join(KEYS)}, _blk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND"
    level = f"sum(coalesce(gap, 0D)) {order} CURRENT ROW) + coalesce(sum(dc) {order} 1 PRECEDING), 0D)"
    start = f"(_blk % {PERM_STRIDE}L) * {block_rows}"
    warm = f"sum(CASE WHEN pos < {start} THEN coalesce(gap, 0D) + dc ELSE 0D END) {order} UNBOUNDED FOLLOWING)"
    rows = rows.selectExpr("*", f"{level} - {warm} AS _level")
    if longest > block_rows:
        totals = pieces.groupBy("perm_id", *KEYS, F.expr(f"pos div {block_rows}").alias("_at")).agg(F.sum(F.coalesce("gap", F.lit(0.0)) + F.coalesce("dc", F.lit(0.0))).alias("_t"))
        base = totals.selectExpr(*KEYS, f"perm_id * {PERM_STRIDE}L + _at AS _blk", f"""coalesce(sum(_t) OVER (PARTITION BY perm_id, {', '.join(KEYS)}
            ORDER BY _at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D) AS _base""")
        rows = rows.join(materialise(base, "levels"), [*KEYS, "_blk"]).selectExpr("* EXCEPT (_level, _base)", "_level + _base AS _level")
    return rows.selectExpr("perm_id", *KEYS, "_blk", "_own", "ts", "exp(_level) AS open", "exp(_level + dh) AS high", "exp(_level + dl) AS low", "exp(_level + dc) AS close", "volume")


def bar_permute(bars: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Permuted copies of each series: shapes of bars and gaps between bars are shuffled apart.

    The first bar keeps its level.  Copies carry ``perm_id`` from 1 to ``n``; no step holds or sorts a whole series.
    """
    return own_rows(permuted_frames(bars, n, seed))


def mcpt_pvalue(real: DataFrame, permuted: DataFrame, by: Sequence[str]) -> DataFrame:
    """(permutations at least as good + 1) / (valid permutations + 1); both sides have ``profit_factor``."""
    by = list(by)
    pf = F.col("profit_factor")
    valid = permuted.where(pf.isNotNull()).select(*by, pf.alias("_perm"))
    joined = real.select(*by, pf.alias("real_pf")).join(valid, by, "left")
    return joined.groupBy(*by, "real_pf").agg(
        F.count("_perm").alias("n_valid"), F.count_if(F.col("_perm") >= F.col("real_pf")).alias("n_better")).withColumn(
            "p_value", F.when(F.col("real_pf").isNotNull(), F.round((F.col("n_better") + 1) / (F.col("n_valid") + 1), 4)))


def cross_steps(fast: int, slow: int, h: int, extra: Sequence[str] = ()) -> list[Step]:
    """``ret``: signed log return over ``h`` bars of EMA cross signals; only rows that have one."""
    from barlens.operators.forward import forward_return
    from barlens.operators.outcomes import ema_cross_entry

    keep = Step(("signal", "fwd"), (), lambda df: df.where("signal <> 0 AND fwd IS NOT NULL").selectExpr(
        *KEYS, *extra, "signal * fwd AS ret", "_blk", "_own"))
    return [*ema_cross_entry(fast, slow), forward_return("fwd", h, "log"), keep]


def _factor(rets: DataFrame, by: Sequence[str], min_n: int) -> DataFrame:
    return rets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), profit_factor(F.col("ret")).alias("profit_factor")).withColumn(
            "profit_factor", F.when(F.col("n") >= min_n, F.col("profit_factor")))


def cross_profit_factor(bars: DataFrame, by: Sequence[str], fast: int, slow: int, h: int = 5, min_n: int = 10) -> DataFrame:
    """Profit factor of EMA cross signals ``h`` bars ahead per series."""
    return _factor(compute(bars, cross_steps(fast, slow, h)), by, min_n)


def permuted_cross_profit_factor(bars: DataFrame, by: Sequence[str], fast: int, slow: int, h: int = 5, min_n: int = 10,
                                 n: int = 300, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same of ``n`` permuted copies, by ``perm_id``: bars are assembled and measured in the same blocks."""
    steps = cross_steps(fast, slow, h, ("perm_id",))
    before, after = reach(steps)
    return _factor(own_rows(run_steps(permuted_frames(bars, n, seed, before, after, block_rows), steps)), [*by, "perm_id"], min_n)
