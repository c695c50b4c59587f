"""Column expressions used across the operators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYS = ("symbol", "timeframe")


def cond(expr: Column) -> Column:
    """A market condition: a comparison with a missing value is false, not unknown."""
    return F.coalesce(expr, F.lit(False))


def safe_div(num: Column, den: Column) -> Column:
    """Quotient that is null where the divisor is zero."""
    return num / F.when(den != 0, den)


def finite(x: Column, digits: int | None = None) -> Column:
    """NaN and infinities become null; optionally rounded."""
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    ok = F.when(~F.coalesce(bad, F.lit(False)), x)
    return ok if digits is None else F.round(ok, digits)


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded double, free of negative zero, for stable published results."""
    col = F.col(x) if isinstance(x, str) else x
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def ts_text(col: str = "ts") -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def weekday(col: str | Column) -> Column:
    """Monday = 0."""
    return F.weekday(col)


def profit_factor(value: Column, no_loss: str = "null") -> Column:
    """Sum of gains over the absolute sum of losses, as an aggregate.

    ``no_loss`` says what a group without losses gives: ``null``, ``inf`` (only
    when it has gains, else 0) or ``zero``.
    """
    wins = F.coalesce(F.sum(F.when(value > 0, value)), F.lit(0.0))
    losses = F.abs(F.coalesce(F.sum(F.when(value < 0, value)), F.lit(0.0)))
    ratio = wins / F.when(losses != 0, losses)
    if no_loss == "null":
        return ratio
    if no_loss == "zero":
        return F.coalesce(ratio, F.lit(0.0))
    if no_loss == "inf":
        return F.coalesce(ratio, F.when(wins > 0, F.lit(float("inf"))).otherwise(0.0))
    raise ValueError(f"unknown no_loss policy {no_loss!r}")


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Correlation as an aggregate; null where one side does not vary."""
    return safe_div(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def sd_from_sums(n: Column, s: Column, ss: Column) -> Column:
    """Sample deviation from count, sum and sum of squares."""
    var = (ss - s * s / n) / F.when(n > 1, n - 1)
    return F.sqrt(F.greatest(var, F.lit(0.0)))


def t_stat(mean: Column, sd: Column, n: Column) -> Column:
    return mean / F.when(sd > 0, sd / F.sqrt(n.cast("double")))


def _gamma_half_ratio(x: Column) -> Column:
    """Gamma(x + 1/2) / Gamma(x) by the asymptotic series, shifted up by eight."""
    y = x + F.lit(8.0)
    series = (
        F.lit(1.0) - 1 / (8 * y) + 1 / (128 * y * y) + 5 / (1024 * y * y * y)
        - 21 / (32768 * y * y * y * y)
    )
    shift = reduce(
        lambda a, i: a * ((x + F.lit(i + 0.5)) / (x + F.lit(float(i)))), range(8), F.lit(1.0)
    )
    return F.sqrt(y) * series / shift


def _simpson(lo: Column, hi: Column, nodes: int, f, *extra: Column) -> Column:
    """Integral of ``f(x, *extra)`` by Simpson's rule; bounds and extras are evaluated once per row."""
    bound = F.struct(lo.alias("lo"), ((hi - lo) / nodes).alias("step"), *[e.alias(f"e{k}") for k, e in enumerate(extra)])

    def area(x: Column) -> Column:
        weight = lambda i: F.when((i == 0) | (i == nodes), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(nodes)), F.lit(0.0),
            lambda acc, i: acc + weight(i) * f(x["lo"] + x["step"] * i, *[x[f"e{k}"] for k in range(len(extra))]),
        ) * x["step"] / 3
    return F.transform(F.array(bound), area)[0]


def student_t_pvalue(t: Column, dof: Column, nodes: int = 600) -> Column:
    """Two-sided Student p-value as a plain expression.

    With t = sqrt(dof) * tan(a) the tail is an integral of cos(a) ** (dof - 1).
    Meant for aggregated rows.
    """
    nu = dof.cast("double")
    root = F.sqrt(nu)
    lo = F.atan(F.abs(t) / root)
    hi = F.when(nu >= 9, F.atan((F.abs(t) + 40.0) / root)).otherwise(F.lit(math.pi / 2))
    tail = _simpson(lo, hi, nodes, lambda a, k: F.pow(F.greatest(F.cos(a), F.lit(0.0)), k), nu - 1)
    p = 2 * _gamma_half_ratio(nu / 2) / math.sqrt(math.pi) * tail
    return F.when(t.isNotNull() & (nu > 0), F.least(p, F.lit(1.0)))


# --- the five Sharpe ratios --------------------------------------------------

# fixed values: bars per year by timeframe
BARS_PER_YEAR = {
    "1m": 374400.0, "5m": 74880.0, "15m": 24960.0, "1h": 6240.0, "4h": 1560.0, "1d": 260.0,
}
DEFAULT_BARS_PER_YEAR = 6240.0


def bars_per_year(timeframe: Column) -> Column:
    expr = F.lit(DEFAULT_BARS_PER_YEAR)
    for name, n in BARS_PER_YEAR.items():
        expr = F.when(timeframe == name, n).otherwise(expr)
    return expr


def sharpe_horizon(mean: Column, sd: Column, timeframe: Column, h: Column) -> Column:
    return F.when(sd > 0, mean / sd * F.sqrt(bars_per_year(timeframe) / h)).otherwise(0.0)


def sharpe_trade_count(mean: Column, sd: Column, n: Column) -> Column:
    return F.when((n >= 2) & (sd > 0), mean / sd * F.sqrt(n.cast("double"))).otherwise(0.0)


def sharpe_perm(mean: Column, sd: Column, n: Column) -> Column:
    return mean / F.greatest(sd, F.lit(1e-10)) * F.sqrt(n.cast("double"))


def sharpe_trade_annual(mean: Column, sd: Column, per_year: Column) -> Column:
    return F.when(sd > 0, mean / sd * F.sqrt(F.greatest(per_year, F.lit(1.0)))).otherwise(0.0)


def sharpe_from_t(t: Column, n: Column) -> Column:
    return F.when(n >= 10, F.round(t / F.sqrt(n.cast("double")) * math.sqrt(252), 2))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function.

    Spark has no erf; Simpson's rule over the density is exact to about 1e-10.
    """
    area = _simpson(F.lit(0.0), F.least(F.abs(x), F.lit(10.0)), 400, lambda z: F.exp(-z * z / 2)) / math.sqrt(2 * math.pi)
    return F.when(x >= 0, 0.5 + area).otherwise(0.5 - area)
