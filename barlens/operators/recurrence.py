"""Exponential averages as window sums.

y[t] = (1-a) * y[t-1] + a * x[t] starting at the first value is, inside a chunk of
rows, a running sum of x[j] * (1-a) ** -j scaled back.  A chunk is long enough that
anything older than the chunk before it weighs less than the rounding of a
double, so the value is the chunk's own sum plus the decayed end of the previous
chunk.  Averages share a chunk length as long as their weights stay far from the
limits of a double; chunk lengths are powers of two and nest, hence all averages
of a step share one sort order.

A missing value leaves an average as it is: decay counts the values that are there, not
the rows.  A chunk's values are taken to outweigh all before the chunk in front of it, so
where more than half of a chunk is missing, older values may be off by exp(-20) of their size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame

from barlens.operators.blocks import FRAME_KEYS, FRAME_SQL, Step

# the weight of older rows falls below exp(-40), about 4e-18
NEGLIGIBLE = 40.0
# exponents of weights stay below this
LARGEST = 450.0


def span_alpha(period: int) -> float:
    return 2.0 / (period + 1)


def wilder_alpha(period: int) -> float:
    return 1.0 / period


def _decay(alpha: float) -> float:
    return -math.log1p(-alpha)


def _chunk_bits(alphas: Sequence[float]) -> dict[float, int]:
    """Chunk length (as a power of two) of each rate, in as few different lengths as possible."""
    bits: dict[float, int] = {}
    current: int | None = None
    for a in sorted(set(alphas)):
        if current is None or _decay(a) * (1 << current) > LARGEST:
            current = max(1, math.ceil(math.log2(NEGLIGIBLE / _decay(a))))
        bits[a] = current
    return bits


def warm_up(alpha: float) -> int:
    """Rows after which the starting value no longer shows in a double."""
    return 1 if alpha >= 1 else math.ceil(NEGLIGIBLE / _decay(alpha))


def ewm(averages: Sequence[tuple[str, str, float]]) -> Step:
    """Step adding ``(out, input column, alpha)`` averages; a null input carries the average on."""
    scans = [a for a in averages if a[2] < 1]
    copies = [a for a in averages if a[2] >= 1]
    bits_of = _chunk_bits([a for _, _, a in scans])
    bits = sorted(set(bits_of.values()), reverse=True)

    keys = ", ".join(FRAME_KEYS)
    chunks = [f"_c{b}" for b in bits]
    whole = f"PARTITION BY {keys} ORDER BY {', '.join([*chunks, 'ts'])}"
    up_to_now = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    up_to_last = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    xs = sorted({x for _, x, _ in scans})

    def fn(df: DataFrame) -> DataFrame:
        df = df.selectExpr("*", f"row_number() OVER ({FRAME_SQL}) - 1 AS _k",
                           *[f"count({x}) OVER ({FRAME_SQL} {up_to_now}) AS _seen_{x}" for x in xs])
        df = df.selectExpr("*", *[f"shiftright(_k, {b}) AS _c{b}" for b in bits])
        before, local, carry, final = [], [], [], []
        for out, x, a in scans:
            # powers of one base cancel in every quotient; exp() of a rounded product would be off by its size in roundings
            b, q = bits_of[a], f"{1 - a!r}D"
            cut = chunks.index(f"_c{b}") + 1
            chunk = f"PARTITION BY {', '.join([keys, *chunks[:cut]])} ORDER BY {', '.join([*chunks[cut:], 'ts'])}"
            end = f"(_k & {(1 << b) - 1}) = {(1 << b) - 1}"
            # values in front of the chunk, and how many of the chunk's own came before this row's
            before.append(f"first(_seen_{x} - CASE WHEN {x} IS NULL THEN 0 ELSE 1 END) OVER ({chunk} {up_to_now}) AS _b_{out}")
            pos = f"(_seen_{x} - _b_{out} - 1)"
            weight = f"CASE WHEN _seen_{x} = 1 THEN 1D ELSE {a!r}D END"
            term = f"coalesce({x} * {weight}, 0D) * power({q}, -{pos})"
            local.append(f"sum({term}) OVER ({chunk} {up_to_now}) * power({q}, {pos}) AS _l_{out}")
            carry.append(f"last(CASE WHEN {end} AND _seen_{x} > _b_{out} THEN _l_{out} END, true) "
                         f"OVER ({whole} {up_to_last}) AS _e_{out}")
            final.append(f"CASE WHEN _seen_{x} > 0 THEN _l_{out} + "
                         f"coalesce(_e_{out} * power({q}, {pos} + 1), 0D) END AS {out}")
        kept = df.columns[: -(1 + len(bits) + len(xs))]
        final += [f"last({x}, true) OVER ({FRAME_SQL} {up_to_now}) AS {out}" for out, x, _ in copies]
        return df.selectExpr("*", *before).selectExpr("*", *local).selectExpr("*", *carry).selectExpr(*kept, *final)

    return Step(
        tuple({x for _, x, _ in averages}), tuple(o for o, _, _ in averages), fn,
        before=max(warm_up(a) for _, _, a in averages),
    )


def ema(out: str, x: str, period: int) -> Step:
    return ewm([(out, x, span_alpha(period))])


def wilder(out: str, x: str, period: int) -> Step:
    return ewm([(out, x, wilder_alpha(period))])
