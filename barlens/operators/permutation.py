"""Random permutations without sorting.

A keyed Feistel network is a bijection of the pairs (l, r) with l < a and r < b.  With
a * b just above n it permutes 0 .. n-1 once the few numbers beyond n are walked on:
the network is applied again until the result is below n.  Every row so learns its place
in any number of permutations from its own number alone, without a sort and without a shuffle.
All steps are integer arithmetic below 2**63, so SQL elsewhere gives the same places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest prime below 2**28; products of two numbers about its size fit a long.
PRIME = 268435399
ROUNDS = 6
# fixed values: odd constants that part permutations (first two) and rounds (last two) from each other
PERM_STEPS, ROUND_STEPS = (1000003, 7368787), (15485863, 32452843)


def key_number(parts: Sequence[Column], place: int) -> Column:
    """Number below ``PRIME`` from seven hexadecimal digits of the md5 of the parts."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 7 * place + 1, 7), 16, 10).cast("long") % PRIME


def round_sql(j: str, own: str, other: str, size: str) -> str:
    """One half of the pair after round ``j``, moved by a keyed square of the other half."""
    key = f"(((_s + {j} * {ROUND_STEPS[0]}) * (_w + {j} * {ROUND_STEPS[1]})) % {PRIME})"
    return f"({own} + (({other} + {key}) * ({other} + _s + {j})) % {PRIME}) % {size}"


def with_places(df: DataFrame, out: str, x: str, n: str, perm: str, parts: Sequence[Column]) -> DataFrame:
    """Adds ``out``: where number ``x`` of 0 .. ``n`` - 1 goes in permutation ``perm`` of the key named by ``parts``.

    The walk is bounded by the a * b - n numbers that lie beyond; only rows that need it pay for it.
    """
    kept = df.columns
    df = df.withColumns({"_u": key_number(parts, 0), "_v": key_number(parts, 1)}).selectExpr(
        "*", f"(_u + {perm} * {PERM_STEPS[0]}L) % {PRIME} AS _s", f"(_v + {perm} * {PERM_STEPS[1]}L) % {PRIME} AS _w",
        f"CAST(ceil(sqrt({n})) AS BIGINT) AS _a")
    df = df.selectExpr("*", f"({n} + _a - 1) div _a AS _b").selectExpr("*", f"{x} div _b AS _l0", f"{x} % _b AS _r0")
    left, right = "_l0", "_r0"
    for j in range(1, ROUNDS + 1):
        own, other, size = (left, right, "_a") if j % 2 else (right, left, "_b")
        name = f"{own[:2]}{j}"
        df = df.selectExpr("*", f"{round_sql(f'{j}L', own, other, size)} AS {name}")
        left, right = (name, right) if j % 2 else (left, name)
    again = f"""aggregate(sequence(1L, {ROUNDS}L), named_struct('l', y div _b, 'r', y % _b),
        (z, j) -> named_struct('l', CASE WHEN j % 2 = 1 THEN {round_sql('j', 'z.l', 'z.r', '_a')} ELSE z.l END,
                               'r', CASE WHEN j % 2 = 0 THEN {round_sql('j', 'z.r', 'z.l', '_b')} ELSE z.r END),
        z -> z.l * _b + z.r)"""
    df = df.selectExpr("*", f"{left} * _b + {right} AS _y")
    walk = f"aggregate(sequence(1L, _a * _b - {n}), _y, (y, i) -> CASE WHEN y < {n} THEN y ELSE {again} END)"
    return df.selectExpr(*kept, f"CASE WHEN _y < {n} THEN _y ELSE {walk} END AS {out}")


def places_sql(source: str, x: str, n: str, perm: str, parts: str, columns: str) -> str:
    """The same places as recursive SQL: ``columns`` of ``source``, and ``y``."""
    def rounds(x: str) -> str:
        left, right, out = f"({x} // _b)", f"({x} % _b)", []
        for j in range(1, ROUNDS + 1):
            own, other, size = (left, right, "_a") if j % 2 else (right, left, "_b")
            name = f"{'l' if j % 2 else 'r'}{j}"
            out.append(f"{round_sql(str(j), own, other, size)} AS {name}")
            left, right = (name, right) if j % 2 else (left, name)
        return f"{', '.join(out)}, {left} * _b + {right} AS y"

    def number(place: int) -> str:
        return f"CAST('0x' || substr(md5(concat_ws(':', {parts})), {7 * place + 1}, 7) AS BIGINT) % {PRIME}"

    keyed = f"""SELECT {columns}, {x} AS _x, CAST({n} AS BIGINT) AS _n, ({number(0)} + {perm} * {PERM_STEPS[0]}) % {PRIME} AS _s, ({number(1)} + {perm} * {PERM_STEPS[1]}) % {PRIME} AS _w,
      CAST(ceil(sqrt({n})) AS BIGINT) AS _a, ({n} + _a - 1) // _a AS _b FROM {source}"""
    carried = f"{columns}, _n, _s, _w, _a, _b"
    return f"""(WITH RECURSIVE walk AS (SELECT {carried}, y FROM (SELECT {carried}, {rounds('_x')} FROM ({keyed}))
      UNION ALL SELECT {carried}, z FROM (SELECT {carried}, y AS z FROM (SELECT {carried}, {rounds('y0')} FROM (SELECT {carried}, y AS y0 FROM walk WHERE y >= _n))))
      SELECT {columns}, y FROM walk WHERE y < _n)"""
