"""Comparisons of equal numbers: rounding must not decide them."""

from fractions import Fraction

import numpy as np

from barlens.operators import conditions as cnd
from barlens.operators.blocks import compute
from barlens.operators.recurrence import ewm, wilder_alpha
from test_rules import closes, col

PRICES = (100.1, 112.57, 133.37, 156.25, 173.45, 180.07, 199.99)


def test_equal_closes_are_inside_their_band(spark):
    ids = ["above_bb_upper", "below_bb_lower", "inside_bb"]
    rows = cnd.conditions_wide(closes(spark, [p for p in PRICES for _ in range(40)]), ids).orderBy("ts").collect()
    flat = [row for k, row in enumerate(rows) if k % 40 >= 19]
    assert len(flat) == 21 * len(PRICES)
    assert all(row.inside_bb and not row.above_bb_upper and not row.below_bb_lower for row in flat)


def test_rsi_has_no_direction_on_an_unchanged_close(spark):
    values = [100.0]
    for k in range(60):
        values += [values[-1] + (7.31 if k % 2 else -7.13)] * 4
    rows = cnd.conditions_wide(closes(spark, values), ["rsi_mid_bull", "rsi_mid_bear"]).orderBy("ts").collect()
    assert any(row.rsi_mid_bull or row.rsi_mid_bear for row in rows)
    assert not [k for k in range(1, len(rows)) if values[k] == values[k - 1] and (rows[k].rsi_mid_bull or rows[k].rsi_mid_bear)]


def test_averages_stay_within_a_few_roundings_far_into_a_chunk(spark):
    values = np.random.default_rng(3).integers(100, 300_00, 3000) / 100
    got = col(compute(closes(spark, values.tolist()), [ewm([("slow", "close", 2 / 201), ("a", "close", wilder_alpha(14))])]), "a")
    base, share = Fraction(1 - 1 / 14), Fraction(1 / 14)
    want, off = Fraction(float(values[0])), []
    for x, y in zip(values[1:].tolist(), got[1:]):
        want = (Fraction(x) * share + want * base).limit_denominator(10**40)
        off.append(abs(y / float(want) - 1))
    assert max(off) < 5e-15
