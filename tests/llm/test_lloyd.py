"""Vector codes beside a plain Lloyd in numpy."""

import hashlib

import numpy as np
import pytest

from barlens.llm import lloyd


def plain(rows, rounds=2):
    """(vec_id, code, error, label_error, digest) of every whole row."""
    whole = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = max(1, -(-max(len(r[1]) for r in whole) // 16))
    x = np.array([[min(max(int(np.floor(256 * c)), -2**26), 2**26) for c in r[1]] + [0] * (16 * width - len(r[1])) for r in whole]).reshape(len(whole), 16, width)
    least = {}
    for r, v in zip(whole, x):
        if r[0] is not None:
            least[r[0]] = min(least.get(r[0], v.ravel().tolist()), v.ravel().tolist())
    book = np.array([least[i] for i in sorted(least)[:64]]).reshape(-1, 16, width)

    def assign():
        far = ((x[:, None] - book[None]) ** 2).sum(3)
        return far.argmin(1), far.min(1)
    for _ in range(rounds):
        near, _ = assign()
        for p in range(16):
            for e in range(len(book)):
                if (mine := x[near[:, p] == e, p]).size:
                    book[e, p] = mine.sum(0) // len(mine)
    near, error = assign()
    digest = hashlib.sha256(",".join(str(c) for p in range(16) for e in range(len(book)) for c in book[e, p]).encode()).hexdigest()
    total = {}
    for r, e in zip(whole, error.sum(1).tolist()):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{e:02x}" for e in n), e, total[r[2]], digest) for r, n, e in zip(whole, near.tolist(), error.sum(1).tolist())), key=str)


def rows_of(rng, n, dim):
    rows = [(i * 7 % 1000 + i, rng.normal(size=dim).round(3).tolist(), int(i % 5) if i % 11 else None) for i in range(n)]
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1], 2), (None, rows[6][1], 1), (5000, None, 1), (5001, [float("nan")] * dim, 1), (5002, [None] * dim, 1), (5003, [float("inf")] + [0.0] * (dim - 1), 1)]
    rows += [(6000 + i, rows[9][1], 3) for i in range(120)]  # a hot group
    return rows


def got(spark, rows, **kw):
    # wrong columns with clashing names must not be read
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, entry string, uid int").repartition(3)
    return sorted((tuple(r) for r in lloyd.compressed(df, **kw).collect()), key=str)


@pytest.mark.parametrize("dim, rounds", [(32, 2), (64, 1), (20, 3)])
def test_codes_equal_a_plain_fit(spark, monkeypatch, dim, rounds):
    rows = rows_of(np.random.default_rng(dim), 400, dim)
    monkeypatch.setattr(lloyd, "BLOCK_MEMBERS", 17)
    monkeypatch.setattr(lloyd, "OWNER_MEMBERS", 90)
    assert got(spark, rows, rounds=rounds) == plain(rows, rounds)


def test_ties_short_tables_and_large_numbers(spark):
    few = [(1, [0.0] * 16, 1), (2, [1.0] * 16, 1), (3, [0.5] * 16, None), (4, [-1e300] * 16, None), (5, [0.25] * 3, 0)]
    assert got(spark, few) == plain(few)
    many = [(1, [i / 7] * 16, 0) for i in range(200)] + [(2, [3.0] * 16, 0)]  # an id more often than there are entries
    assert got(spark, many) == plain(many)


def test_tables_without_codes(spark):
    assert got(spark, [(1, None, 1), (2, [float("nan")], 1)]) == []
    empty = hashlib.sha256(b"").hexdigest()
    assert got(spark, [(None, [1.0] * 16, 1)]) == [(None, None, None, None, empty)]
