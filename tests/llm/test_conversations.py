"""Conversation repair beside a plain search."""

import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest

from barlens.llm import conversations as cv

WHITE = " \t\n\x0b\x0c\r"
FULL = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain_repair(rows, ids):
    sys.setrecursionlimit(20_000)
    out = {}
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = [], set()
        for _, _, role, text in mine:
            body = text.rstrip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))

        @functools.cache
        def best(i, state, inserted=0):
            """(cost, audit, repaired rows) of the rows from i on; the state is what was written last: '', s, u or a."""
            found = []
            if i == len(mine) and state in ("", "a"):
                found.append((0, "", ()))
            new = "a" if state == "u" else "u"
            if inserted < 5:
                c, a, r = best(i, new, inserted + 1)
                found.append((c + 2, "I" + a, ((FULL[new], ""), *r)))
            if i < len(mine):
                role, text = mine[i][2], mine[i][3]
                c, a, r = best(i + 1, state)
                found.append((c + 3, "D" + a, r))
                if faults[i] not in ("blank", "duplicate"):
                    more = int(faults[i] == "truncated")
                    first = role[:1]
                    if first in ("s", "u", "a") and first in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                        c, a, r = best(i + 1, first)
                        found.append((c + more, "K" + a, ((role, text), *r)))
                    c, a, r = best(i + 1, new)
                    found.append((c + 2 + more, "R" + a, ((FULL[new], text), *r)))
            return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

        cost, audit, rest = best(0, "")
        turns = {r[1] for r in mine if r[1] is not None}
        legal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), legal, cost, audit,
                     hashlib.sha256("\n".join(f"{a}:{b}" for a, b in rest).encode()).hexdigest())
    return out


def searched(word):
    """(cost, audit) of the cheapest edits by trying all of them against the grammar as a pattern."""
    found = []
    for gaps in itertools.product(range(3), repeat=len(word) + 1):
        for letters in itertools.product("KRD", repeat=len(word)):
            if any(s == "-" and x != "D" for s, x in zip(word, letters)):
                continue
            cost, audit, choices = 0, "", []
            for n, (s, x) in zip(gaps, [*zip(word, letters), (None, None)]):
                cost, audit = cost + 2 * n, audit + "I" * n
                choices += ["ua"] * n
                if x is None:
                    continue
                audit += x
                cost += {"K": 0, "R": 2, "D": 3}[x] + (x != "D" and s.isupper())
                choices += [] if x == "D" else [s.lower()] if x == "K" else ["ua"]
            if any(re.fullmatch("(s?(ua)+)?", "".join(c)) for c in itertools.product(*choices)):
                found.append((cost, audit))
    return min(found)


def test_nodes_equal_a_search_of_all_edits():
    rng = random.Random(4)
    words = [w for n in range(3) for w in itertools.product("suaoUO-", repeat=n)] + [tuple(rng.choice("suaoUO-") for _ in range(3)) for _ in range(40)]
    for word in words:
        assert cv.Automaton().node("".join(word)[::-1], True)[cv.START][cv.END] == searched(word), word


def test_endings_are_worked_out_once():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("sua-U") for _ in range(rng.randint(0, 6))) for _ in range(300)})
    automaton = cv.Automaton()
    for w in words:
        automaton.node(w, True)
    assert automaton.made == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def make_rows(seed=5):
    rng = random.Random(seed)
    texts = ["Well.", "No stop", "What? ", "", " \t\n", "Ends!\x0b", "é", " ", None, "a. ", "So it is."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "u"]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn if rng.random() < 0.9 else rng.choice([None, turn + 3, 0]), rng.choice(roles[:5] if conv % 2 else roles), rng.choice(texts)))
    rows += [(500, t, ("user", "assistant")[t % 2], f"Turn {t % 90}." if t % 7 else "open") for t in range(300)]  # a long one
    rows += [(501, None, "user", "x.")] * 5 + [(None, 1, "user", "q?"), (None, 2, "assistant", "a."), (None, None, "system", "s.")]
    rows += rows[:3]
    rows += [(600 + i, 0, "user", "Gone.") for i in range(200)]  # some of them lose their only row
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [64, 3])
def test_repairs_equal_a_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(cv, "BLOCK_ROWS", block)
    rows = make_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, word string, block int").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in cv.repair_damaged(df).collect()}
    want = plain_repair(plain_damage(rows), {r[0] for r in rows})
    assert got == want
    assert any(v[6] == "" and k is not None and k >= 600 for k, v in got.items()), "no conversation lost all rows"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.repair_damaged(empty).count() == 0
