import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, doc string, fp string, sha string"
WORDS = ["ba", "lo", "mir", "tenu", "sol", "éta", "ka", "rindo", "ov", "peel", "zu", "xan", "io", "qua"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def make_rows(seed: int = 1) -> list[tuple]:
    """Documents with copies, near copies, shared passages, and every odd case; other columns have clashing names."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(20, 120)) for _ in range(30)]
    passage, line = sentence(rng, 40), sentence(rng, 15)
    texts = list(base)
    texts += [base[0], base[0].upper(), base[1], base[1]]  # exact copies, also in other case
    for k in range(2, 8):  # near copies: one word changed
        words = base[k].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [sentence(rng, 30) + " " + passage + " " + sentence(rng, 30) for _ in range(4)]
    texts += [(line + "\n") * 6 + sentence(rng, 20), line + "\t" + line, "Nd, " * 60, "Nd, " * 90, "a" * 300, "a" * 120]
    texts += ["", None, "   \n\t ", "one two three", "one  two\tthree", "one", "é" * 80, "\u00a0".join(["no break"] * 9), "x\x00y " * 30]
    texts.append(sentence(rng, 30_000))  # a very long text
    texts.append(texts[-1][1000:60_000])
    rows = [(i * 3 + 1, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append((rows[3][0], rows[3][1], *rows[3][2:]))  # a repeated row
    rows.append((None, base[4], "en", "s1", 5))
    rng.shuffle(rows)
    return [(*r, 0.5, "other", "clash", "clash", "clash") for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    found = [(r[0], int("changed" not in (r[1] or "")), int(len(r[1] or "") % 5 == 0)) for r in rows if r[0] is not None]
    return spark.createDataFrame(found + [(None, 1, 1), (1, None, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(labels):
    return labels.where(F.lit(False))
