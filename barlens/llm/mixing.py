"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  Raking scales the cells'
tokens by one factor per source, language and topic until the three marginals meet
their targets.  Probabilities are raked with a bound of one, so that the expected sample
has the marginals and the token budget also where cells are taken whole.  Sources may be many: they stay
distributed, one row each with its tokens by (language, topic), and take their factor
inside the job.  Languages and topics are small vocabularies; only the sums for their
pairs come to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.arrays import chunks, word_bounds
from barlens.llm.frames import batches, stored, text_of
from barlens.llm.textstats import UPPER, sums

#: Share of all tokens to take, exponent that tempers the default targets, sweeps at most, and the accepted relative error.
BUDGET, TEMPER, SWEEPS, TOLERANCE = 0.7, 0.7, 60, 1e-6
#: Accepted miss of the bounded probabilities, as a share of the sample.
BOUNDED_TOLERANCE = 1e-4
#: Sweeps after which a miss that has not fallen by a hundredth is one that the bounds force.
STALL = 8
SEED = "mix-1"


#: What a text is about, as far as its form tells.
TOPICS = ("table", "shout", "symbols", "note", "prose", "long")
LOWER_CASE, MARKS = np.zeros(256, bool), np.zeros(256, bool)
LOWER_CASE[97:123] = True
MARKS[[ord(c) for c in "#$%&*"]] = True


def forms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Eight times the number of words, plus the topic's place in ``TOPICS``."""
    words = np.diff(word_bounds(data, offsets)[2])
    upper, lower = sums(UPPER[data], offsets), sums(LOWER_CASE[data], offsets)
    topic = np.select(
        [sums(data == ord("|"), offsets) * 5 >= np.maximum(words, 1), upper >= np.maximum(lower, 1),
         sums(MARKS[data], offsets) * 10 >= np.maximum(np.diff(offsets), 1), words < 50, words < 400], range(5), 5)
    return words * 8 + topic


def form_of(text: Column) -> Column:
    """``forms`` of a column, counted on whole Arrow batches."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        parts = [forms(data, offsets) for _, _, data, offsets in chunks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return count(text)


def topic_of(form: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in TOPICS]), (form % 8).cast("int"))


def n_words(form: Column) -> Column:
    return F.shiftright(form, 3)


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that any engine can compute: 52 bits of an md5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def tempered(tokens: dict[str, float], temper: float) -> dict[str, float]:
    total = sum(v ** temper for v in tokens.values())
    return {k: v ** temper / total for k, v in tokens.items()} if total else {}


def rake(cells: DataFrame, budget: float = BUDGET, temper: float = TEMPER, lang_targets: dict[str, float] | None = None,
         topic_targets: dict[str, float] | None = None) -> DataFrame:
    """source, lang, topic, weight, probability, error for every cell (source, lang, topic, tokens).

    Weights are raked to the targets.  Probabilities are raked once more with a bound: no cell goes above 1, values
    that have less than their target are taken whole, and the cells below 1 are fitted until the expected sample has
    the marginals and the budget.  ``error`` is the largest miss left, as a share of the sample; it is above
    ``BOUNDED_TOLERANCE`` only where the bounds of several marginals exclude each other.

    Targets are shares of tokens; by default each marginal's own shares raised to ``temper``.
    Given targets are scaled to one over the values present; a value without one has target 0.
    """
    pairs = {(r["lang"], r["topic"]): float(r["tokens"]) for r in cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).collect()}
    langs, topics = sorted({a for a, _ in pairs}), sorted({b for _, b in pairs})
    width = len(topics)
    if not pairs:
        return cells.select("source", "lang", "topic", F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("error"))
    sums = np.array([[pairs.get((a, b), 0.0) for b in topics] for a in langs])
    total = sums.sum()

    def target(values: list[str], given: dict[str, float] | None, own: np.ndarray) -> np.ndarray:
        t = np.array([max(0.0, given.get(v, 0.0)) for v in values]) if given else np.where(own > 0, own, 0) ** temper * (own > 0)
        return t / t.sum() if t.sum() > 0 else t

    t_lang, t_topic = target(langs, lang_targets, sums.sum(1)), target(topics, topic_targets, sums.sum(0))
    place = F.create_map(*[x for i, v in enumerate(langs) for x in (F.lit(v), F.lit(i * width))])[F.col("lang")] \
        + F.create_map(*[x for i, v in enumerate(topics) for x in (F.lit(v), F.lit(i))])[F.col("topic")]
    size = len(langs) * width
    # one row per source: its tokens by (language, topic)
    rows = cells.withColumn("place", place).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("tokens").cast("double")))).alias("m"))
    rows = stored(rows.select("source", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("tokens")), "op2-sources")
    own = F.aggregate("tokens", F.lit(0.0), lambda s, x: s + x)
    powered = rows.agg(F.sum(F.when(own > 0, F.pow(own, F.lit(temper)))).alias("s")).first()["s"] or 1.0
    t_source = F.when(own > 0, F.pow(own, F.lit(temper)) / F.lit(powered)).otherwise(F.lit(0.0))

    def factor(grid: np.ndarray) -> Column:
        """Factor of a source: its target over its tokens under the factors of languages and topics."""
        under = F.aggregate(F.zip_with("tokens", F.array(*[F.lit(float(x)) for x in grid.ravel()]), lambda n, g: n * g), F.lit(0.0), lambda s, x: s + x)
        return F.when(under > 0, t_source / under).otherwise(F.lit(0.0))

    b, c = np.ones(len(langs)), np.ones(width)
    for _ in range(SWEEPS):
        got = rows.select(factor(np.outer(b, c)).alias("a"), F.posexplode("tokens").alias("p", "n")).groupBy("p").agg(F.sum(F.col("a") * F.col("n")).alias("s")).collect()
        fitted = np.zeros(size)
        for r in got:
            fitted[r["p"]] = r["s"]
        fitted = fitted.reshape(len(langs), width)  # sources scaled, languages and topics not yet
        now = fitted * np.outer(b, c)
        error = max(np.abs(now.sum(1) - t_lang).max(), np.abs(now.sum(0) - t_topic).max())
        if error < TOLERANCE:
            break
        for _ in range(100):  # languages and topics against the sources' present factors: a fit of a small table
            lang_sum = (fitted * np.outer(b, c)).sum(1)
            b = np.where(lang_sum > 0, b * t_lang / np.where(lang_sum > 0, lang_sum, 1), 0)
            topic_sum = (fitted * np.outer(b, c)).sum(0)
            c = np.where(topic_sum > 0, c * t_topic / np.where(topic_sum > 0, topic_sum, 1), 0)
            if np.abs((fitted * np.outer(b, c)).sum(1) - t_lang).max() < TOLERANCE / 10:
                break
    raked = np.outer(b, c).ravel()
    # raked tokens over present tokens, both as shares
    rows = rows.withColumn("raked", factor(np.outer(b, c)) * F.lit(total))
    quotas = rows.withColumns({"target": t_source, "own": own})
    share, want = 1.0, budget * total
    for _ in range(50):  # sources that have less than their target are taken whole; the others share the rest
        r = quotas.agg(F.sum(F.when(F.col("target") * share * want >= F.col("own"), F.col("own")).otherwise(0.0)).alias("whole"),
                       F.sum(F.when(F.col("target") * share * want < F.col("own"), F.col("target")).otherwise(0.0)).alias("open")).first()
        new = (want - r["whole"]) / want / r["open"] if r["open"] and want > 0 else share
        if new <= share * (1 + 1e-12):
            break
        share = new
    quotas = stored(quotas.select("source", "tokens", "raked", F.least("own", F.col("target") * share * want).alias("quota")), "op2-quotas")
    q_lang, q_topic = filled(t_lang, sums.sum(1), want), filled(t_topic, sums.sum(0), want)
    best, best_error, errors = (b, c), np.inf, []
    for _ in range(SWEEPS):
        parts = quotas.mapInPandas(_bounded_sums(np.outer(b, c).ravel()), "p int, whole double, open double").groupBy("p").agg(F.sum("whole").alias("whole"), F.sum("open").alias("open")).collect()
        whole, free = np.zeros(size), np.zeros(size)
        for r in parts:
            whole[r["p"]], free[r["p"]] = r["whole"], r["open"]
        whole, free = whole.reshape(len(langs), width), free.reshape(len(langs), width)
        now = whole + free * np.outer(b, c)
        error = max(np.abs(now.sum(1) - q_lang).max(), np.abs(now.sum(0) - q_topic).max()) / want if want > 0 else 0.0
        if error < best_error:
            best, best_error = (b, c), error
        errors.append(error)
        if error < BOUNDED_TOLERANCE or (len(errors) > STALL and error > 0.99 * errors[-1 - STALL]):
            break
        b0, c0 = b, c
        for _ in range(100):  # the cells below one are fitted to what the whole ones leave
            b = _towards(b, b0, q_lang - whole.sum(1), (free * np.outer(b, c)).sum(1))
            c = _towards(c, c0, q_topic - whole.sum(0), (free * np.outer(b, c)).sum(0))
    found = quotas.mapInPandas(_bounded_cells(np.outer(*best).ravel(), raked), "source string, p int, weight double, probability double")
    lang_name = F.array(*[F.lit(v) for v in langs])
    topic_name = F.array(*[F.lit(v) for v in topics])
    return found.select(
        "source", F.get(lang_name, F.floor(F.col("p") / width).cast("int")).alias("lang"), F.get(topic_name, (F.col("p") % width).cast("int")).alias("topic"),
        "weight", "probability", F.lit(float(best_error)).alias("error"))


def filled(targets: np.ndarray, room: np.ndarray, want: float) -> np.ndarray:
    """Tokens by value: ``want`` split by targets, no value above its room; what does not fit goes to the others."""
    share = np.zeros(len(targets))
    open_ = targets > 0
    whole = np.zeros(len(targets), dtype=bool)
    while (open_ & ~whole).any():
        scale = (want - room[whole].sum()) / targets[open_ & ~whole].sum()
        over = open_ & ~whole & (targets * scale >= room)
        if not over.any():
            share[open_ & ~whole] = targets[open_ & ~whole] * scale
            break
        whole |= over
    share[whole] = room[whole]
    return share


def _towards(x: np.ndarray, start: np.ndarray, need: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Factors times need over have, at most four times or a quarter of where a sweep began."""
    ratio = np.where(have > 0, np.maximum(need, 0) / np.where(have > 0, have, 1), 1.0)
    return np.clip(x * ratio, start / 4, start * 4)


def bounded(tokens: np.ndarray, quota: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor a of each row and min(1, a * grid), such that tokens * min(1, a * grid) sums to the row's quota.

    Cells reach 1 in order of their grid value, so the factor for every number of whole cells comes from one
    running sum; the first one that leaves the next cell below 1 is right.  inf where the whole row is needed.
    """
    order = np.argsort(-grid, kind="stable")
    n, g = tokens[:, order], grid[order]
    under = np.cumsum((n * g)[:, ::-1], axis=1)[:, ::-1]
    left = quota[:, None] - (np.cumsum(n, axis=1) - n)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(under > 0, left / np.where(under > 0, under, 1), np.inf)
        fits = (under > 0) & (a * g <= 1)
    first = fits.argmax(axis=1)
    factor = np.where(fits.any(axis=1), np.maximum(a[np.arange(len(a)), first], 0), np.inf)
    with np.errstate(invalid="ignore"):
        chance = np.where(grid > 0, np.minimum(1.0, factor[:, None] * grid), 0.0)
    return factor, chance


#: Sources whose cells are worked on together.
ROWS = 1024


def _bounded_sums(grid: np.ndarray):
    """Per batch and cell: tokens of cells taken whole, and tokens times the source's factor of the others."""
    def run(parts):
        for pdf in parts:
            whole, free = np.zeros(len(grid)), np.zeros(len(grid))
            for at in range(0, len(pdf), ROWS):
                n = np.stack(pdf["tokens"].iloc[at:at + ROWS].to_list())
                factor, chance = bounded(n, pdf["quota"].to_numpy()[at:at + ROWS], grid)
                whole += np.where(chance >= 1, n, 0).sum(0)
                free += np.where(chance < 1, n * np.where(np.isfinite(factor), factor, 0)[:, None], 0).sum(0)
            yield pd.DataFrame({"p": np.arange(len(grid), dtype=np.int32), "whole": whole, "open": free})
    return run


def _bounded_cells(grid: np.ndarray, raked: np.ndarray):
    """source, p, weight, probability of every cell with tokens."""
    def run(parts):
        for pdf in parts:
            for at in range(0, len(pdf), ROWS):
                n = np.stack(pdf["tokens"].iloc[at:at + ROWS].to_list())
                _, chance = bounded(n, pdf["quota"].to_numpy()[at:at + ROWS], grid)
                row, p = np.nonzero(n > 0)
                yield pd.DataFrame({"source": pdf["source"].to_numpy()[at:at + ROWS][row], "p": p.astype(np.int32),
                                    "weight": pdf["raked"].to_numpy()[at:at + ROWS][row] * raked[p], "probability": chance[row, p]})
    return run


def _cells(docs: DataFrame) -> DataFrame:
    """Documents as (doc_id, source, lang, topic, n_tokens); unknown sources and languages are one value each."""
    batches(docs.sparkSession)
    return docs.select(
        "doc_id", F.coalesce(F.col("source"), F.lit("(none)")).alias("source"), F.coalesce(F.col("lang"), F.lit("(none)")).alias("lang"), form_of(text_of()).alias("form")) \
        .select("doc_id", "source", "lang", topic_of(F.col("form")).alias("topic"), n_words(F.col("form")).alias("n_tokens"))


def sample_documents(docs: DataFrame, budget: float = BUDGET, temper: float = TEMPER) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled, error for every row of ``docs``.

    ``error`` is what the expected sample still misses of its marginals (see ``rake``), null in cells without tokens.

    A null source or language is the value ``(none)``; a null text has no tokens and the topic
    ``note``.  Cells without tokens have weight and probability 0.  Rows with one doc_id draw the
    same number, so repeated rows are taken or left together.  An empty table gives an empty result.
    """
    known = stored(_cells(docs), "op2-cells")
    cells = known.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    raked = rake(cells, budget, temper)
    keys = ["source", "lang", "topic"]
    zero = F.lit(0.0)
    return known.join(raked, keys, "left").select(
        "doc_id", *keys, "n_tokens", F.coalesce("weight", zero).alias("weight"), F.coalesce("probability", zero).alias("probability"),
        (uniform(F.col("doc_id")) < F.coalesce("probability", zero)).alias("sampled"), "error")


def mix(docs: DataFrame, budget: float = BUDGET, temper: float = TEMPER) -> DataFrame:
    """The sampled rows of ``docs``, with their columns."""
    known = _cells(docs)
    raked = stored(rake(known.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")), budget, temper)
                   .select(F.struct(F.col("source").alias("s"), F.col("lang").alias("l"), F.col("topic").alias("t")).alias("_cell_of_mix"), F.col("probability").alias("_p_of_mix")), "op2-raked")
    cell = F.struct(F.coalesce(F.col("source"), F.lit("(none)")).alias("s"), F.coalesce(F.col("lang"), F.lit("(none)")).alias("l"), topic_of(F.col("_form_of_mix")).alias("t"))
    return docs.withColumn("_form_of_mix", form_of(text_of())).withColumn("_cell_of_mix", cell).join(raked, "_cell_of_mix").where(uniform(F.col("doc_id")) < F.col("_p_of_mix")).drop("_form_of_mix", "_cell_of_mix", "_p_of_mix")
