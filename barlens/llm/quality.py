"""Quality by a factorisation machine.

Inputs are hashed words (log counts, scaled to length one), statistics of the text's form
and the metadata column n_chars.  The score is w0 + w.x + sum over pairs <v_i, v_j> x_i x_j,
computed in linear time as half of the sum over factors of (sum v_if x_i)^2 - sum (v_if x_i)^2.
It is fitted with Adam in mini-batches on a bounded sample of labelled documents, of which
the driver sees sparse counts only, and then scores all texts on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.arrays import U64, chunks, word_bounds, word_hashes
from barlens.llm.frames import batches, map_batches, stored
from barlens.llm.labelled import held_out, training_sample
from barlens.llm.textstats import FORM, form

#: Held-out rows: crc32 of the id modulo 4 is 2.
FOLDS, FOLD = 4, 2
#: Bound of the fit: sampled labelled documents.
TRAIN_ROWS = 8_000
HASHES, RANK = 1 << 11, 8
EPOCHS, BATCH, STEP, DECAY = 12, 128, 0.02, 1e-4
THRESHOLD = 0.7
DENSE = len(FORM) + 3  # and repeated words, n_chars, and how far that is from the text's length
BLOCK = 512


def dense(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, first: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """Form statistics and metadata; an unknown n_chars is taken as the text's own length."""
    size = np.diff(offsets)
    told = np.where(np.isnan(n_chars) | (n_chars < 0), size, n_chars)
    words = np.maximum(np.diff(first), 1)
    again = np.concatenate(([0, 0], np.cumsum(hashes[1:] == hashes[:-1])))[: len(hashes) + 1]
    return np.column_stack([form(data, offsets), (again[first[1:]] - again[first[:-1]]) / words, np.log1p(told), np.log1p(told) - np.log1p(size)])


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the first word of each text."""
    starts, ends, first = word_bounds(data, offsets)
    return word_hashes(data, starts, ends, lower=True), first


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % U64(HASHES)).astype(np.int64)


def bags(slots: np.ndarray, first: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Scaled log counts of texts lo to hi."""
    part, n = slots[first[lo]: first[hi]], hi - lo
    owner = np.repeat(np.arange(n), np.diff(first[lo: hi + 1]))
    x = np.log1p(np.bincount(owner * HASHES + part, minlength=n * HASHES).reshape(n, HASHES).astype(np.float32))
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return np.hstack([words, (np.clip((stats - self.mean) / self.scale, -5, 5) / 4).astype(np.float32)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        along = x @ self.v
        return self.w0 + x @ self.w + 0.5 * ((along ** 2).sum(1) - (x ** 2) @ (self.v ** 2).sum(1))

    def score(self, data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
        hashes, first = hashed_words(data, offsets)
        stats, slots = dense(data, offsets, hashes, first, n_chars), slots_of(hashes)
        out = [self.raw(self.inputs(bags(slots, first, lo, min(lo + BLOCK, len(stats))), stats[lo: lo + BLOCK])) for lo in range(0, len(stats), BLOCK)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -30, 30))) if out else np.zeros(0)


def train(words: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, y: np.ndarray) -> Machine:
    """Adam on the logistic loss; the same fit for the same rows."""
    rng = np.random.default_rng(5)
    size = HASHES + DENSE
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    scale = stats.std(0) if len(y) else np.ones(DENSE)
    m = Machine(float(np.log(rate / (1 - rate))), np.zeros(size, np.float32), rng.normal(0, 0.05, (size, RANK)).astype(np.float32),
                stats.mean(0) if len(y) else np.zeros(DENSE), np.where(scale > 1e-9, scale, 1))
    if len(set(y.tolist())) < 2:
        m.v[:] = 0
        return m
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (m.w, m.v)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in np.array_split(order, max(1, len(y) // BATCH)):
            bag = np.zeros((len(at), HASHES), np.float32)
            for i, k in enumerate(at):
                bag[i, words[k][0]] = words[k][1]
            x = m.inputs(bag, stats[at])
            error = (1 / (1 + np.exp(-np.clip(m.raw(x), -30, 30))) - y[at]).astype(np.float32) / len(at)
            along = x @ m.v
            grads = (x.T @ error + DECAY * m.w, x.T @ (along * error[:, None]) - m.v * ((x ** 2).T @ error)[:, None] + DECAY * m.v)
            step += 1
            for p, g, (a, b) in zip((m.w, m.v), grads, moments):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= STEP * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
            m.w0 -= STEP * float(error.sum())
    return m


def _n_chars(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Learn from at most ``rows`` labelled documents outside the held-out fold."""
    seen = docs.select("doc_id", "text", _n_chars(docs).alias("n_chars"))
    sample = training_sample(seen, labels, "quality", FOLDS, FOLD, rows, ["text", "n_chars"])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_chars = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        for lo, hi, data, offsets in chunks(batch.column(0)):
            hashes, first = hashed_words(data, offsets)
            stats, slots = dense(data, offsets, hashes, first, n_chars[lo:hi]), slots_of(hashes)
            ids, values = [], []
            for a in range(0, hi - lo, BLOCK):
                for row in bags(slots, first, a, min(a + BLOCK, hi - lo)):
                    at = np.flatnonzero(row)
                    ids.append(at.astype(np.int32))
                    values.append(row[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(list(stats), pa.list_(pa.float64())), batch.column(2).slice(lo, hi - lo)],
                ["ids", "weights", "stats", "y"])

    got = stored(map_batches(sample.select("text", "n_chars", "y"), run, "ids array<int>, weights array<float>, stats array<double>, y int"), "op1-sample").toPandas()
    stats = np.array(got["stats"].tolist(), float).reshape(len(got), DENSE)
    y = got["y"].to_numpy(float)
    order = np.lexsort((*stats.T, y))
    words = [(np.asarray(a, np.int64), np.asarray(b, np.float32)) for a, b in zip(got["ids"], got["weights"])]
    return train([words[i] for i in order], stats[order], y[order])


def scorer(model: Machine):
    """Column function of (text, n_chars): the probability of good quality."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def score(text: pa.Array, n_chars: pa.Array) -> pa.Array:
        told = n_chars.to_numpy(zero_copy_only=False).astype(float)
        parts = [model.score(data, offsets, told[lo:hi]) for lo, hi, data, offsets in chunks(text)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null or empty text is scored from statistics that are zero; a null or missing n_chars counts
    as the text's own length.  Rows repeat as in the input; a row without doc_id counts as held
    out.  Without usable labels every score is the same.  Other columns are not read; an empty
    table gives an empty result.
    """
    batches(docs.sparkSession)
    score = scorer(fit(docs, labels))
    return docs.select(F.col("doc_id"), held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), score(F.col("text"), _n_chars(docs)).alias("score")) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
