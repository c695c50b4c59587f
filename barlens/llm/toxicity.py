"""Toxicity by gradient-boosted trees over dense features.

The lexicon is learned: word stems (a word, or its first bytes) that labelled toxic
documents hold far more often than clean ones.  Features are the lexicon's densities,
also in the densest stretch and after undoing look-alike spelling, how often a hit stands
near a second-person word, capitals, punctuation and obfuscation rates.  Trees are
grown on histograms for the logistic loss; out-of-fold scores calibrate them by isotonic
regression.  Documents are read on the executors only; the driver sees stem counts of a
bounded candidate list and one short row of numbers per sampled document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.arrays import BYTE_CODES, U64, chunks, prefix_sums, slice_hash, word_bounds
from barlens.llm.frames import batches, map_batches, stored
from barlens.llm.labelled import held_out, training_sample
from barlens.llm.textstats import DIGIT, LETTER, NOT_LETTER, PUNCTUATION, SYMBOL, UPPER, lowered, pool_adjacent, sums

#: Held-out rows: crc32 of the id modulo 5 is 0.
FOLDS, FOLD = 5, 0
#: Bounds of the fit: sampled labelled documents, candidate stems, stems of the lexicon.
TRAIN_ROWS, CANDIDATES, LEXICON = 16_000, 1 << 16, 8_192
THRESHOLD = 0.5
PREFIXES = (4, 5, 6, 7, 8)
NEAR_WORDS, STRETCH = 5, 50
#: Second-person words of the four languages.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos",
                 "usted", "ustedes", "tú", "ti", "tus", "vosotros")
#: Look-alike characters and the letters they stand for.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
UNDO = np.arange(256, dtype=np.uint8)
for _sign, _letter in LOOK_ALIKE.items():
    UNDO[ord(_sign)] = ord(_letter)

FEATURES = ("hits", "density", "densest", "undone_hits", "undone_density", "near_person", "near_density", "person_density", "upper", "upper_words",
            "exclamations", "questions", "punctuation", "symbols", "obfuscated", "stretched", "log_words")


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_bounds(data, offsets, NOT_LETTER)


def stems(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, which words have it) for whole words and for each prefix that is shorter than its word."""
    yield slice_hash(total, starts, ends) ^ U64(1), np.arange(len(starts))
    for n in PREFIXES:
        at = np.flatnonzero(ends - starts >= n)
        yield slice_hash(total, starts[at], starts[at] + n), at


class Members:
    """A set of hashes with a bitmap in front."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.sort(values.astype(U64))
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(self.values & U64((1 << 18) - 1)).astype(np.int64)] = True

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of those hashes that are members, by way of the bitmap."""
        maybe = np.flatnonzero(self.bits[(hashes & U64((1 << 18) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.values):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.values, hashes[maybe]), len(self.values) - 1)
        return maybe[self.values[at] == hashes[maybe]]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.values, hashes)


def marked_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: Members) -> np.ndarray:
    total = prefix_sums(BYTE_CODES[data])
    hit = np.zeros(len(starts), bool)
    for hashes, words in stems(total, starts, ends):
        hit[words[lexicon.among(hashes)]] = True
    return hit


def persons() -> Members:
    out = []
    for w in SECOND_PERSON:
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(slice_hash(prefix_sums(BYTE_CODES[b]), np.array([0]), np.array([len(b)]))[0])
    return Members(np.array(out, U64))


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Members) -> np.ndarray:
    """Matrix of the ``FEATURES``; an empty text has zeros."""
    low = lowered(data)
    starts, ends, first = letter_words(low, offsets)
    words = np.diff(first)
    per_word = np.maximum(words, 1)
    owner = np.repeat(np.arange(len(words)), words)

    def count(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return total[first[1:]] - total[first[:-1]]

    hit = marked_words(low, starts, ends, lexicon)
    hits = count(hit)
    running = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
    at = np.flatnonzero(hit)
    densest = np.zeros(len(words), np.int64)
    np.maximum.at(densest, owner[at], running[np.minimum(at + STRETCH, first[owner[at] + 1])] - running[at])
    person = np.zeros(len(starts), bool)
    person[persons().among(slice_hash(prefix_sums(BYTE_CODES[low]), starts, ends))] = True
    people = np.concatenate(([0], np.cumsum(person, dtype=np.int64)))
    near = np.zeros(len(starts), bool)
    near[at] = people[np.minimum(at + NEAR_WORDS + 1, first[owner[at] + 1])] > people[np.maximum(at - NEAR_WORDS, first[owner[at]])]
    undone = UNDO[low]
    if (undone != low).any():
        u_starts, u_ends, u_first = letter_words(undone, offsets)
        u_total = np.concatenate(([0], np.cumsum(marked_words(undone, u_starts, u_ends, lexicon), dtype=np.int64)))
        undone_hits = np.maximum(u_total[u_first[1:]] - u_total[u_first[:-1]], hits)
    else:
        undone_hits = hits
    capital = np.concatenate(([0], np.cumsum(UPPER[data], dtype=np.int64)))
    shouted = (capital[ends] - capital[starts] == ends - starts) & (ends - starts > 2)
    letter, odd = LETTER[data], DIGIT[data] | SYMBOL[data]
    obfuscated, stretched = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(data) > 2:
        obfuscated[1:-1] = odd[1:-1] & letter[:-2] & letter[2:]
        stretched[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (data[2:] < 128)
    near_hits = count(near)
    letters = np.maximum(sums(letter, offsets), 1)
    return np.stack([
        np.log1p(hits), hits / per_word, densest, np.log1p(undone_hits), undone_hits / per_word, np.log1p(near_hits), near_hits / per_word, count(person) / per_word,
        sums(UPPER[data], offsets) / letters, count(shouted) / per_word, sums(data == 33, offsets) / per_word, sums(data == 63, offsets) / per_word,
        sums(PUNCTUATION[data], offsets) / per_word, sums(SYMBOL[data], offsets) / per_word, sums(obfuscated, offsets) / per_word,
        sums(stretched, offsets) / per_word, np.log1p(words)], axis=1).astype(np.float64)


# --- trees ---------------------------------------------------------------------

TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 80, 3, 0.15, 32, 8, 2.0


@dataclass
class Boosted:
    """Trees of one depth: per inner node a feature and a threshold, per leaf a value."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            out += v[node - (2 ** DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Second-order boosting on histograms; one class only, or no rows, gives a constant."""
    inner = 2 ** DEPTH - 1
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    start = float(np.log(rate / (1 - rate)))
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    edges = [np.unique(np.concatenate((e, [0.0]))) for e in edges]  # nothing against something is always a split
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    raw = np.full(len(y), start)
    for _ in range(TREES if len(set(y.tolist())) > 1 else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            best, cut = 1e-6, None
            if len(at) >= 2 * LEAST:
                whole = g[at].sum() ** 2 / (h[at].sum() + RIDGE)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    size = len(e) + 1
                    gs, hs, ns = (np.cumsum(np.bincount(code[at, j], w, size))[:-1] for w in (g[at], h[at], None))
                    gain = gs ** 2 / (hs + RIDGE) + (g[at].sum() - gs) ** 2 / (h[at].sum() - hs + RIDGE) - whole
                    gain[(ns < LEAST) | (len(at) - ns < LEAST)] = 0
                    if gain.max() > best:
                        best, cut = gain.max(), (j, e[gain.argmax()])
            if cut:
                feature[k], threshold[k] = cut
            node[at] = 2 * k + 1 + (x[at, feature[k]] > threshold[k])
        leaf = RATE * np.bincount(node - inner, g, 2 ** DEPTH) / (np.bincount(node - inner, h, 2 ** DEPTH) + RIDGE)
        raw += leaf[node - inner]
        trees.append((feature, threshold, leaf))
    return Boosted(start, *(np.array([t[i] for t in trees]).reshape(len(trees), width) for i, width in enumerate((inner, inner, inner + 1))))


@dataclass
class ToxicityModel:
    lexicon: Members
    trees: Boosted
    knots: np.ndarray
    values: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.raw(features(data, offsets, self.lexicon)), self.knots, self.values)


def informative(a: np.ndarray, b: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Log-likelihood ratio of a stem in ``a`` of the toxic and ``b`` of the clean documents; 0 where it isn't a toxic sign."""
    def part(k, n):
        q = np.clip(k / max(n, 1), 1e-12, 1 - 1e-12)
        return k * np.log(q) + (n - k) * np.log(1 - q)

    pooled = np.clip((a + b) / max(toxic + clean, 1), 1e-12, 1 - 1e-12)
    joint = (a + b) * np.log(pooled) + (toxic + clean - a - b) * np.log(1 - pooled)
    out = 2 * (part(a, toxic) + part(b, clean) - joint)
    return np.where((a >= 3) & (a >= 1.5 * b), out, 0)


LEAST_INFORMATION = 18.0


def stem_counts(sample: DataFrame, candidates: np.ndarray | None) -> DataFrame:
    """stem, y, half, n: documents that hold a stem; of toxic documents only while no candidates are known."""
    members = None if candidates is None else Members(candidates)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        y, half = np.asarray(batch.column(1)).astype(np.int64), np.asarray(batch.column(2)).astype(np.int64)
        for lo, hi, data, offsets in chunks(batch.column(0)):
            low = lowered(data)
            starts, ends, first = letter_words(low, offsets)
            owner = np.repeat(np.arange(lo, hi), np.diff(first))
            group = y[owner] * 2 + half[owner]
            found_stems, found_docs = [], []
            for hashes, words in stems(prefix_sums(BYTE_CODES[low]), starts, ends):
                at = np.flatnonzero(y[owner[words]] == 1) if members is None else members.among(hashes)
                found_stems.append(hashes[at])
                found_docs.append(owner[words[at]])
            stem, doc = np.concatenate(found_stems), np.concatenate(found_docs)
            order = np.lexsort((stem, doc))
            stem, doc = stem[order], doc[order]
            new = np.concatenate(([True], (stem[1:] != stem[:-1]) | (doc[1:] != doc[:-1])))[: len(stem)]
            stem, doc = stem[new], doc[new]
            group = y[doc] * 2 + half[doc]
            order = np.lexsort((group, stem))
            stem, group = stem[order], group[order]
            start = np.flatnonzero(np.concatenate(([True], (stem[1:] != stem[:-1]) | (group[1:] != group[:-1])))[: len(stem)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(stem[start].view(np.int64)), pa.array((group[start] // 2).astype(np.int32)), pa.array((group[start] % 2).astype(np.int32)),
                 pa.array(np.diff(np.concatenate((start, [len(stem)]))).astype(np.int64))], ["stem", "y", "half", "n"])

    rows = sample if members is not None else sample.where("y = 1")
    return map_batches(rows.select("text", "y", "half"), run, "stem long, y int, half int, n long")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn lexicon, trees and calibration from at most ``rows`` labelled documents outside the held-out fold."""
    sample = stored(training_sample(docs, labels, "toxic", FOLDS, FOLD, rows, ["text"]), "op6-sample")  # read four times
    sizes = {(r["y"], r["half"]): r["n"] for r in sample.groupBy("y", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = stem_counts(sample, None).groupBy("stem").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "stem").limit(CANDIDATES)
    candidates = np.array([r["stem"] for r in first.select("stem").collect()], np.int64).view(U64)
    known = stem_counts(sample, candidates).groupBy("stem", "y", "half").agg(F.sum("n").alias("n")).toPandas()
    members = Members(candidates)
    counts = np.zeros((len(members.values), 2, 2))
    if len(known):
        counts[members.numbers(known["stem"].to_numpy(np.int64).view(U64)), known["y"].to_numpy(), known["half"].to_numpy()] = known["n"]

    def lexicon(halves: list[int]) -> Members:
        a, b = counts[:, 1, halves].sum(1), counts[:, 0, halves].sum(1)
        score = informative(a, b, sum(sizes.get((1, h), 0) for h in halves), sum(sizes.get((0, h), 0) for h in halves))
        best = np.argsort(-score, kind="stable")[:LEXICON]
        return Members(members.values[best[score[best] >= LEAST_INFORMATION]])

    whole, crossed = lexicon([0, 1]), (lexicon([1]), lexicon([0]))  # a document's features never come from a lexicon it helped to learn

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        half = np.asarray(batch.column(2))
        for lo, hi, data, offsets in chunks(batch.column(0)):
            both = [features(data, offsets, x) for x in crossed]
            mine = np.where(half[lo:hi, None] == 0, both[0], both[1])
            yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.list_(pa.float64())), batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)], ["x", "y", "half"])

    got = map_batches(sample.select("text", "y", "half"), run, "x array<double>, y int, half int").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    y, half = got["y"].to_numpy(float), got["half"].to_numpy()
    order = np.lexsort((*x.T, y))  # one fit whatever the order in which rows arrive
    x, y, half = x[order], y[order], half[order]
    trees = boost(x, y)
    outside = np.zeros(len(y))
    for h in (0, 1):
        outside[half == h] = boost(x[half != h], y[half != h]).raw(x[half == h])
    knots, values = pool_adjacent(outside, y) if len(y) else (np.zeros(1), np.full(1, 0.5))
    return ToxicityModel(whole, trees, knots, values)


def scorer(model: ToxicityModel):
    """Column function: the probability that a text is toxic."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        parts = [model.score(data, offsets) for _, _, data, offsets in chunks(text)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null or empty text is scored like any other, from features that are all zero.  Rows repeat
    as in the input; a row without doc_id counts as held out.  Without usable labels every score
    is the same.  Other columns are not read; an empty table gives an empty result.
    """
    batches(docs.sparkSession)
    score = scorer(fit(docs, labels))
    return docs.select(F.col("doc_id"), held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), score(F.col("text")).alias("score")) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def is_toxic(docs: DataFrame, labels: DataFrame) -> Column:
    """Condition over rows of ``docs``."""
    batches(docs.sparkSession)
    return scorer(fit(docs, labels))(F.col("text")) >= THRESHOLD
