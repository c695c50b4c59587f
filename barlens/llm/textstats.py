"""Statistics of the form of texts, one number per text, from whole chunks of bytes."""

from __future__ import annotations

import numpy as np

from barlens.llm.arrays import word_bounds

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[ord(c) for c in ".,;:!?'\"()-"]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#$%&*@^~_=+<>{}[]\\/"]] = True
NOT_LETTER = ~LETTER


def sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``marks`` in each text."""
    total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in lower case, in UTF-8 bytes of the same length."""
    out = data.copy()
    out[UPPER[data]] += 32
    if len(data) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[at] += 32
    return out


FORM = ("log_words", "log_bytes", "word_length", "upper", "digits", "punctuation", "symbols", "bars", "exclamations", "marked_words",
        "upper_words", "lines", "line_length", "spaces", "high_bytes")


def form(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Matrix of the ``FORM`` statistics; an empty text has zeros."""
    n = np.diff(offsets)
    starts, ends, first = word_bounds(data, offsets)
    words = np.diff(first)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    marked = np.concatenate(([0], np.cumsum(SYMBOL[last] | (last == 33))))
    capital = np.concatenate(([0], np.cumsum(UPPER[data])))
    shouted = np.concatenate(([0], np.cumsum((capital[ends] - capital[starts]) * 2 > ends - starts))) if len(ends) else np.zeros(1, np.int64)
    lines = sums(data == 10, offsets)
    per_byte, per_word = np.maximum(n, 1), np.maximum(words, 1)
    letters = np.maximum(sums(LETTER[data], offsets), 1)
    return np.stack([
        np.log1p(words), np.log1p(n), n / per_word, sums(UPPER[data], offsets) / letters, sums(DIGIT[data], offsets) / per_byte,
        sums(PUNCTUATION[data], offsets) / per_word, sums(SYMBOL[data], offsets) / per_word, sums(data == 124, offsets) / per_word,
        sums(data == 33, offsets) / per_word, (marked[first[1:]] - marked[first[:-1]]) / per_word,
        (shouted[first[1:]] - shouted[first[:-1]]) / per_word, lines / per_word, np.log1p(n / (lines + 1)),
        sums(data == 32, offsets) / per_byte, sums(data >= 128, offsets) / per_byte], axis=1).astype(np.float64)


def pool_adjacent(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: knots and values for ``np.interp``."""
    order = np.argsort(scores, kind="stable")
    x, first = np.unique(scores[order], return_index=True)
    y = labels[order].astype(float)
    weight = np.diff(np.concatenate((first, [len(y)])))
    value = np.add.reduceat(y, first) / weight
    blocks: list[list[float]] = []  # value, weight, first knot, last knot
    for i, (v, w) in enumerate(zip(value.tolist(), weight.tolist())):
        blocks.append([v, w, i, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, hi = blocks.pop()
            v1, w1, lo, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    knots, values = [], []
    for v, _, lo, hi in blocks:
        for i in dict.fromkeys((int(lo), int(hi))):
            knots.append(x[i])
            values.append(v)
    return np.array(knots), np.array(values)
