"""Substring dedup by sorted suffixes.

The suffixes that start at recurring anchors are range-partitioned by their leading bytes,
with splitters that Spark samples.  A bucket sorts its suffixes, and the reversed texts
before them, by multikey quicksort: by eight bytes at a time, going on only among those
that are still equal.  Neighbours in the two orders give the lengths of common text to
the right and to the left of the anchor, so for every offset the windows of fifty bytes
fall into classes of equal content, with their smallest document.  Splitters part whole
leads, so suffixes with a common lead, which alone can share a window, lie in one bucket;
the comparison across a boundary is that of the leads of the suffixes beside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.arrays import U64, cover, runs
from barlens.llm.frames import map_batches, text_of
from barlens.llm.recurring import Units, keyed, owned_runs, removed_windows

WINDOW, GRAM = 50, 20
BYTES = Units(words=False, window=WINDOW, gram=GRAM)


def padded(data: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int, backwards: bool = False) -> np.ndarray:
    """Matrix of the ``length`` bytes from ``begin`` on (or before it), as 16-bit codes with 0 after the end."""
    out = np.zeros((len(begin), width), np.uint16)
    if not len(data):
        return out
    for k in range(width):
        at = begin - 1 - k if backwards else begin + k
        out[:, k] = np.where(k < length, data[np.clip(at, 0, len(data) - 1)].astype(np.uint16) + 1, 0)
    return out


def multikey_sort(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and how many leading codes each row shares with the one before it in that order.

    Three codes make a key; a step sorts by the next key only the rows that are equal so far.
    """
    n, width = codes.shape
    order, common = np.arange(n), np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)  # rows equal so far, by their place in the order
    tied = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    for k in range(0, width, 4):
        if not len(tied):
            break
        step = min(4, width - k)
        rows = order[tied]
        key = np.zeros(len(rows), U64)
        for j in range(step):
            key = (key << U64(16)) | codes[rows, k + j].astype(U64)
        sub = np.lexsort((key, group[tied]))
        order[tied], key = rows[sub], key[sub]
        same_group = np.concatenate(([False], group[tied][1:] == group[tied][:-1]))
        same = same_group & np.concatenate(([False], key[1:] == key[:-1]))
        differ = np.flatnonzero(same_group & ~same)
        a, b = order[tied[differ]], order[tied[differ] - 1]
        equal = np.zeros(len(differ), np.int64)
        go = np.ones(len(differ), bool)
        for j in range(step):
            go &= codes[a, k + j] == codes[b, k + j]
            equal += go
        common[tied[differ]] = k + equal
        group[tied] = np.maximum.accumulate(np.where(same, 0, tied))
        keep = same.copy()
        keep[:-1] |= same[1:]
        common[tied[same]] = k + step
        tied = tied[keep]
    return order, common


def classes(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """Class of each row: rows whose first ``length`` codes are equal."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate(([0], (common[1:] < length).astype(np.int64)))[: len(order)])
    return out


def suffix_classes(rows: pa.Table, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Windows of the snippets that several documents have, with the smallest of these."""
    column = rows.column("snippet").combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    anchor, lo, hi = (np.asarray(rows.column(c)).astype(np.int64) for c in ("anchor", "lo", "hi"))
    begin = offsets[:-1] + anchor
    right, left = offsets[1:] - begin, anchor
    right_order, right_common = multikey_sort(padded(data, begin, right, window))
    left_order, left_common = multikey_sort(padded(data, begin, left, int(left.max(initial=0)), backwards=True))
    found = []
    for t in range(int(left.max(initial=0)) + 1):  # windows that start t bytes before the anchor
        has = np.flatnonzero((left >= t) & (right >= window - t))
        if not len(has):
            continue
        a, b = classes(right_order, right_common, window - t)[has], classes(left_order, left_common, t)[has]
        key = a * (len(anchor) + 1) + b
        order = np.argsort(key, kind="stable")
        key, has = key[order], has[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        low, high = np.minimum.reduceat(lo[has], first), np.maximum.reduceat(hi[has], first)
        size = np.diff(np.concatenate((first, [len(key)])))
        shared = np.repeat(low < high, size)
        found.append((has[shared], anchor[has[shared]] - t, np.repeat(low, size)[shared]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    snippet, at, owner = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, snippet))
    return owned_runs(owner[order], snippet[order], at[order])


def drop_repeated_strings(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``; with ``keep_text`` also the kept bytes.

    A byte goes if a string of 50 bytes that covers it also starts in a document of smaller
    doc_id, judged on the input.  A null text is empty.  Rows that repeat id and text are alike;
    rows of one id with other texts count as one document, so they take nothing from each other.
    A row without doc_id loses nothing and takes nothing.  Other columns are not read; an empty
    table gives an empty result.
    """
    whole = keyed(docs)
    gone = removed_windows(whole, BYTES, suffix_classes, "op3", by_range=True)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_bytes, n_removed, n_spans, digest, kept = [], [], [], [], []
        for text, starts, counts in zip(batch.column(1), batch.column(2), batch.column(3)):
            raw = (text.as_py() or "").encode()
            left, spans = raw, 0
            if starts.is_valid and len(raw) >= WINDOW:
                lost = cover(np.asarray(starts.values).astype(np.int64), np.asarray(counts.values).astype(np.int64) + WINDOW - 1, len(raw))
                spans = len(runs(lost)[0])
                left = np.frombuffer(raw, np.uint8)[~lost].tobytes()
            n_bytes.append(len(raw))
            n_removed.append(len(raw) - len(left))
            n_spans.append(spans)
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_text, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("fp"))
    joined = rows.join(gone, (rows["doc_id"] == gone["doc"]) & (rows["fp"] == gone["fp"]), "left").select("doc_id", "text", "starts", "counts")
    return map_batches(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
